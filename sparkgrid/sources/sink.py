"""Writing rasters: pixels to GeoTIFF images, and images to files in a shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = "name string, image binary"


def images(pixels: DataFrame, width: int, encode: Callable[[str, np.ndarray], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """(name, image) of the files that ``encode`` makes of each raster's samples.

    ``pixels`` holds raster, j, i and a column for each band; a raster is handled
    in one task, so it should fit there: cut larger ones by lines before.  Columns
    after i become the last axis of an array (line, column, band) of doubles;
    places without a row are 0.
    """
    bands = [c for c in pixels.columns if c not in ("raster", "i", "j")]

    def run(table: pa.Table) -> pa.Table:
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        grid = np.zeros((int(j.max()) + 1, width, len(bands)))
        for k, b in enumerate(bands):
            grid[j, i, k] = table.column(b).to_numpy()
        found = list(encode(table.column("raster")[0].as_py(), grid))
        return pa.table({"name": pa.array([n for n, _ in found], pa.string()), "image": pa.array([x for _, x in found], pa.binary())})

    return pixels.groupBy("raster").applyInArrow(run, IMAGES)


def write_files(table: DataFrame, folder: str) -> None:
    """Write (name, image) rows as files of a folder, a URI that all executors see.

    A file is written beside its name and then moved there, so a task that is
    run again leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
        store, root = pafs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, image in zip(batch.column("name").to_pylist(), batch.column("image").to_pylist(), strict=True):
                draft = f"{root}/.{name}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(draft) as out:
                    out.write(image)
                store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    table.select("name", "image").mapInArrow(run, "files long").agg(F.sum("files")).collect()
