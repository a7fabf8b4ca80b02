"""Strict format arguments: strings in, a validated request out."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

from sparkgrid.diagnostics import Code, RasterError

DEFAULTS = {"band": "1", "representation": "metadata"}
#: Most vertices of a mesh that is made in one piece.
VERTEX_CEILING = 4_194_304
#: Sampling step of each level-of-detail profile.
LOD_STEPS = {"off": 1, "quality": 1, "balanced": 4, "preview": 16}
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


@dataclass
class RasterArguments:
    representation: str = "metadata"
    band: int = 1
    pixel_anchor: str | None = None
    height_scale: float = 1.0
    height_offset: float = 0.0
    nodata: str = "skip"
    fill_value: float | None = None


def _choice(*allowed: str, code: Code = Code.InvalidFormatArgument):
    def read(name: str, text: str) -> str:
        if text not in allowed:
            raise RasterError(code, f"{name} must be one of {', '.join(allowed)}")
        return text

    return read


def _band(name: str, text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text) or not 1 <= int(text) < 1 << 32:
        raise RasterError(Code.InvalidFormatArgument, f"{name} must be a positive integer")
    return int(text)


def _number(name: str, text: str) -> float:
    if not NUMBER.fullmatch(text) or not math.isfinite(float(text)):
        raise RasterError(Code.InvalidFormatArgument, f"{name} must be a finite number")
    return float(text)


def _positive(name: str, text: str) -> float:
    value = _number(name, text)
    if value <= 0:
        raise RasterError(Code.InvalidFormatArgument, f"{name} must be greater than zero")
    return value


#: For each argument the attribute it sets, its reader, and whether it needs a mesh.
ARGUMENTS = {
    "representation": ("representation", _choice("metadata", "mesh", code=Code.UnsupportedFormatArgument), False),
    "band": ("band", _band, False),
    "pixelAnchor": ("pixel_anchor", _choice("area", "point"), False),
    "heightScale": ("height_scale", _positive, True),
    "heightOffset": ("height_offset", _number, True),
    "nodata": ("nodata", _choice("skip", "fill", "keep"), True),
    "fillValue": ("fill_value", _number, True),
}


def parse(values: Mapping[str, str], metadata_only: bool = False) -> RasterArguments:
    """The request of a map of arguments; the first fault, in order of names, raises."""
    out, meshy = RasterArguments(), []
    for name in sorted(values):
        if name not in ARGUMENTS:
            raise RasterError(Code.UnknownFormatArgument, f"unknown argument: {name}")
        attribute, read, mesh = ARGUMENTS[name]
        setattr(out, attribute, read(name, values[name]))
        if mesh:
            meshy.append(name)
    if meshy and out.representation != "mesh":
        raise RasterError(Code.UnsupportedFormatArgument, f"{', '.join(meshy)} need representation=mesh")
    if out.fill_value is not None and out.nodata != "fill":
        raise RasterError(Code.ConflictingFormatArguments, "a fillValue is of use with nodata=fill alone")
    if out.nodata == "fill" and out.fill_value is None:
        raise RasterError(Code.InvalidFormatArgument, "give the fillValue that nodata=fill should put in")
    if metadata_only:
        out.representation = "metadata"
    return out


def resolve_anchor(declared: str | None, argument: str | None) -> tuple[str, str]:
    """Anchor and where it is from: an argument may fill a gap, never override."""
    if declared and argument:
        raise RasterError(Code.ConflictingFormatArguments, "the file states its own anchor, so leave pixelAnchor out")
    if not declared and not argument:
        raise RasterError(Code.MissingGeoreference, "the file states no anchor: choose one by pixelAnchor, area or point")
    return (declared, "file") if declared else (argument, "argument")  # type: ignore[return-value]


def resolve_epsg(declared: int | None, argument: int | None) -> int | None:
    """A CRS code may be supplied where the source has none; another one is a conflict."""
    if declared and argument and declared != argument:
        raise RasterError(Code.ConflictingFormatArguments, "the file states another CRS than epsg does")
    return declared or argument


def check_ceiling(width: int, height: int, ceiling: int = VERTEX_CEILING) -> None:
    if width * height > ceiling:
        raise RasterError(Code.VertexBudgetExceeded, f"a mesh of {width * height} vertices is above the limit of {ceiling}; use tiles or a larger step")


def lod_step(profile: str) -> int:
    if profile not in LOD_STEPS:
        raise RasterError(Code.InvalidFormatArgument, f"lod must be one of {', '.join(LOD_STEPS)}")
    return LOD_STEPS[profile]


def can_read(path: str) -> bool:
    """Whether the name ends as a TIFF's does, in any case."""
    return path.lower().rpartition(".")[2] in ("tif", "tiff") and "." in path


def safe_label(path: str) -> str:
    """The file's name without folders, query or fragment."""
    return re.split(r"[?#]", path, maxsplit=1)[0].replace("\\", "/").rpartition("/")[2] or "raster asset"
