import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkgrid.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 2, 50_000, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            if n > 10:
                ids[3] = 0xFFFFFFFF
            image = tokenfile.pack(ids)
            assert (tokenfile.unpack(image) == ids).all()
            assert (tokenfile.unpack(image, 1, 3) == ids[128:384]).all()
    low = np.arange(1000, 1128, dtype=np.uint32)
    low[5] = 1 << 30  # an outlier costs an exception, not width
    assert len(tokenfile.pack(low)) < 200
    with pytest.raises(ValueError, match="segment"):
        tokenfile.unpack(b"no")


def test_encoder_equals_the_library():
    rng = random.Random(3)
    parts = ["a", "B", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "Ü", "ß", "×", " ", "€", "日本", "<|endoftext|>", "<", "|", ",", "...", "-", "_", "\x00", "the", "²"]
    encoder, library = tokenfile.encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.cuts
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(40)]
        for mine, theirs in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert mine.tolist() == theirs.ids


def brute(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 50)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta.", "It's", "\n"]) for _ in range(rng.randrange(40)))) for k in rng.sample(range(10**6), 80)] + [(-5, None), (3, "")]
    got = tokenfile.encode_documents(documents(rows).repartition(5), PATH)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == brute(rows)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumns({"shard": F.lit("s"), "start": F.lit("x"), "image": F.lit("i")})
    rows = [tuple(r) for r in tokenfile.encode_documents(docs, PATH).collect()]
    assert len(rows) == len(odd_rows)
    spans = sorted((r[1], r[1] + r[2]) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert [r[0] for r in sorted(rows, key=lambda r: r[1])] == [None, None, 1, 2, 3, 4, 4, 4, 7, 8, 9]
    assert tokenfile.encode_documents(docs.limit(0), PATH).count() == 0
