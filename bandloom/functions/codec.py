"""Lossless payload codecs over Arrow batches: zstd, zlib and none, with length checks."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("zstd", "zlib", "none")


def _known(codec: str) -> str:
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}; known: {', '.join(CODECS)}")
    return codec


def pack(raw: bytes, codec: str, level: int) -> bytes:
    if not raw or codec == "none":
        return raw
    if codec == "zlib":
        return zlib.compress(raw, level)
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpack(payload: bytes, raw_length: int, codec: str) -> bytes:
    if not payload or codec == "none":
        raw = payload
    elif codec == "zlib":
        raw = zlib.decompress(payload)
    else:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=raw_length)
    if len(raw) != raw_length:
        raise OSError(f"corrupt record: {len(raw)} bytes instead of {raw_length}")
    return raw


def compress(raw: Column | str, codec: str = "zstd", level: int = 1) -> Column:
    """The packed bytes; empty stays empty."""
    _known(codec)

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else pack(bytes(v), codec, level))

    return F.pandas_udf(run, "binary")(raw)


def decompress(payload: Column | str, raw_length: Column | str, codec: str = "zstd") -> Column:
    """The raw bytes; a record whose length is not raw_length fails the task."""
    _known(codec)

    def run(values: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else unpack(bytes(v), int(n), codec) for v, n in zip(values, lengths, strict=True)])

    return F.pandas_udf(run, "binary")(payload, raw_length)
