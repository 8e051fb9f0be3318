"""Detail codecs: base64 (F-3) and zstd (F-4).

Spark has no zstd SQL function, so compression runs as Arrow-batched pandas
UDFs; base64 stays in the JVM (``spark.sql.chunkBase64String.enabled=false``
keeps it on one line).  Order: compress then encode; decode then decompress.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZSTD_LEVEL = 3


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@F.pandas_udf(T.BinaryType())
def zstd_compress(data: pd.Series) -> pd.Series:
    """F-4: zstd frame of each value (null stays null)."""
    import zstandard

    cctx = zstandard.ZstdCompressor(level=ZSTD_LEVEL, write_content_size=True)
    return data.map(lambda b: None if b is None else cctx.compress(bytes(b)))


_DECODED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def _all_frames(data: bytes) -> bytes:
    """The content of every zstd frame of ``data``, up to its last byte."""
    import zstandard

    out = []
    while data:
        frame = zstandard.ZstdDecompressor().decompressobj()
        out.append(frame.decompress(data))
        if not frame.eof:
            raise ValueError("truncated zstd frame")
        data = frame.unused_data
    return b"".join(out)


@F.pandas_udf(_DECODED)
def zstd_decode(data: pd.Series) -> pd.DataFrame:
    """F-4: ``content`` of all zstd frames of each value; where they can't be
    read to the end, ``content`` is null and ``error`` says why."""
    import zstandard

    rows = []
    for b in data:
        if b is None:
            rows.append((None, None))
            continue
        try:
            if not len(b):
                raise ValueError("empty zstd data")
            rows.append((_all_frames(bytes(b)), None))
        except ValueError as e:
            rows.append((None, str(e)))
        except zstandard.ZstdError:
            rows.append((None, "not zstd data"))
    return pd.DataFrame(rows, columns=["content", "error"], dtype=object)


def zstd_decompress(data) -> Column:
    """F-4: original bytes of zstd data (null where it can't be read)."""
    return zstd_decode(_c(data))["content"]


def b64_encode(data) -> Column:
    """F-3: base64 text of bytes (or of a string's UTF-8 bytes)."""
    return F.base64(_c(data))


def b64_decode(text) -> Column:
    """F-3: bytes of base64 text (null when malformed)."""
    return F.try_to_binary(_c(text), F.lit("base64"))


def encode_detail(data, compression: Column | str, encoding: Column | str) -> Column:
    """Bytes -> detail text: optional zstd, then base64 or plain text."""
    comp = F.lit(compression) if isinstance(compression, str) else compression
    enc = F.lit(encoding) if isinstance(encoding, str) else encoding
    raw = _c(data).cast("binary")
    packed = F.when(comp == "ZSTD", zstd_compress(raw)).otherwise(raw)
    return F.when(enc == "BASE64", b64_encode(packed)).otherwise(packed.cast("string"))


def decoded_detail(text, compression: Column | str, encoding: Column | str) -> Column:
    """Detail text -> struct of ``content`` (base64 or plain, then optional
    zstd) and ``error`` (null unless a layer can't be read)."""
    comp = F.lit(compression) if isinstance(compression, str) else compression
    enc = F.lit(encoding) if isinstance(encoding, str) else encoding
    packed = F.when(enc == "BASE64", b64_decode(text)).otherwise(_c(text).cast("binary"))
    bad = F.when((enc == "BASE64") & _c(text).isNotNull() & packed.isNull(), F.lit("bad base64"))
    plain = F.struct(packed.alias("content"), bad.alias("error"))
    return F.when((comp == "ZSTD") & packed.isNotNull(), zstd_decode(packed)).otherwise(plain)


def decode_detail(text, compression: Column | str, encoding: Column | str) -> Column:
    """Detail text -> bytes (null where they can't be read)."""
    return decoded_detail(text, compression, encoding)["content"]


def byte_slice(data, offset, length) -> Column:
    """A ``(data, offset, length)`` byte slice as binary (0-based offset)."""
    off = F.lit(offset) if isinstance(offset, int) else _c(offset)
    ln = F.lit(length) if isinstance(length, int) else _c(length)
    return F.substr(_c(data).cast("binary"), off + 1, ln)
