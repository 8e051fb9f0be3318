"""Build log details: pack logs into detail records and decode them back to
lines at scale (F-4 with F-3); log file naming for the file scan (A-5)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.functions.codec import decoded_detail, encode_detail
from benchtide.operators.fence import computed_once

# <build id>.<build|benchmark>.<stdout|stderr>.<yyyyMMddHHmmss>.log
LOG_NAME_PATTERN = r"([^/]+)\.(build|benchmark)\.(stdout|stderr)\.(\d{14})\.log$"


def log_detail(data, detail_type: str = "STDOUT_LOG") -> Column:
    """Logs are stored zstd-compressed and base64-encoded; exception
    messages are stored plain."""
    if detail_type == "EXCEPTION_MESSAGE":
        comp, enc = "NONE", "NONE"
    else:
        comp, enc = "ZSTD", "BASE64"
    return F.struct(F.lit(detail_type).alias("type"), F.lit(comp).alias("detailCompression"),
                    F.lit(enc).alias("detailEncoding"),
                    encode_detail(data, comp, enc).alias("detail"))


def decode_details(df: DataFrame, details: str = "buildDetails") -> DataFrame:
    """One row per detail with its decoded bytes (``content``), its position,
    and ``error`` (why the content can't be read, else null)."""
    exploded = df.select("*", F.posexplode_outer(details).alias("detail_no", "_d")).drop(details)
    return exploded.withColumn(
        "_c", decoded_detail(F.col("_d.detail"), F.col("_d.detailCompression"), F.col("_d.detailEncoding"))
    ).withColumns({"content": F.col("_c.content"), "type": F.col("_d.type"), "error": F.col("_c.error")}
                  ).drop("_d", "_c")


def split_details(df: DataFrame, details: str = "buildDetails", queue: str = "build-details"):
    """``(good, dead)``: decoded details, and those that can't be read with
    the queue name, the stored text and the reason (B-4)."""
    exploded = df.select("*", F.posexplode_outer(details).alias("detail_no", "_d")).drop(details)
    decoded = computed_once(exploded.withColumn(
        "_c", decoded_detail(F.col("_d.detail"), F.col("_d.detailCompression"), F.col("_d.detailEncoding"))), ["_c"])
    good = decoded.where(F.col("_c.error").isNull()).withColumns(
        {"content": F.col("_c.content"), "type": F.col("_d.type")}).drop("_d", "_c")
    dead = decoded.where(F.col("_c.error").isNotNull()).select(
        F.lit(queue).alias("queue"), F.col("_d.detail").alias("content"), F.col("_c.error").alias("reason"))
    return good, dead


def log_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """Split decoded log bytes (UTF-8) into numbered lines (1-based)."""
    text = F.col(content).cast("string")
    return df.select("*", F.posexplode(F.split(text, "\n", -1)).alias("_pos", "line")).select(
        *[c for c in df.columns if c != content], (F.col("_pos") + 1).alias("line_no"), "line")


# compressed bytes read at a time: a zstd block of 4 bytes may hold 128 KiB, so
# a piece gives at most 32 MiB
_PIECE = 1024
_LINES, _BYTES = 8192, 4 << 20


def _pieces(text: bytes | memoryview, compression: str, encoding: str):
    """The decoded bytes of a detail, piece by piece."""
    import binascii

    import zstandard

    step = _PIECE * 4
    if encoding == "BASE64":
        packed = (binascii.a2b_base64(text[i:i + step], strict_mode=True) for i in range(0, len(text), step))
    else:
        packed = (bytes(text[i:i + step]) for i in range(0, len(text), step))
    if compression != "ZSTD":
        yield from packed
        return
    frame, read = None, False
    for piece in packed:
        while piece:
            read = True
            frame = frame or zstandard.ZstdDecompressor().decompressobj()
            for lo in range(0, len(piece), _PIECE):
                yield frame.decompress(piece[lo:lo + _PIECE])
                if frame.eof:
                    piece, frame = frame.unused_data + piece[lo + _PIECE:], None
                    break
            else:
                piece = b""
    if not read:
        raise ValueError("empty zstd data")
    if frame is not None:
        raise ValueError("truncated zstd frame")


def _error(text, compression, encoding) -> str | None:
    """Why a detail can't be read to its end, found before any line is given."""
    import binascii

    import zstandard

    try:
        for _ in _pieces(text, compression, encoding):
            pass
    except binascii.Error:
        return "bad base64"
    except zstandard.ZstdError:
        return "not zstd data"
    except ValueError as e:
        return str(e)
    return None


def _lines(pieces):
    """Lists of whole lines, of a bounded number and size."""
    rest: list[bytes] = []      # the beginning of a line that goes on
    held, size = [], 0
    for piece in pieces:
        first, *more = piece.split(b"\n")
        rest.append(first)
        for line in more:
            held.append(b"".join(rest))
            size += len(held[-1])
            rest = [line]
            if len(held) >= _LINES or size >= _BYTES:
                yield held
                held, size = [], 0
    yield [*held, b"".join(rest)]


def _detail_lines(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            detail = batch.column(1).slice(i, 1)[0]
            kind, compression, encoding, text = (detail[k] for k in ("type", "detailCompression", "detailEncoding", "detail"))
            number = 0
            data = text.as_buffer() if text.is_valid else None
            error = _error(memoryview(data), compression.as_py(), encoding.as_py()) if data is not None else None

            def rows(numbers, lines, why):
                n = len(numbers)
                here = pa.array([i] * n, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(here), batch.column(2).take(here), pa.array([kind.as_py()] * n, pa.string()),
                     pa.array(numbers, pa.int64()), pa.array(lines, pa.binary()), pa.array([why] * n, pa.string())],
                    ["row", "detail_no", "type", "line_no", "line", "error"])

            if error is not None:
                yield rows([None], [None], error)
            elif data is not None:
                for lines in _lines(_pieces(memoryview(data), compression.as_py(), encoding.as_py())):
                    yield rows(range(number + 1, number + len(lines) + 1), lines, None)
                    number += len(lines)


def detail_lines(df: DataFrame, details: str = "buildDetails") -> DataFrame:
    """The numbered lines of every detail, as ``log_lines`` of
    ``decode_details`` gives them, for logs larger than a cell: a detail is
    decoded and decompressed piece by piece and its lines go out in batches of
    bounded size, so a task's memory does not grow with the log.  A detail that
    can't be read gives one row with ``error``, and none of its lines."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != details]).alias("row"),
                     F.posexplode(details).alias("detail_no", "detail")).select("row", "detail", "detail_no")
    schema = T.StructType([rows.schema["row"], T.StructField("detail_no", T.IntegerType()),
                           T.StructField("type", T.StringType()), T.StructField("line_no", T.LongType()),
                           T.StructField("line", T.BinaryType()), T.StructField("error", T.StringType())])
    out = rows.mapInArrow(_detail_lines, schema)
    return out.select("row.*", "detail_no", "type", "line_no", F.col("line").cast("string").alias("line"), "error")


def parse_log_name(path) -> dict[str, Column]:
    """A-5: build id, phase, stream and start stamp from a log file path; all
    null where the name isn't of that form."""
    p = F.col(path) if isinstance(path, str) else path

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(p, LOG_NAME_PATTERN, i), F.lit(""))

    return {"build_id": part(1), "phase": part(2), "stream": part(3),
            "started": F.try_to_timestamp(part(4), F.lit("yyyyMMddHHmmss"))}
