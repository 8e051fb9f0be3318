"""Timestamp text forms (F-8 parse, F-9 format) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text formats.
CSV_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"     # results history: ...000+0000
LOG_STAMP_FORMAT = "yyyyMMddHHmmss"                # log file names
LABEL_FORMAT = "dd MMM yyyy"                       # chart labels (%d %b %Y)
CHART_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSX"   # chart points: ...000Z


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _utc(col) -> Column:
    # TIMESTAMP_NTZ and TIMESTAMP both become an instant read in UTC
    return _c(col).cast("timestamp")


def zoned_text(ts) -> Column:
    """F-9: message form of a UTC instant, e.g. ``2021-06-01T10:00Z[UTC]``.

    Seconds are written only when seconds or fraction are non-zero; the
    fraction uses 3 digits when it is whole milliseconds, else 6.
    """
    t = _utc(ts)
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    secs = F.second(t)
    frac = (F.when(micros == 0, F.lit(""))
            .when(micros % 1000 == 0,
                  F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")))
            .otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))))
    sec_part = F.when((secs == 0) & (micros == 0), F.lit("")).otherwise(
        F.concat(F.lit(":"), F.lpad(secs.cast("string"), 2, "0"), frac))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm"), sec_part, F.lit("Z[UTC]"))


# date, T, time and offset are demanded; a zone may follow
ZONED_PATTERN = (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
                 r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)(\[[^\[\]]+\])?$")


def parse_zoned(text) -> Column:
    """F-8: parse ISO date-time text with optional seconds, fraction (up to 9
    digits, kept to microseconds), an offset or ``Z``, and an optional
    ``[Zone]`` suffix.  Any other text gives null."""
    c = _c(text)
    s = F.regexp_replace(c, r"\[[^\]]*\]$", "")
    s = F.regexp_replace(s, r"T(\d{2}):(\d{2})(?=$|Z|[+-])", "T$1:$2:00")
    return F.when(c.rlike(ZONED_PATTERN), s.try_cast("timestamp"))


def csv_date_text(ts) -> Column:
    """F-9: date as written to the results history (``+0000`` offset)."""
    return F.date_format(_utc(ts), CSV_DATE_FORMAT)


def log_stamp(ts) -> Column:
    """F-9: compact stamp used in log file names."""
    return F.date_format(_utc(ts), LOG_STAMP_FORMAT)


def label_text(ts) -> Column:
    """F-9: day label of the chart."""
    return F.date_format(_utc(ts), LABEL_FORMAT)


def percent_text(x, decimals: int = 0) -> Column:
    """F-9: axis percentage text of a ratio."""
    return F.concat(F.format_number(_c(x) * 100, decimals), F.lit("%"))
