"""Column expressions for strings, hashes, paths and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"

# Fixed value: the characters the log producers' regular expressions treat as white space.
WS = r"[\t-\r    -     　﻿]"

NOT_BLANK = WS.replace("[", "[^", 1)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "")


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def cut(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(tail))).otherwise(c)


def one_line(c: Column) -> Column:
    return cut(strip(F.regexp_replace(c, f"{WS}+", " ")), 200)


def excerpt(c: Column) -> Column:
    return cut(strip(F.regexp_replace(c, f"{WS}+", " ")), 60, "…")


def present(c: Column) -> Column:
    """NULL and '' mean the same: nothing recorded."""
    return F.when(c != "", c)


def sha(c: Column, digits: int = 64) -> Column:
    h = F.sha2(c, 256)
    return h if digits == 64 else F.left(h, F.lit(digits))


def nul_join(*parts: Column) -> Column:
    """Join with NUL; a missing part counts as ''."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(NUL, *filled)


def to_ms(raw: Column) -> Column:
    """Epoch milliseconds of an ISO text, NULL where it cannot be read."""
    ts = F.try_to_timestamp(F.when(raw.rlike(r"^[+-]?\d{4}"), raw))
    return F.unix_millis(ts)


def within(path: Column, base: Column | str) -> Column:
    """The path is the base or lies below it; a sibling sharing the prefix does not."""
    base = F.lit(base) if isinstance(base, str) else base
    trimmed = F.regexp_replace(base, "/+$", "")
    return (path == base) | path.startswith(F.concat(trimmed, F.lit("/")))


def encode_cwd(cwd: Column) -> Column:
    """Directory name a working directory is logged under; lossy."""
    return F.regexp_replace(cwd, "[^a-zA-Z0-9]", "-")


def defang(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("-->"), F.lit("-- >")), F.lit("<!--"), F.lit("<! --"))


def display_time(ms: Column, raw: Column) -> Column:
    """``yyyy/MM/dd EEE HH:mm:ss`` in the session time zone, else the cleaned raw text."""
    cleaned = F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r"[\x00-\x1f\x7f-\x9f]", "")
    return F.coalesce(
        F.date_format(F.timestamp_millis(ms), "yyyy/MM/dd EEE HH:mm:ss"),
        F.when(raw != "", defang(cleaned)),
        F.lit("Unknown"),
    )
