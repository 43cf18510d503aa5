"""Lists of [start, end) ranges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import as_col

RANGE = "array<struct<start:int,end:int>>"


def _pair(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _merged(sorted_ranges: Column, gap: int) -> Column:
    """Ranges, sorted, joined where at most ``gap`` lies between them."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_pair(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when(F.size(done) == 0, F.array(_pair(x["start"], x["end"]))).when(x["start"] <= last["end"] + gap, joined).otherwise(F.concat(done, F.array(_pair(x["start"], x["end"]))))

    return F.aggregate(sorted_ranges, F.array().cast(RANGE), step)


def sanitize_ranges(ranges: Column | str, length: Column | str) -> Column:
    """Reversed ranges turned round, clipped to [0, length], empty ones dropped, overlapping or touching ones merged."""
    n = as_col(length)
    turned = F.transform(as_col(ranges), lambda r: _pair(F.least(r["start"], r["end"]), F.greatest(r["start"], r["end"])))
    clip = lambda x: F.greatest(F.lit(0), F.least(n, x))
    # a range without both ends is no range
    whole = F.filter(turned, lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    clipped = F.filter(F.transform(whole, lambda r: _pair(clip(r["start"]), clip(r["end"]))), lambda r: r["end"] > r["start"])
    return F.coalesce(_merged(F.array_sort(clipped), 0), F.array().cast(RANGE))


def merge_ranges(ranges: Column | str, gap: int = 2) -> Column:
    """Inclusive ranges joined where they overlap or at most ``gap`` lies between end and start."""
    return F.coalesce(_merged(F.array_sort(as_col(ranges)), gap), F.array().cast(RANGE))


def ranges_text(ranges: Column | str) -> Column:
    """`0-5|8-9`, for flat output."""
    return F.array_join(F.transform(as_col(ranges), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), "|")
