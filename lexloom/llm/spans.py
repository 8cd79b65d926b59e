"""Spans of regular-expression matches as native columns. Offsets count code points; ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value, part>> of all leftmost non-overlapping matches; part is the given group. One scan, linear in the text.

    The two code points that the scan marks matches with are free for such use in Unicode; in a text that holds them they count as others.
    """
    marked = F.contains(text, F.lit(T.MARK)) | F.contains(text, F.lit(T.PART))
    found = T.found(F.when(marked, T.unmarked(text)).otherwise(text), pattern, *([group] if group else []))
    value = lambda h, k: F.get(h["parts"], F.lit(k))
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), value(h, 0).alias("value"), value(h, 1 if group else 0).alias("part")))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
