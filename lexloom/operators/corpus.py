"""Relational operators on corpora: reason cascades, first-wins deduplication, unions by priority, keyed joins, count tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import patterns

PASSED = "passed"


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """df with the name of the first rule that holds, or ``passed``. A null condition doesn't hold."""
    reason = F.lit(PASSED)
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return df.withColumn(out, reason)


def crawl_rules(text: Column, score: Column | None = None, least_score: float = 0.8, shortest: int = 100, longest: int = 100_000, triggers: tuple[str, ...] = patterns.TRIGGERS, length_first: bool = False) -> list[tuple[str, Column]]:
    """Language score, length, trigger; or length before language, as the archived cascade has it. Missing scores count as 0."""
    language = [("low_language_score", F.coalesce(score, F.lit(0.0)) < least_score)] if score is not None else []
    length = [("too_short", F.length(text) < shortest), ("too_long", F.length(text) > longest)]
    trigger = [("no_trigger", ~patterns.has_trigger(text, triggers))] if triggers else []
    return (length + language if length_first else language + length) + trigger


def reasons(df: DataFrame, rules: list[tuple[str, Column]], *by: str) -> DataFrame:
    return with_reason(df, rules).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def first_by(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are a key. Each task first takes the least of its own rows, so a key may be hot."""
    return _extreme(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    return _extreme(df, keys, order, F.max_by)


def _extreme(df: DataFrame, keys: list[str | Column], order: list[str | Column], pick) -> DataFrame:
    columns = [F.col(c) if isinstance(c, str) else c for c in keys]
    rows = df.select(*[c.alias(f"_key{i}") for i, c in enumerate(columns)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]).alias("_order"))
    return rows.groupBy(*[f"_key{i}" for i in range(len(columns))]).agg(pick("_row", "_order").alias("_row")).select("_row.*")


def unify(sources: list[DataFrame], order: str, sentence: str = "matched_sentence", drop: tuple[str, ...] = (), each: int | None = None) -> DataFrame:
    """Union of sources, the first one first in priority: of rows with one sentence (case and outer blanks apart) the first stays.

    each: at most that many rows of each source, by order.
    """
    tagged = []
    for i, s in enumerate(sources):
        s = s.drop(*drop)
        if each is not None:
            s = s.orderBy(order).limit(each)
        tagged.append(s.withColumn("_prio", F.lit(i)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_by(both, [T.dedup_key(F.col(sentence))], ["_prio", order]).drop("_prio")


def promoted(df: DataFrame, variant: str, base: str = "text", kept: str | None = None) -> DataFrame:
    """df with base replaced by variant where that isn't empty; the old base as kept, if named."""
    out = df.withColumn(kept, F.col(base)) if kept else df
    return out.withColumn(base, T.first_non_empty(F.col(variant), F.col(base))).drop(variant)


def in_both(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that both have."""
    return a.select(*keys).intersect(b.select(*keys))


def only_in(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of a that b hasn't got."""
    return a.select(*keys).subtract(b.select(*keys))


def thresholded(df: DataFrame, score: str, least: int = 3) -> DataFrame:
    """Null scores fail."""
    return df.filter(F.col(score).isNotNull() & (F.col(score) >= least))


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in done: what is left to do after a resume."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def restricted(test: DataFrame, train: DataFrame, label: str, key: str) -> DataFrame:
    """Test rows whose label occurs in train, without those whose key does."""
    return test.join(train.select(label).distinct(), label, "left_semi").join(train.select(key).distinct(), key, "left_anti")


def novel(hits: DataFrame, known: DataFrame, keys: list[str], out: str = "is_novel") -> DataFrame:
    """hits with whether known lacks their keys."""
    seen = known.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return hits.join(seen, keys, "left").withColumn(out, F.col("_seen").isNull()).drop("_seen")


def mapped_distinct(df: DataFrame, column: str, translate, out: str) -> DataFrame:
    """df with out, computed once for each distinct value by translate(DataFrame with column) -> DataFrame with column and out."""
    return df.join(translate(df.select(column).distinct()), column, "left")


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def exploded_counts(df: DataFrame, array: str, out: str = "value") -> DataFrame:
    return df.select(F.explode(array).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def counts_by_each(df: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, key, n: counts by each dimension and in all (dimension ``all``), in one pass of grouping sets."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(dimensions)) - 1
    name, key = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        own = F.col("_g") == (full & ~(1 << (len(dimensions) - 1 - i)))
        name, key = F.when(own, d).otherwise(name), F.when(own, F.col(d).cast("string")).otherwise(key)
    return grouped.select(name.alias("dimension"), key.alias("key"), "n")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row with a column for each of values, zeros filled in."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def rate(df: DataFrame, condition: Column, *by: str, out: str = "rate") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(condition.cast("int")).alias(out))


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, max, avg and the element in the middle (the upper one of two) of value. Windows run over the counts of a group's values."""
    counts_ = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    ranked = counts_.withColumn("_i", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    middle = F.min(F.when(F.col("_i") >= F.floor(F.col("_n") / 2) + 1, F.col(value)))
    return ranked.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), middle.alias("median"))


def rounded_means(df: DataFrame, *values: str) -> DataFrame:
    """One row: the mean of each value, rounded half to even."""
    return df.agg(*[F.bround(F.avg(v)).alias(v) for v in values])


def light_captions(df: DataFrame, text: str = "text", seed: str = "seed_word") -> tuple[DataFrame, DataFrame]:
    """(df with text_light and text_original, one row of counts: total, had_speaker_change, had_leading_fragment, avg_chars_before, avg_chars_after)."""
    out = df.withColumn("text_light", T.light_caption(F.col(text), F.col(seed))).withColumn("text_original", F.col(text))
    first = T.strip(F.col("text_original"))
    stats = out.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.contains("text_original", F.lit(">>"))).alias("had_speaker_change"), F.count_if((first != "") & ~first.rlike(r"^\p{Lu}")).alias("had_leading_fragment"),
        F.bround(F.avg(F.length("text_original"))).alias("avg_chars_before"), F.bround(F.avg(F.length("text_light"))).alias("avg_chars_after"),
    )
    return out, stats


def language_counts(df: DataFrame, text: str, *by: str, mask: str = T.MASK) -> DataFrame:
    """n and several (rows with more than one mask) by groups."""
    masks = F.regexp_count(text, F.lit(rf"\Q{mask}\E"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(masks > 1).alias("several"))


def in_order(results: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """results joined to items by key, in the order of items; items without a result go. Columns of both that clash are results'."""
    extra = [c for c in items.columns if c not in results.columns or c == key]
    return results.join(items.select(*extra), key).orderBy(order)


#: Ranges that a pass of ``ranked_values`` cuts an interval into.
RANGES = 1024


def ranked_values(df: DataFrame, value: str, ranks: Callable[[int], list[int]]) -> tuple[int, dict[int, float]]:
    """The number of rows with a value, and the values at the ranks (from 0) that ranks(number) asks for, exactly.

    Each pass counts the rows of every open interval in RANGES ranges and goes on in the one that holds the rank, so what is aggregated and
    seen by the driver is bounded by the ranks, not by the values. An interval ends as the least and greatest value of its range are equal.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_ = {r: (low, high, r) for r in set(ranks(n))} if n else {}  # rank -> interval, and the rank within it
    while open_:
        found |= {r: a for r, (a, b, _) in open_.items() if a == b}
        open_ = {r: x for r, x in open_.items() if x[0] != x[1]}
        if not open_:
            break
        intervals = sorted({(a, b) for a, b, _ in open_.values()})
        of = at = F.lit(None)
        for i, (a, b) in enumerate(intervals):  # disjoint
            inside = F.col("v").between(a, b)
            part = F.floor(F.coalesce(F.try_divide(F.col("v") / 2 - a / 2, F.lit(b / 2 - a / 2)), F.lit(0.0)) * RANGES)
            # The ends are ranges of their own, so an interval becomes smaller in every pass, however its values lie.
            of, at = F.when(inside, i).otherwise(of), F.when(F.col("v") == a, -1).when(F.col("v") == b, RANGES).when(inside, F.least(part, F.lit(RANGES - 1))).otherwise(at)
        counted = rows.select("v", of.cast("int").alias("i"), at.cast("int").alias("at")).filter("i IS NOT NULL").groupBy("i", "at").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        ranges: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["i"], r["at"])):  # at most RANGES rows for each interval
            ranges.setdefault(r["i"], []).append(r)
        for r, (a, b, k) in list(open_.items()):
            for x in ranges[intervals.index((a, b))]:
                if k < x["c"]:
                    open_[r] = (x["a"], x["b"], k)
                    break
                k -= x["c"]
    return n, found


def linear_percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Percentiles of value, between two rows by linear interpolation; see ``ranked_values``."""
    place = lambda n, p: (n - 1) * p
    n, at = ranked_values(df, value, lambda n: [int(x) for p in shares for x in (math.floor(place(n, p)), math.ceil(place(n, p)))])
    if not n:
        return [None] * len(shares)
    return [at[math.floor(x)] + (x - math.floor(x)) * (at[math.ceil(x)] - at[math.floor(x)]) for x in (place(n, p) for p in shares)]


def length_profile(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """One row: 5th, 50th and 95th percentile (linear) of value, and how many reach each threshold."""
    at = linear_percentiles(df, value, [0.05, 0.5, 0.95])
    return df.agg(*[F.lit(x).cast("double").alias(n) for n, x in zip(("p5", "p50", "p95"), at, strict=True)], *[F.count_if(F.col(value) >= t).alias(f"n_{i}") for i, t in enumerate(thresholds)])


def hit_profile(hits: DataFrame, *post: str) -> DataFrame:
    """One row over posts: most, median and mean number of hits, and how many posts have a single one or several."""
    n, posts = F.col("n"), counts(hits, *post)
    sizes = posts.groupBy("n").agg(F.count(F.lit(1)).alias("posts"))
    (median,) = linear_percentiles(posts, "n", [0.5])
    per = lambda c: F.coalesce(F.sum(F.when(c, F.col("posts"))), F.lit(0))
    return sizes.agg(F.max(n).alias("most"), F.lit(median).cast("double").alias("median"), (F.sum(n * F.col("posts")) / F.sum("posts")).alias("mean"), per(n == 1).alias("single"), per(n >= 2).alias("several"))


def capped(df: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order. Each task first keeps the first n of its own, so a key may be hot."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def video_plan(hits: DataFrame, videos: DataFrame, keep: Column, limit: int, query: str = "query", video: str = "video_id", channel: str = "channel_name", order: str = "place") -> tuple[DataFrame, DataFrame]:
    """(videos to fetch, rows by channel): of each query's hits the distinct videos in order, at most twice limit, those that keep holds for.

    videos has one row a video, with what keep reads and channel. A video that several queries find counts for each of them.
    """
    distinct = hits.groupBy(query, video).agg(F.min(order).alias(order))
    chosen = capped(distinct, [query], [order, video], 2 * limit).join(videos, video).filter(keep)
    return chosen, chosen.groupBy(channel).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(query).alias("queries"))


def neighbours(df: DataFrame, group: list[str], order: str, value: str, n: int = 2) -> DataFrame:
    """df with arrays before and after: value in up to n rows on either side within group."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-n, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, n)))


def islands(df: DataFrame, group: list[str], order: str, barrier: Column, anchor: Column) -> DataFrame:
    """The rows around each group's first anchor up to the nearest barriers on either side."""
    w = Window.partitionBy(*group)
    marked = df.withColumn("_at", F.min(F.when(anchor, F.col(order))).over(w)).withColumn("_b", F.when(barrier, F.col(order)))
    low = F.max(F.when(F.col("_b") < F.col("_at"), F.col("_b"))).over(w)
    high = F.min(F.when(F.col("_b") > F.col("_at"), F.col("_b"))).over(w)
    inside = marked.withColumn("_low", low).withColumn("_high", high).filter(F.col("_at").isNotNull() & (F.col("_low").isNull() | (F.col(order) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(order) < F.col("_high"))))
    return inside.drop("_at", "_b", "_low", "_high")


def ordered(df: DataFrame, *orders: tuple[str, list]) -> DataFrame:
    """Rows by the place of each column's value in its list; other values follow in their own order."""
    keys: list[Column] = []
    for column, values in orders:
        place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
        keys += [F.when(place > 0, place).otherwise(len(values) + 1), F.col(column)]
    return df.orderBy(*keys)


def repeats_mean(df: DataFrame, *by: str) -> DataFrame:
    """The mean of each numeric column over repeats of an experiment."""
    numbers = [f.name for f in df.schema if f.name not in by and f.dataType.typeName() in ("double", "float", "integer", "long")]
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numbers])
