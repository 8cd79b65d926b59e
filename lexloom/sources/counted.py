"""Writes that count what went in and what came out: metrics are observed in a pass that is made anyway, none is made to count."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import patterns
from ..scratch import scratch

Write = Callable[[DataFrame], None]


class Counters:
    """Named counts at places of a plan; they are there once an action on the plan has ended.

    A count is taken where the plan stands when ``at`` is called, so before a filter it sees what the filter drops.
    """

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def at(self, df: DataFrame, **counts: Column) -> DataFrame:
        one = Observation(f"counters-{uuid4().hex}")
        self.seen.append(one)
        return df.observe(one, *[c.alias(n) for n, c in counts.items()])

    def read(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for one in self.seen:
            out |= one.get
        return {k: v or 0 for k, v in out.items()}


def _rate(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def build_training(rows: DataFrame, write: Write, truncate: Callable[[DataFrame], DataFrame], text: str = "text", mask: str = T.MASK) -> dict[str, int]:
    """Truncates rows, drops those whose mask is lost, writes the rest; n_in, n_out, n_skipped, n_truncated.

    truncate changes text and nothing else; the text before is kept beside it until counts are taken.
    """
    counters = Counters()
    cut = truncate(rows.withColumn("_before", F.col(text)))
    kept = F.coalesce(F.contains(F.col(text), F.lit(mask)), F.lit(False))
    cut = counters.at(
        cut.withColumn("_kept", kept), n_in=F.count(F.lit(1)), n_out=F.count_if("_kept"), n_skipped=F.count_if(~F.col("_kept")),
        n_truncated=F.count_if(F.col("_kept") & ~F.col(text).eqNullSafe(F.col("_before"))),
    )
    write(cut.filter("_kept").drop("_before", "_kept"))
    return counters.read()


def extract(docs: DataFrame, lexicon: DataFrame, write: Write, key: Column | None = None, least: int = 1, **options) -> dict[str, int | float]:
    """Matches of docs with their sentence (without the text), written without repeats; n_scanned, n_too_short, n_no_match, n_matched, n_matches, n_duplicates, n_kept, match_rate (matched
    over scanned, in percent).

    docs: with text. Texts shorter than least are too short. key: what makes a match a repeat, the digest of its sentence by default;
    it enters the dedup only once something matched, and of equal ones the first by row and place stays. options: of ``patterns.find_matches``.

    A sentence may be as long as its text, so matches are compared by key and place alone. The first of each key are landed, and only
    the documents that hold one are matched again, for their sentences.
    """
    text = options.get("text", "text")
    counters = Counters()
    words = patterns.lexicon_words(lexicon)
    found = patterns.with_hits(docs, words, **options)
    short = F.coalesce(F.length(text), F.lit(0)) < least
    hits = F.when(short, 0).otherwise(F.size("_hits"))
    found = counters.at(
        found, n_scanned=F.count(F.lit(1)), n_too_short=F.count_if(short), n_no_match=F.count_if(~short & (hits == 0)), n_matched=F.count_if(hits > 0), n_matches=F.sum(hits.cast("bigint")),
    )
    ids = [c for c in docs.columns if c != text]

    def matched(hits: DataFrame) -> DataFrame:
        rows = patterns.exploded(hits, words, docs.columns, **options)
        rows = rows.withColumn("matched_sentence", T.sentence_around(F.col(text), F.col("start"), F.col("end")))
        return rows.withColumn("_key", F.md5(F.col("matched_sentence").cast("binary")) if key is None else key).drop(text)

    # Of a key's matches the least by row stays; the rows behind a key are compared, not gathered.
    spark, path = docs.sparkSession, f"{scratch(docs.sparkSession)}/firsts-{uuid4().hex}"
    place = F.struct(*ids, "ord", "start")
    matched(found.filter(~short)).select("_key", place.alias("_place")).groupBy("_key").agg(F.min("_place").alias("_place")).write.parquet(path)
    least_ = spark.read.parquet(path)
    holding = [F.col(f"_place.{c}").alias(f"_id{i}") for i, c in enumerate(ids)]
    own = [F.col(c).eqNullSafe(F.col(f"_id{i}")) for i, c in enumerate(ids)]
    again = docs.join(least_.select(*holding).distinct(), reduce(and_, own, F.lit(True)), "left_semi") if ids else docs
    again = patterns.with_hits(again.filter(F.length(text) >= least), words, **options)
    chosen = least_.select(F.col("_key").alias("_k"), F.col("_place").alias("_p"))
    rows = matched(again).join(chosen, F.col("_key").eqNullSafe(F.col("_k")) & place.eqNullSafe(F.col("_p")), "left_semi")
    firsts = rows.dropDuplicates(["_key"]).drop("_key")  # rows that repeat all ids may hold the same place
    write(counters.at(firsts, n_kept=F.count(F.lit(1))))
    out = counters.read()
    return out | {"n_duplicates": out["n_matches"] - out["n_kept"], "match_rate": _rate(100 * out["n_matched"], out["n_scanned"])}
