"""Scores of predictions, rankings, label sets and raters. Integer sufficient statistics come first, one division last."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def reciprocal_rank(predictions: Column, gold: Column) -> Column:
    at = F.array_position(predictions, gold)
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def hit_at(predictions: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(predictions, 1, k), gold), F.lit(False)).cast("int")


def ranking(df: DataFrame, predictions: str, gold: str, *by: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """n, acc_at_k for each k, and mrr, in all or by groups. Arrays to group by are joined by commas; missing groups are ``unknown``."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    for c in by:
        df = df.withColumn(c, F.coalesce(T.non_empty(F.array_join(c, ",") if kinds[c] == "array" else F.col(c).cast("string")), F.lit("unknown")))
    p, g = F.col(predictions), F.col(gold)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(hit_at(p, g, k)).alias(f"acc_at_{k}") for k in ks], F.avg(reciprocal_rank(p, g)).alias("mrr"))


def ranking_breakdowns(df: DataFrame, predictions: str, gold: str, *dimensions: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """dimension, key, n, acc_at_k, mrr: over all rows (dimension ``all``) and by each dimension, in one pass of grouping sets."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    p, g = F.col(predictions), F.col(gold)
    named = [F.coalesce(T.non_empty(F.array_join(c, ",") if kinds[c] == "array" else F.col(c).cast("string")), F.lit("unknown")).alias(c) for c in dimensions]
    rows = df.select(*named, *[hit_at(p, g, k).alias(f"_hit{k}") for k in ks], reciprocal_rank(p, g).alias("_rr"))
    sets = [[F.col(d)] for d in dimensions] + [[]]
    sums = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_hit{k}").alias(f"acc_at_{k}") for k in ks], F.avg("_rr").alias("mrr"), F.grouping_id().alias("_g"))
    name, key, full = F.lit("all"), F.lit(None).cast("string"), (1 << len(dimensions)) - 1
    for i, d in enumerate(dimensions):
        own = F.col("_g") == (full & ~(1 << (len(dimensions) - 1 - i)))
        name, key = F.when(own, d).otherwise(name), F.when(own, F.col(d)).otherwise(key)
    return sums.select(name.alias("dimension"), key.alias("key"), "n", *[f"acc_at_{k}" for k in ks], "mrr")


def predicted(df: DataFrame, completions: str, k: int = 5, out: str = "predictions") -> DataFrame:
    """df with the first k distinct normal forms of ranked completions, filled up with empty strings."""
    return df.withColumn(out, padded(top_completions(F.col(completions), k), k))


def distinct_predictions(predictions: Column, k: int) -> Column:
    """The first k distinct normal forms, in order, without empty ones."""
    return F.slice(F.filter(F.array_distinct(F.transform(predictions, lambda p: T.normalize_prediction(p))), lambda p: p != ""), 1, k)


def top_completions(completions: Column, k: int) -> Column:
    """completions: array<struct<text, score>>. The first k distinct normal forms by falling score."""
    ordered = F.array_sort(completions, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    return distinct_predictions(F.transform(ordered, lambda c: c["text"]), k)


def holds_label(output: Column, label: Column) -> Column:
    """Whether the label's words stand side by side in the output; both in normal form (see ``normalize_prediction``), cut at white space."""
    spaced = lambda x: F.concat(F.lit(" "), F.regexp_replace(T.normalize_prediction(x), r"(?U)\s+", " "), F.lit(" "))
    return F.contains(spaced(output), spaced(label)) & (F.length(spaced(label)) > 2)


def set_scores(df: DataFrame, outputs: str, labels: str, *by: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """set_acc_at_k: an output among the first k holds all labels; coverage_at_k: the largest share of labels one of them holds."""
    share = lambda o: F.size(F.filter(labels, lambda g: holds_label(o, g))) / F.greatest(F.size(labels), F.lit(1))
    scored = df.withColumn("_share", F.transform(outputs, share))
    best = [F.coalesce(F.array_max(F.slice("_share", 1, k)), F.lit(0.0)) for k in ks]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg((b >= 1.0).cast("int")).alias(f"set_acc_at_{k}") for k, b in zip(ks, best, strict=True)], *[F.avg(b).alias(f"coverage_at_{k}") for k, b in zip(ks, best, strict=True)])


def confusion(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """A row for each value of a, with a count for each of b; all values are there."""
    rows = df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(f"b_{v}") for v in values])
    full = df.sparkSession.createDataFrame([(v,) for v in values], f"{a} {df.schema[a].dataType.simpleString()}")
    return F.broadcast(full).join(rows, a, "left").select(a, *[F.coalesce(f"b_{v}", F.lit(0)).alias(f"b_{v}") for v in values])


def kappa(df: DataFrame, a: str, b: str, weights: str = "none") -> DataFrame:
    """n, agreement and Cohen's kappa of two integer raters; weights none or quadratic. Rows with a null are left out.

    From the counts of pairs alone: the observed and the expected disagreement, both as sums of integers.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    cost = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) if weights == "quadratic" else (F.col("a") != F.col("b")).cast("int")
    observed = pairs.agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("a") == F.col("b")).cast("int")).alias("same"), F.sum(F.col("c") * cost).alias("seen"))
    one, two = pairs.groupBy("a").agg(F.sum("c").alias("ca")), pairs.groupBy("b").agg(F.sum("c").alias("cb"))
    expected = one.join(F.broadcast(two)).agg(F.sum(F.col("ca") * F.col("cb") * cost).alias("chance"))  # a row per rating on each side
    return observed.join(F.broadcast(expected)).select("n", (F.col("same") / F.col("n")).alias("agreement"), (1 - F.col("seen") * F.col("n") / F.col("chance")).alias("kappa"))


#: Ranges that values are cut into for ranks.
RANGES = 256


def _value_ranks(sizes: DataFrame, out: str) -> DataFrame:
    """_v and its rank, ties at their mean, of counts by value (_v, _c).

    Values are cut into ranges by quantiles; what lies before a range is a number of the driver's, of RANGES at most, and a window ranks the
    values of one range only.
    """
    cuts = sorted(set(sizes.select(F.percentile_approx("_v", [i / RANGES for i in range(RANGES)], 10 * RANGES)).first()[0] or []))
    kind = sizes.schema["_v"].dataType
    at = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]).cast(f"array<{kind.simpleString()}>"), lambda c: c <= F.col("_v")))
    ranged = sizes.withColumn("_r", at)
    heads, total = {}, 0
    for r in sorted(ranged.groupBy("_r").agg(F.sum("_c").alias("h")).collect()):  # at most RANGES + 1 rows
        heads[r["_r"]], total = total, total + r["h"]
    head = F.get(F.array(*[F.lit(heads.get(i, 0)).cast("bigint") for i in range(len(cuts) + 1)]), F.col("_r"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.select("_v", (head + before + (F.col("_c") + 1) / 2).alias(out))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the rank of a number, ties at their mean. Rows without it go.

    Ranks come from counts by value, and values are cut into ranges, so neither equal values nor all of them meet in one task's window.
    """
    sizes = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(_value_ranks(sizes, out), F.col(value) == F.col("_v")).drop("_v")


def _tail_probability(rho: float | None, n: int | None) -> float | None:
    """Two-sided p of a rank correlation, by Student's t with n - 2 degrees: a regularised incomplete beta as a continued fraction."""
    if rho is None or n is None or n < 3:
        return None
    if abs(rho) >= 1 or rho == 0:
        return 0.0 if rho else 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - rho * rho  # x = df / (df + t * t)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for m in range(1, 10_000):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho and its two-sided p over rows with both values; one row. p is worked out from the other two by one call."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    of = lambda c: _value_ranks(pairs.groupBy(F.col(c).alias("_v")).agg(F.sum("c").alias("_c")), f"r{c}").withColumnRenamed("_v", c)
    # Ranks are joined to the counts of pairs; their mean is (n + 1) / 2, so what is left are two sums of squares and one of products.
    ranked = pairs.join(of("a"), "a").join(of("b"), "b")
    n = F.sum("c")
    sums = ranked.agg(n.alias("n"), F.sum(F.col("c") * F.col("ra") * F.col("ra")).alias("aa"), F.sum(F.col("c") * F.col("rb") * F.col("rb")).alias("bb"), F.sum(F.col("c") * F.col("ra") * F.col("rb")).alias("ab"))
    mean = F.col("n") * (F.col("n") + 1) / 2 * ((F.col("n") + 1) / 2)
    out = sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.col("ab") - mean, F.sqrt(F.col("aa") - mean) * F.sqrt(F.col("bb") - mean)).alias("rho"))
    return out.withColumn("p", F.udf(lambda rho, n: _tail_probability(rho, n), "double")("rho", "n"))


def binary_scores(df: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of the class 1, accuracy, macro_f1 of both classes, mae."""
    g, p = F.col(gold), F.col(predicted)
    cells = df.groupBy(*by).agg(F.count_if((g == 1) & (p == 1)).alias("tp"), F.count_if((g == 0) & (p == 1)).alias("fp"), F.count_if((g == 1) & (p == 0)).alias("fn"), F.count_if((g == 0) & (p == 0)).alias("tn"), F.avg(F.abs(g - p)).alias("mae"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = lambda x: _ratio(2 * x, 2 * x + fp + fn)
    return cells.select(*by, "tp", "fp", "fn", "tn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), f1(tp).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((f1(tp) + f1(tn)) / 2).alias("macro_f1"), "mae")


def multilabel_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Of two equally long arrays of numbers, 0 or 1: hamming (loss), subset_accuracy, micro_f1, mse (mean of the squared differences)."""
    same = F.zip_with(gold, predicted, lambda x, y: (x == y).cast("int"))
    count = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    both = F.zip_with(gold, predicted, lambda x, y: x * y)
    sums = df.agg(F.sum(F.size(gold)).alias("cells"), F.sum(count(same)).alias("same"), F.count(F.lit(1)).alias("n"), F.sum((count(same) == F.size(gold)).cast("int")).alias("exact"), F.sum(count(both)).alias("tp"), F.sum(count(F.col(gold)) + count(F.col(predicted))).alias("ones"), F.sum(count(F.zip_with(gold, predicted, lambda x, y: ((x - y) * (x - y)).cast("int")))).alias("squares"))
    return sums.select("n", (1 - F.col("same") / F.col("cells")).alias("hamming"), (F.col("exact") / F.col("n")).alias("subset_accuracy"), _ratio(2 * F.col("tp"), F.col("ones")).alias("micro_f1"), (F.col("squares") / F.col("cells")).alias("mse"))


def per_label_scores(df: DataFrame, gold: str, predicted: str, names: list[str]) -> DataFrame:
    cells = df.select(F.posexplode(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p")))).select(F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("label"), F.col("col.g").alias("g"), F.col("col.p").alias("p"))
    return binary_scores(cells, "g", "p", "label")


def threshold_sweep(df: DataFrame, gold: Column, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1 of score >= threshold against gold. Each row is counted once per threshold, in one pass."""
    rows = df.select(gold.cast("int").alias("g"), F.col(score).alias("_s")).select("g", "_s", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return binary_scores(rows.withColumn("p", (F.col("_s") >= F.col("threshold")).cast("int")), "g", "p", "threshold").select("threshold", "precision", "recall", "f1")


def accuracy_by_frequency(df: DataFrame, train: DataFrame, label: str, correct: str, thresholds: list[int]) -> DataFrame:
    """at_least, n, accuracy over test rows whose label occurs at least so often in train."""
    known = train.groupBy(label).agg(F.count(F.lit(1)).alias("_f"))
    rows = df.join(known, label, "left").withColumn("_f", F.coalesce("_f", F.lit(0))).withColumn("at_least", F.explode(F.array(*map(F.lit, thresholds)))).filter("_f >= at_least")
    return rows.groupBy("at_least").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def padded(predictions: Column, k: int) -> Column:
    """The first k predictions, filled up with empty strings."""
    own = F.slice(F.coalesce(predictions, F.array().cast("array<string>")), 1, k)
    return F.concat(own, F.array_repeat(F.lit(""), F.lit(k) - F.size(own)))


def with_model_score(items: DataFrame, scores: DataFrame, key: str, score: str = "llm_affect_score") -> DataFrame:
    """items with the model's score, null where it gave none; of a key's several scores the greatest."""
    return items.join(scores.groupBy(key).agg(F.max(score).alias(score)), key, "left")


def shares(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, for each condition how many rows meet it (name) and their share (name_rate); 0 of none."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    rates = [F.coalesce(F.try_divide(F.col(name), F.col("total")), F.lit(0.0)).alias(f"{name}_rate") for name in conditions]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts).select("total", *conditions, *rates)
