"""Models enter as injected callables on batches; classical baselines come from pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, MinMaxScaler, StringIndexer, Tokenizer, Word2Vec
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import bound_batches
from .corpus import pending


#: Characters of prompts that a model gets at a time, unless one is longer: what a task's Python holds of them and of the replies is bounded.
PROMPT_CHARS = 1 << 20


def _in_slices(parts: Iterator[pd.Series], run: Callable[[list[str]], list], most: int) -> Iterator[pd.Series]:
    """The results of run on slices of the parts in order, of at most so many characters each, if one text isn't longer."""
    for part in parts:
        texts, low, held = part.to_numpy(dtype=object), 0, 0
        for i, x in enumerate(texts):
            n = len(x) if isinstance(x, str) else 0
            if held and held + n > most:
                yield _replies(run, part.index[low:i], texts[low:i])
                low, held = i, 0
            held += n
        yield _replies(run, part.index[low:], texts[low:])


def _replies(run: Callable[[list[str]], list], index: pd.Index, texts) -> pd.Series:
    return pd.Series(run([x if isinstance(x, str) else "" for x in texts]), index=index, dtype=object)


def generated(df: DataFrame, prompt: str, reply: Callable[[list[str]], list[str]], out: str = "raw") -> DataFrame:
    """df with the replies of a model to a prompt column. It gets prompts of at most PROMPT_CHARS at a time, if one isn't longer."""
    bound_batches(df.sparkSession)
    most = PROMPT_CHARS

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _in_slices(parts, reply, most)

    return df.withColumn(out, run(prompt))


def scored(df: DataFrame, keys: list[str], prompt: Column, reply: Callable[[list[str]], list[str]], model: str, done: DataFrame | None = None) -> DataFrame:
    """Rows with llm_raw_output, llm_affect_score (0 to 3 or null), llm_model; rows whose keys are in done are left out."""
    todo = df if done is None else pending(df, done, keys)
    out = generated(todo.withColumn("_prompt", prompt), "_prompt", reply, "llm_raw_output").drop("_prompt")
    return out.withColumn("llm_affect_score", T.parse_score(F.col("llm_raw_output"))).withColumn("llm_model", F.lit(model))


def persons(df: DataFrame, parts: str, tag: Callable[[list[str]], list[int]], out: str = "persons") -> DataFrame:
    """df with the grammatical person of each part of an array column, by an injected tagger."""

    @F.pandas_udf("array<int>")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda x: list(tag(list(x))))

    return df.withColumn(out, run(parts))


def completed(df: DataFrame, prompt: str, complete: Callable[[list[str]], list[list[tuple[str, float]]]], out: str = "completions") -> DataFrame:
    """df with a model's completions of a prompt column, array<struct<text, score>>, by a hook that gets batches of prompts.

    A hook that knows no scores (sampling, greedy) gives equal ones; its order then stays. It gets prompts as in ``generated``.
    """
    bound_batches(df.sparkSession)
    most = PROMPT_CHARS

    @F.pandas_udf("array<struct<text:string,score:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _in_slices(parts, lambda prompts: [[{"text": t, "score": float(s)} for t, s in one] for one in complete(prompts)], most)

    return df.withColumn(out, run(prompt))


def drops(parts: list[str], mask: str = T.MASK) -> list[tuple[int, int]]:
    """The runs parts[a:b] that are left after each drop in turn, from none on: the end and the start take turns, the part with the mask stays."""
    own = next((i for i, p in enumerate(parts) if mask in p), None)
    a, b, end, out = 0, len(parts), True, [(0, len(parts))]
    while b - a > 1:
        drop_end = own is None or own < b - 1
        drop_start = own is None or own > a
        if (end and drop_end) or not drop_start:
            b -= 1
        else:
            a += 1
        end = not end
        out.append((a, b))
    return out


def truncated(df: DataFrame, text: str, count: Callable[[list[str]], list[int]], most: int, split: Callable[[str], list[str]], mask: str = T.MASK) -> DataFrame:
    """df with text cut to most tokens by dropping sentences in turn from the end and the start, never the one with the mask.

    count takes texts and gives their numbers of tokens. Which sentences go at which drop follows from the mask's place alone, so the first
    run that fits is found by halving: a batch's texts are counted together, in as many calls as the longest has bits in its number of
    sentences. A run within another mustn't have more tokens than it, as holds for tokenizers.
    """

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        out = series.to_numpy(dtype=object, copy=True)
        texts = [i for i, x in enumerate(out) if x is not None]
        over = [i for i, n in zip(texts, count([out[i] for i in texts]), strict=True) if n > most]
        parts = {i: split(out[i]) for i in over}
        runs = {i: drops(parts[i], mask) for i in over}
        low, high = dict.fromkeys(over, 0), {i: len(runs[i]) - 1 for i in over}  # the last run stays even if it is too long
        shown = lambda i, k: " ".join(parts[i][slice(*runs[i][k])])
        while open_ := [i for i in over if low[i] < high[i]]:
            middle = {i: (low[i] + high[i]) // 2 for i in open_}
            for i, n in zip(open_, count([shown(i, middle[i]) for i in open_]), strict=True):
                if n <= most:
                    high[i] = middle[i]
                else:
                    low[i] = middle[i] + 1
        for i in over:
            out[i] = shown(i, low[i])
        return pd.Series(out, index=series.index, dtype=object)

    return df.withColumn(text, run(text))


def training_arrays(prompt: Column, target: Column, most: int, pad: int = 0, ignored: int = -100) -> Column:
    """struct<input_ids, labels, attention> of token arrays: prompt and target, cut to most from the left and padded; only the target counts."""
    ids, marks = F.concat(prompt, target), F.concat(F.transform(prompt, lambda _: F.lit(ignored)), target)
    last = lambda x: F.slice(x, F.greatest(F.size(x) - most + 1, F.lit(1)), F.lit(most))
    missing = F.greatest(most - F.size(last(ids)), F.lit(0))
    filled = lambda x, v: F.concat(last(x), F.array_repeat(F.lit(v), missing))
    ones = F.transform(ids, lambda _: F.lit(1))
    return F.struct(filled(ids, pad).alias("input_ids"), filled(marks, ignored).alias("labels"), filled(ones, 0).alias("attention"))


def forest_baseline(text: str = "text", label: str = "label", least: int = 5, trees: int = 50) -> Pipeline:
    """Counts of words in at least ``least`` and at most 80 % of the texts, weighed by rarity, into a random forest."""
    stages = [StringIndexer(inputCol=label, outputCol="target"), Tokenizer(inputCol=text, outputCol="words"), CountVectorizer(inputCol="words", outputCol="counts", minDF=least, maxDF=0.8), IDF(inputCol="counts", outputCol="features")]
    return Pipeline(stages=[*stages, RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=trees, seed=42)])


def vector_baseline(text: str = "text", label: str = "label", size: int = 50) -> Pipeline:
    """Mean word vectors, scaled to 0 to 1, into a linear support vector machine."""
    stages = [StringIndexer(inputCol=label, outputCol="target"), Tokenizer(inputCol=text, outputCol="words"), Word2Vec(inputCol="words", outputCol="mean", vectorSize=size, seed=42), MinMaxScaler(inputCol="mean", outputCol="features")]
    return Pipeline(stages=[*stages, LinearSVC(featuresCol="features", labelCol="target")])


def short_name(model: Column) -> Column:
    """A model's name without its owner."""
    return F.substring_index(model, "/", -1)


def with_mask_of(text: Column, mask: str, own: str = T.MASK) -> Column:
    """text with the corpus' mask swapped for a model's."""
    return F.replace(text, F.lit(own), F.lit(mask))


def truncation_counts(before: DataFrame, after: DataFrame, key: str, text: str, mask: str = T.MASK) -> DataFrame:
    """One row: rows before, rows after that still hold the mask (kept), and those of them whose text is shorter (truncated)."""
    both = before.select(key, F.length(text).alias("_before")).join(after.select(key, F.col(text).alias("_text")), key, "left")
    kept = F.coalesce(F.contains("_text", F.lit(mask)), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"), F.count_if(kept & (F.length("_text") < F.col("_before"))).alias("truncated"))


def weights(model, words: list[str]) -> DataFrame:
    """word, weight of a fitted linear model over counts of words (a two-class naive Bayes: log ratios; else its coefficients)."""
    values = (model.theta.toArray()[1] - model.theta.toArray()[0]) if hasattr(model, "theta") else model.coefficients.toArray()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(pd.DataFrame({"word": list(words), "weight": values.astype(float)}), "word string, weight double")  # as many as the model has


def word_weights(rows: DataFrame, words: str = "words", label: str = "label", smoothing: float = 1.0) -> DataFrame:
    """word, weight of a naive Bayes model of two classes (label 0 and 1) over counts of words, fitted on all rows (words array, label): the log
    ratios of ``weights``, for vocabularies of any size. Each word's counts are one row; only the classes' totals meet all of them.
    """
    counts = rows.select(F.col(label).alias("_label"), F.explode(words).alias("word")).groupBy("word").agg(F.count_if(F.col("_label") == 0).alias("_c0"), F.count_if(F.col("_label") == 1).alias("_c1"))
    totals = counts.agg(F.sum("_c0").alias("_n0"), F.sum("_c1").alias("_n1"), F.count(F.lit(1)).alias("_v"))
    log = lambda k: F.log((F.col(f"_c{k}") + smoothing) / (F.col(f"_n{k}") + smoothing * F.col("_v")))
    return counts.join(F.broadcast(totals)).select("word", (log(1) - log(0)).alias("weight"))


def top_words(weighed: DataFrame, known: DataFrame | None, k: int, out: str = "place") -> DataFrame:
    """The k words of known (word; None: all) with the largest weight on either side, with their place: +1, +2, … and -1, -2, …"""
    own = weighed if known is None else weighed.join(known.select("word").distinct(), "word", "left_semi")
    side = lambda order, sign: own.orderBy(order, "word").limit(k).withColumn(out, F.lit(sign) * F.row_number().over(Window.orderBy(order, "word")))  # noqa: E731  k rows
    return side(F.desc("weight"), 1).unionByName(side(F.asc("weight"), -1))
