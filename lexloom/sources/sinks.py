"""Writers. Spark's commit protocol makes each of them atomic: a reader sees all files of a write or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: how the seed is shown to annotators.
HIGHLIGHT = "background-color:#2dfe5f"


def jsonl(df: DataFrame, path: str, resume: bool = False) -> None:
    df.write.mode("append" if resume else "overwrite").json(path)


def jsonl_once(df: DataFrame, path: str) -> None:
    """Fails if path exists."""
    df.write.mode("errorifexists").json(path)


def raw_lines(df: DataFrame, path: str, line: str = "value") -> None:
    """Kept lines as they were read."""
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def stats(df: DataFrame, path: str) -> None:
    """A table of dimension, key and n as one JSON object of maps."""
    maps = df.groupBy("dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("key", F.lit("all")), "n")))).alias("m"))
    maps.select(F.to_json(F.map_from_entries(F.collect_list(F.struct("dimension", "m")))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def splits(df: DataFrame, path: str, *by: str, order: tuple[str, ...] = ()) -> None:
    """Parquet by split (and language), rows sorted inside files."""
    (df.sortWithinPartitions(*by, *order) if order else df).write.mode("overwrite").partitionBy(*by).parquet(path)


def annotation_rows(df: DataFrame, style: str = HIGHLIGHT, most: int = 5000) -> DataFrame:
    """id, short_context, full_context, emo_term, show_inst of df (id, text, matched_sentence, seed_word, and perhaps title or video_title).

    Both contexts show the first hit of the seed in a styled span; the full one is cut around the sentence and headed by the title, if
    there is one that isn't empty. Characters beyond ASCII are references.
    """
    seed = F.coalesce("seed_word", F.lit(""))
    shown = lambda x: T.wrap_first(x, seed, f'<span style="{style}">', "</span>")
    title = T.first_non_empty(*[F.col(c) for c in ("title", "video_title") if c in df.columns], F.lit(None).cast("string"))
    head = F.coalesce(F.concat(F.lit("<em>"), title, F.lit("</em><br><br>")), F.lit(""))
    text = T.window_around(F.coalesce("text", F.lit("")), F.coalesce("matched_sentence", F.lit("")), most, most // 2)
    short = F.concat(F.lit("<strong>"), shown(F.coalesce("matched_sentence", F.lit(""))), F.lit("</strong><br>"))
    return df.select("id", T.escape_non_ascii(short).alias("short_context"), T.escape_non_ascii(F.concat(head, shown(text), F.lit("<br>"))).alias("full_context"), T.escape_non_ascii(seed).alias("emo_term"), F.lit("show").alias("show_inst"))


def annotation_csv(df: DataFrame, path: str, style: str = HIGHLIGHT) -> None:
    """The rows that annotators see, as CSV."""
    annotation_rows(df, style).write.mode("overwrite").options(header=True, escape='"').csv(path)


def presentation_csv(df: DataFrame, path: str) -> None:
    """id (prefix of the source and a number), input, labels (a list literal)."""
    label = F.concat(F.lit("['"), F.array_join("labels", "', '"), F.lit("']"))
    df.select("id", "input", label.alias("labels")).write.mode("overwrite").options(header=True, escape='"').csv(path)


def fan_out(df: DataFrame, path: str, kept: str, condition) -> None:
    """All rows to path, those that meet condition to kept: written once, the second read from the first."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).filter(condition).write.mode("overwrite").parquet(kept)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small result table as Markdown; numbers with a point have digits decimals."""
    rows = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.collect()]
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex(df: DataFrame, digits: int = 3) -> str:
    rows = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v).replace("_", r"\_") for v in r] for r in df.collect()]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", rf"{head} \\ \hline", *[" & ".join(r) + r" \\" for r in rows], r"\end{tabular}"])
