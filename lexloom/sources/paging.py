"""Pages of a search API, for each query until two empty ones in a row, an error, or a page limit.

Landed pages are JSON files ``{folder}/{query}/{page}.json``, which Spark's own readers find wherever they lie; ``pages_of`` is the same rule
for a client that fetches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pages_of(query: str, fetch: Callable[[str, int], str | None], most: int, empty: int = 2) -> Iterator[tuple[str, int, str]]:
    """(query, page, body) of the pages that count, by a fetch function; None is a missing page."""
    blanks = 0
    for page in range(1, most + 1):
        try:
            body = fetch(query, page)
            found = body and json.loads(body).get("result")
        except (OSError, ValueError):
            return
        if body is None:
            return
        blanks = 0 if found else blanks + 1
        if blanks >= empty:
            return
        if blanks == 0:
            yield query, page, body


def landed_pages(spark: SparkSession, folder: str, queries: list[str] | None = None, done: list[str] | None = None, most: int = 100, empty: int = 2) -> DataFrame:
    """query, page, body of the landed pages that count; queries: only these; done: without these.

    A page that is missing or broken ends its query, as an error would. Windows run over the pages of one query.
    """
    files = spark.read.options(wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").text(folder)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = files.select(F.regexp_extract(path, r"([^/]+)/\d+\.json$", 1).alias("query"), F.regexp_extract(path, r"/(\d+)\.json$", 1).try_cast("int").alias("page"), F.col("value").alias("body")).filter("page IS NOT NULL")
    if queries is not None:
        rows = rows.filter(F.col("query").isin(*queries)) if queries else rows.limit(0)
    if done:
        rows = rows.filter(~F.col("query").isin(*done))
    order = Window.partitionBy("query").orderBy("page")
    blank = F.coalesce(F.json_array_length(F.get_json_object("body", "$.result")), F.lit(0)) == 0
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_blank", blank).withColumn("_run", F.sum(F.col("_blank").cast("int")).over(order.rowsBetween(1 - empty, 0)))
    ends = (F.col("page") != F.col("_n")) | (F.col("page") > most) | F.try_parse_json("body").isNull() | (F.col("_run") >= empty)
    rows = rows.withColumn("_stop", F.min(F.when(ends, F.col("page"))).over(Window.partitionBy("query")))
    return rows.filter((F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))) & ~F.col("_blank")).select("query", "page", "body")
