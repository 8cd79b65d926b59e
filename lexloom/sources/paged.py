"""A paged search API as a Spark data source: one partition per query (runs of queries, where there are very many), and pages are fetched by
the task that reads it.

``paged_source`` makes a source of a fetch function; Spark reads it as a table or as a stream with ``spark.read.format`` and
``spark.readStream.format``. The stop rule of a query (two empty pages in a row, an error, a missing page, the page limit) is that of
``paging.pages_of``. As a stream, an offset is the number of queries that are done, so a checkpoint goes on behind the last whole query.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .paging import pages_of

PAGES = "query string, page int, body string"
_ARROW = pa.schema([("query", pa.string()), ("page", pa.int32()), ("body", pa.string())])
#: Pages in an Arrow batch.
BATCH = 64
#: Partitions up to which each query has its own; of more queries, neighbours share one.
PARTITIONS = 1000

Fetch = Callable[[str, int], str | None]


class QueryPartition(InputPartition):
    def __init__(self, *queries: str) -> None:
        super().__init__(queries)
        self.queries = queries


def _dealt(queries: list[str]) -> list[InputPartition]:
    size = -(-len(queries) // PARTITIONS)
    return [QueryPartition(*queries[i : i + size]) for i in range(0, len(queries), max(1, size))]


class _Pages:
    """What the table's reader and the stream's have in common."""

    def __init__(self, fetch: Fetch, options: dict) -> None:
        self.fetch, self.most, self.empty = fetch, int(options.get("most", 100)), int(options.get("empty", 2))
        done = set(json.loads(options.get("done", "[]")))
        self.queries = [q for q in dict.fromkeys(json.loads(options["queries"])) if q not in done]

    def read(self, partition: QueryPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads if there are no partitions
            return
        held: list[tuple[str, int, str]] = []
        for page in (p for q in partition.queries for p in pages_of(q, self.fetch, self.most, self.empty)):
            held.append(page)
            if len(held) == BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _dealt(self.queries)


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"queries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"queries": len(self.queries)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(self.queries[start["queries"] : end["queries"]])


def paged_source(fetch: Fetch, name: str = "paged_api") -> type[DataSource]:
    """A data source of this name over fetch(query, page), which gives a page's JSON, or None if there is none.

    Options: queries (a JSON array; for a stream it may only grow at its end), done (a JSON array of queries to leave out), most (pages a
    query, 100), empty (empty pages in a row that end a query, 2).
    """

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(fetch, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(fetch, self.options)

    return PagedSource


def _options(queries: list[str], done: list[str], most: int, empty: int) -> dict[str, str]:
    return {"queries": json.dumps(queries), "done": json.dumps(done), "most": str(most), "empty": str(empty)}


def fetched_pages(spark: SparkSession, fetch: Fetch, queries: list[str], done: list[str] | None = None, most: int = 100, empty: int = 2, name: str = "paged_api") -> DataFrame:
    """query, page, body of the pages that count, fetched by Spark's tasks, a query each (see PARTITIONS). A lost task fetches its queries again."""
    spark.dataSource.register(paged_source(fetch, name))
    return spark.read.format(name).options(**_options(queries, done or [], most, empty)).load()


def streamed_pages(spark: SparkSession, fetch: Fetch, queries: list[str], done: list[str] | None = None, most: int = 100, empty: int = 2, name: str = "paged_api") -> DataFrame:
    """As fetched_pages, as a stream: each run reads the queries that its checkpoint hasn't got."""
    spark.dataSource.register(paged_source(fetch, name))
    return spark.readStream.format(name).options(**_options(queries, done or [], most, empty)).load()


def store_fetch(folder: str) -> Fetch:
    """fetch for pages that lie in a store as ``folder/query=…/page=…/`` (as Spark's partitionBy writes text): any store that Arrow opens."""

    def fetch(query: str, page: int) -> str | None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        files = store.get_file_info(fs.FileSelector(f"{root}/query={query}/page={page}", allow_not_found=True))
        bodies = [store.open_input_stream(f.path).read().decode() for f in files if f.base_name.startswith("part-")]
        return "".join(bodies).rstrip("\n") if bodies else None

    return fetch


def bucket_of(query: Column, buckets: int) -> Column:
    """The bucket of ``bucket_fetch`` that holds a query's pages."""
    return (F.crc32(query.cast("binary")) % buckets).cast("int")


def land(pages: DataFrame, folder: str, buckets: int) -> None:
    """Writes pages (query, page, value) as a store for ``bucket_fetch``: a file for each bucket of queries, as one for each page is slow to write."""
    rows = pages.select("query", "page", "value", bucket_of(F.col("query"), buckets).alias("bucket"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "query", "page").write.partitionBy("bucket").parquet(folder)


def bucket_fetch(folder: str, buckets: int) -> Fetch:
    """fetch for pages that ``land`` wrote, in any store that Arrow opens. The pages of the query that is being read are held."""
    held: dict[str, dict[int, list[str]]] = {}

    def fetch(query: str, page: int) -> str | None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if query not in held:
            store, root = fs.FileSystem.from_uri(folder)
            found: dict[int, list[str]] = {}
            files = store.get_file_info(fs.FileSelector(f"{root}/bucket={zlib.crc32(query.encode()) % buckets}", allow_not_found=True))
            for f in files:
                if f.base_name.startswith("part-"):
                    rows = pq.read_table(f.path, filesystem=store, columns=["page", "value"], filters=[("query", "==", query)], partitioning=None)
                    for n, body in zip(rows["page"].to_pylist(), rows["value"].to_pylist(), strict=True):
                        found.setdefault(n, []).append(body)
            held.clear()
            held[query] = found
        bodies = held[query].get(page)
        return "\n".join(bodies) if bodies else None

    return fetch
