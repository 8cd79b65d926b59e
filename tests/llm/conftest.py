import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(r if len(r) == 4 else (*r, *[None] * (4 - len(r)))) for r in rows], "doc_id bigint, text string, lang string, source string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "sha", "rid", "size", "target", "part", "start", "queue", "n", "ids", "_source", "_row", "_sha", "_id", "copies", "keep_id", "label", "score", "key", "hub"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
