"""Registration, and the inputs that a query and its SQL derive alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.queries import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "source", "lang")))


#: A sentence or two for every document, chosen by its id, so that rare findings occur.
CARRIERS = [
    "However, the plan is a testament to care. Moreover, it will not fail, and we may delve into it in order to learn.",
    "First, we note that the truth is simple. In conclusion, studies show that it matters.",
    "The price rose to $1,200 in 2021, about 12.5% over the year. See Section 4 or write to a.b@example.org by 2022-03-14.",
    "I think you might like it. Maybe we wasn't wrong. Yesterday I walked home and counted 14 birds, and/or fewer.",
    "Every child is loved. Every house has rooms. It turns out that nobody, none of us, can say if it never was so.",
    "At the end of the day, the future looks bright, ensuring growth. Ultimately, let me be clear: it is robust and seamless.",
    "On the other hand, it cannot last. Therefore we must go, unless most of them will stay without us.",
]


def seeded(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with their carrier as a last line."""
    carrier = F.element_at(F.array(*[F.lit(c) for c in CARRIERS]), (F.col("doc_id") % len(CARRIERS) + 1).cast("int"))
    return docs.withColumn(text_col, F.concat(F.col(text_col), F.lit("\n"), carrier))


def seeded_sql(columns: str = "doc_id, source") -> str:
    return f"SELECT {columns}, text || chr(10) || {sql.listed(CARRIERS)}[doc_id % {len(CARRIERS)} + 1] AS text FROM documents"


def altered(docs: DataFrame) -> DataFrame:
    """Each document as ``original`` beside a rewrite: 'and' gives way to a comma, and some words go."""
    t = F.regexp_replace(F.regexp_replace("text", " and ", ", "), " (?:not|most|may|if) ", " ")
    return docs.withColumn("original", F.col("text")).withColumn("rewritten", t).drop("text")


def altered_sql() -> str:
    return rf"SELECT doc_id, text AS original, regexp_replace(regexp_replace(text, ' and ', ', ', 'g'), ' (?:not|most|may|if) ', ' ', 'g') AS rewritten FROM ({seeded_sql('doc_id')})"
