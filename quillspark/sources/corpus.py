"""Text sources and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATE = "text string, source struct<path:string,line:int,message_index:int,offset:int,date:string,adapter:string,mtime:double>, words int, dictated boolean, suspect_ai boolean, id string"
PREFERENCE = "pair_id string, dimension string, choice string, ts string, a_label string, b_label string"


def read_documents(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """Whole files below ``path``: ``path, text, mtime, status``.

    Suffixes count in any case; blank files are kept with status ``empty``.
    Order by ``path`` where order matters: a scan has none.
    """
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    meta = F.col("_metadata")
    rows = files.select(meta["file_path"].alias("path"), F.col("value").alias("text"), F.unix_micros(meta["file_modification_time"]).alias("us"))
    return rows.select("path", "text", (F.col("us") / 1e6).alias("mtime"), F.when(F.col("text").rlike(r"\S"), "ok").otherwise("empty").alias("status"))


def read_lines(spark: SparkSession, path: str | list[str], suffix: str = "jsonl") -> DataFrame:
    """Lines of the files below ``path`` with 1-based numbers: ``path, line, value``.

    Files are read whole, as a line's number is its place in the file.
    """
    files = read_documents(spark, path, (suffix,))
    lines = files.select("path", F.posexplode(F.split("text", r"\r\n|[\r\n]")).alias("at", "value"))
    return lines.where(F.col("value").rlike(r"\S")).select("path", (F.col("at") + 1).alias("line"), "value")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list of candidates, or with that list under ``candidates``; 0-based ``index`` added."""
    text = spark.read.text(path, wholetext=True)
    one = F.from_json("value", f"struct<candidates:array<struct<{_fields()}>>>")
    many = F.from_json("value", f"array<struct<{_fields()}>>")
    listed = F.when(F.ltrim("value").startswith("["), many).otherwise(one["candidates"])
    return text.select(F.posexplode(listed).alias("index", "c")).select("index", "c.*")


def _fields() -> str:
    return CANDIDATE.replace("text string", "text:string").replace("source struct", "source:struct").replace("words int", "words:int").replace("dictated boolean", "dictated:boolean").replace("suspect_ai boolean", "suspect_ai:boolean").replace("id string", "id:string")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """One preference a line; ``at`` keeps the order of rows (file, line)."""
    lines = read_lines(spark, path)
    return lines.select(F.from_json("value", PREFERENCE).alias("p"), F.struct("path", "line").alias("at")).select("p.*", "at")


def read_wikitext(spark: SparkSession, path: str) -> DataFrame:
    """An offline snapshot, revision 0."""
    return spark.read.text(path, wholetext=True).select(F.lit(0).alias("revision"), F.col("value").alias("text"))


def report_json(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``id, report``: the columns as JSON, nulls kept."""
    return rows.select(id_col, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("report"))


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    rows.write.mode(mode).json(path)


def write_sheets(sheets: DataFrame, path: str) -> None:
    """``situation, text`` as one folder a situation; stale sheets go with the overwrite."""
    sheets.select("situation", "text").write.mode("overwrite").partitionBy("situation").text(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, words``, hashed on the file's own bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.regexp_count(F.decode("content", "UTF-8"), F.lit("[A-Za-z0-9']+")).alias("words"))


def write_state(snapshot: DataFrame, path: str) -> None:
    """The last snapshot with its hash."""
    snapshot.withColumn("sha256", F.sha2("text", 256)).write.mode("overwrite").parquet(path)


def task_chunks(candidates: DataFrame, order: list[Column | str], size: int = 10) -> DataFrame:
    """``chunk, payload``: candidates in order, ``size`` to a chunk, as JSON.

    The order is a global one, so rows are numbered by range partition and
    offset rather than in one task.
    """
    from quillspark.plans.ordering import numbered

    rows = numbered(candidates, order, "candidate_index")
    chunk = F.floor(F.col("candidate_index") / size) + 1
    packed = rows.groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("candidate_index", "text", "source"))).alias("c"))
    return packed.select("chunk", F.to_json("c").alias("payload"))


def drop_stats(annotated: DataFrame) -> DataFrame:
    """``drop_reason, n`` from the annotated relation."""
    return annotated.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def top_rows(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """A report's first rows (take-ordered, no global sort)."""
    return rows.orderBy(*order).limit(limit)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
