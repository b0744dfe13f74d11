"""Transcript readers (S3-S6): role-tagged and envelope JSON lines, adapter chosen per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in the two formats.
ENVELOPES = ["session_meta", "event_msg", "response_item", "turn_context", "compacted"]
INJECTED = ["# AGENTS.md instructions for", "<environment_context>", "<user_instructions>", "<INSTRUCTIONS>", "<skill>", "<turn_aborted>"]
ROLE_TAGGED, ENVELOPE = "role-tagged", "envelope"

ENTRY = "type string, timestamp string, created_at string, message string, content string, payload string"
PAYLOAD = "type string, role string, message string, content string"


def content_text(raw: Column) -> Column:
    """Text of a message body that is a string, or a list of strings and of objects with ``text``."""
    parts = F.from_json(raw, "array<string>")
    piece = lambda p: F.when(F.ltrim(p).startswith("{"), F.get_json_object(p, "$.text")).otherwise(p)
    listed = F.array_join(F.filter(F.transform(parts, piece), lambda x: x.isNotNull()), "\n")
    return F.when(raw.isNull(), F.lit("")).when(F.ltrim(raw).startswith("["), F.coalesce(listed, F.lit(""))).otherwise(raw)


def injected(t: Column) -> Column:
    hit = F.lit(False)
    for prefix in INJECTED:
        hit = hit | F.ltrim(t).startswith(prefix)
    return hit


def entries(lines: DataFrame) -> DataFrame:
    """Parsed lines (``path, line, value``): adds ``valid``, role, envelope facts; one narrow pass."""
    e = F.from_json("value", ENTRY)
    rows = lines.withColumn("valid", F.try_parse_json("value").isNotNull()).withColumn("e", e)
    rows = rows.withColumn("p", F.from_json("e.payload", PAYLOAD)).withColumn("role_in", F.get_json_object("e.message", "$.role"))
    users = ["user", "assistant"]
    role = F.when(F.col("role_in").isin(users), F.col("role_in")).when(F.col("e.type").isin(users), F.col("e.type"))
    envelope = F.col("e.type").isin(ENVELOPES) & F.ltrim("e.payload").startswith("{")
    return rows.select("path", "line", "valid", "e", "p", role.alias("role"), F.coalesce(envelope, F.lit(False)).alias("envelope"))


def files(rows: DataFrame) -> DataFrame:
    """Per file the adapter (first recognisable line decides, envelope before role), and whether a line is corrupt."""
    known = F.when(F.col("envelope"), ENVELOPE).when(F.col("role").isNotNull(), ROLE_TAGGED)
    first = F.min_by(known, F.when(known.isNotNull(), F.col("line")))
    return rows.groupBy("path").agg(
        F.coalesce(first, F.lit(ROLE_TAGGED)).alias("adapter"),
        F.max(F.when(~F.col("valid"), 1).otherwise(0)).alias("corrupt"),
        F.max(F.when(F.col("envelope"), 1).otherwise(0)).alias("has_envelope"),
        F.max(F.when(F.col("role").isNotNull(), 1).otherwise(0)).alias("has_role"),
    )


def read(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, drop counts, warnings) of transcript lines.

    One invalid line discards its whole file.  Role-tagged: users' messages are
    candidates, others count as ``authorship``.  Envelope: ``user_message``
    events and messages of the user; wrappers injected into them count as
    ``instruction-injection``.
    """
    rows = entries(lines)
    facts = files(rows)
    usable = facts.where("corrupt = 0 and ((adapter = 'role-tagged' and has_role = 1) or (adapter = 'envelope' and has_envelope = 1))")
    good = rows.join(usable.select("path", "adapter"), "path")
    e, p = F.col("e"), F.col("p")
    date = F.coalesce(F.nullif(e["timestamp"], F.lit("")), e["created_at"])
    tagged = F.col("adapter") == ROLE_TAGGED
    role_text = F.when(F.ltrim(e["message"]).startswith("{"), content_text(F.get_json_object(e["message"], "$.content"))).otherwise(content_text(e["content"]))
    event, item = (e["type"] == "event_msg"), (e["type"] == "response_item") & (p["type"] == "message")
    parts = content_text(F.when(F.ltrim(p["content"]).startswith("["), p["content"]))
    wrapped = F.exists(F.transform(F.from_json(p["content"], "array<string>"), lambda x: F.get_json_object(x, "$.text")), injected)
    fate = (
        F.when(tagged & F.col("role").isNull(), "none")
        .when(tagged & (F.col("role") != "user"), "authorship")
        .when(tagged, "keep")
        .when(~F.col("envelope"), "none")
        .when(event & (p["type"] == "agent_message"), "authorship")
        .when(event & (p["type"] == "user_message") & p["message"].isNotNull(), F.when(injected(p["message"]), "instruction-injection").otherwise("keep"))
        .when(item & ~F.coalesce(p["role"] == "user", F.lit(False)), "authorship")
        .when(item & (parts != ""), F.when(F.coalesce(wrapped, F.lit(False)), "instruction-injection").otherwise("keep"))
        .otherwise("none")
    )
    text = F.when(tagged, role_text).when(event, p["message"]).otherwise(parts)
    judged = good.select("path", "line", "adapter", date.alias("date"), text.alias("text"), fate.alias("fate"))
    source = F.struct("path", "line", F.col("line").alias("message_index"), F.lit(None).cast("int").alias("offset"), "date", "adapter", F.lit(None).cast("double").alias("mtime"))
    kept = judged.where("fate = 'keep'").select("text", source.alias("source"))
    drops = judged.where("fate in ('authorship', 'instruction-injection')").groupBy(F.col("fate").alias("drop_reason")).agg(F.count("*").alias("n"))
    said = F.when(F.col("corrupt") == 1, "invalid JSON; skipping file").otherwise("unknown jsonl schema; skipped")
    warnings = facts.join(usable.select("path"), "path", "left_anti").select("path", said.alias("warning"))
    return kept, drops, warnings


def from_documents(documents: DataFrame) -> DataFrame:
    """Whole files (``path, text, mtime``) as candidates."""
    none = F.lit(None)
    source = F.struct("path", none.cast("int").alias("line"), none.cast("int").alias("message_index"), F.lit(0).alias("offset"), none.cast("string").alias("date"), F.lit("text-folder").alias("adapter"), "mtime")
    return documents.select("text", source.alias("source"))


def collect(transcripts: DataFrame, documents: DataFrame) -> DataFrame:
    """S3: candidates of both kinds as one relation."""
    return transcripts.unionByName(from_documents(documents), allowMissingColumns=True)
