"""Logs and question sets: lines read back leniently, labels and questions held against their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.texts import clean_reference

# The fields of an adjudication that hold a label, and the labels.
LABEL_FIELDS = ("relevance", "subject_compatibility", "temporal_applicability", "evidence_sufficiency", "authority_compatibility", "overall_decision", "conflict_status")
LABELS = (
    "relevant", "irrelevant", "uncertain", "compatible", "incompatible", "applicable", "not_applicable", "not_temporal", "sufficient", "insufficient", "conflicting",
    "current", "historical", "superseded", "deleted", "restored", "accept", "reject", "abstain", "unknown", "open", "resolved", "reopened",
)


def log_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as JSON lines, in the form in which a log is appended."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def read_log(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines (value) as rows; a line that is not whole JSON of the schema is skipped."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("r")).where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def check_labels(records: DataFrame) -> DataFrame:
    """Adds field: the first label field whose value is missing or unknown, null where the record is accepted."""
    wrong = [F.when(F.col(f).isNull() | ~F.col(f).isin(*LABELS), F.lit(f)) for f in LABEL_FIELDS]
    return records.withColumn("field", F.coalesce(*wrong))


def check_questions(questions: DataFrame) -> DataFrame:
    """question_id, query, expected (array), expect_empty -> reason, null where it is accepted.

    A query is asked once (its first by id); it names what it expects, or says that it expects nothing, not both.
    """
    first = questions.groupBy("query").agg(F.min("question_id").alias("_first"))
    j = questions.join(first, "query", "left")
    size, empty = F.coalesce(F.size("expected"), F.lit(0)), F.coalesce("expect_empty", F.lit(False))
    reason = (
        F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "query_missing").when(F.col("_first") < F.col("question_id"), "duplicate_query")
        .when(empty & (size > 0), "expected_with_expect_empty").when(~empty & (size <= 0), "expected_missing")
    )
    return j.withColumn("reason", reason).drop("_first")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def check_authored(documents: DataFrame) -> DataFrame:
    """doc_id, claims (JSON array of objects), chunks -> one row a document: its number of claims, and why it is rejected.

    A claim has key, value, claim and evidence (a quote, or a list of different ones); its quotes stand in a chunk character by
    character, its wording in a chunk with the quote, white space aside; a window ends no earlier than it starts. One bad claim
    rejects the document; of several faults the first in this order is named. The reason carries no text of the document.
    """
    parsed = F.from_json("claims", "array<struct<key string, value string, claim string, evidence string, valid_from timestamp, valid_until timestamp>>")
    c = documents.withColumn("c", F.explode_outer(parsed)).withColumn("_unreadable", F.coalesce(parsed.isNull() & F.col("claims").isNotNull(), F.lit(False)))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    raw = F.col("c.evidence")
    c = c.withColumn("_quotes", F.when(raw.isNotNull(), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))))
    quotes, said = F.col("_quotes"), squeeze(F.col("c.claim"))
    found = F.forall(quotes, lambda q: F.exists("chunks", lambda k: k.contains(q)))
    worded = F.forall(quotes, lambda q: F.exists("chunks", lambda k: k.contains(q) & squeeze(k).contains(said)))
    faults = (
        ("value_missing", F.col("c.value").isNull()), ("key_or_claim_missing", blank(F.col("c.key")) | blank(F.col("c.claim"))),
        ("evidence_missing", quotes.isNull() | (F.size(quotes) <= 0) | F.exists(quotes, blank)), ("evidence_repeated", F.size(F.array_distinct(quotes)) < F.size(quotes)),
        ("evidence_not_in_chunk", ~found), ("claim_not_in_chunk", ~worded), ("window_reversed", F.col("c.valid_until") < F.col("c.valid_from")),
    )
    broken = F.when(F.col("c").isNotNull(), F.coalesce(*[F.when(holds, F.lit(i)) for i, (_, holds) in enumerate(faults)]))
    per = c.groupBy("doc_id").agg(F.count("c").alias("n_claims"), (F.count_distinct("c.key") < F.count("c.key")).alias("_twice"), F.min(broken).alias("_broken"), F.max("_unreadable").alias("_unreadable"))
    reason = F.when(F.col("_unreadable"), "unreadable").when(F.col("_twice"), "key_repeated").otherwise(F.get(F.array(*[F.lit(name) for name, _ in faults]), F.col("_broken")))
    return per.select("doc_id", "n_claims", reason.alias("reason"))


def eligible(documents: DataFrame, structural: DataFrame, authored: DataFrame, archived: DataFrame) -> DataFrame:
    """The documents that may hold memory: any with a structural or authored claim, or in the archive already (each: doc_id)."""
    known = structural.select("doc_id").union(authored.select("doc_id")).union(archived.select("doc_id")).distinct()
    return documents.join(known, "doc_id", "left_semi")


# Fixed value: the pattern of a declaration line.
DECLARATION = r"(?i)^\s*(?:[-*+]\s+)?(?:\*\*|__)?(supersedes|superseded[\s_-]?by)(?:\*\*|__)?\s*:\s*(\S.*?)\s*$"


def declarations(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line -> doc_id, relation (supersedes, superseded_by), reference, line_no of its first line."""
    relation = F.when(F.lower(F.regexp_extract("line", DECLARATION, 1)) == "supersedes", "supersedes").otherwise("superseded_by")
    said = lines.where(F.col("line").rlike(DECLARATION)).select("doc_id", "line_no", relation.alias("relation"), clean_reference(F.regexp_extract("line", DECLARATION, 2)).alias("reference"))
    return said.where("reference is not null").groupBy("doc_id", "relation", "reference").agg(F.min("line_no").alias("line_no"))
