"""Statements as memory: checked, given a key and a path, written out as documents with one authored claim, and stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import merges, texts

# The longest statement, the states that a statement may have, what a segment of a scope may hold.
LONGEST, STATES, APPROVED, SEGMENT = 4000, ("approved", "draft", "rejected"), "approved", r"[A-Za-z0-9._-]+"
STORED = "corpus_id string, path string, request_id long, key string, statement string, state string, raw string, hash string"
KEYS = ("corpus_id", "path")


def normalised(statement: Column) -> Column:
    """White space becomes single spaces; marks of a heading at the start go."""
    flat = texts.strip(F.regexp_replace(statement, r"\s+", " "))
    return texts.strip(F.regexp_replace(flat, "^#+", ""))


def scoped(scope: Column, key: Column) -> Column:
    """A key under its scope; one that is there already stays as it is."""
    return F.when(scope.isNull() | F.startswith(key, F.concat(scope, F.lit("/"))), key).otherwise(F.concat_ws("/", scope, key))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def rendered(statement: Column, key: Column, state: Column, day: Column) -> Column:
    """The document: frontmatter with one claim whose value and evidence are the statement, its title, the statement."""
    title, said = texts.title_label(statement), quoted(statement)
    other = state != APPROVED
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    head = [F.lit("---\n"), field("title", quoted(title)), field("date", F.date_format(day, "yyyy-MM-dd")), F.lit("document_type: note\n"), F.when(other, field("status", state)).otherwise("")]
    claim = [F.lit("claims:\n"), field("  - key", quoted(key)), *[field(f"    {name}", said) for name in ("claim", "value", "evidence")], F.when(other, field("    info_state", state)).otherwise("")]
    return F.concat(*head, *claim, F.lit("---\n\n# "), title, F.lit("\n\n"), statement, F.lit("\n"))


def remembered(requests: DataFrame) -> DataFrame:
    """request_id, corpus_id, statement, key, scope, state, day -> the same requests with reason, key, path, statement, state, raw.

    A request is refused for the first that holds: a state of another name, a scope that is no relative folder, a statement that
    is null, empty or too long, a blank key; its key, path and raw are then null, reason says why. A null state is approved. Without
    a key the statement's digest is the key, so a sentence is one memory however often it is said. Repeated rows stay.
    """
    said, state, scope = normalised(F.col("statement")), F.coalesce("state", F.lit(APPROVED)), F.col("scope")
    folder = scope.rlike(rf"^{SEGMENT}(/{SEGMENT})*$") & ~scope.rlike(r"(^|/)\.\.?(/|$)") & ~scope.contains("\n")
    reason = (
        F.when(~state.isin(*STATES), "invalid_state").when(scope.isNotNull() & ~folder, "invalid_scope").when(F.coalesce(said, F.lit("")) == "", "statement_empty")
        .when(F.length(said) > LONGEST, "statement_too_long").when(F.col("key").isNotNull() & (texts.strip(F.col("key")) == ""), "key_blank")
    )
    own = F.coalesce(texts.strip(F.col("key")), F.concat(F.lit("text:"), F.sha2(F.to_json(F.array(said)), 256)))
    r = requests.withColumns({"reason": reason, "_said": said, "_state": state}).withColumn("_key", F.when(F.col("reason").isNull(), scoped(scope, own)))
    path = F.when(F.col("_key").isNotNull(), F.concat(F.coalesce(F.concat(scope, F.lit("/")), F.lit("")), texts.memory_path(F.col("_key"))))
    raw = F.when(F.col("_key").isNotNull(), rendered(F.col("_said"), F.col("_key"), F.col("_state"), F.col("day")))
    return r.select("request_id", "corpus_id", "reason", F.col("_key").alias("key"), path.alias("path"), F.col("_said").alias("statement"), F.col("_state").alias("state"), raw.alias("raw"))


def remember(store: str, batch: int, requests: DataFrame) -> DataFrame:
    """Writes the accepted statements of a batch into the stored table, and says of each request what came of it: written,
    overtaken (a later request of the batch, by id, has its path), unchanged, or refused.

    One document a key: a statement under a key that is there replaces it, an equal one does nothing. A rerun writes nothing.
    """
    asked = remembered(requests)
    good = asked.where("reason is null").select("corpus_id", "path", "request_id", "key", "statement", "state", "raw", F.sha2(F.concat_ws("|", "state", "statement"), 256).alias("hash"))
    merges.merge(store, batch, good.withColumn("deleted", F.lit(False)), KEYS, STORED, order="request_id", same=["hash"])
    spark = requests.sparkSession
    done = spark.read.schema(f"{STORED}, _outcome string").parquet(f"{store}/data/batch={batch}").where("_outcome <> 'kept'").select("corpus_id", "path", F.col("request_id").alias("_by"), "_outcome")
    last = good.groupBy("corpus_id", "path").agg(F.max("request_id").alias("_last"))
    j = asked.join(last, ["corpus_id", "path"], "left").join(done, ["corpus_id", "path"], "left")
    outcome = F.when(F.col("reason").isNotNull(), "refused").when(F.col("request_id") < F.col("_last"), "overtaken").when(F.col("_outcome") == "unchanged", "unchanged").otherwise(F.col("_outcome"))
    return j.select("request_id", "corpus_id", "path", outcome.alias("outcome"), "reason")
