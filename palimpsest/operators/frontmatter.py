"""Frontmatter by a bounded line grammar: the keys an author wrote, and warnings of code, line and field, never of content.

A block lies between two lines of ---, the first one opening the document. Its lines are `key: value` with a plain, quoted
or [listed] value, items (`- x`) and indented lines that belong to the key before, comments and blanks. A line that is none
of these, or a value that does not close, makes the block unreadable: the document then has no keys, and its whole text is
its body. This is no YAML: anchors, tags and several documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.texts import strip

UNREADABLE, NO_TITLE, INVALID, NO_LIST = "frontmatter_unparseable", "frontmatter_missing_title", "frontmatter_invalid_field", "claims_not_a_list"
_MARK = "---[ \\t\\x0b\\f\\r]*[\\u0085\\u2028\\u2029]?"  # a line of it, with white space after
FRONT = rf"(?s)\A{_MARK}((?:\n.*?)??)\r?\n{_MARK}(?:\n|\z)"  # the text up to the end of the second mark, read no further
KEY, ENTRY, BLANK = r"^([A-Za-z_][A-Za-z0-9_-]*):(?:\s+(.*?))?\s*$", r"^\s*-(?:\s+(.*?))?\s*$", r"^\s*(#.*)?$"
# Fields that hold text, in the order in which they are checked, and words that are no text.
TEXT_FIELDS = ("title", "date", "tags", "document_type", "competition", "status", "git_repo", "notebook", "summary")
NO_TEXT = r"(?i)^(true|false|yes|no|on|off|null|~|[-+]?[0-9][0-9_]*(\.[0-9]*)?([eE][-+]?[0-9]+)?|\d{4}-\d{2}-\d{2})?$"
OPEN = r"""^("[^"]*|'[^']*|\[[^\]]*|\{[^}]*|[@`%&*!|>].*)$"""
DAY = r"^[\"']?\d{4}-\d{2}-\d{2}[\"']?$"


def rest() -> Column:
    """What follows the block of a raw text that has one."""
    return F.replace(F.substr("raw", F.length(F.regexp_extract("raw", FRONT, 0)) + 1), F.lit("\r\n"), F.lit("\n"))


def heading() -> Column:
    """The first heading of level 1 in the rest; empty where there is none."""
    return F.regexp_extract(F.concat(F.lit("\n"), "rest"), r"\n[ \t]*#[ \t]+([^\n]+?)[ \t]*#*[ \t]*(\n|$)", 1)


def split_documents(docs: DataFrame) -> DataFrame:
    """doc_id, raw -> doc_id, raw, block (lines between the marks; null where there is none), rest (what follows)."""
    head = F.regexp_extract("raw", FRONT, 0)
    there = head != ""
    between = F.regexp_extract("raw", FRONT, 1)  # with the line end before it; empty where the marks are next to each other
    block = F.when(between == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(between, F.lit(2)), r"\r\n|\n", -1))
    return docs.select("doc_id", "raw", F.when(there, block).alias("block"), F.when(there, rest()).alias("rest"))


def block_lines(parts: DataFrame) -> DataFrame:
    """Lines of blocks: doc_id, n (from 1), key, value, item, bad, and owner (the key that a line belongs to)."""
    x = parts.where("block is not null").select("doc_id", F.posexplode("block").alias("at", "line")).where(~F.col("line").rlike(BLANK))
    x = x.select("doc_id", (F.col("at") + 1).alias("n"), "line", F.nullif(F.regexp_extract("line", KEY, 1), F.lit("")).alias("key"), F.regexp_extract("line", KEY, 2).alias("value"))
    item = F.col("key").isNull() & F.col("line").rlike(ENTRY)
    x = x.withColumn("item", F.when(item, F.regexp_extract("line", ENTRY, 1)))
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("owner", F.last("key", ignorenulls=True).over(order))
    held = F.coalesce("item", "value")
    nested = F.col("key").isNull() & ~item & F.col("line").rlike(r"^ +\S")
    unclosed = held.rlike(OPEN) | (~held.rlike(r"""^["'\[{]""") & held.rlike(r": ") & F.col("key").isNotNull())
    bad = (F.col("key").isNull() & ~item & ~nested) | F.col("owner").isNull() | F.coalesce(unclosed, F.lit(False))
    return x.withColumn("bad", bad).withColumn("nested", nested)


def fields(lines: DataFrame) -> DataFrame:
    """doc_id, field, n, value (quotes taken off), items, nested (whether lines of another form follow) of readable blocks."""
    bad = lines.where("bad").select("doc_id").distinct()
    x = lines.join(bad, "doc_id", "left_anti").groupBy("doc_id", F.col("owner").alias("field"))
    said = x.agg(F.max(F.when(F.col("key").isNotNull(), F.col("n"))).alias("n"), F.max_by("value", F.when(F.col("key").isNotNull(), F.col("n"))).alias("value"), F.transform(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("n", "item")))), lambda i: i["item"]).alias("items"), F.max("nested").alias("nested"))
    inline = F.regexp_extract("value", r"^\[(.*)\]$", 1)
    listed = F.when(F.col("value").rlike(r"^\[.*\]$"), F.when(strip(inline) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inline, ","), strip))).when(F.size("items") > 0, F.col("items"))
    return said.select("doc_id", "field", "n", "value", listed.alias("items"), "nested")


def unquoted(value):
    return F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")


def titles(parts: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, title of documents with fields: the written one, else the first heading of level 1 in the body."""
    written = found.where((F.col("field") == "title") & ~F.col("value").isin("", '""', "''", "~", "null")).select("doc_id", unquoted(F.col("value")).alias("written"), (F.col("value").rlike(NO_TEXT) | F.col("items").isNotNull()).alias("odd"))
    first = F.col("heading") if "heading" in parts.columns else heading()
    has = found.select("doc_id").distinct()
    return parts.select("doc_id", first.alias("heading")).join(has, "doc_id", "left_semi").join(written, "doc_id", "left").select("doc_id", F.coalesce("written", F.nullif("heading", F.lit(""))).alias("title"), F.coalesce("odd", F.lit(False)).alias("odd"))


def documents(docs: DataFrame, body_as: Callable[[Column], Column] = lambda body: body) -> DataFrame:
    """doc_id, raw -> doc_id, title, keys (in order of writing), body.

    body_as is taken of the bodies before they are shuffled: a digest spares that of whole texts.
    """
    parts = split_documents(docs)
    found = fields(block_lines(parts))
    keys = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "field"))), lambda k: k["field"]).alias("keys"))
    bodies = parts.select("doc_id", F.when(F.col("rest").isNotNull(), body_as(strip(F.col("rest")))).alias("_rest"), body_as(strip(F.col("raw"))).alias("_raw"), F.col("rest").isNotNull().alias("_cut"))
    body = F.when(F.col("_cut") & ~F.coalesce("unreadable", F.lit(False)), F.col("_rest")).otherwise(F.col("_raw"))
    unreadable = block_lines(parts).where("bad").select("doc_id", F.lit(True).alias("unreadable")).distinct()
    return bodies.join(keys, "doc_id", "left").join(titles(parts, found).drop("odd"), "doc_id", "left").join(unreadable, "doc_id", "left").select("doc_id", "title", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), body.alias("body"))


def warnings(docs: DataFrame) -> DataFrame:
    """doc_id, raw -> doc_id, code, line (in the block, from 1), field. The first invalid field of a document is named."""
    parts = split_documents(docs)
    lines = block_lines(parts)
    found = fields(lines)
    unreadable = lines.where("bad").groupBy("doc_id").agg(F.min("n").alias("line")).select("doc_id", F.lit(UNREADABLE).alias("code"), "line", F.lit("").alias("field"))
    value, items = F.col("value"), F.col("items")
    blank = (value == "") & items.isNull() & ~F.col("nested")
    day = blank | value.isin("~", "null") | (value.rlike(DAY) & F.try_to_timestamp(unquoted(value), F.lit("yyyy-MM-dd")).isNotNull())
    listed = items.isNotNull() & ~F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda i: i.rlike(NO_TEXT))
    right = F.when(F.col("field") == "date", day).when(F.col("field") == "tags", listed).otherwise(items.isNull() & ~F.col("nested") & ~value.rlike(NO_TEXT))
    rank = F.array_position(F.array(*map(F.lit, TEXT_FIELDS)), F.col("field"))
    wrong = found.where(F.col("field").isin(*TEXT_FIELDS[1:])).where(~right).select("doc_id", "field", rank.alias("rank"))
    untitled = titles(parts, found).where("title is null or odd").select("doc_id", F.lit("title").alias("field"), F.lit(0).cast("long").alias("rank"))
    first = wrong.unionByName(untitled).groupBy("doc_id").agg(F.min_by("field", "rank").alias("field"))
    named = first.select("doc_id", F.when(F.col("field") == "title", NO_TITLE).otherwise(INVALID).alias("code"), F.lit(None).cast("int").alias("line"), "field")
    no_list = found.where((F.col("field") == "claims") & items.isNull() & ~(blank | value.isin("~", "null"))).select("doc_id", F.lit(NO_LIST).alias("code"), F.lit(None).cast("int").alias("line"), "field")
    return unreadable.unionByName(named).unionByName(no_list)
