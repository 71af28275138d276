"""Markdown as line tables: kinds of line, heading paths, table rows, statements. All by windows inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, 0)


def kinds(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line -> kind: fenced block, heading, table, bullet, blank or prose. A fence holds until the next."""
    fence = F.col("line").startswith("```")
    inside = F.sum(fence.cast("int")).over(so_far()) % 2 == 1
    kind = F.when(fence | inside, "block").when(F.col("line").rlike("^#{1,6} "), "heading").when(F.col("line").startswith("|"), "table").when(F.col("line").startswith("- "), "bullet").when(F.trim("line") == "", "blank").otherwise("prose")
    return lines.withColumn("kind", kind)


def heading_paths(kinded: DataFrame) -> DataFrame:
    """Adds path: the open headings of levels 1 to 3, joined; a heading closes those of its level and below."""
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1)))
    title = F.regexp_replace("line", "^#+ ", "")
    out = kinded
    for n in (1, 2, 3):
        out = out.withColumn(f"_h{n}", F.last(F.when(level == n, F.struct("line_no", title.alias("t"))), ignorenulls=True).over(so_far()))
    at = [F.coalesce(F.col(f"_h{n}.line_no"), F.lit(-1)) for n in (1, 2, 3)]
    two = F.when(at[1] > at[0], F.col("_h2.t"))
    three = F.when((at[2] > at[1]) & (at[2] > at[0]), F.col("_h3.t"))
    return out.withColumn("path", F.concat_ws(" > ", F.col("_h1.t"), two, three)).drop("_h1", "_h2", "_h3")


def table_rows(kinded: DataFrame) -> DataFrame:
    """Rows of tables as `column: value; ...`, the columns from the line before the separator."""
    bar = F.col("line").rlike(r"^\|[-| ]+\|$")
    header = (F.col("kind") == "table") & F.lead(bar).over(in_doc())
    t = kinded.withColumns({"_bar": bar, "_head": F.coalesce(header, F.lit(False))}).withColumn("_names", F.last(F.when(F.col("_head"), F.col("line")), ignorenulls=True).over(so_far()))
    cells = lambda c: F.transform(F.split(F.regexp_replace(c, r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))
    row = F.array_join(F.zip_with(cells("_names"), cells("line"), lambda n, v: F.concat(n, F.lit(": "), v)), "; ")
    return t.where("kind = 'table' and not _bar and not _head and _names is not null").select("doc_id", "line_no", row.alias("claim"))


def statements(pathed: DataFrame) -> DataFrame:
    """Bullets as statements, the first of equal ones under a heading."""
    s = pathed.where("kind = 'bullet'").select("doc_id", "path", "line_no", F.trim(F.substring("line", 3, 1_000_000_000)).alias("statement"))
    return s.groupBy("doc_id", "path", "statement").agg(F.min("line_no").alias("line_no"))


def normative(pathed: DataFrame, found: DataFrame, signals: str) -> DataFrame:
    """Prose sentences with a signal word, of documents that gave no other claim (found: doc_id)."""
    s = pathed.where("kind = 'prose'").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return s.select("doc_id", "line_no", F.posexplode(F.split("line", r"(?<=[.!?])\s+", -1)).alias("position", "sentence")).where(F.col("sentence").rlike(signals))
