"""A directory as a source: its files scanned, read by their formats, and made the content of a stored index.

The index has two stored tables (see operators.merges): documents by corpus and path, and their chunks. A sync is one batch of
each. The chunks are replaced by what the documents' batch did, as it was committed, so a job that dies between the two is
run again with the same number: the first table then does nothing and the second is brought up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import chunking, frontmatter, merges, texts
from palimpsest.operators.relevance import small

# The formats by extension, the closed set of document types and the one for all others.
MARKDOWN, PLAIN, JSON, TYPES, OTHER = ("md", "markdown"), "txt", "json", ("kaggle", "project", "note", "paper"), "note"
DOCUMENTS = "corpus_id string, path string, id string, hash string, title string, document_type string, tags array<string>, summary string, body string"
CHUNKS = "corpus_id string, path string, order_index int, heading_path string, text string"
KEYS = ("corpus_id", "path")


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """All files below a directory whose names match: path (relative to it), content (bytes).

    Spark's reader leaves out files without a byte, so an empty file counts as absent.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.substr(F.col("path"), F.lit(len(whole.rstrip("/")) + 2)).alias("path"), "content")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case, without its dot; empty for a name that only begins with one."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"^(.+)\.[^.]+$", "$1")


def _texts(files: DataFrame) -> DataFrame:
    """path, kind (the extension), raw (the text), reason (why it is not read)."""
    kind, text = extension(F.col("path")), F.try_validate_utf8(F.col("content").cast("string"))
    reason = F.when(~kind.isin(*MARKDOWN, PLAIN, JSON, *texts.LANGUAGES), "unsupported").when(text.isNull(), "not_utf8")
    raw = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    return files.select("path", kind.alias("_kind"), raw.alias("raw"), reason.alias("reason"))


def rejected(files: DataFrame) -> DataFrame:
    """(path, content) -> path, reason of the files that dispatch() does not read."""
    return _texts(files).select("path", "reason").where("reason is not null")


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) -> documents (path, title, document_type, tags, summary, body) and rejects (path, reason).

    Every file is in one of the two. A file is rejected for an extension that is not read (yaml, docx, pptx and pdf need a
    parser that this library does not hold) or bytes that are not UTF-8; a null content is no UTF-8. Line ends become \\n. A path
    that occurs twice is read twice. Markdown takes what its frontmatter says, and its file's name where it has no title.
    """
    good = _texts(files).where("reason is null")
    name, bare, kind, raw = name_of(F.col("path")), stem(F.col("path")), F.col("_kind"), F.col("raw")
    tag = F.element_at(F.create_map(*[F.lit(x) for pair in texts.LANGUAGES.items() for x in pair]), kind)
    first = F.nullif(texts.strip(F.substring_index(F.ltrim(raw, F.lit(texts.BLANKS)), "\n", 1)), F.lit(""))
    fenced = lambda head, tag: F.concat(F.lit("# "), head, F.lit("\n\n```"), tag, F.lit("\n"), texts.strip(raw), F.lit("\n```\n"))
    plain, json, line = kind == PLAIN, kind == JSON, F.col("_line")
    converted = good.where(~kind.isin(*MARKDOWN)).withColumn("_line", F.when(plain, F.substring(F.coalesce(first, bare), 1, 120))).select(
        "path", F.when(plain, line).when(json, bare).otherwise(F.concat(name, F.lit(" ("), tag, F.lit(")"))).alias("title"), F.lit(OTHER).alias("document_type"),
        F.when(plain, F.array(F.lit("text"))).when(json, F.array(F.lit("json"))).otherwise(F.array(F.lit("code"), tag)).alias("tags"),
        F.when(plain, F.concat(F.lit("Plain text document: "), name)).when(json, texts.json_summary(raw)).otherwise(F.concat(F.lit("Source code file "), name)).alias("summary"),
        F.when(plain, F.concat(F.lit("# "), line, F.lit("\n\n"), texts.strip(raw))).when(json, fenced(bare, F.lit("json"))).otherwise(fenced(name, tag)).alias("body"),
    )
    return converted.unionByName(markdown(good.where(kind.isin(*MARKDOWN)).select("path", "raw"))), rejected(files)


def markdown(files: DataFrame) -> DataFrame:
    """(path, raw) -> documents: title, type, tags (a list, or words between commas) and summary of the frontmatter, and the body.

    The texts are read once for their frontmatter, which is cut off as a small table, and once for their bodies.
    """
    docs = files.withColumn("doc_id", F.sha2(F.concat_ws("\n", "path", "raw"), 256))
    parts = frontmatter.split_documents(docs)
    front = durable(parts.where("block is not null").select("doc_id", "block", frontmatter.heading().alias("heading")).dropDuplicates(["doc_id"]))
    lines = durable(frontmatter.block_lines(front))
    said = durable(frontmatter.fields(lines))
    value = frontmatter.unquoted(F.col("value"))
    of = lambda name, x: F.max(F.when(F.col("field") == name, x))
    listed = F.coalesce(F.transform("items", lambda x: texts.strip(frontmatter.unquoted(x))), F.filter(F.transform(F.split(value, ","), texts.strip), lambda x: x != ""))
    own = said.groupBy("doc_id").agg(of("document_type", value).alias("_type"), of("summary", value).alias("_summary"), of("tags", listed).alias("_tags"))
    readable = front.select("doc_id").join(lines.where("bad").select("doc_id").distinct(), "doc_id", "left_anti").withColumn("_cut", F.lit(True))
    told = readable.join(frontmatter.titles(front, said).drop("odd"), "doc_id", "left").join(own, "doc_id", "left")
    j = docs.join(small(durable(told)), "doc_id", "left")
    kind = F.when(F.col("_type").isin(*TYPES), F.col("_type")).otherwise(OTHER)
    body = texts.strip(F.when(F.col("_cut"), frontmatter.rest()).otherwise(F.col("raw")))
    return j.select("path", F.coalesce("title", stem(F.col("path"))).alias("title"), kind.alias("document_type"), F.coalesce("_tags", F.array().cast("array<string>")).alias("tags"), F.nullif("_summary", F.lit("")).alias("summary"), body.alias("body"))


def _merge(store: str, batch: int, files: DataFrame, corpus: str, delete_removed: bool) -> None:
    index = merges.read(files.sparkSession, f"{store}/documents", DOCUMENTS, batch - 1).where(F.col("corpus_id") == corpus)
    rows = dispatch(files)[0].dropDuplicates(["path"]).select(F.lit(corpus).alias("corpus_id"), "path", F.sha2(F.concat(F.lit(corpus), F.lit(":"), "path"), 256).alias("id"), F.sha2(F.to_json(F.struct("title", "document_type", "tags", "summary", "body")), 256).alias("hash"), "title", "document_type", "tags", "summary", "body", F.lit(False).alias("deleted"))
    if delete_removed:
        gone = index.join(files.select("path"), "path", "left_anti")
        rows = rows.unionByName(gone.select(*rows.columns[:-1]).withColumn("deleted", F.lit(True)))
    merges.merge(f"{store}/documents", batch, rows, KEYS, DOCUMENTS, same=["hash"], keep=["id"])


def ingest(store: str, batch: int, files: DataFrame, corpus: str, delete_removed: bool = True) -> DataFrame:
    """Makes a corpus of the stored index equal to the files (path, content) -> path, outcome: one row a file or removed document.

    added, changed, unchanged, deleted, or failed with its reason. A file that fails leaves what is indexed under its path as it
    was. Documents keep their id; other corpora are not touched; running a batch again changes nothing.
    """
    spark = files.sparkSession
    if batch not in merges.batches(spark, f"{store}/documents"):
        _merge(store, batch, files, corpus, delete_removed)
    done = spark.read.schema(f"{DOCUMENTS}, _outcome string").parquet(f"{store}/documents/data/batch={batch}").where(F.col("corpus_id") == corpus)
    touched = done.where("_outcome in ('added', 'changed', 'deleted')")
    cut = chunking.markdown_chunks(touched.where("_outcome <> 'deleted'").select(F.col("path").alias("doc_id"), "body"))
    chunks = cut.select(F.lit(corpus).alias("corpus_id"), F.col("doc_id").alias("path"), F.col("chunk_no").alias("order_index"), F.col("path").alias("heading_path"), "text")
    merges.replace(f"{store}/chunks", batch, chunks, touched, KEYS, CHUNKS)
    told = done.where("_outcome not in ('kept', 'absent')").select("path", F.col("_outcome").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return told.unionByName(rejected(files).select("path", F.lit("failed").alias("outcome"), "reason"))


def sync_directory(spark: SparkSession, store: str, batch: int, root: str, corpus: str, pattern: str = "*.md", delete_removed: bool = True) -> DataFrame:
    """ingest of all files below a directory."""
    return ingest(store, batch, scan(spark, root, pattern), corpus, delete_removed)
