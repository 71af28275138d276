"""Whether an answer is about the question's subject, hints of near-duplicate statements, and parts without an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import gates
from palimpsest.operators.relevance import overlap_above, small, subject_terms, term_index

# A strong answer, how far below the best the subject's best may lie, and from which share of the corpus on a
# subject is its own topic; words that are too general to stand for a subject.
STRONG, RATIO, SHARE = 0.65, 0.80, 0.01
GENERIC = "raw kb default backend public sdk mb head embed embedd size bundle value current status claim source document path size gzip gzipp".split()
HINT, HINTS = 0.60, 3


def subject_gates(subjects: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """question_id, subject; doc_id, text; question_id, doc_id, score -> gate: why the question abstains, or null.

    subject_absent: no document has any of its subject's terms; distinctive_absent: those it has are general, and one that it
    lacks is long or short enough and no variant of a known term (a shared beginning of four letters and of all but one of the
    shorter); subject_not_the_answer: the subject is rare and its best document scores far below the best. The first two are
    asked only where no document answers strongly.
    """
    asked = subjects.select("question_id", F.explode(subject_terms(F.col("subject"))).alias("term"))
    wanted = small(asked.select("term").distinct())
    # variants share their first four letters: texts are read once, for terms that begin as one of the subjects' does
    heads = small(asked.select(F.substring("term", 1, 4).alias("head")).distinct())
    words = docs.select("doc_id", F.explode(subject_terms(F.col("text"))).alias("term"))
    words = durable(words.withColumn("head", F.substring("term", 1, 4)).join(heads, "head", "left_semi"))
    postings = words.select("doc_id", "term").join(wanted, "term", "left_semi")
    known = postings.select("term").distinct().withColumn("known", F.lit(True))
    n_docs = docs.count()
    terms = asked.join(known, "term", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    absent = terms.where("not known").select(F.col("term").alias("gone"), F.substring("term", 1, 4).alias("head")).distinct()
    vocabulary = words.select("head", "term").distinct()
    shared = F.greatest(F.lit(4), F.least(F.length("gone"), F.length("term")) - 1)
    same = (F.length("gone") >= shared) & (F.length("term") >= shared) & (F.col("gone").substr(F.lit(1), shared) == F.col("term").substr(F.lit(1), shared))
    varied = absent.join(vocabulary, "head").where(same).select(F.col("gone").alias("term"), F.lit(True).alias("varied")).distinct()
    telling = ~F.col("known") & F.col("varied").isNull() & ((F.length("term") <= 3) | (F.length("term") >= 6))
    per = terms.join(varied, "term", "left").groupBy("question_id").agg(F.count_if("known").alias("present"), F.count_if(F.col("known") & ~F.col("term").isin(*GENERIC)).alias("special"), F.max(telling).alias("telling"))
    about = postings.join(small(asked), "term").select("question_id", "doc_id").distinct()
    held = about.join(scores, ["question_id", "doc_id"], "left").groupBy("question_id").agg(F.count("*").alias("n_about"), F.max("score").alias("best_about"))
    best = scores.groupBy("question_id").agg(F.max("score").alias("best"))
    j = subjects.select("question_id").join(per, "question_id", "left").join(best, "question_id", "left").join(held, "question_id", "left")
    top = F.coalesce("best", F.lit(0.0))
    gate = (
        F.when((top < STRONG) & (F.col("present") == 0), "subject_absent").when((top < STRONG) & (F.col("special") == 0) & F.col("telling"), "distinctive_absent")
        .when((F.col("n_about") / F.lit(max(n_docs, 1)) < SHARE) & (F.col("best_about") > 0) & (F.col("best_about") < top * RATIO), "subject_not_the_answer")
    )
    return j.select("question_id", gate.alias("gate"))


def coverage_order(scores: DataFrame, coverage: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of a question by their best claim's score x (1 + share of the whole question that the claim covers).

    scores and coverage: question_id, doc_id, score; keys: doc_id, key.
    """
    covered = coverage.select("question_id", "doc_id", F.col("score").alias("_c"))
    adjusted = F.col("score") * (1 + F.coalesce("_c", F.lit(0.0)))
    j = scores.join(covered, ["question_id", "doc_id"], "left").join(keys, "doc_id")
    return j.groupBy("question_id", "key").agg(F.round(F.max(adjusted), 6).alias("score"))


def duplicate_hints(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """statement_id, text; claim_id, claim -> for each statement the three live claims that say most of it, if they say enough."""
    return hints(statements, term_index(claims.select(F.col("claim_id").alias("doc_id"), F.col("claim").alias("text"))))


def hints(statements: DataFrame, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """duplicate_hints against an index of the claims (their ids as doc_id)."""
    scores = overlap_above(statements.select(F.col("statement_id").alias("question_id"), "text"), index, HINT)
    near = gates.shortlist(scores, "question_id", "doc_id", HINTS)
    return near.select(F.col("question_id").alias("statement_id"), F.col("doc_id").alias("claim_id"), "score", "rank")


def unmatched_parts(parts: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """question_id, part, text; scores by part_id = question_id/part -> the parts that nothing answers."""
    won = scores.where(F.col("score") >= least).select(F.col("question_id").alias("part_id")).distinct()
    return parts.withColumn("part_id", F.concat_ws("/", "question_id", "part")).join(won, "part_id", "left_anti").select("question_id", "part")


def with_headings(docs: DataFrame) -> DataFrame:
    """doc_id, text, heading -> the words of a claim and of its section: what a question is held against, not what terms are counted in."""
    return docs.withColumn("text", F.concat_ws(" ", "text", "heading"))


def contextual_scores(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """overlap_scores against text and heading, weighed by the frequencies of the texts alone."""
    asked = questions.select("question_id", F.explode(subject_terms(F.col("text"))).alias("term"))
    wanted = small(asked.select("term").distinct())
    own = docs.select("doc_id", F.explode(subject_terms(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    n_docs = docs.count()
    idf = F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = asked.join(df, "term", "left").select("question_id", "term", idf.alias("idf"))
    total = weighed.withColumn("total", F.sum("idf").over(Window.partitionBy("question_id")))
    held = with_headings(docs).select("doc_id", F.explode(subject_terms(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    hits = held.join(small(total), "term").groupBy("question_id", "doc_id").agg(F.round(F.sum("idf") / F.max("total"), 6).alias("score"))
    return hits
