"""Quality classifier: an interpolated modified Kneser-Ney n-gram model trained on trusted text.

Tokens are the UTF-16 units of the text (digits as one unit, white space as another), so that every script is told apart
as finely as Latin letters; a gram of ORDER = 3 units is one 64-bit number. Counting and scoring are joins over shards:
trusted texts give (model, gram, count) rows, which Spark sums and turns into discounted probabilities and back-off
weights for each order; documents become blocks of some megabytes of one model, each block asks once for its distinct
grams, a join with the count tables answers, and the block adds up the perplexity of its documents. No table of the model
passes the driver or is broadcast. A document is accepted where its perplexity lies between two quantiles of the trusted
documents of its language and length class, widened by `slack`.

Trusted documents: labelled quality 1 and not toxic. Models are trained on about `most` a language at most, by hash of
doc_id; the quantiles are those of all trusted documents, each scored by a model that was trained without its fold, in
bins of BIN nats (so that they do not depend on how rows are split). A null language uses the model and quantiles of all
languages, as does the score of a language with fewer than `least` trusted documents, which is accepted whatever its
score: other languages' limits say nothing of it. A null or empty text has no tokens and is rejected; with no trusted
documents at all every other document is accepted. Discounts that counts of counts do not give (a zero among them) are
half a count, so every probability is above zero. Repeated rows are judged each; extra columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import binary_values, materialize, slices, small, temporary

ORDER, UNITS = 3, 1 << 16
MAX_TRUSTED, LEAST, FOLDS = 5_000, 30, 2
LOW, HIGH, SLACK, BIN = 0.002, 0.99, 0.02, 0.001
LENGTHS = (16, 64, 256, 1024)
ALL, WHOLE = "", "all"
BLOCK_BYTES, OPEN_BYTES = 8 << 20, 32 << 20
EDGES = ("￾", "￿")  # before and after a text: never characters


def _units() -> np.ndarray:
    t = np.arange(UNITS, dtype=np.uint16)
    t[:33], t[0x85], t[0xA0] = 32, 32, 32
    t[48:58] = 48
    return t


FOLDED = _units()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram of every position of all texts, with each text's first gram and number of grams (its end included)."""
    joined = "".join(f"{EDGES[0] * (ORDER - 1)}{t.decode('utf-8', 'replace')}{EDGES[1]}" for t in texts).encode("utf-16-le")
    u = FOLDED[np.frombuffer(joined, "<u2")]
    ends = np.flatnonzero(u == ord(EDGES[1])) if EDGES[1] not in b"".join(texts).decode("utf-8", "replace") else None
    if ends is None:  # a text holds the edge's own number
        ends = np.cumsum([len(t.decode("utf-8", "replace").encode("utf-16-le")) // 2 + ORDER for t in texts]) - 1
    u = u.astype(np.int64)
    key = u[: len(u) - ORDER + 1].copy()
    for i in range(1, ORDER):
        key = (key << 16) | u[i : len(u) - ORDER + 1 + i]
    begins = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    return key, begins, ends - begins - ORDER + 2


def own(key: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Without the grams that run from one text into the next."""
    edge = np.zeros(len(key) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return key[np.cumsum(edge[:-1]) > 0]


def model_id(name: str) -> int:
    return xxhash.xxh64_intdigest(name) - (1 << 63)


def count_grams(trusted: DataFrame) -> DataFrame:
    """model, text, fold -> (m, g, n) of each model and of ALL, whole and without each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[str, list[bytes]] = {}
            for model, text, fold in zip(batch.column(0).to_pylist(), binary_values(batch, 1), batch.column(2).to_pylist(), strict=True):
                for name in {model, ALL} if text else ():
                    for part in (WHOLE, *(f for f in range(FOLDS) if f != fold)):
                        by.setdefault(f"{name}/{part}", []).append(text)
            for name, texts in by.items():
                g, n = np.unique(own(*grams(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), model_id(name))), pa.array(g), pa.array(n)], ["m", "g", "n"])

    return trusted.select("model", "text", "fold").mapInArrow(run, "m long, g long, n long").groupBy("m", "g").agg(F.sum("n").alias("n"))


def last(k: int):
    """The last k units of g."""
    return F.col("g") if k == ORDER else F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1))


def context(k: int):
    """All but the last of the last k units of g."""
    return F.shiftrightunsigned(last(k), 16)


def model_tables(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order k: (m, g, alpha) discounted probabilities and (m, h, beta) back-off weights of contexts."""
    level = materialize(counts)
    tables = {}
    for k in range(ORDER, 0, -1):
        of = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        sound = F.col("n1") * F.col("n2") * F.col("n3") * F.col("n4") > 0
        d = [F.when(sound, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(0.5).alias(f"d{i}") for i in (1, 2, 3)]
        discounts = level.groupBy("m").agg(*of).select(F.col("m").alias("_m"), *d)
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(discounts, F.col("m") == F.col("_m")).select("m", "g", "n", context(k).alias("h"), cut.alias("cut"))
        contexts = rows.groupBy("m", "h").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("beta"))
        contexts = materialize(contexts, keep=True)
        alpha = rows.join(contexts.select("m", "h", "total"), ["m", "h"]).select("m", "g", ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"))
        tables[k] = materialize(alpha, keep=True), contexts.select("m", "h", "beta")
        if k > 1:  # continuation counts: how many units a shorter gram follows
            level = materialize(level.groupBy("m", last(k - 1).alias("g")).agg(F.count("*").alias("n")))
    return tables


def probabilities(asked: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Distinct (m, g) -> (m, g, x), the natural log of the gram's interpolated probability."""
    wanted = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("m", last(k).alias("g")).distinct()
    below = None
    for k in range(1, ORDER + 1):
        alpha, beta = tables[k]
        rows = wanted[k].join(alpha, ["m", "g"], "left").withColumn("h", context(k)).join(beta, ["m", "h"], "left")
        if below is None:
            rows, lower = rows, F.lit(1.0 / UNITS)
        else:
            rows = rows.withColumn("s", last(k - 1)).join(below.select("m", F.col("g").alias("s"), F.col("p").alias("lower")), ["m", "s"])
            lower = F.col("lower")
        below = rows.select("m", "g", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("beta", F.lit(1.0)) * lower).alias("p"))
        if k < ORDER:
            below = materialize(below)
    return below.select("m", "g", F.log("p").alias("x"))


def blocks(rows: DataFrame) -> DataFrame:
    """_row, _text, _model -> blocks: the texts of one model (compressed), their sizes (-1: null) and rows."""
    row_type = rows.schema["_row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[list[pa.Array], list[bytes | None], list[int]]] = {}
        pack = zstandard.ZstdCompressor(level=5).compress

        def flush(model: str) -> pa.RecordBatch:
            nonlocal number
            structs, texts, _ = held.pop(model)
            number += 1
            whole = pa.concat_arrays(structs)
            sizes = [-1 if t is None else len(t) for t in texts]
            listed = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([model]), pa.array([pack(b"".join(t or b"" for t in texts))]), pa.array([sizes], pa.list_(pa.int32())), listed], ["block", "model", "texts", "sizes", "rows"])

        for batch in slices(batches):
            texts, models = binary_values(batch, 1), batch.column(2).to_pylist()
            by: dict[str, list[int]] = {}
            for i, model in enumerate(models):
                by.setdefault(model, []).append(i)
            for model, at in by.items():
                structs, own_texts, size = held.setdefault(model, ([], [], [0]))
                structs.append(batch.column(0).take(pa.array(at)))
                own_texts += [texts[i] for i in at]
                size[0] += sum(len(texts[i] or b"") + 64 for i in at)
                if size[0] >= BLOCK_BYTES:
                    yield flush(model)
            while sum(h[2][0] for h in held.values()) > OPEN_BYTES:
                yield flush(max(held, key=lambda m: held[m][2][0]))
        for model in sorted(held):
            yield flush(model)

    return rows.mapInArrow(run, StructType([StructField("block", LongType()), StructField("model", StringType()), StructField("texts", BinaryType()), StructField("sizes", ArrayType(IntegerType())), StructField("rows", ArrayType(row_type))]))


def unpacked(texts: bytes, sizes: list[int]) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(texts), 0, []
    for n in sizes:
        out.append(data[at : at + max(n, 0)])
        at += max(n, 0)
    return out


PART = 1 << 20  # bytes of a block whose grams are held at once


def parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts with some length, of about PART bytes (one text at least)."""
    at: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            size += len(t)
        if size >= PART:
            yield at, [texts[j] for j in at]
            at, size = [], 0
    if at:
        yield at, [texts[j] for j in at]


def score(rows: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """_row, _text, _model -> _row, _text, model, n_tokens, log_prob (natural) and perplexity."""
    table = materialize(blocks(rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, model, texts, sizes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = [np.unique(own(*grams(some))) for _, some in parts(unpacked(texts, sizes))]
                g = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(np.full(len(g), model_id(model))), pa.array(g)], ["block", "m", "g"])

    asked = materialize(table.select("block", "model", "texts", "sizes").mapInArrow(ask, "block long, m long, g long"))
    answers = asked.join(materialize(probabilities(asked.select("m", "g").distinct(), tables)), ["m", "g"]).select("block", "g", "x")
    row_type = rows.schema["_row"].dataType

    def add_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(g := answers.column("g").to_numpy())
        g, x = g[order], answers.column("x").to_numpy()[order]
        sizes = block.column("sizes").to_pylist()[0]
        texts = unpacked(block.column("texts").to_pylist()[0], sizes)
        n, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for at, some in parts(texts):
            key, first, count = grams(some)
            each = x[np.minimum(np.searchsorted(g, key), len(g) - 1)]
            inside = np.zeros(len(key) + 1, np.int64)
            np.add.at(inside, first, 1)
            np.add.at(inside, first + count, -1)
            n[at], logs[at] = count, np.add.reduceat(np.where(np.cumsum(inside[:-1]) > 0, each, 0.0), first)
        whole = block.column("rows").combine_chunks()
        structs = (whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole).flatten()
        given = pa.array([None if s < 0 else t for t, s in zip(texts, sizes, strict=True)], pa.binary()).cast(pa.string())
        names = pa.array([block.column("model").to_pylist()[0]] * len(texts), pa.string())
        return pa.table([structs, given, names, pa.array(n), pa.array(logs), pa.array(np.exp(-logs / np.maximum(n, 1)), mask=n == 0)], names=["_row", "_text", "model", "n_tokens", "log_prob", "perplexity"])

    schema = StructType([StructField("_row", row_type), StructField("_text", StringType()), StructField("model", StringType()), StructField("n_tokens", LongType()), StructField("log_prob", DoubleType()), StructField("perplexity", DoubleType())])
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)


def trusted_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED, least: int = LEAST) -> DataFrame:
    """lang, model, text, fold and sampled (about `most` a language at most, by hash) of every trusted document."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_trusted")).distinct()
    good = small(materialize(good))
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = text.join(good, F.col("_id") == F.col("_trusted"), "left_semi")
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = materialize(found.groupBy("lang").agg(F.count("*").alias("_n")).withColumnRenamed("lang", "_l"))  # written, so that Spark knows its size
    named = F.when(F.col("lang").isNotNull() & (F.col("_n") >= least), F.col("lang")).otherwise(F.lit(ALL))
    return found.join(sizes, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", named.alias("model"), "text", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), (share * F.col("_n") < most).alias("sampled"))


def length_class():
    out = F.lit(0)
    for edge in LENGTHS:
        out = out + (F.col("n_tokens") >= edge).cast("int")
    return out


def thresholds(trusted: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], low: float = LOW, high: float = HIGH, slack: float = SLACK, least: int = LEAST) -> DataFrame:
    """(model, class) -> low and high log perplexity of all trusted documents, n; null class: all lengths, null model: all.

    Groups of fewer than `least` are left out. The quantiles are ends of bins of BIN nats.
    """
    rows = trusted.select(F.struct("model").alias("_row"), F.col("text").alias("_text"), F.concat("model", F.lit("/"), "fold").alias("_model"))
    scored = score(rows, tables).where("n_tokens > 0").select(F.col("_row.model").alias("model"), length_class().alias("class"), F.floor(F.log("perplexity") / BIN).alias("bin"))
    levels = F.explode(F.array(F.struct("model", "class"), F.struct("model", F.lit(None).cast("int").alias("class")), F.struct(F.lit(None).cast("string").alias("model"), F.lit(None).cast("int").alias("class"))))
    bins = materialize(scored.groupBy("model", "class", "bin").agg(F.count("*").alias("n")).select(levels.alias("of"), "bin", "n").groupBy("of", "bin").agg(F.sum("n").alias("n")))
    upto = Window.partitionBy("of").orderBy("bin")
    sums = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("of")))
    edge = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin")))
    found = sums.groupBy("of").agg((edge(low) * BIN - slack).alias("low"), ((edge(high) + 1) * BIN + slack).alias("high"), F.max("total").alias("n"))
    return found.where((F.col("n") >= least) | F.col("of.model").isNull()).select("of.*", "low", "high", "n")


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED, keep: list[str] | None = None, **quantiles) -> DataFrame:
    """_row (the columns of keep, without text, as c0, c1 and so on), _text, model, n_tokens, log_prob, perplexity, low, high
    (of perplexity) and accepted."""
    least = quantiles.get("least", LEAST)
    with temporary():  # the trusted texts and what scores them are not needed beyond the limits
        trusted = materialize(trusted_documents(docs, labels, most, least))
        tables = model_tables(count_grams(trusted.where("sampled")))
        limits = materialize(thresholds(trusted, tables, **quantiles), keep=True)
        named = materialize(trusted.where(F.col("model") != ALL).select(F.col("model").alias("_named")).distinct(), keep=True)
    columns = [c for c in keep or docs.columns if c != "text"]
    lang = F.col("lang").cast("string")
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)], lang.alias("lang"))
    rows = docs.select(row.alias("_row"), F.col("text").cast("string").alias("_text"), lang.alias("_lang"))
    rows = rows.join(named, F.col("_lang") == F.col("_named"), "left").select("_row", "_text", F.concat(F.coalesce("_named", F.lit(ALL)), F.lit(f"/{WHOLE}")).alias("_model"))
    out = score(rows, tables).withColumn("model", F.expr(f"substring(model, 1, length(model) - {len(WHOLE) + 1})")).withColumn("_k", length_class())
    levels = [(limits.where("class is not null and model is not null"), ["model", "_k"]), (limits.where("class is null and model is not null"), ["model"]), (limits.where("class is null and model is null"), [])]
    for i, (level, on) in enumerate(levels):
        level = level.select(F.col("model").alias("_m"), F.col("class").alias("_c"), F.col("low").alias(f"_low{i}"), F.col("high").alias(f"_high{i}"))
        match = {0: F.lit(True), 1: F.col("model") == F.col("_m"), 2: (F.col("model") == F.col("_m")) & (F.col("_k") == F.col("_c"))}[len(on)]
        out = out.join(F.broadcast(level) if not on else level, match, "left").drop("_m", "_c")  # without keys: one row
    low, high = F.coalesce("_low0", "_low1", "_low2"), F.coalesce("_high0", "_high1", "_high2")
    x = F.log("perplexity")
    unmodelled = (F.col("model") == ALL) & (F.coalesce(F.col("_row.lang"), F.lit(ALL)) != ALL)
    ok = (F.col("n_tokens") > 0) & (unmodelled | F.coalesce(x.between(low, high), F.lit(True)))
    return out.select("_row", "_text", "model", "n_tokens", "log_prob", "perplexity", F.exp(low).alias("low"), F.exp(high).alias("high"), ok.alias("accepted"))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, model, n_tokens, log10_prob, perplexity, low, high, accepted."""
    c = classify(docs, labels, keep=["doc_id"])
    return c.select(F.col("_row.c0").cast("long").alias("doc_id"), F.col("_row.lang").alias("lang"), "model", "n_tokens", (F.col("log_prob") / float(np.log(10))).alias("log10_prob"), "perplexity", "low", "high", "accepted")


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    others = iter(range(len(docs.columns)))
    columns = [F.col("_text").alias(c) if c == "text" else F.col(f"_row.c{next(others)}").alias(c) for c in docs.columns]
    return classify(docs, labels).where("accepted").select(*columns)
