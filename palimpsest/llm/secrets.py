"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The two first-order models are trained from labelled samples in all documents: what the patterns match is random, every
other run of letters and digits is ordinary. Partial transition counts of each partition are summed by Spark; the
result has at most 2 * 65 * 65 rows, whatever the input. A candidate, any run of CANDIDATE that no pattern took, is a
secret where the log-likelihood ratio of its transitions passes `evidence` in all (the odds against a random run) and
`threshold` on average. The models judge the patterns' own matches as well; these stay whatever they say, and n_confirmed
counts those that they agree with.

Spans are (kind, start, end) in code points, end exclusive. A null or empty text has none. Rows are handled alone, so
repeated rows give repeated results. Without samples both models are uniform and nothing is added.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, with_row_struct

# The patterns of the base scan, in the order of the kinds.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
KINDS = [*PATTERNS, "markov"]
CANDIDATE = re.compile(r"(?<![^\W_])[A-Za-z0-9+/_=-]{12,}(?![^\W_])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
N = len(ALPHABET) + 1  # class 0: the edge of a run
CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET, 1):
    CLASS[ord(_c)] = _i
THRESHOLD, EVIDENCE = 0.5, 14.0  # nats a transition, and in all (odds of about a million)
PRIOR = 10  # samples that each transition starts with in both models, so that few samples are little evidence


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, secret's own start) of the patterns' matches: leftmost and non-overlapping per kind."""
    out = []
    for m in PATTERNS["assign"].finditer(text):
        if m.end() - m.start(2) >= 12:
            out.append((m.start(), "assign", m.end(), m.start(2)))
    out += [(m.start(), "access", m.end(), m.start()) for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end(), m.start()) for m in PATTERNS["hex"].finditer(text)]
    return out


def transitions(data: bytes) -> np.ndarray:
    """Counts of neighbouring classes; what is not of the alphabet is an edge."""
    c = CLASS[np.frombuffer(b" " + data + b" ", np.uint8)]
    return np.bincount(c[:-1] * N + c[1:], minlength=N * N)


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each transition, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, random = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
        for batch in batches:
            found: list[str] = []
            for at in range(0, batch.num_rows, 512):
                texts = [x for x in batch.column(0).slice(at, 512).to_pylist() if x]
                found += [text[own:end] for text in texts for _, _, end, own in base_spans(text)]
                total += transitions(" ".join(texts).encode("utf-8", "replace"))
            random += transitions(" ".join(found).encode())
        for label, counts in ((1, random), (0, np.maximum(total - random, 0))):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label), pa.int64()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["label", "transition", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "label long, transition long, n long").groupBy("label", "transition").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, N * N))
    for r in rows:  # bounded by the alphabet
        counts[r["label"], r["transition"]] += r["n"]
    return log_ratio(counts)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Transition counts of ordinary and random samples -> log-likelihood ratio of each transition."""
    counts = counts.reshape(2, N, N) + float(PRIOR)
    counts[:, 0, 0] = PRIOR
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def scores(candidates: list[str], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each candidate, edges included, in all and a transition."""
    if not candidates:
        return np.empty(0), np.empty(0)
    c = CLASS[np.frombuffer((" " + " ".join(candidates) + " ").encode("utf-8", "replace"), np.uint8)]
    each = ratio[c[:-1], c[1:]]
    n = np.array([len(x.encode("utf-8", "replace")) + 1 for x in candidates])
    total = np.add.reduceat(each, np.cumsum(n) - n)
    return total, total / n


def score(candidate: str, ratio: np.ndarray) -> float:
    """Mean log-likelihood ratio of one candidate."""
    return float(scores([candidate], ratio)[1][0])


def random_looking(candidates: list[str], ratio: np.ndarray, threshold: float, evidence: float) -> np.ndarray:
    total, mean = scores(candidates, ratio)
    return (total >= evidence) & (mean >= threshold)


def untaken(text: str, spans: list[tuple[int, str, int, int]]) -> list[re.Match]:
    """Candidates that overlap no pattern's span."""
    merged: list[list[int]] = []
    for start, _, end, _ in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    starts = [m[0] for m in merged]
    out = []
    for m in CANDIDATE.finditer(text):
        i = bisect.bisect_left(starts, m.end()) - 1
        if i < 0 or merged[i][1] <= m.start():
            out.append(m)
    return out


def judged_spans(text: str | None, ratio: np.ndarray, threshold: float = THRESHOLD, evidence: float = EVIDENCE) -> tuple[list[tuple[int, str, int]], int]:
    """All spans by start, then kind as listed, and how many of the patterns' own the models confirm."""
    if not text:
        return [], 0
    base = base_spans(text)
    found = untaken(text, base)
    added = random_looking([m[0] for m in found], ratio, threshold, evidence)
    confirmed = int(random_looking([text[own:end] for _, _, end, own in base], ratio, threshold, 0.0).sum())
    spans = [s[:3] for s in base] + [(m.start(), "markov", m.end()) for m, yes in zip(found, added.tolist(), strict=True) if yes]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))), confirmed


def secret_spans(text: str | None, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, str, int]]:
    """All spans by start, then kind as listed: the patterns' own and the models'."""
    return judged_spans(text, ratio, threshold)[0]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns, n_added (spans of the models alone) and n_confirmed (the patterns' spans that they agree with)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value in batch.column(1):
            spans, confirmed = judged_spans(value.as_py(), ratio, threshold)
            base = [s for s in spans if s[1] != "markov"]
            n = [sum(s[1] == k for s in spans) for k in KINDS]
            out.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3], confirmed))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "n_confirmed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows_of(one), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_confirmed long")


def redact_secrets(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark in text, and n_chars, if there, counted anew; all other columns stay."""

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for start, _, end in secret_spans(text, ratio, threshold):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join((*out, text[at:])) if out else text

    packed = with_row_struct(docs, F.col("text").cast("string").alias("_text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(x.as_py()) for x in batch.column(1)], pa.string())], ["_row", "_text"])

    cleaned = packed.mapInArrow(rows_of(one), packed.schema)
    fresh = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        same = F.col("_text").eqNullSafe(F.col("_row.text").cast("string"))
        fresh["n_chars"] = F.when(same, F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[fresh[c].alias(c) if c in fresh else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
