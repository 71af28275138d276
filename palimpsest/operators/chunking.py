"""Heading-aware chunks of Markdown: prose by paragraphs up to a size, tables apart with their header repeated.

The cutter carries state through a document (open headings, the chunk under way, where a statement may be cut), so it is
one pass in an Arrow function; documents are independent and are not shuffled. All work is on offsets into the body, which
every chunk carries, so that it can be found again. A null body has no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.operators.extraction import FIELD, ITEM, PIPE, SEPARATOR, UNFINISHED

LIMIT = 1200
Span = tuple[int, int]
CHUNK = "doc_id long, chunk_no int, path string, kind string, text string, start int, end int, n_tokens int"
_HEADING, _ITEM, _FIELD, _PIPE, _SEPARATOR = map(re.compile, (r"(#{1,6})\s+(.+)$", ITEM, FIELD, PIPE, SEPARATOR))


def trimmed(text: str, start: int, end: int) -> Span:
    inner = text[start:end]
    left = len(inner) - len(inner.lstrip())
    return start + left, max(start + left, start + len(inner.rstrip()))


def line_spans(text: str, start: int, end: int) -> list[Span]:
    out, at = [], start
    while at <= end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        out.append((at, stop))
        at = stop + 1
    return out


def sections(text: str) -> Iterator[tuple[str, Span]]:
    """(heading path, span of the trimmed text under it), in order."""
    stack: list[tuple[int, str]] = []
    begin = 0
    for a, b in [*line_spans(text, 0, len(text)), (len(text), -1)]:
        head = _HEADING.match(text, a, b) if b >= 0 else None
        if not head and b >= 0:
            continue
        path, span = " > ".join(t for _, t in stack), trimmed(text, begin, a)
        if path or span[0] < span[1]:
            yield path, span
        if head:
            level = len(head[1])
            stack = [s for s in stack if s[0] < level] + [(level, head[2].strip())]
            begin = b


def blocks(text: str, span: Span) -> Iterator[tuple[str, list[Span]]]:
    """Runs of lines of a section: ("prose", lines) or ("table", header, separator, rows)."""
    lines, prose, i = line_spans(text, *span), [], 0
    row = lambda k: k < len(lines) and _PIPE.match(text[slice(*lines[k])])
    while i < len(lines):
        if row(i) and row(i + 1) and _SEPARATOR.match(text[slice(*lines[i + 1])]):
            if prose:
                yield "prose", prose
                prose = []
            j = i
            while row(j):
                j += 1
            yield "table", lines[i:j]
            i = j
        else:
            prose.append(lines[i])
            i += 1
    if prose:
        yield "prose", prose


def statement_starts(text: str, start: int, end: int) -> Iterator[int]:
    """Where items and fields begin; an indented field under an item does not."""
    under_item = False
    for a, b in line_spans(text, start, end):
        line = text[a:b]
        if _ITEM.match(line):
            under_item = True
            yield a
        elif _FIELD.match(line.strip()) and not (under_item and line[:1].isspace()):
            under_item = False
            yield a


def cut(text: str, start: int, limit: int) -> int:
    """Where to end a piece of a paragraph that is too long: before the last statement, else at a line's end, else after a
    sentence or word, each past half of the limit; and not behind a word that cannot end a sentence."""
    end, half = start + limit, start + limit // 2
    starts = [a for a in statement_starts(text, start, end) if a > half]
    newline = text.rfind("\n", start, end)
    word = text.rfind(" ", start, end)
    if starts:
        end = starts[-1]
    elif newline > half:
        end = newline
    elif word > half:
        end = word + 1
    last = None
    for last in re.finditer("[A-Za-z]+", text[start:end]):
        pass
    if last and last[0].lower() in UNFINISHED:
        space = text.rfind(" ", start, start + last.start())
        if space > half:
            end = space
    return end


def paragraphs(text: str, start: int, end: int) -> Iterator[Span]:
    at = start
    while at <= end:
        stop = text.find("\n\n", at, end)
        stop = end if stop < 0 else stop
        span = trimmed(text, at, stop)
        if span[0] < span[1]:
            yield span
        at = stop + 2


def prose_chunks(text: str, lines: list[Span], limit: int) -> Iterator[list[Span]]:
    """Chunks as the spans they join: whole paragraphs while they fit, long ones cut."""
    start, end = lines[0][0], lines[-1][1]
    if end - start <= limit:
        yield [(start, end)]
        return
    held: list[Span] = []
    for a, b in paragraphs(text, start, end):
        while b - a > limit:
            if held:
                yield held
                held = []
            stop = cut(text, a, limit)
            yield [trimmed(text, a, stop)]
            a = trimmed(text, stop, b)[0]
        if held and sum(y - x + 2 for x, y in held) + b - a > limit:
            yield held
            held = []
        if a < b:
            held.append((a, b))
    if held:
        yield held


def row_cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def read_out(names: list[str], row: list[str]) -> str:
    """`label: column: value; ...`; a value without a column's name is left out."""
    told = "; ".join(f"{n}: {v}" for n, v in zip(names[1:], row[1:], strict=False) if n and v)
    return f"{row[0]}: {told}" if row[0] and told else row[0] or told


def table_chunks(text: str, lines: list[Span], limit: int) -> Iterator[tuple[str, Span]]:
    """Header, rows as written and rows read out, with the rows' span; as many rows as fit, one at least."""
    head, names = text[lines[0][0] : lines[1][1]], row_cells(text[slice(*lines[0])])
    group: list[tuple[Span, str]] = []
    size = len(head)

    def closed() -> tuple[str, Span]:
        return "\n".join([head, *[text[slice(*s)] for s, _ in group], *[t for _, t in group]]), (group[0][0][0], group[-1][0][1])

    for span in lines[2:]:
        told = read_out(names, row_cells(text[slice(*span)]))
        more = span[1] - span[0] + len(told) + 2
        if group and size + more > limit:
            yield closed()
            group, size = [], len(head)
        group.append((span, told))
        size += more
    if group:
        yield closed()


def chunks(text: str, limit: int = LIMIT) -> Iterator[tuple[str, str, str, int, int]]:
    """(path, kind, text, start, end) of each chunk."""
    for path, span in sections(text):
        for kind, lines in blocks(text, span):
            if kind == "table":
                for out, (a, b) in table_chunks(text, lines, limit):
                    yield path, kind, out, a, b
            elif path or text[lines[0][0] : lines[-1][1]].strip():
                for spans in prose_chunks(text, lines, limit):
                    yield path, kind, "\n\n".join(text[a:b] for a, b in spans), spans[0][0], spans[-1][1]


def markdown_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, body -> CHUNK: start and end are offsets (code points) into the body; n_tokens is a fourth of the length.

    Ids are numbers or strings, and stay what they are.
    """
    named = docs.schema["doc_id"].dataType == StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string() if named else pa.int64()), ("chunk_no", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32())])
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(doc, i, *c, max(1, len(c[2]) // 4)) for i, c in enumerate(chunks(body, limit))] if body else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    kind = "string" if named else "long"
    return docs.select(F.col("doc_id").cast(kind), F.col("body").cast("string")).mapInArrow(run, CHUNK.replace("doc_id long", f"doc_id {kind}"))


def heading_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, body -> doc_id, chunk_no, text: the simple chunker. A line that starts with # opens a chunk, and so does one
    that would make it longer than the limit."""

    def split(body: str) -> list[str]:
        out: list[list[str]] = [[]]
        size = 0
        for line in body.split("\n"):
            if line.startswith("#"):
                out.append([line])
                size = len(line)
                continue
            size += len(line) + 1
            if size > limit and out[-1]:
                out.append([])
                size = len(line)
            out[-1].append(line)
        return [t for t in ("\n".join(c).strip() for c in out) if t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split(body or "")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["doc_id", "chunk_no", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("body").cast("string")).mapInArrow(run, "doc_id long, chunk_no int, text string")
