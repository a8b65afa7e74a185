"""Token-budget chunking: an Arrow-batched scan per document, as packing is a sequential fold."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.ingest import number

# What counts as a token, a paragraph and a sentence.
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PARAGRAPH = re.compile(r"\S.*?(?=\n\s*\n|$)", re.DOTALL)
_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s+|$)|\n{2,}|$)", re.DOTALL)
_CHUNK = "chunk_index int, char_start int, char_end int, content string"
SCHEMA = f"doc_id long, {_CHUNK}"
PAGE_SCHEMA = f"doc_id long, page long, {_CHUNK}"
#: Characters of chunks that a task holds before it gives them out.
CHARS = 1 << 20


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    text: str

    @cached_property
    def tokens(self) -> int:
        return len(_TOKEN.findall(self.text))


def spans(pattern: re.Pattern, text: str, shift: int = 0) -> list[Span]:
    found = [Span(m.start() + shift, m.end() + shift, m.group().strip()) for m in pattern.finditer(text)]
    return [s for s in found if s.text]


def pack(units: list[Span], budget: int, carry: Callable[[list[Span]], list[Span]], join: Callable[[list[Span]], Span], too_long: Callable[[Span], list[Span]] | None) -> Iterator[Span]:
    """Units in order, joined while they fit; ``carry`` says what a closed chunk repeats in the next.

    A carried overlap that leaves no room for the next unit is a chunk of its own. A unit
    over the budget closes the chunk and is split by ``too_long``.
    """
    held: list[Span] = []
    for u in units:
        if too_long is not None and u.tokens > budget:
            if held:
                yield join(held)
            held = []
            yield from too_long(u)
            continue
        for keep in (carry, lambda _: []):
            if held and sum(h.tokens for h in held) + u.tokens > budget:
                yield join(held)
                held = keep(held)
        held = [*held, u]
    if held:
        yield join(held)


def chunk_text(text: str, budget: int = 256, overlap: int = 1) -> list[Span]:
    """Chunks of a cleaned text; offsets refer to it."""
    last = lambda held: held[len(held) - overlap :] if overlap > 0 else []
    blank = lambda held: Span(held[0].start, held[-1].end, " ".join(h.text for h in held))
    sliced = lambda held: Span(held[0].start, held[-1].end, text[held[0].start : held[-1].end].strip())

    def words(s: Span) -> list[Span]:
        units = [Span(s.start + m.start(), s.start + m.end(), m.group()) for m in re.finditer(r"\S+", s.text)]
        out, held, n = [], [], 0
        for u in units:
            if held and n + u.tokens > budget:
                out.append(blank(held))
                held = last(held)
                n = sum(h.tokens for h in held)
            held = [*held, u]
            n += u.tokens
        return [*out, blank(held)] if held else out

    def paragraph(p: Span) -> list[Span]:
        return list(pack(spans(_SENTENCE, p.text, p.start), budget, last, blank, words))

    tail = lambda held: last(held) if len(held) > 1 else []
    return [c for c in pack(spans(_PARAGRAPH, text), budget, tail, sliced, paragraph) if c.text.strip()]


def _chunked(keys: list[str], budget: int, overlap: int):
    """Chunks of batches of (keys, text), a text at a time, given out as soon as they are ``CHARS`` characters."""
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("chunk_index", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            own, texts = [b.column(k) for k in keys], b.column("text")
            for at in range(b.num_rows):
                key = [c[at].as_py() for c in own]
                for k, c in enumerate(chunk_text(texts[at].as_py() or "", budget, overlap)):
                    rows.append((*key, k, c.start, c.end, c.text.strip()))
                    held += len(rows[-1][-1])
                    if held > CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def chunk_documents(docs: DataFrame, budget: int = 256, overlap: int = 1) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, content) of (doc_id, text); no shuffle."""

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.clean_text(F.col("text")).alias("text")).mapInArrow(_chunked(["doc_id"], budget, overlap), SCHEMA)


def chunk_pages(pages: DataFrame, budget: int = 256, overlap: int = 1) -> DataFrame:
    """(doc_id, page, chunk_index, char_start, char_end, content) of (doc_id, page, text).

    The index runs on over the pages of a document, blank ones have no chunk, and offsets
    are those of the page. Chunks are numbered over the whole table, less the first number
    of their document, so a document of very many pages needs no task of its own.
    """

    made = pages.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "page")), T.clean_text(F.col("text")).alias("text")).mapInArrow(_chunked(["doc_id", "page"], budget, overlap), PAGE_SCHEMA)
    rows = number(made, ["doc_id", "page", "chunk_index"])
    first = rows.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("n").alias("_first"))
    index = (F.col("n") - F.col("_first")).cast("int").alias("chunk_index")
    return rows.join(first, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "page", index, "char_start", "char_end", "content")
