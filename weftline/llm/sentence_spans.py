"""Substring deduplication by sliding sentence spans.

From every sentence on, the run of consecutive sentences that just reaches ``min_words``
words is hashed (96 bits), and so is the last such run that ends with the text. The hashes
are joined over the whole corpus, and sentences covered by a run whose first occurrence
lies elsewhere are removed. The first occurrence is the one in the smallest doc_id, and the
earliest there. Words are what ASCII white space divides. A sentence
ends at ``.``, ``!`` or ``?`` before white space and at a line end; one of over ``LONG``
words is cut at its commas, semicolons and colons too, and a clause of over ``LONG`` words
before the word of least hash (the last of equals) of every ``NEAR`` consecutive words, so
that a passage pasted into running text has whole sentences of its own.

With the defaults a passage of 50 words with the same line ends is caught wherever it is
pasted: at most ``LONG`` words at either end share a sentence with other text and stay, so
36 words or more are whole sentences, and a run that just reaches 30 words has at most 36.
Behind its last run fewer words than one sentence may stay. Repeats of fewer than
``min_words`` words are never touched.

Scale: only (hash, doc_id) rows of 28 bytes are grouped, counted where they lie first; a
bounded Bloom filter of the repeated hashes then holds back every run that occurs once,
and the exact join meets the rest (a hot passage is a hot key of a plain equi-join, which
adaptive execution splits). The covered runs of a document are one short list. Texts move
only for documents that lose a sentence; all others never pass through Python again.

Defined results: null text stays null and a blank text stays as it is; texts are read
whole; a document of fewer than ``min_words`` words has no run; runs repeated inside one
document lose all but the first; rows that repeat an id and a text are one document and
are cut alike, those that repeat an id with another text are cut by their own text, but a
run they share is first in both; null ids are never changed and never a first occurrence;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import cut, discard

LONG = 7
NEAR = 5
MIN_WORDS = 30
PART = 1 << 20
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_GAP = np.zeros(256, np.int8)
_GAP[list(b",;:")] = 1
_GAP[list(b".!?")] = 2


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as the longest text needs."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            up = np.full(2 * n, self.base, np.uint64)
            down = np.full(2 * n, pow(self.base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the slices of ``values``: polynomials, as differences of prefix sums."""
        up, down = self.upto(len(values))
        upto = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=upto[1:])
        return (upto[end] - upto[start]) * down[start]


_BYTES, *_RUNS_OF = (_Powers(x) for x in (0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A part of the text at a time, so that a very long text needs no more memory."""
    out, i = [np.empty(0, np.uint64)], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PART)))
        out.append(_BYTES.of(data[start[i] : end[j - 1]].astype(np.uint64), start[i:j] - start[i], end[i:j] - start[i]))
        i = j
    return _mix(np.concatenate(out))


def sentence_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word of each sentence, hashes of all words, first byte of all words) of a text's bytes."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return start, np.empty(0, np.uint64), start
    h = _word_hashes(data, start, end)
    gap = _GAP[data[end - 1]]
    lines = np.flatnonzero(data == 10)
    at = np.searchsorted(lines, end[:-1])
    ended = at < len(lines)
    ended[ended] = lines[at[ended]] < start[1:][ended]
    gap[:-1][ended] = 2
    first = np.zeros(n, bool)
    first[0] = True
    first[1:] = gap[:-1] == 2
    clause = np.flatnonzero(gap[:-1] == 1) + 1
    first[clause[_in_long(first)[clause]]] = True
    long = _in_long(first)
    if n >= NEAR and long.any():
        part = np.cumsum(first)
        at = np.flatnonzero(long[: n - NEAR + 1] & (part[: n - NEAR + 1] == part[NEAR - 1 :]))
        near = [h[at + j] for j in range(NEAR)]
        least = np.minimum.reduce(near)
        best = np.zeros(len(at), np.int64)
        for j, x in enumerate(near):  # the last of equals
            best[x == least] = j
        first[at + best] = True
    return np.flatnonzero(first), h, start


def _in_long(first: np.ndarray) -> np.ndarray:
    """For each word, whether its sentence has over ``LONG`` words."""
    sizes = np.diff(np.append(np.flatnonzero(first), len(first)))
    return np.repeat(sizes > LONG, sizes)


def runs(data: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash, first sentence, end) of the runs that just reach ``min_words`` words."""
    starts, h, _ = sentence_starts(data)
    n, k = len(h), len(starts)
    if n < max(1, min_words):
        return (np.empty(0, np.int64),) * 4
    edge = np.append(starts, n)
    end = np.searchsorted(edge, edge[:-1] + min_words)
    i = np.flatnonzero(end <= k)
    e = end[i]
    if e[-1] < k:  # the last sentences of a text are in a run too
        i, e = np.append(i, np.searchsorted(edge, n - min_words, side="right") - 1), np.append(e, k)
    one, two = (p.of(h, edge[i], edge[e]) for p in _RUNS_OF)
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), i, e


def _data(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.empty(0, np.uint8)


_RUNS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("at", pa.int32()), ("end", pa.int32()), ("again", pa.bool_())])


def _explode(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUNS, strict=True)], schema=_RUNS)

        for b in batches:
            for i, key, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                if i is None or not t.is_valid:
                    continue
                h1, h2, at, end = runs(_data(t), min_words)
                n = len(h1)
                if not n:
                    continue
                again = np.ones(n, bool)  # not the first of its kind in this document; runs come by position
                again[np.unique(h1, return_index=True)[1]] = False
                parts.append((np.full(n, i, np.int64), np.full(n, key, np.int64), h1, h2, at.astype(np.int32), end.astype(np.int32), again))
                held += n
                if held > 100_000:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences of their covered runs."""
    for b in batches:
        texts, gone, where = [], [], []
        lists = b.column("covered")
        flat, offset = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for row, t in enumerate(b.column("text")):
            data = _data(t)
            starts, _, byte = sentence_starts(data)
            edge = np.concatenate(([0], byte[starts[1:]], [len(data)]))
            covered = flat[offset[row] : offset[row + 1]]
            drop = np.bincount(covered >> 32, minlength=len(starts) + 1) - np.bincount(covered & 0xFFFFFFFF, minlength=len(starts) + 1)
            drop = np.cumsum(drop)[:-1] > 0
            turn = np.diff(np.concatenate(([False], drop, [False])).astype(np.int8))
            raw, keep, places, at, char = data.tobytes(), [], [], 0, 0
            for a, z in zip(edge[np.flatnonzero(turn == 1)].tolist(), edge[np.flatnonzero(turn == -1)].tolist(), strict=True):
                keep.append(raw[at:a].decode())
                char += len(keep[-1])
                places.append({"start": char, "end": char + len(raw[a:z].decode())})
                at, char = z, places[-1]["end"]
            texts.append("".join([*keep, raw[at:].decode()]))
            gone.append(int(drop.sum()))
            where.append(places)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(where, _SPANS)], ["doc_id", "text", "n_removed", "removed"])


OUT = "doc_id long, text string, n_removed long, removed array<struct<start:int,end:int>>"


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text without repeated spans, n_removed sentences, removed character spans."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    found = docs.mapInArrow(_explode(min_words), "doc_id long, key long, h1 long, h2 int, at int, end int, again boolean")
    firsts = cut(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n"))
    bits = bloom.bits_for(firsts.count())
    again = bloom.split(found, F.col("h1"), bits, bloom.of_keys(firsts, F.col("h1"), bits, one=True), one=True)[0]
    hit = again.join(firsts, ["h1", "h2"]).where("again or doc_id <> first").select("doc_id", "key", "at", "end").distinct()
    # a key holds no more than one document's runs
    covered = cut(hit.groupBy("doc_id", "key").agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("end")).alias("covered")))
    discard(firsts)
    bits = bloom.bits_for(covered.count())
    maybe, straight = bloom.split(docs, F.col("key"), bits, bloom.of_keys(covered, F.col("key"), bits))
    met = maybe.join(covered, ["doc_id", "key"], "left")
    lost = met.where("covered is not null").select("doc_id", "text", "covered").mapInArrow(_cut_text, OUT)
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = straight.select("doc_id", "text").unionByName(met.where("covered is null").select("doc_id", "text"))
    return whole.select("doc_id", "text", F.lit(0).cast("long").alias("n_removed"), none.alias("removed")).unionByName(lost)
