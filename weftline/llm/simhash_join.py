"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in two bits at most are linked. Cut into two halves,
one half of such a pair differs in one bit at most. So each distinct fingerprint is indexed
under its two halves and under the 64 variants of a half with one bit as a wildcard: a pair
meets in a node named by an equal half, or in that of the one wildcard bit in which the
halves differ, on its two sides. Fingerprints of a node are compared and links verified.

Large nodes branch on by the same rule over the bits that their name leaves open: in an
equal half's node the other half is cut into two again, and so on; in a wildcard's node one
bit is left to differ, so its children are named by all open bits, or by all but one, and
hold four fingerprints at most. A node of ``SMALL`` fingerprints or fewer is compared. At
eight open bits no node is larger, so no group is ever compared as a whole, whatever the
fingerprints are, and nothing is capped.

Scale:
- equal fingerprints are one row before any join, so a group of copies of any size costs one;
- 66 rows of 24 bytes a distinct fingerprint are counted by node, with a partial sum where
  they lie; only rows of nodes that hold a possible pair move again, to be compared;
- a node emits the links that join its members, not all pairs;
- components come from ``operators.components``; ids meet components over tables that are
  written first, so a hot fingerprint's rows can be split.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and
are linked like any other; repeated ids are judged row by row; a null id is never a
component's id unless all ids of the component are null; texts are read whole, in blocks of
``BLOCK`` shingles; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, discard
from weftline.operators.components import components

SEED = 42
BLOCK = 1 << 16
SMALL = 256
BITS = 2
#: The shape of a node: offset * 2^14 + width of the open bits * 2^7 + 1 + wildcard bit, or 0 for none.
ROOT = 64 << 7


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned SimHash of the k-word shingles, repeats included, of the ASCII-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - k + 1) if words else 0
    if not n:
        return 0
    if len(words) <= k:
        shingles = iter((b" ".join(words),))
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", min(BLOCK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shapes(shape: int) -> list[tuple[int, int]]:
    """(child's shape, mask of the bits that name it) of all children of a node of that shape."""
    at, width, wild = shape >> 14, shape >> 7 & 127, shape & 127
    whole = (1 << width) - 1 << at
    if wild:  # one bit is left to differ
        return [(wild, whole), *((wild, whole & ~(1 << j)) for j in range(at, at + width))]
    out, half = [], width // 2
    for mine, other in ((at, at + half), (at + half, at)):
        bits = (1 << half) - 1 << mine
        below = other << 14 | half << 7
        out += [(below, bits), *((below | 1 + j, bits & ~(1 << j)) for j in range(mine, mine + half))]
    return out


def children(node: np.ndarray, shape: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, shape, fp) of every child that the rows go to. Nodes are named by hashes, links are verified."""
    out = []
    for s in np.unique(shape):
        of = np.flatnonzero(shape == s)
        for number, (below, mask) in enumerate(shapes(int(s))):
            name = _mix(_mix(node[of] + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) ^ (fp[of] & np.uint64(mask)))
            out.append((name, np.full(len(of), below, np.int32), fp[of]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ROWS = "node long, shape int, fp long"


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            if part.num_rows:
                node, shape, fp = (part.column(c).to_numpy() for c in ("node", "shape", "fp"))
                node, shape, fp = children(node.view(np.uint64), shape, fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(shape), pa.array(fp.view(np.int64))], ["node", "shape", "fp"])


def _sizes(rows: DataFrame) -> DataFrame:
    """(node, n) of the nodes that may hold a pair: two members, and of a wildcard's node on both sides."""
    wild = F.col("shape") % 128
    side = F.when(wild > 0, F.expr("shiftright(fp, shape % 128 - 1) & 1")).otherwise(0)
    sizes = rows.groupBy("node", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(side).alias("ones"))
    return sizes.where("n > 1 and (shape % 128 = 0 or (ones > 0 and ones < n))").select("node", "shape", "n")


def near(fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join the fingerprints into all components that their pairs give."""
    up = np.arange(len(fp))
    links = []
    for i in range(len(fp) - 1):
        for j in np.flatnonzero((np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits) & (up[i + 1 :] != up[i])) + i + 1:
            if up[j] != up[i]:
                links.append((i, int(j)))
                up[up == up[j]] = up[i]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of the nodes; rows come sorted by node, which has ``SMALL`` rows at most."""
    rest_n, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(np.diff(node)) + 1
        found = [(group[i], group[j]) for group in np.split(fp, ends) for i, j in near(group)]
        if found:
            a, b = np.array(found, np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for b in batches:
        if b.num_rows:
            node = np.concatenate((rest_n, b.column("node").to_numpy()))
            fp = np.concatenate((rest_f, b.column("fp").to_numpy().view(np.uint64)))
            full = int(np.searchsorted(node, node[-1]))  # the last node may go on
            yield from links(node[:full], fp[:full])
            rest_n, rest_f = node[full:], fp[full:]
    yield from links(rest_n, rest_f)


def links(fingerprints: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links that give the components of all pairs of ``fp`` (distinct) that differ in two bits at most.

    With the written tables that they are read from.
    """
    rows = fingerprints.select(F.lit(0).cast("long").alias("node"), F.lit(ROOT).alias("shape"), "fp")
    found, above = [], None
    while True:
        below = rows.mapInArrow(_branch, ROWS)
        sizes = cut(_sizes(below))
        small, large = sizes.where(F.col("n") <= SMALL).select("node", "shape"), sizes.where(F.col("n") > SMALL).select("node", "shape")
        met = below.join(small, ["node", "shape"]).select("node", "fp").repartition("node").sortWithinPartitions("node")
        found.append(cut(met.mapInArrow(_compare, "a long, b long").distinct()))
        more = large.count()
        nxt = cut(below.join(large, ["node", "shape"]).select("node", "shape", "fp")) if more else None
        discard(sizes, above)
        if not more:
            return reduce(DataFrame.unionByName, found), found
        rows = above = nxt


def near_duplicates(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, kept: one row per input row.

    A component's id is the smallest doc_id that reaches it, and that document is kept.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut(docs.mapInArrow(_fingerprints(k), "doc_id long, fp long"))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges, used = links(classes.select("fp"))
    comp = components(edges)
    ids = classes.join(comp, F.col("fp") == F.col("id"))
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = comp.join(least, "component").select(F.col("id").alias("fp"), "component_id")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    named = cut(named)  # written, so that the join deals both sides anew and can split a hot fingerprint
    discard(*used, comp, classes)
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
