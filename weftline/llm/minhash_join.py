"""Near-duplicate detection by a chosen-path set similarity join over minwise tokens.

Each document is a set of word shingles and has ``COORDS`` minwise tokens (one per hash
function). A tree branches the documents: a node picks one coordinate by a hash of its
path, and every document goes to the child named by its own token there. A node of at
most ``SMALL`` documents at one of ``DEPTHS`` is a leaf; only larger ones branch on. Leaf
members are compared exhaustively: by their minwise tokens first, and where those agree
well enough, on their full shingle sets. ``TREES`` independent trees give the recall: a
pair at similarity s shares a node of depth d with probability s^d, so at 0.85 sixteen
trees miss it with probability (1 - 0.85^2)^16 = 1e-9 in leaves of depth two, 8e-6 in those
of depth four and 6e-3 in those of depth eight. Deep leaves arise only inside large groups
of documents that agree, where other members give further paths to the same component.

Scale:
- documents with equal sets are one class before any tree is built (membership is joined
  back at the end), so exact copies cost one row;
- trees carry (nodes at all depths, id, component) rows of 48 bytes, computed once a wave
  and written; leaves are compared on 128 bytes a document, and what may be linked there is
  one cluster. Texts move only for members of clusters, found through a bounded Bloom
  filter, once per distinct cluster: documents that share no more than a passage or a line
  do not move;
- large deep nodes, which hold documents that agree, are first collapsed by stars: each
  member is compared with ``PIVOTS`` members of its node, typical ones for the most part,
  and linked to the most similar one, so a group of near copies of any size becomes few
  components at a cost linear in its rows;
- the trees run in waves of ``WAVE``, so that later ones do not compare what is linked; after
  a wave with at most one new link to ``NEW_LINKS`` documents the rest run as one. A node whose members are one component is done. In a
  large node the largest component (its main one) is not compared within itself: it and
  the rest are dealt in blocks of ``BLOCK`` documents, and blocks of the rest meet all
  others. A node is dealt as soon as that copies a row ``COPIES`` times at most on average,
  and in any case at the last depth; no cell has over two blocks or ``SMALL`` documents.

Exactness: links are confirmed on the full sets (64-bit shingle hashes) by
``100 * |A & B| >= percent * |A | B|`` in integers. Pairs whose tokens agree in a share of
more than ``MARGIN`` under the bound are not compared: five standard deviations, 1e-6 of the
links at the bound. No bucket, partner or candidate is capped.

Defined results: a null or blank text has the empty set, is linked with nothing and is its
own component; equal sets are linked; texts are read whole; rows that repeat an id are one
document per id in ``component_id`` and come out once per row, and ``keep_first`` keeps or
drops them together; a null id comes out with a null component and is not kept, but
``keep_first`` leaves its row; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import cut, discard
from weftline.operators.components import components

COORDS = 128
TREES = 16
WAVE = 4
SMALL = 256
DEPTHS = (2, 4, 8, 16)
STAR_LEVELS, STAR_SIZE = ("n1", "n2"), 128
PIVOTS = 5
SAMPLE = 12
BLOCK = 128
COPIES = 6
NEW_LINKS = 100
MARGIN = 0.16
#: Rows of 16 bytes that may be broadcast; larger tables of leaves are met by a shuffle, larger ones of components by a shuffle of the rows that a Bloom filter lets through.
BROADCAST = 1 << 17
_RNG = np.random.Generator(np.random.PCG64(20240611))
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembering up to two million words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 2_000_000:
            self[word] = h
        return h


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the ASCII-lower-cased text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    acc = np.full(n, min(len(w), k), np.uint64)
    for j in range(min(len(w), k)):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(acc)


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, as 16 bits."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096, None] * _MUL[None, :] + _ADD[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    return (_mix(out) >> np.uint64(48)).astype(np.uint16)


def pack(tokens: np.ndarray) -> bytes:
    """All low bytes, then all high bytes: the first ``COORDS`` bytes do for a first comparison."""
    return tokens.astype("<u2").view(np.uint8).reshape(COORDS, 2).T.tobytes()


def unpack(column: pa.Array) -> np.ndarray:
    """(rows, COORDS) tokens."""
    raw = np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, 2, COORDS)
    return raw[:, 0].astype(np.uint16) | raw[:, 1].astype(np.uint16) << 8


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sizes, keys, sigs = [], [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), k, words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(pack(minwise(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def branch(node: np.ndarray, sig: np.ndarray, steps: int) -> np.ndarray:
    """Node keys ``steps`` further down: each node picks its next coordinate by its own path."""
    rows = np.arange(len(sig))
    for _ in range(steps):
        coord = (_mix(node + np.uint64(0x632BE59BD9B4E019)) % np.uint64(COORDS)).astype(np.int64)
        node = _mix(node * np.uint64(0xD6E8FEB86659FD93) ^ (sig[rows, coord].astype(np.uint64) + (coord.astype(np.uint64) << np.uint64(32))))
    return node


LEVELS = [f"n{i}" for i in range(len(DEPTHS))]
NODES = ", ".join(f"{c} long" for c in [*LEVELS, "doc_id", "comp"])


def _roots(first: int, last: int):
    """The nodes of every document at all depths, in the trees ``first`` to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _mix(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            if b.num_rows:
                sig = np.repeat(unpack(b.column("sig")), len(roots), axis=0)
                node, nodes = np.tile(roots, b.num_rows), []
                for depth, above in zip(DEPTHS, (0, *DEPTHS), strict=False):
                    node = branch(node, sig, depth - above)
                    nodes.append(pa.array(node.view(np.int64)))
                ids, comp = (pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), len(roots))) for c in ("doc_id", "comp"))
                yield pa.RecordBatch.from_arrays([*nodes, ids, comp], [*LEVELS, "doc_id", "comp"])

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    """The nodes that hold more than one component."""
    return rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("members")
    ).where("lo <> hi").drop("lo", "hi")


def _typical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of a member are the commonest ones among a few members of its node."""
    held: dict[bytes, np.ndarray] = {}
    for b in batches:
        score = []
        for sig, sample in zip(b.column("sig").to_pylist(), b.column("sample").to_pylist(), strict=True):
            key = b"".join(sample)
            if key not in held:
                if len(held) > 256:
                    held.clear()
                low = np.frombuffer(key, np.uint8).reshape(len(sample), -1)[:, :COORDS]
                held[key] = np.array([np.bincount(c).argmax() for c in low.T], np.uint8)
            score.append(int(np.count_nonzero(held[key] == np.frombuffer(sig, np.uint8)[:COORDS])))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.array(score, pa.int64())], ["node", "doc_id", "score"])


def _nearest(least: int):
    """(a, b) of each row and the pivot of another component that agrees with it most, where that is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, comp, sig, pivots in zip(*(b.column(c).to_pylist() for c in ("doc_id", "comp", "sig", "pivots")), strict=True):
                mine = np.frombuffer(sig, np.uint8)
                met = [(int(np.count_nonzero(np.frombuffer(p["sig"], np.uint8)[:COORDS] == mine[:COORDS])), -p["id"]) for p in pivots if p["comp"] != comp and p["id"] != i]
                best = max(met, default=(0, 0))
                if best[0] >= least:
                    out.append((max(i, -best[1]), min(i, -best[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _stars(docs: DataFrame, reps: DataFrame, trees: int, k: int, percent: int) -> DataFrame | None:
    """Confirmed links of the members of large deep nodes to pivots of their nodes; null without such nodes."""
    least = int(np.ceil((percent / 100 - MARGIN) * COORDS))
    rows = cut(reps.mapInArrow(_roots(0, trees), NODES).select(F.explode(F.array(*STAR_LEVELS)).alias("node"), "doc_id", "comp"))
    large = cut(_sizes(rows).where(F.col("n") > STAR_SIZE).select("node"))
    used = [rows, large]
    if not large.count():
        discard(*used)
        return None
    rows = cut(rows.join(large, "node"))
    ids = cut(rows.select("doc_id").distinct())
    signed = cut(rows.join(bloom.semi_by_id(reps, ids, ids.count()).select("doc_id", "sig"), "doc_id"))  # only their tokens move
    sample = signed.groupBy("node").agg(F.array(*(F.min_by("sig", F.xxhash64(F.lit(i), "doc_id")) for i in range(SAMPLE))).alias("sample"))
    sample = cut(sample)
    scored = cut(signed.join(sample, "node").mapInArrow(_typical, "node long, doc_id long, score long"))
    # some of the most typical members, and some of any kind
    order = [F.col("score") * 4 + F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(16)) for i in range(PIVOTS - 2)] + [F.xxhash64(F.lit(i), "doc_id") for i in range(2)]
    picks = scored.groupBy("node").agg(F.array(*(F.max_by("doc_id", x) for x in order)).alias("ids")).select("node", F.explode(F.array_distinct("ids")).alias("doc_id"))
    chosen = signed.join(picks, ["node", "doc_id"]).groupBy("node").agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), "comp", "sig")).alias("pivots"))
    chosen = cut(chosen)
    pairs = cut(signed.join(chosen, "node").mapInArrow(_nearest(least), "a long, b long").distinct())
    used += [rows, ids, signed, sample, scored, chosen, pairs]
    met_ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    n = met_ids.count()
    texts = cut(bloom.semi_by_id(docs, met_ids, n).join(met_ids, "doc_id", "left_semi")) if n else docs.limit(0)
    mine, other = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(t)) for c, t in (("a", "ta"), ("b", "tb")))
    links = cut(pairs.join(other, "b").join(mine, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm(k, percent), "a long, b long"))
    discard(*used, met_ids, texts)
    return links


def _confirm(k: int, percent: int):
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = WordHashes(), {}
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                sets = []
                for text in (ta, tb):  # pivots come again and again
                    if text not in held:
                        if len(held) > 256:
                            held.clear()
                        held[text] = shingle_set(text, k, words)
                    sets.append(held[text])
                if linked(*sets, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _cells_of(reps: DataFrame, first: int, last: int) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, c1, c2, doc_id, comp) of all leaves of the trees, each member set once, and the tables it reads."""
    rows = cut(reps.mapInArrow(_roots(first, last), NODES))
    dealt, alone, held, used = [], None, [], [rows]
    for i, level in enumerate(LEVELS):
        here = rows.withColumn("node", F.col(level))
        end = level == LEVELS[-1]
        sizes = cut(_sizes(here))
        used.append(sizes)
        held.append(here)
        small = sizes.where(F.col("n") <= SMALL).select(F.lit(i).alias("level"), "node", "members", "n")
        alone = small if alone is None else alone.unionByName(small)
        large = sizes.where(F.col("n") > SMALL).select("node")
        if not large.count():
            break
        parts = here.select("node", "comp").join(large, "node").groupBy("node", "comp").count().groupBy("node").agg(F.sum("count").alias("n"), F.max(F.struct("count", "comp")).alias("top"))
        others = F.col("n") - F.col("top.count")
        parts = parts.select("node", "n", others.alias("others"), F.col("top.comp").alias("main"), F.ceil(F.col("top.count") / BLOCK).cast("int").alias("mains"), F.ceil(others / BLOCK).cast("int").alias("rests"))
        cost = (F.col("n") - F.col("others")) * F.col("rests") + F.col("others") * (F.col("mains") + F.col("rests"))
        parts = cut(parts.withColumn("deal", F.lit(end) | (cost <= COPIES * F.col("n"))))
        used.append(parts)
        dealt.append(_deal(here.join(parts.where("deal"), "node")))
        rest = parts.where("not deal").select("node")
        if end or not rest.count():
            break
        rows = cut(here.join(rest, "node").select(*LEVELS, "doc_id", "comp"))
        used.append(rows)
    # the same members under several trees are one leaf
    alone = cut(alone.groupBy("members", "n").agg(F.min(F.struct("level", "node")).alias("leaf")).select("leaf.level", "leaf.node"))
    used.append(alone)
    leaves, few = [], alone.count() <= BROADCAST
    for i, here in enumerate(held):
        own = alone.where(F.col("level") == i).select("node")
        leaves.append(here.join(F.broadcast(own) if few else own, "node").select(F.col("node").alias("leaf"), F.lit(-1).alias("c1"), F.lit(0).alias("c2"), "doc_id", "comp"))
    return reduce(DataFrame.unionByName, [*leaves, *dealt]), used


def _deal(rows: DataFrame) -> DataFrame:
    """Blocks of the main component meet blocks of the rest, and blocks of the rest each other."""
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    cell = lambda a, b: F.struct(a.cast("int").alias("c1"), b.cast("int").alias("c2"))
    with_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: cell(F.col("mine"), j))
    met = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: cell(i, F.col("mine"))),
        F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: cell(-1 - F.least(F.col("mine"), j), F.greatest(F.col("mine"), j))),
    )
    rows = rows.withColumn("mine", mine).select("node", "doc_id", "comp", F.explode(F.when(F.col("comp") == F.col("main"), with_rests).otherwise(met)).alias("cell"))
    return rows.select(F.col("node").alias("leaf"), "cell.c1", "cell.c2", "doc_id", "comp")


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |A & B| >= percent * |A | B| on sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def leaf_links(ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the leaf's documents into all components that its pairs give.

    Documents of one component already need no comparison. The documents nearest to the
    leaf's typical one come first: in a group of copies they link most others at once.
    """
    n = len(ids)
    uf = _Union(n)
    first: dict[int, int] = {}
    for i, c in enumerate(comps):
        uf.up[uf.find(i)] = uf.find(first.setdefault(c, i))
    if n > 8:
        sigs = np.stack([minwise(s) for s in sets])
        typical = np.array([v[np.argmax(c)] for v, c in (np.unique(col, return_counts=True) for col in sigs.T)], np.uint16)
        order = np.argsort(-(sigs == typical).sum(axis=1), kind="stable")
    else:
        sigs, order = None, np.arange(n)
    links = []
    size = np.array([len(s) for s in sets])
    rest = np.arange(n)
    for i in order:
        if len(rest) < 2:
            break
        root = uf.find(i)
        roots = np.array([uf.find(j) for j in rest])
        far = rest[roots != root]
        if not len(far):
            if (roots == roots[0]).all():
                break
            continue
        near = far[(100 * np.minimum(size[far], size[i]) >= percent * np.maximum(size[far], size[i]))]
        if sigs is not None:
            near = near[(sigs[near] == sigs[i]).mean(axis=1) >= percent / 100 - MARGIN]
        for j in near:
            if uf.find(j) != uf.find(i) and linked(sets[i], sets[j], percent):
                links.append((ids[i], ids[j]))
                uf.up[uf.find(j)] = uf.find(i)
    return links


def _cells(names: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of equal keys; the key is all but the last three columns."""
    key, rows = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in names]
        for row in zip(*cols, strict=True):
            if row[:-3] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = row[:-3], []
            rows.append(row[-3:])
    if len(rows) > 1:
        yield key, rows


def _clusters(percent: int):
    """Members of a cell that may be linked to one of another component, as (cluster, doc_id, comp).

    A cluster is named by its members, so the same cluster out of several cells is one.
    """
    least = int(np.ceil((percent / 100 - MARGIN) * COORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _cells(("leaf", "c1", "c2", "doc_id", "comp", "short"), batches):
            rows.sort(key=lambda r: r[1])  # a component's members lie together and are not compared
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, COORDS)
            comp = np.array([r[1] for r in rows])
            after = np.searchsorted(comp, comp, side="right")
            uf = _Union(len(rows))
            for i, at in enumerate(after):
                for j in np.flatnonzero((sig[at:] == sig[i]).sum(axis=1, dtype=np.int32) >= least):
                    uf.up[uf.find(int(at + j))] = uf.find(i)
            groups: dict[int, list[int]] = {}
            for i in range(len(rows)):
                groups.setdefault(uf.find(i), []).append(i)
            out = []
            for g in groups.values():
                if len(g) > 1:
                    ids = sorted(rows[i][0] for i in g)
                    name = xxhash.xxh3_64_intdigest(np.array(ids, np.int64).tobytes()) - 2**63
                    out += [(name, rows[i][0], rows[i][1]) for i in g]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["leaf", "doc_id", "comp"])

    return run


def _compare(k: int, percent: int):
    """Confirmed links of the clusters; rows come sorted by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for _, rows in _cells(("leaf", "doc_id", "comp", "text"), batches):
            links = leaf_links([r[0] for r in rows], [r[1] for r in rows], [shingle_set(r[2], k, words) for r in rows], percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _links(docs: DataFrame, reps: DataFrame, first: int, last: int, k: int, percent: int) -> DataFrame:
    """Confirmed links of the leaves of the trees ``first`` to ``last``, written."""
    cells, used = _cells_of(reps, first, last)
    cells = cells.join(reps.select("doc_id", F.substring("sig", 1, COORDS).alias("short")), "doc_id").select("leaf", "c1", "c2", "doc_id", "comp", "short")
    cells = cells.repartition("leaf", "c1", "c2").sortWithinPartitions("leaf", "c1", "c2", "doc_id")
    near = cut(cells.mapInArrow(_clusters(percent), "leaf long, doc_id long, comp long").distinct())
    discard(*used)
    n = near.count()
    texts = bloom.semi_by_id(docs, near, n) if n else docs.limit(0)
    met = near.join(texts, "doc_id").select("leaf", "doc_id", "comp", "text")
    links = cut(met.repartition("leaf").sortWithinPartitions("leaf", "doc_id").mapInArrow(_compare(k, percent), "a long, b long"))
    discard(near)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    ``k`` words a shingle; documents are linked from ``percent`` hundredths of Jaccard
    similarity; a component's id is its smallest doc_id, and that document is kept.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = cut(docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, set_key binary, sig binary"))
    full = sigs.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    # one row per class; where ids repeat with different texts, each text takes part
    reps = full.join(classes.where("n > 1"), "set_key", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))).select("doc_id", F.col("doc_id").alias("comp"), "sig")
    reps = cut(reps)
    comp = None

    def join_up(links: DataFrame | None) -> None:
        """Take the new links into ``comp`` (id, component) and ``reps``."""
        nonlocal comp, reps
        if links is None:
            return
        old = comp
        comp = components(links if old is None else links.unionByName(old.toDF("a", "b")))
        discard(old, links)
        last, n = reps, comp.count()
        renamed = lambda rows, comp: rows.drop("comp").join(comp, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"), "sig")
        if n <= BROADCAST:
            reps = cut(renamed(reps, F.broadcast(comp)))
        else:
            bits = bloom.bits_for(n)
            maybe, sure = bloom.split(reps, F.col("doc_id"), bits, bloom.of_keys(comp, F.col("id"), bits))  # most documents are in no link and do not move
            reps = cut(sure.unionByName(renamed(maybe, comp)))
        discard(last)

    join_up(_stars(docs, reps, WAVE, k, percent))
    rows, first, wave = reps.count(), 0, WAVE
    while first < TREES:
        last = min(TREES, first + wave)
        links = _links(docs, reps, first, last, k, percent)
        n = links.count()
        first, wave = last, WAVE if n * NEW_LINKS > rows else TREES
        if n or comp is None:
            join_up(links)
        else:
            discard(links)
    discard(reps)
    full = full.select("doc_id", "n_shingles", "set_key").join(classes.where("n > 1").select("set_key", "rep"), "set_key", "left")
    full = full.withColumn("rep", F.coalesce("rep", "doc_id")).join(comp, F.col("rep") == F.col("id"), "left")
    full = full.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = sigs.where(F.col("set_key").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.unionByName(rest)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one of each near-duplicate component."""
    drop = cut(near_duplicates(docs, k, percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"))
    return bloom.anti_by_id(docs, drop, drop.count())
