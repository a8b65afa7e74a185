"""SimHash links and components against plain loops."""

import random

import pytest
import xxhash

from tests.llm.test_llm import copies, docs, prose
from weftline.llm import simhash_join


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs):
    """row number -> smallest id of its component; ``pairs`` are (id, fingerprint)."""
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2:
                up[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(pairs):
        least.setdefault(find(n), []).append(i)
    return [min((i for i in least[find(n)] if i is not None), default=None) for n in range(len(pairs))]


def test_fingerprints():
    texts = [None, "", " \t\r\n", "a", "A b", "a b c", "Ab\x0bcD\x0cef gh", "x y z Été t", prose(1, 500), "the end " * 4000, "w " * 70_000]
    for t in texts:
        assert simhash_join.fingerprint(t) == brute_fingerprint(t), (t or "")[:20]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(2)
    rows = copies() + [(2000 + i, prose(1, 900 + i)) for i in range(40)] + [(3000, None), (3001, ""), (3002, " \t"), (3003, "One"), (3004, "one"), (-4, "two words"), (None, "two words"), (None, "other"), (3004, "another text"), (5, "one")]
    long = prose(77, 2000).split()
    for j in range(60):
        words = list(long)
        for _ in range(j % 6):
            words[r.randrange(len(words))] = f"edit{j}"
        rows.append((4000 - j, " ".join(words)))
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((str(i), f"{fp:016x}", c, i is not None and i == c) for (i, fp), c in zip(fps, brute(fps), strict=True))
    got = simhash_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(x["doc_id"]), x["fingerprint"], x["component_id"], x["kept"]) for x in got) == want
    assert len({c for _, _, c, _ in want}) < len({fp for _, fp in fps})  # some are linked, not only equal


@pytest.mark.parametrize("small", [4, 16, 256])
def test_links_in_large_nodes(spark, monkeypatch, small):
    """Dense balls of fingerprints, so halves, quarters and wildcards of all depths are met."""
    monkeypatch.setattr(simhash_join, "SMALL", small)
    r = random.Random(small)
    fps = set()
    for centre in (0, (1 << 64) - 1, 0x0123456789ABCDEF, 1 << 63):
        for _ in range(150):
            x = centre
            for _ in range(r.choice((0, 1, 2, 3, 4))):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {0xABCD000000000000 | r.randrange(1 << 11) for _ in range(250)}  # one half is equal
    fps |= {0x1234 << 20 | r.randrange(1 << 6) << 58 | r.randrange(1 << 4) for _ in range(120)}
    fps |= {r.randrange(1 << 64) for _ in range(100)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links, _ = simhash_join.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    up = {x: x for x in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        up[find(a)] = find(b)
    want, number = {}, brute([(i, x) for i, x in enumerate(fps)])
    for x, c in zip(signed, number, strict=True):
        want.setdefault(c, set()).add(x)
    got = {}
    for x in signed:
        got.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_nodes_end(spark):
    """A node of eight open bits holds 256 fingerprints at most, one of a wildcard's children four."""
    for shape, _ in simhash_join.shapes(simhash_join.ROOT):
        todo, depth = [shape], 0
        while todo:
            depth += 1
            nxt = []
            for s in todo:
                width, wild = s >> 7 & 127, s & 127
                if not wild and width > 8:
                    nxt += [c for c, _ in simhash_join.shapes(s)]
                elif wild:
                    whole = (1 << width) - 1 << (s >> 14)
                    assert all((whole & ~m).bit_count() <= 1 for _, m in simhash_join.shapes(s))
            todo = list(dict.fromkeys(nxt))
        assert depth <= 3


def test_odd_tables(spark):
    assert simhash_join.near_duplicates(docs(spark, [])).count() == 0
    got = simhash_join.near_duplicates(docs(spark, [(None, None), (None, "")])).collect()
    assert [(x["doc_id"], x["fingerprint"], x["component_id"], x["kept"]) for x in got] == [(None, "0" * 16, None, False)] * 2
