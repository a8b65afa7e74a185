import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import boosting, bpe, exact_dedup, minhash_join, pairwise_quality, secret_scan, sentence_spans, template_decontam, toxicity, url_filter, warc
from weftline.llm.queries import tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long, rep string, n long, b string"  # with names that operators use inside


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 7, "y") for i, t in rows], DOC)


WORDS = [a + b for a in ("ta", "re", "mi", "so", "lu", "ke") for b in ("na", "ro", "vi", "pe", "du", "sha")]


def prose(seed, n):
    r = random.Random(seed)
    out, line = [], []
    for _ in range(n):
        line.append(r.choice(WORDS) + r.choice(WORDS))
        if r.random() < 0.12:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return " ".join([*out, *line])


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "a "), (7, "a"), (7, "a"), (None, "q")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    assert by[1]["keep_id"] == 7 and by[1]["group_size"] == 4 and not by[1]["kept"] and by[7]["kept"]
    assert by[3]["keep_id"] == 4 and by[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5]["kept"] and by[6]["kept"] and by[5]["group_size"] == 1
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def copies():
    r = random.Random(5)
    rows = [(i, prose(i, 80)) for i in range(60)]
    for j in range(160):
        # a group of near copies larger than a small node
        words = rows[1][1].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"edit{j}x{r.randrange(99)}"
        rows.append((100 + j, " ".join(words)))
    rows += [(400 + j, rows[2][1]) for j in range(30)] + [(500, ""), (501, None), (502, "  \n"), (503, "two words"), (504, "Two WORDS"), (505, prose(3, 6000)), (506, prose(3, 6000) + " more")]
    shared = prose(77, 60)
    rows += [(600 + j, shared + " " + prose(600 + j, 25)) for j in range(120)]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = copies()
    want, sizes = brute_components(rows, 3, 85)
    got = minhash_join.near_duplicates(docs(spark, rows), 3, 85).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """Nodes count as large from nine documents on, so stars, deeper branches and blocks of all kinds are met."""
    for name, value in {"SMALL": 8, "BLOCK": 4, "STAR_SIZE": 8}.items():
        monkeypatch.setattr(minhash_join, name, value)
    rows = copies()
    words = prose(900, 90).split()
    for j in range(80):  # each is near the one before, the last is far from the first
        words[j] = f"drift{j}"
        rows.append((700 + j, " ".join(words)))
    want, _ = brute_components(rows, 3, 85)
    assert want[779] == 700 and len({want[100 + j] for j in range(160)}) > 1
    for copies_of_a_row, lost in ((12, 0), (0, 5)):  # dealt early, and always down to the last depth, where a pair alone may be missed
        monkeypatch.setattr(minhash_join, "COPIES", copies_of_a_row)
        got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(docs(spark, rows), 3, 85).collect()}
        assert sum(got[i] != want[i] for i in want) <= lost


def test_near_duplicates_of_odd_rows(spark):
    assert minhash_join.near_duplicates(docs(spark, [])).count() == 0
    got = minhash_join.near_duplicates(docs(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, False), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_leaf_links_connects_like_all_pairs():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 120, dtype=np.uint64))
    sets = []
    for _ in range(90):
        s = base.copy()
        k = r.integers(0, 14)
        s[r.choice(len(s), k, replace=False)] = r.integers(0, 2**63, k, dtype=np.uint64)
        sets.append(np.unique(s))
    links = minhash_join.leaf_links(list(range(90)), list(range(90)), sets, 85)
    up = minhash_join._Union(90)
    for a, b in links:
        assert minhash_join.linked(sets[a], sets[b], 85)
        up.up[up.find(a)] = up.find(b)
    full = minhash_join._Union(90)
    for a in range(90):
        for b in range(a):
            if minhash_join.linked(sets[a], sets[b], 85):
                full.up[full.find(a)] = full.find(b)
    part = lambda u: sorted(sorted(i for i in range(90) if u.find(i) == x) for x in {u.find(i) for i in range(90)})
    assert part(up) == part(full) and len(links) < 90


def jobs_of(spark, name, f):
    """The result of ``f`` and the number of Spark jobs that it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_near_duplicates_of_few_links_take_few_jobs(spark):
    """On many partitions the jobs cost more than the rows; few links make no waves of their own."""
    rows = docs(spark, copies())
    got, jobs = jobs_of(spark, "near duplicates of few links", lambda: minhash_join.near_duplicates(rows, 3, 85).collect())
    assert len(got) == rows.count() and jobs <= 150


def test_near_duplicates_of_many_links(spark, monkeypatch):
    """The same components by waves of four trees to the end as by one wave of the rest."""
    want, _ = brute_components(copies(), 3, 85)
    monkeypatch.setattr(minhash_join, "NEW_LINKS", 10**9)
    got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(docs(spark, copies()), 3, 85).collect()}
    assert got == want


# ---------------------------------------------------------------- sentence spans


def brute_sentences(text):
    """(words, character span) of the sentences by plain loops."""
    mask = 2**64 - 1

    def word_hash(w):
        x = sum(c * pow(0xA0761D6478BD642F, i, 2**64) for i, c in enumerate(w.encode())) & mask
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 29

    toks = [(m.group(), m.start()) for m in re.finditer(r"[^ \t-\r]+", text)]
    if not toks:
        return []
    ends = lambda i, chars: i == len(toks) - 1 or toks[i][0][-1] in chars or chars == ".!?" and "\n" in text[toks[i][1] + len(toks[i][0]) : toks[i + 1][1]]

    def groups(idx, chars):
        out, cur = [], []
        for i in idx:
            cur.append(i)
            if i == idx[-1] or ends(i, chars):
                out.append(cur)
                cur = []
        return out

    out = []
    for sent in groups(range(len(toks)), ".!?"):
        for clause in groups(sent, ",;:") if len(sent) > 7 else [sent]:
            if len(clause) <= 7:
                out.append(clause)
                continue
            starts = {0}
            for k in range(len(clause) - 4):
                least = min((word_hash(toks[clause[k + j]][0]), -(k + j)) for j in range(5))
                starts.add(-least[1])
            order = [*sorted(starts), len(clause)]
            out += [clause[x:y] for x, y in zip(order, order[1:], strict=False)]
    at = [0, *(toks[s[0]][1] for s in out[1:]), len(text)]
    return [([toks[i][0] for i in s], (at[k], at[k + 1])) for k, s in enumerate(out)]


def brute_spans(rows, least):
    """doc_id -> sentences to remove, from all runs of sentences as tuples of words."""
    cut = {i: brute_sentences(t) for i, t in rows if i is not None and t is not None}
    seen, out = {}, {}
    for i in sorted(cut):
        sents, found = [s for s, _ in cut[i]], set()
        for lo in range(len(sents)):
            hi = lo + 1
            while hi < len(sents) and sum(map(len, sents[lo:hi])) < least:
                hi += 1
            if sum(map(len, sents[lo:hi])) >= least:
                found.add((lo, hi))
        if found:
            found.add((max(lo for lo in range(len(sents)) if sum(map(len, sents[lo:])) >= least), len(sents)))
        for lo, hi in sorted(found):
            words = tuple(w for s in sents[lo:hi] for w in s)
            if words in seen:
                out.setdefault(i, set()).update(range(lo, hi))
            else:
                seen[words] = i
    return cut, out


def test_spans_against_brute_force(spark):
    passage = prose(9, 70)
    rows = [(i, prose(1000 + i, 60) + " " + (passage if i % 4 == 0 else "") + " " + prose(2000 + i, 40)) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "  "), (93, "As. Er. As."), (94, passage + " " + passage), (95, "no end, but, a very long one: " + "word, " * 300), (96, "\n\n x.y z.\n" + prose(5, 2000)), (97, "\n\n x.y z.\n" + prose(5, 2000)), (None, passage)]
    odd = "É,中文。 ß! " * 30 + "x\u00a0y\u3000z\x0b\x1c\x85 " + passage + "\r\n" + "日本\n语? " * 20
    rows += [(98, odd), (99, "ü " + odd + " ñ")]
    got = {r["doc_id"]: r for r in sentence_spans.dedup_spans(docs(spark, rows)).collect()}
    cut, want = brute_spans(rows, 30)
    assert len(got) == len(rows) and {i for i, r in got.items() if r["n_removed"]} == set(want)
    for i, t in rows:
        gone = want.get(i, set())
        assert got[i]["n_removed"] == len(gone)
        assert got[i]["text"] == (t if not gone else "".join(t[a:b] for k, (_, (a, b)) in enumerate(cut[i]) if k not in gone)), i
        if t is not None:
            keep, at = [], 0
            for x in got[i]["removed"]:
                keep.append(t[at : x["start"]])
                at = x["end"]
            assert "".join(keep) + t[at:] == got[i]["text"]
    assert sentence_spans.dedup_spans(docs(spark, [])).count() == 0


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    data = np.frombuffer((prose(7, 800) + " é " + "x" * 500).encode(), np.uint8)
    whole = sentence_spans.sentence_starts(data)
    monkeypatch.setattr(sentence_spans, "PART", 64)
    assert all((a == b).all() for a, b in zip(whole, sentence_spans.sentence_starts(data), strict=True))


def test_spans_of_ids_that_repeat(spark):
    a, b = prose(1, 80), prose(2, 80)
    got = sorted((r["doc_id"], len(r["text"])) for r in sentence_spans.dedup_spans(docs(spark, [(1, a), (5, a), (5, b), (6, b), (6, b)])).collect())
    assert got == [(1, len(a)), (5, 0), (5, len(b)), (6, 0), (6, 0)]


def test_passages_of_fifty_words_wherever_they_are_pasted(spark):
    r = random.Random(12)
    passages = []
    for k in range(90):
        words = [r.choice(WORDS) + r.choice(WORDS) + r.choice(WORDS) for _ in range(r.choice((50, 50, 55, 80)))]
        for i in range(len(words) - 1):
            if k % 3 and r.random() < (0, 0.03, 0.15)[k % 3]:
                words[i] += r.choice(".,;!")
        passages.append(words)
    glue = lambda: [f"{r.choice(WORDS)}{r.randrange(10**9)}" for _ in range(r.randint(0, 30))]
    short = passages[0][:29]
    rows = [(100 * copy + k, " ".join([*glue(), *words, *glue()])) for copy in (1, 2) for k, words in enumerate(passages)]
    rows += [(500 + k, " ".join([*glue(), *short, *glue()])) for k in range(5)]
    got = {x["doc_id"]: x["text"] for x in sentence_spans.dedup_spans(docs(spark, rows)).collect()}
    text = dict(rows)
    for k, words in enumerate(passages):
        gone = len(text[200 + k].split()) - len(got[200 + k].split())
        assert got[100 + k] == text[100 + k] and len(words) - 20 <= gone <= len(words), (k, " ".join(words))
    assert all(got[500 + k] == text[500 + k] for k in range(5))  # repeats of fewer words stay


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 60
    rows = [(1, "http://a", big), (2, None, big), (0, "http://c", None), (5, "x\r\ny", big), (6, "http://s", "short"), (7, "http://s", "short"), (8, "http://z", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == 7 and all(r["ok"] for r in got.values())
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {i: ("revisit", 1) if i in (2, 5) else ("response", None) for i in got}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_ids_that_repeat(spark):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, c), (0, c), (None, c), (7, b), (7, b), (9, "s"), (9, "s"), (None, None)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, "x") for i, h in rows], "page_id long, url string, html string, payload_digest string")
    got = warc.archive_round_trip(pages).collect()
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    assert all(r["ok"] for r in got)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    first = {a: 1, b: 2, c: 0}
    want = [(i, len(h or ""), sha(h), "revisit" if h in first and first[h] != i else "response", first[h] if h in first and first[h] != i else None) for i, h in rows]
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted(want, key=key)


def test_warc_reader_holds_no_more_than_a_block(tmp_path):
    import io

    big = b"z" * (64 << 20)
    stream = io.BytesIO(warc.record("response", {"Content-Type": "application/http"}, warc._HTTP + big) + warc.record("resource", {}, b""))
    sizes = [len(x) for x in warc.inflate(stream) if not isinstance(x, bool)]
    assert max(sizes) <= warc.BLOCK
    stream.seek(0)
    got = list(warc.records(stream, keep=False))
    assert [(b.size, b.sha.hexdigest(), ok) for _, b, ok in got] == [(len(big), hashlib.sha256(big).hexdigest(), True), (0, hashlib.sha256(b"").hexdigest(), True)]


def test_warc_reader_notices_damage(tmp_path, spark):
    good = warc.record("resource", {"Content-Type": "text/plain"}, b"hello")
    bad = zlib.decompress(good, 31).replace(b"hello", b"jello")
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    (tmp_path / "a.warc.gz").write_bytes(good + z.compress(bad) + z.flush() + good[:-9])
    ok = [r["ok"] for r in warc.read_warc_files(spark, str(tmp_path)).collect()]
    assert ok == [True, False, False]


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def codec():
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.load_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(codec):
    mine, theirs = codec
    r = random.Random(2)
    chars = "abcdefghijklmnopqrstuvwxyzéßñ中文 ABC019.,!?'\n\t  的是😀ไทยкий²½"
    texts = ["", "  ", "a" * 2000, "aé" * 500 + " " * 50, *("".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(1500)), *(prose(i, 50) for i in range(20))]
    for t in texts:
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert mine.decode(ids).decode() == t
        assert "".join(bpe.stream_text(mine, ids, step=1)) == t


def test_bpe_with_a_full_transducer(codec):
    small = bpe.Transducer(codec[0].fst.ranks, max_states=5)
    for w in ("thhereandx", "élève", "zzzzyyyy", "unbelievably"):
        assert small.encode(w.encode()) == codec[1].encode_ordinary(w)


def test_bpe_query(spark):
    path, pattern = tokenizer()
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs(spark, [(1, None), (2, "héllo wörld"), (3, "x" * 100_000)]), path, pattern).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["decoded_sha256"] == hashlib.sha256("héllo wörld".encode()).hexdigest()


# ---------------------------------------------------------------- decontamination

ITEM = "A train leaves the old station with 120 passengers and travels 45 km before Anna counts the remaining 30 seats near the door"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one here now please"), (3, None), (4, "12 13 14 15 16 17 18 19")], "item_id long, text string")
    re_made = ITEM.replace("120", "350").replace("45 km", "12 km").replace("Anna", "Boris").replace("30", "8")
    torn = ITEM.replace("120", "7").replace("45 km", "9 km")
    rows = [
        (1, prose(1, 40) + " " + ITEM + " " + prose(2, 40)), (2, prose(3, 40) + " " + re_made + " " + prose(4, 20)), (3, prose(5, 90)), (4, None), (5, ""),
        (6, "well, short one here now please, he said"), (7, "99 98 97 96 95 94 93 92"), (8, prose(8, 9000)), (9, "x " + torn),
    ]
    got = {r["doc_id"]: r for r in template_decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2, 6, 9}
    assert got[1]["verbatim"] and not got[2]["verbatim"] and got[1]["item_ids"] == [1] and got[6]["item_ids"] == [2]
    assert template_decontam.decontaminate(docs(spark, []), bench).count() == 0
    assert template_decontam.decontaminate(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_slots_must_agree(spark):
    item = "the sum of 5 and 5 makes the number that every small child here knows by heart"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "7")), (2, item.replace("5 and 5", "7 and 8"))]
    got = {r["doc_id"]: r["contaminated"] for r in template_decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: True, 2: False}


def test_different_values_may_become_equal(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, ITEM.replace("120", "50").replace("30", "50")), (1, "nothing here at all"), (None, ITEM), (3, ITEM), (3, ITEM)]
    got = template_decontam.decontaminate(docs(spark, rows), bench).collect()
    assert sorted((r["doc_id"] or -1, r["contaminated"]) for r in got) == [(-1, False), (1, True), (1, True), (3, True), (3, True)]


def test_quotations_that_go_on_or_shout(spark):
    quote = "A train leaves the old station and travels far into the hills before Anna counts the remaining empty seats near the door"
    item = quote + " while everybody there waits quietly for news about Boris and then goes home after a very long day together with Clara in the rain of the evening"
    bench = spark.createDataFrame([(1, item), (2, ITEM)], "item_id long, text string")
    own = " whereas nobody here talks loudly of facts about Anna or even runs off before this rather short night alone"
    rows = [(1, quote + own), (2, ITEM.upper()), (3, ("well, " + quote.upper()).replace("HILLS BEFORE", "HILLS, BEFORE").replace("STATION AND", "STATION, AND"))]
    got = {r["doc_id"]: r for r in template_decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert {i: r["item_ids"] for i, r in got.items()} == {1: [1], 2: [2], 3: [1]}


# ---------------------------------------------------------------- trained scorers


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        t, bad, rude = prose(i, 60), i % 5 == 0, i % 4 == 0
        if bad:
            t = " ".join(w + "%%%" for w in t.split())
        if rude:
            w = t.split()
            for k in range(0, len(w), 12):
                w[k] = ("grumblor", "snarkfel", "you")[k % 3]
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(not bad), int(rude)))
    rows += [(n, None), (n + 1, ""), (n + 2, prose(1, 5000))]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels, len(rows)


def test_quality_and_toxicity_on_held_out_rows(spark):
    d, lab, labels, n = labelled(spark)
    for score, at in ((pairwise_quality.score_quality, 1), (toxicity.score_toxicity, 2)):
        got = {r["doc_id"]: r for r in score(d, lab).collect()}
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got.values())
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
        out = [x for x in labels if got[x[0]]["held_out"]]
        assert np.mean([got[x[0]]["predicted"] == x[at] for x in out]) >= 0.95
    twice = pairwise_quality.labelled_sample(d.unionByName(d), lab, "quality", 100).collect()
    assert len(twice) == 100 == len({r["doc_id"] for r in twice})
    assert pairwise_quality.score_quality(d.limit(0), lab).count() == 0 == toxicity.score_toxicity(d.limit(0), lab).count()
    d = d.withColumn("_score", F.lit(1)).withColumn("_weft_score", F.lit(2))
    good = pairwise_quality.keep_good(d, lab)
    assert good.columns == d.columns and 300 <= good.count() < n


def test_scorers_on_labelled_documents(spark):
    """Held-out rows of the test tables."""
    d = "/root/testdata/sf0.1"
    docs_, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for score, label, least in ((pairwise_quality.score_quality, "quality", 0.98), (toxicity.score_toxicity, "toxic", 0.97)):
        rows = score(docs_, labels).where("held_out").join(labels.where(f"{label} is not null"), "doc_id").select("predicted", F.col(label).alias("y")).collect()
        rare = min((0, 1), key=lambda v: sum(r["y"] == v for r in rows))
        right = [r["predicted"] == r["y"] for r in rows if r["y"] == rare]
        print(label, len(rows), np.mean([r["predicted"] == r["y"] for r in rows]), len(right), np.mean(right))
        assert np.mean([r["predicted"] == r["y"] for r in rows]) >= least and np.mean(right) >= 0.85


def test_scorers_without_labels(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in pairwise_quality.score_quality(d, none).collect()] == [1.0, 1.0]
    assert [r["score"] for r in toxicity.score_toxicity(d, none).collect()] == [0.0, 0.0]


def test_boosting_and_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = boosting.Boosted().fit(x[:600], y[:600]).predict(x[600:])
    assert ((f > 0) == y[600:]).mean() > 0.93
    c = boosting.Isotonic().fit(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    p = c.predict(np.array([0.0, 1.0, 2.5, 4.0, 9.0]))
    assert (np.diff(p) >= 0).all() and p[0] == 0 and p[-1] == 1 and p[2] == 0.5


# ---------------------------------------------------------------- URLs


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def test_urls(spark):
    r = random.Random(4)
    urls = [None, "", "example.com/en/", "http://", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.www.example.com/en/1", "http://b.net/es/", "http://net/fr/", "http://x.net/en/", "http://notexample.com/en/", "http://ÉX.com", "x://com/", "http://h?x=/a", "http://h#://b.net/es/"]
    urls += [f"https://{r.choice('abc')}{i}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr'])}/{r.randrange(999)}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: x for x in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, want[1]), u
        assert got[i]["verdict"] in ("allow", "block") and (want[2] is None or got[i]["verdict"] == want[2])
    free = [got[i]["verdict"] for i, u in enumerate(urls) if u and got[i]["rule"] is None and "example.net/en" in u]
    assert free
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {x["verdict"] for x in url_filter.filter_urls(pages.where("page_id < 2")).collect()} == {"allow"}


def test_url_ratios_against_exact_counts(spark):
    r = random.Random(6)
    chars = [chr(c) for c in range(33, 127)] + list("éßñ中")
    urls = [f"https://{'www.example.com/en' if i % 2 else 'b.net/es'}/{''.join(r.choice(chars) for _ in range(250))}" for i in range(1200)]
    urls += ["http://free.org/" + "".join(r.choice(chars) for _ in range(40)) for _ in range(30)] + [None, "", urls[0]]
    data = [(u or "").encode() for u in urls]
    counts = {}  # by class, order, context and, for the second kind, the byte
    for u, d in zip(urls, data, strict=True):
        if u and "free.org" not in u and zlib.crc32(d) % 5:
            y, padded = int("www.example.com" in u), bytes(4) + d + b"\0"
            for at in range(4, len(padded)):
                for k in range(5):
                    for key in ((y, padded[at - k : at], None), (y, padded[at - k : at], padded[at])):
                        counts[key] = counts.get(key, 0) + 1
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: x["ratio"] for x in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(urls)
    for i in range(1150, len(urls)):
        padded, total = bytes(4) + data[i] + b"\0", 0.0
        for at in range(4, len(padded)):
            p = [1 / 256, 1 / 256]
            for k in range(5):
                for y in (0, 1):
                    c, b = (counts.get((y, padded[at - k : at], x), 0) for x in (None, padded[at]))
                    p[y] = (b + 4 * p[y]) / (c + 4)
            total += np.log(p[1] / p[0])
        assert abs(got[i] - total / (len(padded) - 4)) < 1e-6, urls[i]


# ---------------------------------------------------------------- secrets


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'{prose(1, 20)} token = "{key}" {prose(2, 20)}'), (2, prose(3, 3000)), (3, None), (4, ""), (5, f"{key} said twice token = {key}"), (6, "see commit file example-xxabxxcdxx-0000 and go")]
    got = secret_scan.scan_secrets(docs(spark, rows)).collect()
    real = {(r["doc_id"], r["word_index"]) for r in got if r["is_secret"]}
    assert (1, 22) in real and (5, 5) in real
    assert not [r for r in got if r["doc_id"] in (2, 3, 4)] and (6, 3) not in real
    assert {r["secret_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256(key.encode()).hexdigest()}
    assert len([r for r in got if r["doc_id"] == 5]) == 2
    assert secret_scan.scan_secrets(docs(spark, [])).count() == 0


def test_every_secret_of_a_word(spark):
    aws, sha = "AKIA" + hashlib.sha256(b"a").hexdigest()[:16].upper(), hashlib.sha1(b"b").hexdigest()
    rows = [
        (1, '{"path":"/app/v1/config.yml","key":"%s","secret":"%s"}' % (aws, sha)), (2, "then password: hunter2Xy9! and pwd=correcthorse now"), (3, "the secret garden, a password prompt and tokens are here"),
        (4, f"token={sha},secret={sha[::-1]}"), (5, f"we found {aws} in there"), (5, None),
    ]
    got = secret_scan.scan_secrets(docs(spark, rows)).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    real = {(r["doc_id"], r["secret_sha256"]) for r in got if r["is_secret"]}
    assert {(r["doc_id"], r["secret_sha256"]) for r in got} >= {(1, digest("/app/v1/config.yml"))}
    assert real == {(1, digest(aws)), (1, digest(sha)), (2, digest("hunter2Xy9!")), (2, digest("correcthorse")), (4, digest(sha)), (4, digest(sha[::-1])), (5, digest(aws))}


def brute_candidates(text):
    """(word index, candidate) by loops over characters."""
    key, name = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/.-"), re.compile(r"(?i)(token|secret|passwo?r?d|pwd)[\"'`]?[=:]{1,2}>?[\"'`]?$")
    out, words = [], re.split(r"\s+", text)
    for i, w in enumerate(words):
        at, last = 0, 0
        named = i and re.search(r"(?i)(token|secret|passwo?r?d|pwd)[\"'`]?[=:]{1,2}>?$", words[i - 1]) or i > 1 and re.fullmatch("[=:]{1,2}>?|is|was", words[i - 1]) and re.search(r"(?i)(token|secret|passwo?r?d|pwd)[\"'`]?$", words[i - 2])
        while at < len(w):
            stop = at
            if name.search(w[:at]) or at == last == 0 and named and w[:1] not in "\"'`" or named and last == 0 and at in (1, 2) and set(w[:at]) <= set("\"'`"):
                while stop < len(w) and w[stop] not in "\"'`,;&<>(){}[]":
                    stop += 1
                if stop - at >= 6:
                    out.append((i, w[at:stop].rstrip(".:")))
                    at = last = stop
                    continue
                stop = at
            while stop < len(w) and w[stop] in key:
                stop += 1
            end = stop
            while end > at and w[end - 1] == ".":
                end -= 1
            if end - at >= 16:
                pad = end
                while pad < len(w) and pad - end < 2 and w[pad] == "=":
                    pad += 1
                run = w[at:pad]
                if re.search("[0-9]", run) or re.search("[A-Z].*[a-z].*[A-Z]", run):
                    out.append((i, run))
                at = last = pad
                continue
            at += 1
    return out


def test_candidates_against_brute_force(spark):
    r = random.Random(8)
    bits = ["token", "secret", "password", "pwd=", "is", "was", "=", ":", '"', "'", ",", "{", "}", "a.b", "x" * 15, "Ab" * 9, "q1" * 10, "/usr/lib/", "é", "...", "==", "value", "hunter2!", "Zz9", "&", "\n", " ", " ", " "]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 40)))) for i in range(600)]
    got = secret_scan.candidates(docs(spark, rows)).select("doc_id", "word_index", "candidate").collect()
    want = sorted((i, *c) for i, t in rows for c in brute_candidates(t) if len(c[1]) >= 6)
    assert sorted(map(tuple, got)) == want


def test_secrets_in_long_texts(spark):
    import time

    rows = [(1, "A" * 1_000_000), (2, "a1B-" * 250_000), (3, "中" * 500_000 + "token=abcdef123 "), (4, ("password is " + "x" * 50 + " ") * 5000), (5, "passwd" + " " * 1_000_000), (6, "." * 500_000)]
    at = time.time()
    got = secret_scan.candidates(docs(spark, rows)).groupBy("doc_id").count().collect()
    assert {x["doc_id"]: x["count"] for x in got} == {2: 1, 3: 1, 4: 5000} and time.time() - at < 30


def test_secrets_precision_and_recall(spark):
    """Findings in words and contexts that the training set does not have."""
    r = random.Random(21)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    real = [lambda: f'token = "{hexes(40)}"', lambda: f"DB_PASSWORD={some(14)}", lambda: f"'api_key': '{some(32)}'", lambda: f"ghp_{some(36)}", lambda: f"client_secret: {some(28)}", lambda: f"pwd is {some(10)}", lambda: f"Authorization: bearer={some(48)}"]
    junk = [
        lambda: f"commit {hexes(40)}", lambda: f"sha256:{hexes(64)}", lambda: f"id={hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"see https://host{r.randrange(99)}.example.org/some/long/path-{r.randrange(9999)}",
        lambda: "the password is required for", lambda: f"{r.randrange(10**15, 10**16)}", lambda: "token = your_token_here", lambda: f"getUserNameFromIndex{r.randrange(99)}", lambda: f"written by some.one{r.randrange(99)}@mail.example.com",
    ]
    rows = [(2 * i, f"{prose(i, 12)} {r.choice(real)()} {prose(i + 900, 12)}") for i in range(350)] + [(2 * i + 1, f"{prose(i, 12)} {r.choice(junk)()} {prose(i + 900, 12)}") for i in range(350)]
    found = {x["doc_id"] for x in secret_scan.scan_secrets(docs(spark, rows)).where("is_secret").select("doc_id").distinct().collect()}
    hit, false = sum(i % 2 == 0 for i in found), sum(i % 2 for i in found)
    print("secrets: recall", hit / 350, "precision", hit / max(1, hit + false))
    assert hit / 350 >= 0.95 and hit / (hit + false) >= 0.95


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = [], []
    for i in range(300):
        t = prose(i, 60)
        if i % 6 == 0:
            t = " ".join(w + "&&&" for w in t.split())
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(i % 6 != 0), 0))
    rows += [(1001, rows[1][1], "en", "s", 1), (1002, rows[2][1] + " tail", "en", "s", 1), (1003, prose(3, 30) + " " + ITEM + " " + prose(4, 30), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    d, kept = docs, {}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        d = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {r["doc_id"] for r in d.select("doc_id").collect()}
        assert name == "bpe" or d.columns == docs.columns
    every = {r[0] for r in rows}
    bad = {i for i in range(300) if i % 6 == 0}
    assert kept["quality"] == every - bad
    assert kept["exact_dedup"] == kept["quality"] - {1}
    assert kept["near_dedup"] == kept["exact_dedup"] - {1002}
    assert kept["decontamination"] == kept["near_dedup"] - {1003}
    assert kept["bpe"] == kept["decontamination"]
    assert {r["doc_id"] for r in p.run(spark, str(tmp_path)).select("doc_id").collect()} == kept["bpe"]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ids and rows that repeat, columns named like those used inside, empty tables."""
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, _maybe int, _score int, _weft_go int, id int, n int, sig int, rep string, h1 int"
    a, b = prose(1, 60), prose(2, 60)
    rows = [(None, None), (None, a), (1, None), (2, ""), (3, " \n"), (5, a), (5, b), (7, b), (8, a), (8, a), (9, prose(3, 9000)), (10, "two words"), (11, "Two  WORDS")]
    full = [(i, t, "en", 1, 2, 3, 4, 5, 6, "x", 7) for i, t in rows]
    d = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(i + 100, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, a), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs_ = spark.createDataFrame(full, names)
    keep = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert keep(p.exact(spark, docs_, d)) == sorted([(3, " \n"), (2, ""), (7, b), (8, a), (9, rows[10][1]), (10, "two words"), (11, "Two  WORDS")], key=str)
    assert keep(p.near(spark, docs_, d)) == sorted([r for r in rows if r[0] not in (7, 8, 11)], key=str)
    assert keep(p.decontaminate(spark, docs_, d)) == sorted(rows, key=str)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs_, d)
        assert out.columns == docs_.columns and {tuple(r)[2:] for r in out.collect()} <= {full[0][2:]}, name
        assert stage(spark, docs_.limit(0), d).count() == 0
    assert p.tokens(spark, docs_, d).count() == len(rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    assert p.quality(spark, docs_, d).count() == len(rows) == p.decontaminate(spark, docs_, d).count()


def test_oracle_sql(spark):
    from tests.oracle import connection, rows
    from weftline.llm import queries

    d = "/root/testdata/sf0.001"
    c = connection(d)
    for name, sql in queries.ORACLE_SQL.items():
        assert rows(queries.QUERIES[name](spark, d).toPandas()) == rows(c.sql(sql).df())


def test_held_out_fold(spark):
    from weftline.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
