"""URL filtering by rules and, where no rule fits, by a character language-model ratio.

Two smoothed Markov models of orders 0 to ``ORDER``, each order backing off to the one
below, are trained on the URLs that rules accept and reject. A URL without a rule is
judged by the difference of its log-likelihoods over its length against a threshold
calibrated on the rule-judged URLs of a fold left out of the counts.

n-gram counts cover every rule-judged URL outside the fold and are exact: a gram of
``ORDER + 1`` bytes is a number of 40 bits, kept in a distributed table that grows with
the URLs. Counts of lower orders are sums over it, and the difference at a character
depends on its gram only, so each distinct gram is scored once and the characters of the
URLs are joined to the scores.

Scale: grams are counted within each task first; sums of one or two bytes (at most 65,536
rows) are broadcast, those of more are windows over distinct grams. Grams that hold over
a thousandth of all places, fewer than a thousand by that, are joined by broadcast, the
others by a shuffle. Scores are added as integers, so the order of rows has no effect.

Defined results: a null URL or one without ``://`` has empty host and path and fits no
rule; without both kinds of rule-judged URLs the rest is allowed; ties of the ratio with
the threshold are allowed; rows that repeat an id are judged each by its own URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

ORDER = 4  # a gram of ORDER + 1 bytes is exact in a long
UNIT = 1e9
HOT = 1000
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host lower-cased, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(url index, gram) of every character: the ``ORDER`` bytes before it and itself as one number."""
    data = [np.frombuffer(u.encode("utf-8", "surrogatepass"), np.uint8) for u in urls]
    lens = np.array([len(d) + 1 for d in data])
    buf = np.zeros(int(lens.sum()), np.int64)  # a zero ends each URL, and fills the places before the first
    at = 0
    for d, n in zip(data, lens, strict=True):
        buf[at : at + n - 1] = d
        at += n
    which = np.repeat(np.arange(len(urls)), lens)
    start = np.repeat(np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    pos = np.arange(len(buf)) - start
    gram = buf.copy()
    for k in range(1, ORDER + 1):
        gram |= np.where(pos >= k, np.roll(buf, k), 0) << (8 * k)
    return which, gram


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, len(b), 4096):
            part = b.iloc[at : at + 4096]
            yield part, *grams(["" if u is None else u for u in part["url"]])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each gram once a part, with its places in all, rejected and accepted URLs."""
    for part, which, gram in _parts(batches):
        keys, at = np.unique(gram, return_inverse=True)
        y = part["y"].to_numpy()[which]
        yield pd.DataFrame({"gram": keys, "n": np.bincount(at), "n0": np.bincount(at[y == 0], minlength=len(keys)), "n1": np.bincount(at[y == 1], minlength=len(keys))})


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, which, gram in _parts(batches):
        yield pd.DataFrame({"row": part["row"].to_numpy()[which], "gram": gram})


def count_grams(urls: DataFrame) -> DataFrame:
    """(gram, n, n0, n1) from (url, y): y 1 for accepted, 0 for rejected and -1 for URLs that are not learnt from."""
    found = urls.select("url", "y").mapInPandas(_count, "gram long, n long, n0 long, n1 long")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")))


def score_grams(counts: DataFrame) -> DataFrame:
    """(gram, n, score): the log-likelihood difference (accepted minus rejected) of its last byte, in units of 1 / ``UNIT``."""
    out = counts
    p = {y: F.lit(1 / 256) for y in (0, 1)}
    for k in range(ORDER + 1):
        for kind, key, size in (("c", F.shiftright("gram", 8), k), ("b", F.col("gram"), k + 1)):
            key = key.bitwiseAND(F.lit((1 << 8 * size) - 1))
            names = {y: f"{kind}{k}_{y}" for y in (0, 1)}
            if size <= 2:  # at most 65,536 rows
                sums = counts.groupBy(key.alias("_key")).agg(*(F.sum(f"n{y}").alias(c) for y, c in names.items()))
                out = out.withColumn("_key", key).join(F.broadcast(sums), "_key").drop("_key")
            elif size <= ORDER:  # distinct grams, so a key has at most 256 ** (ORDER + 1 - size) of them
                out = out.withColumn("_key", key).withColumns({c: F.sum(f"n{y}").over(Window.partitionBy("_key")) for y, c in names.items()}).drop("_key")
            else:
                out = out.withColumns({c: F.col(f"n{y}") for y, c in names.items()})
        p = {y: (F.col(f"b{k}_{y}") + 4 * p[y]) / (F.col(f"c{k}_{y}") + 4) for y in (0, 1)}
    return out.select("gram", "n", F.round((F.log(p[1]) - F.log(p[0])) * UNIT).cast("long").alias("score"))


def ratios(rows: DataFrame) -> DataFrame | None:
    """(row, ratio) from (row, url, y); null without both kinds of URLs to learn from."""
    counts = cut(count_grams(rows))
    total = counts.agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return None
    scores = cut(score_grams(counts))
    places = rows.select("row", "url").mapInPandas(_places, "row long, gram long")
    # fewer than HOT grams can hold more than 1 / HOT of all places each; without them no key of the join is large
    hot = F.broadcast(scores.where(F.col("n") > total["n"] / HOT).select("gram", "score"))
    cold = places.join(hot, "gram", "left_anti").join(scores.select("gram", "score"), "gram")
    every = places.join(hot, "gram").unionByName(cold)
    return every.groupBy("row").agg((F.sum("score") / UNIT / F.count(F.lit(1))).alias("ratio"))


def threshold(judged: DataFrame) -> float:
    """From (ratio, y) of the fold left out of the counts."""
    bins = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("ratio") * 100))).cast("long")
    hist = judged.groupBy("y", bins.alias("bin")).count().toPandas()  # at most 4002 rows
    n = {y: np.bincount(hist["bin"][hist["y"] == y] + 1000, hist["count"][hist["y"] == y], 2001) for y in (0, 1)}
    if not n[0].sum() or not n[1].sum():
        return 0.0
    # at a bin's lower edge: rejected below it, accepted from it on
    good = np.concatenate(([0], np.cumsum(n[0])))[:2001] / n[0].sum() + 1 - np.concatenate(([0], np.cumsum(n[1])))[:2001] / n[1].sum()
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return (float(best[len(best) // 2]) - 1000) / 100


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio: one row per page."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    fold = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    y = F.when(F.col("by_rule").isNull() | F.col("url").isNull(), -1).otherwise((F.col("by_rule") == "allow").cast("int"))
    # ids and URLs may repeat or be null, so the written rows get numbers of their own
    rows = cut(rows.withColumns({"judged": y, "y": F.when(fold, -1).otherwise(y), "fold": fold, "row": F.monotonically_increasing_id()}))
    found = ratios(rows)
    if found is None:
        out, least = rows.withColumn("ratio", F.lit(0.0)), 0.0
    else:
        out = cut(rows.join(found, "row"))
        least = threshold(out.where("fold and judged >= 0").select("ratio", F.col("judged").alias("y")))
    free = F.when(F.col("ratio") >= least, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", free).alias("verdict"), "ratio")
