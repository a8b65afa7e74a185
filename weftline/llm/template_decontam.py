"""Benchmark decontamination by template windows. Native: SQL functions only.

Texts are canonicalised word by word: numbers (with a unit glued on), names (capitals
inside a sentence) and units after a number become typed placeholders, the rest is lower
case without punctuation. Windows of ``width`` canonical words of the benchmark are
hashed and joined to those of the documents. Windows that match at one offset are one
alignment; it counts if it covers ``coverage`` of the item's windows or ``enough`` of
them, and if the slots agree: equal values of the item meet equal values of the document
(different ones may become equal), so a re-parameterised question is caught and a chance
meeting of placeholders is not; slots are compared where windows matched. Windows of the
case-folded words match too, placeholders or not, and an alignment with enough of those is
a verbatim quotation whose slots need no agreement. A window needs ``literals`` words that are no placeholders.

Scale: the windows of the benchmark are broadcast while they are at most ``SMALL_SIDE``
rows (32 MB); a larger benchmark is joined by a shuffle of only those document windows
that a bounded Bloom filter of the benchmark passes. Document texts do not move, but for
the documents with an alignment, whose slots are read again.

Defined results: a null or blank text matches nothing; an item shorter than ``width``
words is one window of its own length and must match whole; items with fewer than
``literals`` literal words match nothing; rows that repeat an id share their verdict;
a null id is never contaminated; empty tables give no match; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import cut

SMALL_SIDE = 2_000_000
# Units that may follow a number.
UNITS = "kg|g|mg|km|m|cm|mm|mi|miles|ft|feet|inch|inches|lb|lbs|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|usd|eur|dollars|euros|cents|percent|degrees"


_STRIPPED = '.,;:!?"()'
_BLANKS = "\t\n\x0b\f\r\u00a0"


def raw_text(text: Column) -> Column:
    """The text with every white space a blank: literal replacements, as a scan by regular expression costs more than the rest."""
    t = F.coalesce(text, F.lit(""))
    for x in _BLANKS:
        t = F.replace(t, F.lit(x), F.lit(" "))
    return t


def canonical(raw: Column) -> Column:
    """The canonical form; it has as many blanks as ``raw``, so words keep their places."""
    t = F.regexp_replace(raw, r"\p{Lu}(?<=[\p{Ll},;] .)[\p{L}'’-]*", "\u0001")  # names
    t = F.lower(bind(t, lambda t: F.when(t.rlike("[0-9]"), _measures(t)).otherwise(t)))
    for x in _STRIPPED:
        t = F.replace(t, F.lit(x), F.lit(""))
    return t


def folded(raw: Column) -> Column:
    """The words without case and punctuation, in the places of the canonical ones."""
    t = F.lower(raw)
    for x in _STRIPPED:
        t = F.replace(t, F.lit(x), F.lit(""))
    return t


def _measures(t: Column) -> Column:
    """Numbers and the units after them as placeholders."""
    number = F.regexp_replace(t, r"[+-]?[0-9][0-9.,:/]*(?:[a-zA-Z%°€$£]{1,3}(?= |$))?", "\u0002")
    return F.regexp_replace(number, rf"(?i)(?<=\u0002 )(?:{UNITS}|%|°)(?=[ .,;!?]|$)", "\u0003")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression named inside a lambda is computed at each of its steps."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words between blanks; a blank after a blank makes none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _windows(text: Column, width: int) -> Column:
    """The hashes of all windows of the words, by position.

    Hashes of 1, 2, 4, ... words are joined in pairs, so a window costs a few steps
    whatever its width; a width that is no power of two joins two that overlap.
    """

    def join(hs: Column, have: int) -> Column:
        if have == width:
            return F.slice(hs, F.lit(1), F.greatest(F.lit(1), F.size(hs) - width + 1))
        shift = min(have, width - have)
        return bind(F.zip_with(hs, F.slice(hs, F.lit(1 + shift), F.greatest(F.lit(0), F.size(hs) - shift)), lambda x, y: F.xxhash64(x, y)), lambda h: join(h, have + shift))

    return bind(words_of(text), lambda ws: bind(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: join(hs, 1)))


def _literal_counts(canon: Column, width: int) -> Column:
    """The literal words of each window, by position."""
    at = lambda ws: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - width + 1))
    return bind(words_of(canon), lambda ws: F.transform(at(ws), lambda i: F.size(F.filter(F.slice(ws, i, width), lambda w: ~w.rlike("^[\u0001-\u0003]?$")))))


def decontaminate(
    docs: DataFrame, bench: DataFrame, width: int = 8, literals: int = 5, coverage: float = 0.5, enough: int = 12,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """doc_id, contaminated, item_ids, n_windows, verbatim: one row per document."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), raw_text(F.col(text_col)).alias("raw")).where("id is not null")
    b = bench.select(F.col(item_col).cast("long").alias("item"), raw_text(F.col("text")).alias("raw")).where("item is not null and raw <> ''")
    b = b.withColumn("canon", canonical(F.col("raw")))
    b = cut(b.withColumn("words", F.size(words_of(F.col("canon")))).where("words > 0"))
    short = [r[0] for r in b.where(F.col("words") < width).select("words").distinct().collect()]  # fewer than width numbers

    hits = None
    for w in [width, *short]:
        part = b.where(F.col("words") >= width if w == width else F.col("words") == w)
        cells = F.arrays_zip(_windows(canonical(F.col("raw")), w).alias("h"), _windows(folded(F.col("raw")), w).alias("g"), _literal_counts(F.col("canon"), w).alias("n"))
        items = part.select("item", F.posexplode(cells).alias("item_pos", "c")).where(F.col("c.n") >= min(literals, w))
        items = cut(items.select("item", "item_pos", F.explode(F.array_distinct(F.array("c.h", "c.g"))).alias("h")))
        n = items.count()
        own = d.select("id", _windows(canonical(F.col("raw")), w).alias("hs"), _windows(folded(F.col("raw")), w).alias("gs"))
        own = own.select("id", F.size("hs").alias("m"), F.posexplode(F.concat("hs", "gs")).alias("at", "h"))
        own = own.select("id", (F.col("at") % F.col("m")).alias("pos"), (F.col("at") >= F.col("m")).alias("exact"), "h")
        if n <= SMALL_SIDE:
            # the same window of many items is one key on the broadcast side
            met = own.join(F.broadcast(items.groupBy("h").agg(F.collect_list(F.struct("item", "item_pos")).alias("at"))), "h")
        else:
            bits = bloom.bits_for(n)
            passed = bloom.split(own, F.col("h"), bits, bloom.of_keys(items, F.col("h"), bits))[0]
            met = passed.join(items.groupBy("h").agg(F.collect_list(F.struct("item", "item_pos")).alias("at")), "h")
        met = met.select("id", "pos", "exact", F.explode("at").alias("at")).select("id", "exact", "at.item", "at.item_pos", (F.col("pos") - F.col("at.item_pos")).alias("shift"))
        runs = met.groupBy("id", "item", "shift").agg(F.collect_set("item_pos").alias("at"), F.size(F.collect_set(F.when(F.col("exact"), F.col("item_pos")))).alias("n_exact"))
        sizes = items.groupBy("item").agg(F.count_distinct("item_pos").alias("total"))
        need = F.least(F.lit(enough), F.ceil(F.col("total") * coverage))
        good = runs.withColumn("n", F.size("at").cast("long")).join(sizes, "item").where(F.col("n") >= need)
        good = good.select("id", "item", "shift", "n", "at", F.lit(w).alias("width"), (F.col("n_exact") >= need).alias("quoted"))
        hits = good if hits is None else hits.unionByName(good)
    hits = cut(hits)
    ids = hits.select("id").distinct()
    n = ids.count()
    verdict = _slots(bloom.semi_by_id(d, ids, n, "id") if n else d.limit(0), b, hits)
    found = verdict.groupBy("id").agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"), F.sum("n").alias("n_windows"), F.max("verbatim").alias("verbatim")
    )
    # the verdicts come to the ids; no text is moved
    out = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(found, F.col("doc_id") == F.col("id"), "left")
    return out.select(
        "doc_id", F.col("id").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"), F.coalesce("verbatim", F.lit(False)).alias("verbatim"),
    )


def _slots(docs: DataFrame, bench: DataFrame, hits: DataFrame) -> DataFrame:
    """The alignments whose slot values agree, with whether the values are the same too."""
    item = bench.select("item", F.filter(F.arrays_zip(F.split("raw", " ").alias("w"), F.split("canon", " ").alias("c")), lambda x: x["c"] != "").alias("both"))
    item = item.select("item", F.col("both.w").alias("iw"), F.col("both.c").alias("ic"))
    met = hits.join(docs, "id").join(item, "item").dropDuplicates(["id", "item", "shift"])
    met = met.withColumn("both", F.filter(F.arrays_zip(F.split("raw", " ").alias("w"), F.split(canonical(F.col("raw")), " ").alias("c")), lambda x: x["c"] != ""))
    met = met.select("id", "item", "shift", "n", "at", "width", "quoted", "iw", "ic", F.col("both.w").alias("dw"), F.col("both.c").alias("dc"))
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}0-9]+|[^\p{L}0-9%]+$", "")
    places = bind(F.struct("iw", "ic", "dw", "dc", "shift", "at", "width"), lambda m: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(m["iw"]) - 1), lambda i: F.get(m["ic"], i).rlike("^[\u0001-\u0003]$") & F.get(m["dc"], (i + m["shift"]).cast("int")).eqNullSafe(F.get(m["ic"], i)) & F.exists(m["at"], lambda a: (a <= i) & (i < a + m["width"]))),
        lambda i: F.struct(F.get(m["iw"], i).alias("a"), F.get(m["dw"], (i + m["shift"]).cast("int")).alias("b")),
    ))
    met = met.withColumn("pairs", F.array_distinct(F.transform(places, lambda p: F.struct(bare(p["a"]).alias("a"), bare(p["b"]).alias("b")))))
    same = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")  # each value of the item meets one value
    return met.where(same | F.col("quoted")).select("id", "item", "n", F.forall("pairs", lambda p: p["a"] == p["b"]).alias("verbatim"))
