"""Text normalisation, tokenisation and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import vocab


def clean_text(t: Column) -> Column:
    """Repairs common mis-decoded sequences, then blanks and line ends."""
    t = F.coalesce(t, F.lit(""))
    for bad, good in vocab.MOJIBAKE:
        t = F.replace(t, F.lit(bad), F.lit(good))
    t = F.regexp_replace(t, "â([A-Za-z][A-Za-z0-9 %().,/&:-]{0,40})â", '"$1"')
    t = F.regexp_replace(t, r"(?U)(?<=\w)âs\b", "'s")
    t = F.replace(t, F.lit("â"), F.lit(""))
    for pattern, good in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")):
        t = F.regexp_replace(t, pattern, good)
    return t


def token_count(t: Column) -> Column:
    """Words and single other marks."""
    return F.regexp_count(t, F.lit(r"(?U)\w+|[^\w\s]"))


def ascii_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(t: Column) -> Column:
    """Distinct lower-case tokens of three letters or more, without stop words."""
    kept = F.filter(F.array_distinct(ascii_tokens(t)), lambda x: F.length(x) >= 3)
    return F.array_except(kept, F.array(*map(F.lit, vocab.QUERY_STOPWORDS)))


def word_set(t: Column, least: int = 3) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(rf"(?U)\w{{{least},}}"), F.lit(0)))


def normalize_name(name: Column) -> Column:
    """Lower case, letters, digits and single blanks, without one organisation suffix."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), r"\s+", " "))
    return F.regexp_replace(t, rf"\s({'|'.join(vocab.ORG_SUFFIXES)})$", "")


def graph_tokens(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalize_name(t), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def aliases(name: Column, ticker: Column | None = None, explicit: Column | None = None) -> Column:
    """Sorted distinct aliases: normalised, compact, acronym, ticker and given ones."""
    compact = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    parts = F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0))
    acronym = F.lower(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))
    out = F.array(normalize_name(name), F.when(compact(name) != "", compact(name)), F.when(F.length(acronym) >= 2, acronym))
    if ticker is not None:
        given = F.nullif(ticker, F.lit(""))
        out = F.concat(out, F.array(normalize_name(given), F.lower(F.regexp_replace(given, "[^A-Za-z0-9.]", ""))))
    if explicit is not None:
        given = F.coalesce(explicit, F.array().cast("array<string>"))
        out = F.concat(out, F.transform(given, normalize_name), F.filter(F.transform(given, compact), lambda x: x != ""))
    return F.array_sort(F.array_distinct(F.array_compact(out)))


def relation_type(r: Column) -> Column:
    up = F.replace(F.upper(r), F.lit(" "), F.lit("_"))
    return F.when(up.isin(*vocab.RELATION_TYPES), up).otherwise("RELATED_TO")


def term_key(content: Column) -> Column:
    """Equal for contents with the same words of four letters or more (the first 30 by order)."""
    return F.md5(F.array_join(F.slice(F.array_sort(word_set(content, 4)), 1, 30), " ").cast("binary"))


def text_key(content: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(F.lower(content), r"\s+", " ")).cast("binary"))


def excerpt(content: Column, question: Column, most: int = 360) -> Column:
    """At most ``most`` characters that start 80 before the first question term."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    tokens = query_tokens(question)
    no_broad = F.array_except(tokens, lit(vocab.BROAD_TERMS))
    focused = F.array_except(no_broad, lit(vocab.GENERIC_TERMS))
    chosen = F.when(F.size(focused) > 0, focused).when(F.size(no_broad) > 0, no_broad).otherwise(tokens)
    first = F.array_min(F.filter(F.transform(chosen, lambda k: F.position(k, F.lower(content))), lambda p: p > 0))
    start = F.greatest(first - 1 - 80, F.lit(0))
    cut = F.trim(F.substr(content, (start + 1).cast("int"), F.lit(most)))
    shown = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + most < F.length(content), "...").otherwise(""))
    return F.when(F.length(content) <= most, content).when(first.isNull(), F.substring(content, 1, most)).otherwise(shown)


def parse_table(content: Column) -> Column:
    """struct(headers, rows) of a serialised table: a ``Headers:`` line, then ``k: v | k: v`` lines."""
    lines = F.filter(F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_header = lambda x: F.lower(x).startswith("headers:")
    heads = F.transform(F.filter(lines, is_header), lambda x: F.transform(F.split(F.regexp_replace(x, "^[^:]*:", ""), r"\|"), lambda y: F.trim(y)))
    cell = lambda c: F.struct(F.trim(F.split_part(c, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace(c, "^[^:]*:", "")).alias("value"))
    rows = F.transform(F.filter(lines, lambda x: ~is_header(x) & x.contains(":") & x.contains("|")), lambda x: F.transform(F.filter(F.split(x, r"\|"), lambda c: c.contains(":")), cell))
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    headers = F.coalesce(F.try_element_at(heads, F.lit(-1)), F.transform(F.get(rows, F.lit(0)), lambda c: c["key"]), F.array().cast("array<string>"))
    return F.struct(headers.alias("headers"), rows.alias("rows"))


def entity_spans(t: Column, most: int = 5) -> Column:
    """Runs of capitalised words, distinct, in order."""
    bare = lambda w: F.regexp_replace(w, r"""^[.,:;!?()\[\]{}<>\\"']+|[.,:;!?()\[\]{}<>\\"']+$""", "")
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), bare), lambda w: w != "")
    capital = lambda w: w.rlike(r"(?U)^\p{Lu}") & w.rlike(r"\p{L}")
    # words are joined by a blank inside a run and by a line end between runs
    runs = F.array_join(F.transform(words, lambda w: F.when(capital(w), w).otherwise("\n")), " ")
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(runs, "\n"), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def keywords(t: Column, most: int = 8) -> Column:
    bare = lambda w: F.regexp_replace(w, r"""^[.,:;!?()\[\]{}<>\\"']+|[.,:;!?()\[\]{}<>\\"']+$""", "")
    words = F.transform(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), bare)
    return F.slice(F.transform(F.filter(words, lambda w: w.rlike(r"(?U)^\p{L}{4,}$")), F.lower), 1, most)


def doc_type(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in vocab.FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))


def doc_id(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def fence(t: Column, marks: tuple[str, ...] = ("<<DOC>>", "<</DOC>>")) -> Column:
    """Text with the markers that delimit untrusted content taken out."""
    for m in marks:
        t = F.replace(t, F.lit(m), F.lit(""))
    return t
