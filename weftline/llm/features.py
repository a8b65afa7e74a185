"""Text statistics for the trained scorers, over whole texts."""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np

_PUNCT = string.punctuation.encode()
_STRONG = b"#$%&*|~^<>{}[]\\=_@+`"
_LEET = str.maketrans("013457@$!", "oieastasi")
_ODD = re.compile(r"[a-zA-Z][0-9@$!*]+[a-zA-Z]|(\w)\1{3,}|(?:\b\w[.\-_ ]){3,}\w\b")
# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur thou du dich dir dein deine ihr euch sie tu toi te ton ta vous votre vos tú usted ustedes vosotros".split())

QUALITY_NAMES = [
    "log_words", "word_len", "word_len_sd", "upper", "digit", "punct", "strong", "strong_words", "bang_words", "distinct", "top_word", "same_as_last",
    "short_words", "sentence_len", "lines", "line_repeats", "commas", "stops", "entropy", "caps_words", "non_ascii",
]


def quality_features(text: str | None) -> np.ndarray:
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lens = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    p = by[by > 0] / size
    count = lambda chars: float(by[list(chars)].sum())
    m = max(1, n)
    stops = count(b".!?")
    return np.array([
        math.log1p(n), lens.mean(), lens.std(), count(string.ascii_uppercase.encode()) / size, count(string.digits.encode()) / size, count(_PUNCT) / size,
        count(_STRONG) / size, sum(1 for w in words if w[-1] in _STRONG or w[0] in _STRONG) / m, sum(1 for w in words if w.endswith(b"!!")) / m, len(counts) / m,
        max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m, float((lens <= 3).mean()), m / (1 + stops), len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)), count(b",") / m, stops / m, float(-(p * np.log2(p)).sum()), sum(1 for w in words if w.isupper()) / m,
        float(by[128:].sum()) / size,
    ])


TOXIC_NAMES = [
    "lexicon_density", "lexicon_hits", "stem_density", "stem_hits", "strongest", "near_second_person", "second_person", "upper", "caps_words", "punct", "bang",
    "question", "obfuscated", "obfuscated_lexicon", "log_words", "word_len", "distinct",
]
STEM = 5
_TRIM = string.punctuation + "«»“”„…"


def plain(word: str) -> str:
    return word.strip(_TRIM).lower()


def toxic_views(text: str | None, lexicons: list[tuple[dict[str, float], dict[str, float]]]) -> list[np.ndarray]:
    """The features of a text under each (lexicon, stems); what does not depend on them is computed once."""
    t = text or ""
    words = t.split()
    n, size = max(1, len(words)), max(1, len(t))
    low = [plain(w) for w in words]
    you = np.array([i for i, w in enumerate(low) if w in SECOND_PERSON])
    odd = sum(1 for _ in _ODD.finditer(t))
    spelt = [(l, l.translate(_LEET)) for l in low if any(c in l for c in "013457@$!*")]
    tail = [
        len(you) / n, sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size, sum(map(str.isupper, words)) / n, sum(map(t.count, string.punctuation)) / size, t.count("!") / n,
        t.count("?") / n, 1000 * odd / n,
    ]
    end = [math.log1p(len(words)), len(t) / n, len(set(low)) / n]
    out = []
    for lexicon, stems in lexicons:
        hits = [i for i, w in enumerate(low) if w in lexicon]
        stem = [stems[w[:STEM]] for w in low if w[:STEM] in stems]
        near = sum(1 for i in hits if np.abs(you - i).min() <= 4) if hits and len(you) else 0
        odd_hits = sum(1 for l, s in spelt if l not in lexicon and s in lexicon)
        strongest = max([lexicon[low[i]] for i in hits], default=0) + 0.5 * max(stem, default=0)
        out.append(np.array([1000 * len(hits) / n, len(hits), 1000 * sum(stem) / n, sum(stem), strongest, near, *tail, odd_hits, *end]))
    return out


def toxic_features(text: str | None, lexicon: dict[str, float], stems: dict[str, float]) -> np.ndarray:
    return toxic_views(text, [(lexicon, stems)])[0]
