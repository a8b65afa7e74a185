"""Byte-level BPE encoding by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are:
merging their joined bytes gives the two again. So the encoding of a prefix is extended
by the one token that ends here and fits the token before it. As a transducer: an item
(trie node, pending tokens) stands for a token begun at an earlier place after the pending
tokens; a state is the set of items alive. Reading a byte moves each item down the trie;
of the tokens that end, one fits, and starts a new item. Tokens on which all items agree
are emitted at once, the rest after a lookahead bounded by the longest token. States and
moves are made when first met and kept, so a known path costs one table lookup a byte. At
``max_states`` no more are made: a word that leaves the table is finished by walking its
items without naming their sets.

Encoding runs it over each match of the split pattern; matches seen before are answered
from a bounded memory. A match that is itself a token is that token, as in tiktoken.
Decoding turns ids into bytes and follows UTF-8 incrementally, holding back the bytes of
an unfinished character.

Defined results: null text is empty and has no tokens; surrogates that are no characters
are replaced as tiktoken replaces them; a text of any length is read whole, in time that
grows with its length; rows that repeat come out once each; a null id comes out null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The merges of ``ranks`` as a transducer; ``max_states`` bounds what it keeps."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 30_000) -> None:
        self.ranks = ranks
        self.max_states = max_states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.kids: list[dict[int, int]] = [{}]  # a trie of the tokens
        self.token_at: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for x in word:
                nxt = self.kids[node].get(x)
                if nxt is None:
                    nxt = self.kids[node][x] = len(self.kids)
                    self.kids.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.fit: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        # an item is (trie node, pending tokens, token before them or -1)
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._state(((0, (), -1),))

    def _state(self, items: tuple) -> int:
        got = self.ids.get(items)
        if got is None:
            got = self.ids[items] = len(self.states)
            self.states.append(items)
            self.moves.append({})
        return got

    def merge(self, word: bytes) -> list[int]:
        """The merges applied one at a time, lowest rank first, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens of the token's last merge; (token, token) if it has none."""
        got = self.split.get(token)
        if got is None:
            word = self.bytes_of[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                best = min(((self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            got = self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (or start, if a is -1).

        Undoes the merges at the seam from the latest back: if the two pieces that meet
        there at some moment would merge before the next merge on either side, the
        encoding of the joined bytes crosses the seam.
        """
        key = a + 1 << 32 | b
        got = self.fit.get(key)
        if got is None:
            if len(self.fit) > 2_000_000:
                self.fit.clear()
            got = self.fit[key] = self._whole(b) if a < 0 else self._seam(a, b)
        return got

    def _whole(self, b: int) -> bool:
        return self.merge(self.bytes_of[b]) == [b]

    def _seam(self, a: int, b: int) -> bool:
        if not self.fits(-1, b):
            return False
        ranks, word = self.ranks, self.bytes_of
        before = 1 << 62  # the rank of the merge undone last on either side
        left_done = right_done = False
        while True:
            across = ranks.get(word[a] + word[b])
            if across is not None and across < before:
                return False
            left, right = self.halves(a), self.halves(b)
            left_done, right_done = left[0] == a, right[0] == b
            if left_done and right_done:
                return True
            # the later merge goes first; of two alike, the right one, as the left one was made first
            if right_done or not left_done and a > b:
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def _move(self, state: int, x: int) -> tuple[int, tuple[int, ...]]:
        alive, fresh = [], None
        for node, pending, before in self.states[state]:
            nxt = self.kids[node].get(x)
            if nxt is None:
                continue
            alive.append((nxt, pending, before))
            token = self.token_at[nxt]
            if token >= 0 and fresh is None and self.fits(pending[-1] if pending else before, token) and (pending or before >= 0 or self.fits(-1, token)):
                fresh = (0, (*pending, token), before)
        if fresh is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append(fresh)
        shared = 0
        low = min(len(p) for _, p, _ in alive)
        while shared < low and len({p[shared] for _, p, _ in alive}) == 1:
            shared += 1
        out = alive[0][1][:shared]
        if shared:
            alive = [(node, p[shared:], out[-1]) for node, p, _ in alive]
        move = (self._state(tuple(alive)), out)
        self.moves[state][x] = move
        return move

    def _walk(self, state: int, rest: bytes) -> list[int]:
        """The tokens still to come from ``state``, found without making states."""
        kids, token_at, fit, fits = self.kids, self.token_at, self.fit, self.fits
        alive = []
        for node, pending, before in self.states[state]:
            chain = (before, None)
            for t in pending:
                chain = (t, chain)
            alive.append((node, chain))
        for x in rest:
            nxt, fresh = [], None
            for node, chain in alive:
                k = kids[node].get(x)
                if k is None:
                    continue
                if kids[k]:
                    nxt.append((k, chain))
                if fresh is None:
                    t = token_at[k]
                    if t >= 0:
                        ok = fit.get(chain[0] + 1 << 32 | t)
                        if fits(chain[0], t) if ok is None else ok:
                            fresh = (t, chain)
            if fresh is None:
                raise ValueError("the vocabulary lacks a byte")
            nxt.append((0, fresh))
            alive = nxt
        out, chain = [], next(c for n, c in reversed(alive) if n == 0)
        while chain[1] is not None:
            out.append(chain[0])
            chain = chain[1]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, moves, full = self.start, [], self.moves, len(self.states) >= self.max_states
        for at, x in enumerate(piece):
            step = moves[state].get(x)
            if step is None:
                if full:
                    return out + self._walk(state, piece[at:])
                step = self._move(state, x)
            state = step[0]
            if step[1]:
                out += step[1]
        for node, pending, _ in reversed(self.states[state]):
            if node == 0:
                return out + list(pending)
        return out


# A split pattern in use, and the same restricted to Latin-1 for the standard library's faster engine.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Codec:
    """encode(text) -> little-endian 32-bit ids; decode(ids) -> bytes."""

    MEMORY = 800_000

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.latin = _LATIN if pattern == SPLIT else self.split
        self.seen: dict[str, bytes] = {}
        self.held = 0
        self.table = [self.fst.bytes_of.get(i, b"") for i in range(max(self.fst.bytes_of, default=-1) + 1)]

    def piece(self, s: str) -> bytes:
        ids = np.array(self.fst.encode(s.encode("utf-8")), "<u4").tobytes()
        if self.held > 64 << 20 or len(self.seen) >= self.MEMORY:
            self.seen.clear()
            self.held = 0
        if len(s) <= 64:
            self.seen[s] = ids
            self.held += len(ids) + len(s)
        return ids

    def encode(self, text: str) -> bytes:
        split = self.latin
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            split = self.split
            try:
                text.encode("utf-8")
            except UnicodeEncodeError:
                text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        seen, out = self.seen, []
        for s in split.findall(text):
            ids = seen.get(s)
            out.append(self.piece(s) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Utf8Stream:
    """Incremental UTF-8: feed bytes, get text; an unfinished character waits for its rest."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        hold = 0
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead & 0xC0 == 0x80:
                    continue  # a following byte: look further back for its lead
                need = 2 if lead & 0xE0 == 0xC0 else 3 if lead & 0xF0 == 0xE0 else 4 if lead & 0xF8 == 0xF0 else 1
                hold = back if need > back else 0
                break
        self.rest = data[len(data) - hold :]
        return data[: len(data) - hold].decode("utf-8", "replace")


def stream_text(codec: Codec, ids: bytes, step: int = 65536) -> Iterator[str]:
    """The text of the ids, a bounded number of ids at a time."""
    utf8 = Utf8Stream()
    for at in range(0, len(ids), 4 * step):
        yield utf8.feed(codec.decode(ids[at : at + 4 * step]))
    yield utf8.feed(b"", last=True)


@lru_cache(maxsize=2)
def codec_for(path: str, pattern: str) -> Codec:
    """The codec of a worker process; its states and memory, both bounded, serve the tasks that follow."""
    return Codec(load_ranks(path), pattern)


def _codec_batches(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for b in batches:
            n, ids_sha, text_sha, ids_out = [], [], [], []
            for t in b.column("text"):
                ids = codec.encode(t.as_py() or "")
                back = hashlib.sha256()
                for part in stream_text(codec, ids):
                    back.update(part.encode("utf-8"))
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(back.hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): one row per document, no shuffle.

    ``path`` is the rank file, on every executor at the same place.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_codec_batches(path, pattern, with_ids), schema)
