"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can end its encoding
(encodings of prefixes agree: if the encoding of a text ends in t, then what is
before t is encoded as the prefix without t).  So the table holds one token a
prefix.  For a prefix an automaton gives the tokens that are its suffixes; the
one to store is the one that may follow the token stored where it starts.
Whether b may follow a is decided by the merges alone: undoing the merges of
a and b from the last to the first, no merge across the seam may come earlier
than those that the two tokens use.  Back-pointers from the end give the ids.
The time is linear in the piece's length, whatever it repeats.

The new pieces of many texts go through this together, a step for each place in
a piece and not for each piece; a long piece goes alone, by the same rule.
"""

from __future__ import annotations

import hashlib
import json
import string
import sys
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, claim, id_text, text_buffer

#: How the byte-level pre-tokenizer splits text (fixed value of the public file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers, the longest one it does, and pairs whose compatibility it remembers.
CACHE_PIECES, CACHE_CHARS, CACHE_PAIRS = 250_000, 48, 400_000
#: Characters that the pattern takes as neither white space nor letters nor numbers.
MARKS = string.punctuation
#: Bytes of a piece that goes with others, and pieces that go together.
STEP_BYTES, STEP_PIECES = 64, 1 << 16
#: Slots of the table by which many pairs are looked up at once, as a power of two.
PAIR_BITS = 20


def byte_chars() -> list[str]:
    """The printable character by which the file format names each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class PrefixBpe:
    """One vocabulary: encode(text) and decode(ids)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        names = {c: b for b, c in enumerate(byte_chars())}
        raw = {name: "".join(chr(names[c]) for c in name) for name in model["vocab"]}  # bytes as latin-1 characters
        self.bytes_of = {i: raw[name].encode("latin-1") for name, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens") or ()}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        ids = {raw[name]: i for name, i in model["vocab"].items()}
        #: (left, right) -> (rank, merged); halves: merged -> (left, right, rank)
        self.merge, self.halves = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b = ids[raw[left]], ids[raw[right]]
            whole = ids[raw[left] + raw[right]]
            self.merge[a, b] = rank, whole
            self.halves.setdefault(whole, (a, b, rank))
        self.may_follow: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.length = {}
        self.reachable: list[tuple[str, int]] = []
        for text, i in ids.items():
            self.length[i] = len(text)
            if self._reachable(i):
                self.automaton.add_word(text, (len(text), i))
                self.reachable.append((text, i))
        self.automaton.make_automaton()
        self.steps: Steps | None = None
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # where Python's letters are the pattern's too, a word of letters needs no pattern
        letters = "".join(filter(str.isalpha, map(chr, range(sys.maxunicode + 1))))
        self.alpha = str.isalpha if regex.fullmatch(r"\p{L}+", letters) else (lambda _: False)
        self.inside = regex.compile(r"\s \s")
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _reachable(self, token: int) -> bool:
        """Whether BPE gives the token for its own bytes."""
        if token not in self.halves:
            return self.length[token] == 1
        a, b, _ = self.halves[token]
        return self._compatible(a, b, self.halves[token][2])

    def _compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether no merge across the seam precedes those inside the two tokens; merges from rank `limit` on don't count."""
        while True:
            if (m := self.merge.get((left, right))) is not None and m[0] < limit:
                return False
            lh, rh = self.halves.get(left), self.halves.get(right)
            lr, rr = lh[2] if lh else -1, rh[2] if rh else -1
            if lr < 0 and rr < 0:
                return True
            # Undo the latest merge.  Of merges of one rank the leftmost comes
            # first: a seam merge loses to the left token's, wins over the right's.
            if lr > rr:
                limit, left = min(limit, lr), lh[1]
            else:
                limit, right = min(limit, rr + 1), rh[0]

    def forget(self) -> None:
        self.cache.clear()
        self.spaced.clear()
        self.may_follow.clear()
        self.steps = None

    def follows(self, pair: int) -> bool:
        """Whether the right token of left << 20 | right may follow the left one."""
        may = self.may_follow
        ok = may.get(pair)
        if ok is None:
            if len(may) >= CACHE_PAIRS:
                may.clear()
            ok = may[pair] = self._compatible(pair >> 20, pair & 0xFFFFF)
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        """piece: bytes as latin-1 characters."""
        n = len(piece)
        last, may, length = [-1] * (n + 1), self.may_follow, self.length
        end, done = 0, False
        for at, (size, token) in self.automaton.iter(piece):
            at += 1
            if at != end:
                end, done = at, False
            if done:
                continue
            before = at - size
            if before == 0:
                last[at], done = token, True
                continue
            prev = last[before]
            if prev < 0:
                continue
            key = prev << 20 | token
            ok = may.get(key)
            if ok is None:
                ok = may[key] = self._compatible(prev, token)
                if len(may) > CACHE_PAIRS:
                    may.clear()
            if ok:
                last[at], done = token, True
        out, at = [], n
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def _plan(self, text: str) -> list[tuple[dict[str, bytes], list[str]]]:
        """What of which table makes up the ids.  Pieces never go on over a space that has other than white space on one side: remember what lies between."""
        if self.inside.search(text):
            return [(self.cache, self.split.findall(text))]
        words = text.split(" ")
        first = self.split.findall(words[0])
        del words[0]
        return [(self.cache, first), (self.spaced, words)]

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        raw = list(map(str.encode, pieces))
        long = [at for at, r in enumerate(raw) if len(r) > STEP_BYTES]
        alone = [np.array(self.encode_piece(raw[at].decode("latin-1")), "<u4").tobytes() for at in long]
        for at in long:
            raw[at] = b""
        if raw and self.steps is None:
            self.steps = Steps(self)
        out: list[bytes] = []
        for at in range(0, len(raw), STEP_PIECES):
            out += self.steps.encode(raw[at : at + STEP_PIECES])
        for at, ids in zip(long, alone, strict=True):
            out[at] = ids
        return out

    def _learn(self, plans: list) -> list[tuple[dict, str]]:
        """Puts what the plans need into their tables; what is not to stay there."""
        cache, spaced, split, alpha = self.cache, self.spaced, self.split, self.alpha
        words = set().union(*[keys for table, keys in plans if table is spaced]).difference(spaced)
        # letters are one piece with the space before them, and marks after them are another; the pattern cuts the rest
        plain = [w for w in words if alpha(w)]
        others = list(words.difference(plain))
        stems = [w.rstrip(MARKS) for w in others]
        marked = [(w, " " + s, w[len(s) :]) for w, s in zip(others, stems, strict=True) if alpha(s)]
        cut = [(w, split.findall(" " + w)) for w, s in zip(others, stems, strict=True) if not alpha(s)]
        ahead = [" " + w for w in plain]
        pieces = set(ahead).union([s for _, s, _ in marked], [m for _, _, m in marked], *[own for _, own in cut], *[keys for table, keys in plans if table is cache])
        pieces = list(pieces.difference(cache))
        cache.update(zip(pieces, self._fresh(pieces), strict=True))
        spaced.update(zip(plain, map(cache.__getitem__, ahead), strict=True))
        spaced.update([(w, cache[s] + cache[m]) for w, s, m in marked])
        spaced.update([(w, b"".join(map(cache.__getitem__, own))) for w, own in cut])
        return [(cache, p) for p in pieces if len(p) > CACHE_CHARS] + [(spaced, w) for w in words if len(w) > CACHE_CHARS or "\n" in w]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; the texts' new pieces are encoded together."""
        for table in (self.cache, self.spaced):
            if len(table) >= CACHE_PIECES:
                table.clear()
        plans: list[list] = []
        for text in texts:
            plan, at = [], 0
            if self.special:
                for m in self.special.finditer(text):
                    plan += self._plan(text[at : m.start()])
                    plan.append((None, [self.added[m[0]].to_bytes(4, "little")]))
                    at = m.end()
            plans.append(plan + self._plan(text[at:] if at else text))
        passing = self._learn([part for plan in plans for part in plan])
        out = [b"".join([b"".join(keys if table is None else map(table.__getitem__, keys)) for table, keys in plan]) for plan in plans]
        for table, key in passing:
            del table[key]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Steps:
    """The same dynamic program for many pieces at once, over arrays: the automaton's next states, each state's longest token, each token's next shorter one."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe
        nodes: list[dict[int, int]] = [{}]
        parent, byte, depth, word = [0], [0], [0], {}
        for text, token in bpe.reachable:
            at = 0
            for d, b in enumerate(text.encode("latin-1"), 1):
                if (to := nodes[at].get(b)) is None:
                    to = nodes[at][b] = len(nodes)
                    nodes.append({})
                    parent.append(at)
                    byte.append(b)
                    depth.append(d)
                at = to
            word[at] = token
        parent, byte, depth = np.array(parent), np.array(byte), np.array(depth)
        own = np.full(len(nodes), -1, np.int32)
        own[list(word)] = list(word.values())
        self.length = np.zeros(max(bpe.length, default=0) + 1, np.int32)
        self.length[list(bpe.length)] = list(bpe.length.values())
        self.shorter = np.full(len(self.length), -1, np.int32)
        self.longest = own.copy()
        fail = np.zeros(len(nodes), np.int64)
        table = np.zeros((len(nodes), 256), np.int32)  # a state's number times 256, so that a byte is added to it
        for d in range(int(depth.max()) + 1):
            level = np.flatnonzero(depth == d)
            if d:
                if d > 1:
                    fail[level] = table[fail[parent[level]], byte[level]] >> 8
                table[level] = table[fail[level]]
                below = self.longest[fail[level]]
                ends = own[level] >= 0
                self.shorter[own[level][ends]] = below[ends]
                self.longest[level[~ends]] = below[~ends]
            children = np.flatnonzero(depth == d + 1)
            table[parent[children], byte[children]] = children << 8
        self.table = table.ravel()
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # pair << 1 | whether it may be; the last one of a slot stays

    def _follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 20 | right
        slot = (pair * 0x1E3779B97F4A7C15).view(np.uint64) >> np.uint64(64 - PAIR_BITS)
        held = self.pairs[slot]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            keys, back = np.unique(pair[new], return_inverse=True)
            held[new] = (keys << 1 | np.fromiter(map(self.bpe.follows, keys.tolist()), bool, len(keys)))[back]
            self.pairs[slot[new]] = held[new]
        return held & 1 == 1

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        n, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        lengths = sizes[order]
        starts = (np.cumsum(sizes) - sizes)[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        longest = int(lengths[0]) if n else 0
        last = np.full((longest + 1, n), -1, np.int32)
        state = np.zeros(n, np.int32)
        for at in range(1, longest + 1):
            k = int(np.searchsorted(-lengths, -at, side="right"))
            state = self.table[state[:k] + data[starts[:k] + (at - 1)]]
            rows, token = np.arange(k), self.longest[state >> 8]
            while len(rows):
                before = at - self.length[token]
                left = last[before, rows]
                ok = before == 0
                some = np.flatnonzero(~ok & (left >= 0) & (token >= 0))
                ok[some] = self._follow(left[some], token[some])
                ok &= token >= 0
                last[at, rows[ok]] = token[ok]
                rows, token = rows[~ok], token[~ok]
                rest = token >= 0
                rows, token = rows[rest], self.shorter[token[rest]]
        rows, at, found = np.flatnonzero(lengths), lengths.copy(), []
        while len(rows):
            token = last[at[rows], rows]
            if (token < 0).any():
                raise KeyError("a byte that the vocabulary lacks")
            found.append((rows, token))
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        counts = np.zeros(n, np.int64)
        for rows, _ in found:
            counts[rows] += 1
        own = np.empty(n, np.int64)
        own[order] = counts
        ends = np.cumsum(own)  # in the order in which the pieces came
        ids = np.empty(int(counts.sum()), "<u4")
        for back, (rows, token) in enumerate(found, 1):
            ids[ends[order[rows]] - back] = token
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


@lru_cache(maxsize=4)
def _from_spec(text: str) -> PrefixBpe:
    return PrefixBpe(json.loads(text))


@lru_cache(maxsize=4)
def load(path: str) -> PrefixBpe:
    with open(path, encoding="utf-8") as f:
        return _from_spec(f.read())


def _claimed(path: str) -> PrefixBpe:
    """The vocabulary, its memory given back once the worker turns to another operator."""
    bpe = load(path)
    claim(bpe.forget)
    return bpe


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids array<int>, decoded string.

    Null text is empty and gives no ids; rows are handled one by one, so ties,
    repeated rows and an empty table need nothing.  `vocabulary` is a path that
    every executor can open (the file is part of their installation).
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = _claimed(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _encoded(docs: DataFrame, vocabulary: str | None, id_col: str, text_col: str, carry_ids: bool) -> DataFrame:
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = _claimed(path)
        for batch in batches:
            texts = batch.column("text")
            offs, at = text_buffer(texts)[1], 0
            while at < batch.num_rows:
                begin = at
                at = max(int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, side="right")) - 1, at + 1)  # so many bytes, or one text
                raw = bpe.encode_many(texts.slice(begin, at - begin).to_pylist())
                text_sha = [hashlib.sha256(bpe.decode(memoryview(ids).cast("I")).encode()).hexdigest() for ids in raw]
                counts = [len(r) // 4 for r in raw]
                columns = [batch.column("id").slice(begin, at - begin), pa.array(counts, pa.int64())]
                if carry_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                columns += [pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    names = [c for c in kinds if carry_ids or c != "ids"]
    return id_text(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Nulls, repeated rows and empty tables as in `tokenize`; texts of any length.
    """
    return _encoded(docs, vocabulary, id_col, text_col, carry_ids=False)


def with_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pipeline's last stage: doc_id, n_tokens, ids (array<int>, what a model is trained on), ids_sha256, decoded_sha256 of what is left.

    Nulls, repeated rows and empty tables as in `tokenize`.
    """
    return _encoded(docs, vocabulary, id_col, text_col, carry_ids=True)
