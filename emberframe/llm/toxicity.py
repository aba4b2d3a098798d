"""Toxicity scores behind a noisy channel.

A writer who hides a word swaps letters for look-alikes, repeats them or puts
separators between them.  The decoder treats what is seen as the output of such
a channel: each seen character is a column of a lattice of letters that may
have been meant (or of nothing, for separators and repeats), and the Viterbi
path under a character trigram model, counted over all documents, is the
restored word.  The score is a logistic model over words and word beginnings of
the restored text.

The decoder runs wherever a word may begin inside a token: at its first
character and after each that is not a letter.  It is spared only where the
skeleton (what has no letter reading left out, letters that share a look-alike
folded together, repeats as one) does not begin like the skeleton of some
feature.  Every path through the lattice has the skeleton of what is seen, so
another restoration could not change the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Written, chunks, claim, id_text

#: Labelled rows that the classifier is fitted on at most (those of the smallest hash), and features kept.
FIT_ROWS, FIT_FEATURES = 20_000, 4_096
#: Lengths of the word beginnings that count as features, besides whole words.
PREFIXES = range(4, 9)
#: Letters of the skeleton that are decoded at once; of longer tokens each word start gets so many, in pieces that overlap.
PIECE = 64
#: Words that a worker remembers.
CACHE_WORDS = 200_000

#: Letters that a seen character may stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
SEPARATORS = ".-_*'~^·•,:;/\\ "
#: Log probabilities of the channel: a letter as itself, by a look-alike, said again, a separator.
AS_IS, SWAPPED, REPEATED, SEPARATED = math.log(0.9), math.log(0.05), math.log(0.2), math.log(0.2)

_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_LETTERS = re.compile(r"[^\W\d_]+")
#: What the decoder could change: anything but a letter, or a repeat.
_ODD = re.compile(r"[\W\d_]|(.)\1", re.DOTALL)
#: What follows a word as often as it belongs to it.
_TAIL = "!|$+0123456789"
#: Single characters, white space between them.
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")

CLASSES = 64


def _class_table() -> np.ndarray:
    """Byte -> class: 0 ends a word, 1 to 26 are a to z, the others are bytes of further letters."""
    t = np.zeros(256, np.uint8)
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    t[128:] = 27 + np.arange(128) % 37
    return t


_CLASS = _class_table()


def _classes() -> dict[str, str]:
    """Letter -> the first letter of its class: letters that share a look-alike, directly or by others, are one."""
    of = {c: c for to in LOOKALIKES.values() for c in to}
    for to in LOOKALIKES.values():
        for c in to:
            old, new = sorted((of[c], of[to[0]]), reverse=True)
            of = {k: new if v == old else v for k, v in of.items()}
    return of


class _Fold(dict):
    """Code point -> class of its letter readings; '' without any, as the decoder then passes over it."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        letter = LOOKALIKES[ch][0] if ch in LOOKALIKES else ch if _LETTERS.fullmatch(ch) else ""
        self[code] = out = _CLASS_OF.get(letter, letter)
        return out


_CLASS_OF = _classes()
_FOLD = _Fold()


def skeleton(word: str) -> str:
    return _RUNS.sub(r"\1", word.translate(_FOLD))


def count_letters(docs: DataFrame) -> np.ndarray:
    """Trigram counts of letter classes over every whole text: CLASSES ** 3 cells, whatever the corpus."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for _, buf, offs in chunks(batches):
            c = np.zeros(len(buf) + 2 * len(offs), np.uint8)  # two ends of words between texts
            for i in range(len(offs) - 1):
                c[offs[i] + 2 * i + 2 : offs[i + 1] + 2 * i + 2] = _CLASS[buf[offs[i] : offs[i + 1]]]
            for at in range(0, len(c) - 2, CHUNK_BYTES):  # a long text in pieces
                d = c[at : at + CHUNK_BYTES + 2].astype(np.int32)
                code = (d[:-2] << 12) | (d[1:-1] << 6) | d[2:]
                total += np.bincount(code[d[1:-1] + d[2:] > 0], minlength=CLASSES**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3, np.int64)
    for r in rows.collect():  # at most CLASSES ** 3 rows
        out[r["cell"]] = r["n"]
    return out


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), interpolated with the lower orders."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def _step(self, state: tuple[int, int], letter: str) -> tuple[float, tuple[int, int]]:
        a, b = state
        cost = 0.0
        for byte in letter.encode():
            c = int(_CLASS[byte])
            cost += self.model[(a << 12) | (b << 6) | c]
            a, b = b, c
        return cost, (a, b)

    def restore(self, seen: str) -> str:
        """The most likely word behind what is seen."""
        #: (state, last letter) -> (log probability, letters so far)
        paths: dict[tuple, tuple[float, str]] = {((0, 0), ""): (0.0, "")}
        for ch in seen:
            after: dict[tuple, tuple[float, str]] = {}

            def put(key, value, after=after):
                if key not in after or after[key][0] < value[0]:
                    after[key] = value

            meant = [(ch, AS_IS)] if _LETTERS.fullmatch(ch) else []
            meant += [(to, SWAPPED) for to in LOOKALIKES.get(ch, "")]
            for (state, last), (p, out) in paths.items():
                for letter, channel in meant:
                    cost, to = self._step(state, letter)
                    put((to, letter), (p + channel + cost, out + letter))
                    if letter == last:
                        put((state, last), (p + channel + REPEATED, out))
                if not meant or ch in SEPARATORS:
                    put((state, last), (p + SEPARATED, out))
            paths = after
        return max(((p + self._step(key[0], " ")[0], out) for key, (p, out) in paths.items()), key=lambda x: x[0])[1]


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


class Reader:
    """The features of a text.  known: those to keep and so to look for; None keeps all (when fitting)."""

    def __init__(self, letters: np.ndarray, known: dict[str, float] | None):
        self.restorer, self.known = Restorer(letters), known
        #: Words seen before: those with features, and those without.
        self.cache: dict[str, tuple] = {}
        self.clean: set[str] = set()
        if known is not None:
            #: A word has a feature only if it begins like one.
            self.heads = {f.rstrip("$")[:3] for f in known}
            self.skeletons = {skeleton(f.rstrip("$")) for f in known} - {""}
            self.whole = {skeleton(f[:-1]) for f in known if f.endswith("$")} - {""}
            self.sizes, self.whole_sizes = (sorted({len(s) for s in x}) for x in (self.skeletons, self.whole))
            self.lead = min([3, *self.sizes])
            self.leads = {s[: self.lead] for s in self.skeletons}

    def _may_hide(self, word: str) -> bool:
        s, k = skeleton(word), self.lead
        return any(s[i : i + k] in self.leads for i in range(len(s) - k + 1))

    def hidden(self, word: str, anywhere: bool = False) -> set[str]:
        """The most likely words behind the pieces of a token.  anywhere: any character may begin or end a word."""
        fitting = self.known is None
        if not fitting and not self._may_hide(word):
            return set()
        #: Of the characters with a reading: themselves, whether a word may begin or end there, their run of one class.
        kept, begins, ends, run = [], [], [], []
        classes, first = [], []  # of each run: its class, where it starts in `kept`
        after = True
        for ch in word:
            fold = _FOLD[ord(ch)]
            letter = bool(fold) and ch not in LOOKALIKES
            if ends and not letter:
                ends[-1] = True
            if fold:
                if not classes or classes[-1] != fold:
                    classes.append(fold)
                    first.append(len(kept))
                kept.append(ch)
                begins.append(after or anywhere)
                ends.append(anywhere)
                run.append(len(classes) - 1)
            after = not letter
        if not kept:
            return set()
        ends[-1] = True
        seen, s = "".join(kept), "".join(classes)
        first.append(len(seen))
        #: A word of a feature may be longer than PIECE.
        most = PIECE if fitting else max(PIECE, self.sizes[-1] + 1)
        pieces = set()
        for i, begin in enumerate(begins):
            if not begin:
                continue
            q = run[i]
            piece = seen[i : first[min(q + most, len(s))]]
            if fitting:
                if not anywhere or not i or q % (PIECE // 2) == 0 and first[q] == i:
                    pieces |= {piece, piece.rstrip(_TAIL)}
            elif any(s[q : q + k] in self.skeletons for k in self.sizes):
                pieces |= {piece, piece.rstrip(_TAIL)}
                for k in self.whole_sizes:
                    if q + k <= len(s) and s[q : q + k] in self.whole:
                        stops = [j for j in range(max(i, first[q + k - 1]), first[q + k]) if ends[j]]
                        pieces |= {seen[i : j + 1] for j in (*stops[:1], *stops[-1:])}
        pieces.discard("")
        return {self.restorer.restore(p) if _ODD.search(p) else p for p in pieces}

    def of_word(self, word: str, anywhere: bool = False) -> tuple:
        forms = set() if anywhere else {word} if word.isalpha() else set(_LETTERS.findall(word))
        if anywhere or _ODD.search(word):
            forms |= self.hidden(word, anywhere)
        known = self.known
        if known is None:
            return tuple(dict.fromkeys(f for w in sorted(forms) for f in word_features(w)))
        heads = self.heads
        likely = [w for w in forms if w[:3] in heads]
        return tuple(dict.fromkeys(f for w in sorted(likely) for f in word_features(w) if f in known)) if likely else ()

    def of_text(self, text: str) -> set[str]:
        text = text.lower()
        words = set(text.split())
        cache, clean, out = self.cache, self.clean, set()
        for spaced in {"".join(m[0].split()) for m in _SPACED.finditer(text)}:  # letters that stood apart may hold several words
            out.update(self.of_word(spaced, anywhere=True))
        for word in words - clean:
            found = cache.get(word)
            if found is None:
                found = self.of_word(word)
                if len(cache) + len(clean) >= CACHE_WORDS:
                    cache.clear()
                    clean.clear()
                if found:
                    cache[word] = found
                else:
                    clean.add(word)
            if found:
                out.update(found)
        return out


def _fit(rows: list[tuple[int, list[int]]], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over present features, each scaled by its log ratio; Newton-like steps."""
    n, m = len(rows), len(ratio)
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    feat = np.array([f for r in rows for f in r[1]], np.int64)
    x = ratio[feat]
    beta, bias = np.full(m, 0.3), -4.0
    m1, m2, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, 901):
        z = np.bincount(doc, x * beta[feat], n) + bias
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(feat, x * err[doc], m) / n + 1e-5 * (beta - 0.3)
        gb = err.mean()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        beta -= 0.02 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        beta = np.maximum(beta, 0.05)
        bias -= 0.05 * (b1 / c1) / (math.sqrt(b2 / c2) + 1e-8)
    return beta * ratio, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The letter model over all documents; the classifier over FIT_ROWS labelled rows outside the held-out fold at most.

    A document with several labels is toxic if one of them is 1; null labels do
    not count.  Of rows that share an id one text is fitted on (that of the
    smallest hash).  Without labelled rows of both kinds no document is toxic.
    Texts of any length count whole.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    model = Model(letter_model(count_letters(texts)))
    marks = labels.select(labels[id_col].cast("long").alias("lid"), labels[label_col].cast("int").alias("y"))
    marks = marks.where("lid IS NOT NULL AND y IS NOT NULL").groupBy("lid").agg(F.max("y").alias("y"))
    marks = marks.where(F.crc32(F.col("lid").cast("string").cast("binary")) % 5 != 0)
    marks = marks.orderBy(F.xxhash64("lid"), "lid").limit(FIT_ROWS)  # bounded: it may be broadcast
    # rows that share an id are one: FIT_ROWS stay FIT_ROWS
    fit = texts.join(F.broadcast(marks), texts.id == marks.lid).groupBy("lid").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    fit_table = Written(fit.select("text", "y"), "fit")
    fit = fit_table.df
    letters = spark.sparkContext.broadcast(model.letters)

    def count(batches):
        claim()
        reader = Reader(letters.value, None)
        seen: dict[str, list[int]] = {}
        docs_of = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                y = int(y > 0)
                docs_of[y] += 1
                for f in reader.of_text(text):
                    seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > 500_000:
                    yield _rows(seen)
                    seen = {}
        seen[""] = docs_of
        yield _rows(seen)

    def _rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["f", "clean", "toxic"])

    sums = fit.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = sums.where("f = ''").first()
    if not total or not total["clean"] or not total["toxic"]:
        return model
    clean, toxic = total["clean"], total["toxic"]
    ratio = F.log((F.col("toxic") + 0.1) / toxic) - F.log((F.col("clean") + 0.1) / clean)
    best = sums.where(f"f != '' AND toxic >= {max(3, toxic // 60)}").withColumn("ratio", ratio).where("ratio > 2.5")
    best = best.orderBy(F.desc(F.col("ratio") * F.col("toxic")), "f").limit(FIT_FEATURES).collect()
    if not best:
        return model
    index = {r["f"]: i for i, r in enumerate(best)}
    known = spark.sparkContext.broadcast(index)

    def read(batches):
        reader = Reader(letters.value, known.value)
        for batch in batches:
            y = [int(v > 0) for v in batch.column("y").to_pylist()]
            has = [sorted(known.value[f] for f in reader.of_text(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(has, pa.list_(pa.int32()))], names=["y", "has"])

    rows = [(r["y"], r["has"]) for r in fit.mapInArrow(read, "y int, has array<int>").collect()]  # FIT_ROWS at most
    fit_table.drop()
    rows.sort()
    weights, model.bias = _fit(rows, np.array([r["ratio"] for r in best]))
    model.weights = {f: float(weights[i]) for f, i in index.items()}
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; with `carry` also row, the struct of all input columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim()
        m = shared.value
        reader = Reader(m.letters, m.weights)
        for batch in batches:
            out = []
            texts = batch.column("row").field(text_col) if carry else batch.column("text")
            for text in texts:
                z = m.bias + sum(m.weights[f] for f in sorted(reader.of_text(str(text.as_py() or ""))))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64())], names=[*kept, "score"])

    base = id_text(docs, id_col, text_col)
    kept = ["id"]
    if carry:
        base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"))
        kept = ["row", "id"]
    schema = ", ".join([*(f"{c} {base.schema[c].dataType.simpleString()}" for c in kept), "score double"])
    out = base.mapInArrow(run, schema)
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select(*kept[:-1], F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts have the score of a text without features; a null id
    counts as the text ''; repeated rows get the same score.
    """
    return scores(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, rows that the model rejects left out."""
    out = scores(docs, train(docs, labels, id_col, text_col), id_col, text_col, carry=True).where("predicted = 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
