"""Quality by perplexity under an interpolated modified Kneser-Ney model of words.

The model is of word pairs (order 2; words are split at white space, and every
text is closed in one mark) and is counted over every whole trusted text.  With
c(v, w) the count of a pair, N(w) in how many contexts w goes on to the left, and
D(c) the discount of a count,

    P(w | v) = (c(v, w) - D(c)) / c(v) + gamma(v) / c(v) * Q(w),
    Q(w) = (N(w) - D'(N)) / N + gamma' / N / (types + 1),

where gamma adds up the discounts.  So log P(w | v) is the sum of

    log gamma(v) / c(v), whatever follows v, and
    log (x(v, w) + Q(w)) with x = (c(v, w) - D(c)) / gamma(v), 0 for unseen pairs.

Tables grow with the corpus, so they are sharded by word and never broadcast or
collected.  Trusted pairs, pre-aggregated by task, meet by their context v,
which gives gamma(v); pairs with x then meet by w, which gives N(w).  Every
document's pairs go to the shard of w, meet the model's shard there, and come
back as one number a document and shard; their sum is the document's
log-probability.  A mark is a word like others, and what a word adds as a
context is added where it is predicted, as every word and mark of a closed text
is both once.

What is shuffled are blocks: columns of a task's pairs for one shard, sorted and
compressed.  A word that is a large share of all words (HEAVY; the list is
bounded by the share) has its pairs dealt over all shards by context, with its
own numbers known to all of them.

Documents go through in PASSES parts, so that what lies on disk at once is a
part of it; each row is scored once.

A document is rejected when its perplexity is over a quantile of trusted
documents of its language.  Those are kept out of the counts: a document that
was counted itself is no measure for one that was not.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, chunks, free_shuffles
from .kernels import U, mix, word_hashes

#: Share of the held-out trusted documents of a language that the threshold lets pass, and how many it takes to set one of its own.
QUANTILE, LEAST_TRUSTED = 0.99, 30
#: One trusted document in so many is kept out of the counts, for the thresholds.
HELD_OUT = 5
#: Words that a block is made of; counted words, and bytes of scored text, for each shard.
BLOCK_WORDS, SHARD_WORDS, SHARD_BYTES = 2_000_000, 1_000_000, 32 << 20
PASSES = 8
#: A word is heavy if it is one word in so many or more.
HEAVY = 256
#: The mark that closes a text.
MARK = 0x6D61726B


#: Words are known by 48 bits of a hash, contexts of a known word by 40, and x to 16 bits.
WORD, CONTEXT, REAL, COUNT, TEXT = 6, 5, 3, 4, 4


def _pack(widths: tuple, *columns: np.ndarray) -> bytes:
    """Columns of one length, the given number of low bytes of each; bytes of like weight stand together.  The first is sorted and kept as differences."""
    whole = [c.astype("<u8") for c in columns]
    whole[0] = np.diff(whole[0], prepend=U(0))
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), 8)[:, :k].T).tobytes() for c, k in zip(whole, widths, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(widths: tuple, raw: bytes, n: int) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw, max_output_size=n * sum(widths)), 0, []
    for k in widths:
        c = np.zeros((n, 8), np.uint8)
        c[:, :k] = np.frombuffer(data, np.uint8, n * k, at).reshape(k, n).T
        out.append(c.reshape(-1).view("<u8"))
        at += n * k
    mask = U((1 << (8 * widths[0])) - 1)
    out[0] = np.cumsum(out[0], dtype=U) & mask
    return out


def _real(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32).view(np.uint32) >> np.uint32(8)


def _from_real(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(8)).view(np.float32)


_LOW_CONTEXT = U((1 << (8 * CONTEXT)) - 1)
#: Columns of blocks: pairs by context (v, w, n); pairs by word (w, v, x); weights (v, weight); questions (w, v, text).
BY_CONTEXT, BY_WORD, WEIGHTS, ASKED = (WORD, WORD, COUNT), (WORD, CONTEXT, REAL), (WORD, 4), (WORD, CONTEXT, TEXT)
#: Of a block's texts: uid, words.
TEXTS = (8, 4)


def _among(word: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(word), bool)
    return heavy[np.minimum(np.searchsorted(heavy, word), len(heavy) - 1)] == word


def _shard_of(word: np.ndarray, other: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    """A word's shard; a heavy one's pairs are dealt by their other word."""
    by = np.where(_among(word, heavy), mix(word ^ other), word)
    return (mix(by) >> U(33)).astype(np.int64) % shards


def _pairs(batches):
    """(context, word, text number) of all pairs of closed texts, about BLOCK_WORDS at once, and the rows that end there."""
    held, rows = [], []
    size, texts = 0, 0
    for batch, buf, offs in chunks(batches):
        h, per = word_hashes(buf, offs, lower=False)
        h &= U((1 << (8 * WORD)) - 1)
        ends = np.cumsum(per)
        word = np.insert(h, ends, U(MARK))  # a mark after each text
        n = per + 1
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[np.cumsum(n) - n] = U(MARK)
        held.append((context, word, np.repeat(np.arange(texts, texts + len(n)), n).astype(np.int32)))
        rows.append(batch)
        size, texts = size + len(word), texts + len(n)
        if size >= BLOCK_WORDS:
            yield (*(np.concatenate(c) for c in zip(*held, strict=True)), rows)
            held, rows, size, texts = [], [], 0, 0
    if held:
        yield (*(np.concatenate(c) for c in zip(*held, strict=True)), rows)


def _unique_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None):
    """Pairs in order, each once, and how often (or what n adds up to)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    if n is None:
        return a[first], b[first], np.diff(np.append(first, len(a)))
    return a[first], b[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


_BLOCK = "shard int, n long, block binary"


def _blocks(widths: tuple, shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A block for each shard; the columns are sorted by the first within a shard."""
    order = np.argsort(shard.astype(np.int32), kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else order
    some, n, raw = [], [], []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=False):
        own = order[lo:hi]
        some.append(int(shard[own[0]]))
        n.append(hi - lo)
        raw.append(_pack(widths, *(c[own] for c in columns)))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["shard", "n", "block"])


def _rows(batches):
    for batch in batches:
        columns = [batch.column(c) for c in batch.schema.names]
        for i in range(batch.num_rows):
            yield {name: c[i].as_py() for name, c in zip(batch.schema.names, columns, strict=True)}


def _gathered(batches):
    """A task's shards, one after the other, with the rows of each; a shard's part of a table has a bounded size."""
    for _, rows in groupby(_rows(batches), lambda r: r["shard"]):
        yield list(rows)


def _by_shard(blocks: DataFrame, shards: int, *more: str) -> DataFrame:
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard", *more)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), cap) for d, cap in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (0.95, 1.9, 2.8), strict=True))


def _cut(d: tuple, n: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted column, and where each begins (and the column ends)."""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[first], np.append(first, len(a))


class Model:
    """Sharded tables, and what all shards share: heavy words (in order) with their Q and weight as a context, and a few numbers."""

    def __init__(self, tables: Written, shards: int, heavy: np.ndarray, numbers: dict, scalars: dict):
        self.tables, self.shards, self.heavy, self.numbers, self.scalars = tables, shards, heavy, numbers, scalars


class Shard:
    """One shard of the model, from its blocks."""

    def __init__(self, model: Model, rows: list[dict]):
        self.unseen = model.scalars["unseen"]
        w, v, x = _columns(BY_WORD, [r for r in rows if r["kind"] == 0])
        self.words, at = _runs(w)
        n = np.diff(at)
        self.q = (n - _cut(model.scalars["cut"], n)) / model.scalars["pairs"] + self.unseen
        self.contexts, weight = _columns(WEIGHTS, [r for r in rows if r["kind"] == 1])
        self.weight = weight.astype(np.uint32).view(np.float32).astype(float)
        self.heavy = np.array(list(model.numbers), U)
        self.numbers = np.array(list(model.numbers.values())).reshape(-1, 2)
        code = self._code(w, v)
        by = np.argsort(code)
        self.code, self.x, self.w, self.v = code[by], _from_real(x[by]), w[by], v[by]

    @staticmethod
    def _code(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return mix(w) ^ (mix(v) << U(1))

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], default)

    def log_p(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """What each pair adds: log (x + Q(w)), and the weight of w as a context; w in order."""
        distinct, at = _runs(w)
        q = self._look(self.words, self.q, distinct, self.unseen)
        weight = self._look(self.contexts, self.weight, distinct, 0.0)
        wide = _among(distinct, self.heavy)
        q[wide] = self._look(self.heavy, self.numbers[:, 0], distinct[wide], 0.0)
        weight[wide] = self._look(self.heavy, self.numbers[:, 1], distinct[wide], 0.0)
        many, seen = np.diff(at), np.zeros(len(w))
        if len(self.code):
            wanted = self._code(w, v)
            i = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
            hit = (self.w[i] == w) & (self.v[i] == v)
            seen[hit] = self.x[i[hit]]
        return np.log(np.repeat(q, many) + seen) + np.repeat(weight, many)


def _heavy_words(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Words that are one in HEAVY or more of some block, most common first, and how many words there are.

    A word that is one in HEAVY of all words is so in a block; at most HEAVY words are collected.
    """

    def run(batches):
        for _, word, _, _ in _pairs(batches):
            w, n = np.unique(word, return_counts=True)
            big = n * HEAVY >= len(word)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(w[big].view(np.int64), 0)), pa.array(np.append(n[big], 0)), pa.array(np.append(np.zeros(int(big.sum()), np.int64), len(word)))], names=["w", "n", "total"])

    rows = texts.select("text").mapInArrow(run, "w long, n long, total long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = Written(rows, "heavy")
    total = rows.df.agg(F.sum("total")).first()[0] or 0
    words = [r["w"] for r in rows.df.where(F.col("n") * HEAVY >= total).where("n > 0").orderBy(F.desc("n"), "w").limit(HEAVY).collect()]
    rows.drop()
    return np.sort(np.array(words, np.int64).view(U)), total


def fit(texts: DataFrame, scored_bytes: int = 0) -> Model:
    """The model of the trusted texts (a column text), sharded also for so many bytes of text to be scored."""
    spark = texts.sparkSession
    heavy, total = _heavy_words(texts)
    shards = max(1, -(-total // SHARD_WORDS), -(-scored_bytes // SHARD_BYTES))

    def count(batches):
        for context, word, _, _ in _pairs(batches):
            v, w, n = _unique_pairs(context, word)
            yield _blocks(BY_CONTEXT, _shard_of(v, w, shards, heavy), v, w, n)

    def merge(batches):
        """A shard's pairs, each once, and what is told of them: counts of counts under 0, and the heavy contexts' parts (v, c, n1, n2, n3+)."""
        for rows in _gathered(batches):
            v, w, n = (np.concatenate(c) for c in zip(*(_unpack(BY_CONTEXT, r["block"], r["n"]) for r in rows), strict=True))
            v, w, n = _unique_pairs(v, w, n.astype(np.int64))
            told = [[0, *(int((n == i).sum()) for i in range(1, 5))]]
            for h in heavy:
                own = n[np.searchsorted(v, h) : np.searchsorted(v, h, side="right")]
                if len(own):
                    told.append([int(h), int(own.sum()), int((own == 1).sum()), int((own == 2).sum()), int((own > 2).sum())])
            yield _told(_kind(0, _blocks(BY_CONTEXT, np.full(len(v), rows[0]["shard"]), v, w, n)), told)

    table = f"kind int, {_BLOCK}, told array<array<long>>"
    pairs = Written(_by_shard(texts.select("text").mapInArrow(count, _BLOCK), shards).mapInArrow(merge, table), "pairs")
    free_shuffles(spark)
    said = _sums(pairs.df, 4)
    d = _discounts(*said.pop(0, [0] * 4))
    known = {v: (c, float(np.dot(d, ns))) for v, (c, *ns) in said.items()}  # c(v), gamma(v)

    def context(batches):
        """Pairs with x to the shard of their word; what a word weighs as a context to its own."""
        for r in _rows(batches):
            v, w, n = _unpack(BY_CONTEXT, r["block"], r["n"])
            n = n.astype(np.int64)
            cut = _cut(d, n)
            values, at = _runs(v)
            c, gamma = (np.add.reduceat(x, at[:-1]).astype(float) for x in (n, cut))
            for i in np.flatnonzero(_among(values, heavy)):
                c[i], gamma[i] = known[int(values[i])]
            x = (n - cut) / np.repeat(gamma, np.diff(at))
            order = np.lexsort((v, w))
            v, w, x = v[order], w[order], x[order]
            yield _kind(0, _blocks(BY_WORD, _shard_of(w, v, shards, heavy), w, v & _LOW_CONTEXT, _real(x)))
            light = ~_among(values, heavy)  # those of heavy words are known to all
            weight = np.log(gamma / c).astype(np.float32).view(np.uint32)
            yield _kind(1, _blocks(WEIGHTS, _shard_of(values[light], values[light], shards, heavy), values[light], weight[light]))

    def by_word(batches):
        """A shard's tables, and what is told of them: of N the counts of counts, sum and number, and heavy words' parts."""
        for rows in _gathered(batches):
            shard = rows[0]["shard"]
            w, v, x = _columns(BY_WORD, [r for r in rows if r["kind"] == 0])
            order = np.lexsort((v, w))
            w, v, x = w[order], v[order], x[order]
            words, at = _runs(w)
            n = np.diff(at)
            wide = _among(words, heavy)
            own = n[~wide]
            told = [[0, *(int((own == i).sum()) for i in range(1, 5)), int(n.sum()), len(own)]]
            told += [[int(words[i]), int(n[i])] for i in np.flatnonzero(wide)]
            yield _told(_kind(0, _blocks(BY_WORD, np.full(len(w), shard), w, v, x)), told)
            c, weight = _columns(WEIGHTS, [r for r in rows if r["kind"] == 1])
            order = np.argsort(c)
            yield _told(_kind(1, _blocks(WEIGHTS, np.full(len(c), shard), c[order], weight[order])), [])

    moved = pairs.df.select("shard", "n", "block").where("n > 0").mapInArrow(context, f"kind int, {_BLOCK}")
    tables = Written(_by_shard(moved, shards).mapInArrow(by_word, table), "model")
    pairs.drop()
    free_shuffles(spark)
    told = _sums(tables.df, 6)
    wide = {w: r[0] for w, r in told.items() if w}
    *of, pairs_n, types = told.get(0, [0] * 6)
    for n in wide.values():
        if n <= 4:
            of[n - 1] += 1
    types += len(wide)
    d1 = _discounts(*of)
    some = of[:2]
    gamma1 = d1[0] * some[0] + d1[1] * some[1] + d1[2] * (types - some[0] - some[1])
    scalars = {"cut": d1, "pairs": max(1, pairs_n), "unseen": max(gamma1, 1e-9) / max(1, pairs_n) / (types + 1)}
    q = {w: (n - float(_cut(d1, np.array([n]))[0])) / scalars["pairs"] + scalars["unseen"] for w, n in wide.items()}
    numbers = {}
    for h in heavy.tolist():
        c, gamma = known[h]
        numbers[h] = (q.get(h, scalars["unseen"]), math.log(gamma / c))
    return Model(tables, shards, heavy, numbers, scalars)


def _kind(kind: int, blocks: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * blocks.num_rows, pa.int32()), *blocks.columns], names=["kind", *blocks.schema.names])


def _told(blocks: pa.RecordBatch, told: list) -> pa.RecordBatch:
    """With what is told on the first row, or on one without a block."""
    if not blocks.num_rows and told:
        blocks = pa.RecordBatch.from_arrays([pa.array([0], f.type) if pa.types.is_integer(f.type) else pa.array([b""], f.type) for f in blocks.schema], schema=blocks.schema)
    column = pa.array([told, *[[]] * (blocks.num_rows - 1)] if blocks.num_rows else [], pa.list_(pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([*blocks.columns, column], names=[*blocks.schema.names, "told"])


def _sums(tables: DataFrame, width: int) -> dict[int, list[int]]:
    """What the shards have told, added up by the first number; HEAVY + 1 rows are collected at most."""
    t = F.col("t")
    rows = tables.select(F.explode("told").alias("t")).select(F.get(t, 0).alias("k"), *[F.coalesce(F.get(t, i), F.lit(0).cast("long")).alias(f"c{i}") for i in range(1, width + 1)])
    return {r["k"]: list(r[1:]) for r in rows.groupBy("k").agg(*[F.sum(f"c{i}") for i in range(1, width + 1)]).collect()}


def _columns(widths: tuple, rows: list[dict]) -> list[np.ndarray]:
    parts = [_unpack(widths, r["block"], r["n"]) for r in rows if r["n"]]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, U) for _ in widths]


def log_probabilities(texts: DataFrame, model: Model) -> DataFrame:
    """uid, total (log P), words and marks of texts (uid, text); equal uids add up."""
    shards, heavy, tables = model.shards, model.heavy, model.tables
    shared = Model(None, shards, heavy, model.numbers, model.scalars)  # without what belongs to the driver

    def ask(batches):
        for context, word, text, rows in _pairs(batches):
            uid = np.concatenate([b.column(b.schema.get_field_index("uid")).to_numpy() for b in rows])
            order = np.lexsort((context, word))
            w, v, t = word[order], context[order], text[order]
            blocks = _kind(2, _blocks(ASKED, _shard_of(w, v, shards, heavy), w, v & _LOW_CONTEXT, t))
            ids = pa.array([_pack(TEXTS, uid.view(U), np.bincount(text, minlength=len(uid)))] * blocks.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*blocks.columns, ids, pa.array([len(uid)] * blocks.num_rows, pa.int64())], names=[*blocks.schema.names, "ids", "texts"])

    def answer(batches):
        for _, rows in groupby(_rows(batches), lambda r: r["shard"]):  # by kind: the model's tables come first
            held: list[dict] | None = []
            for r in rows:
                if r["kind"] < 2:
                    held.append(r)
                    continue
                if held is not None:
                    shard, held = Shard(shared, held), None
                w, v, t = _unpack(ASKED, r["block"], r["n"])
                total = np.bincount(t.astype(np.int64), shard.log_p(w, v), r["texts"]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r["ids"]], pa.binary()), pa.array([r["texts"]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["ids", "texts", "total"])

    def add(batches):
        """The answers of all shards to a block."""
        for ids, rows in groupby(_rows(batches), lambda r: r["ids"]):
            total, n = 0.0, 0
            for r in rows:
                total, n = total + np.frombuffer(r["total"], np.float32).astype(float), r["texts"]
            uid, words = _unpack(TEXTS, ids, n)
            yield pa.RecordBatch.from_arrays([pa.array(uid.view(np.int64)), pa.array(total), pa.array(words.astype(np.int64)), pa.array([1] * n, pa.int64())], names=["uid", "total", "words", "marks"])

    asked = texts.select("uid", "text").mapInArrow(ask, f"kind int, {_BLOCK}, ids binary, texts long")
    both = tables.df.drop("told").where("n > 0").withColumns({"ids": F.lit(None).cast("binary"), "texts": F.lit(0).cast("long")}).unionByName(asked)
    got = _by_shard(both, shards, "kind").mapInArrow(answer, "ids binary, texts long, total binary")
    got = got.repartition(shards, "ids").sortWithinPartitions("ids").mapInArrow(add, "uid long, total double, words long, marks long")
    return got.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("total", "words", "marks")])


def perplexities(texts: DataFrame, model: Model, passes: int = PASSES) -> DataFrame:
    """uid, perplexity by word and mark (null for a text without words) of texts (uid, text)."""
    out = None
    for i in range(passes):
        part = texts.where(F.pmod(F.xxhash64("uid"), F.lit(passes)) == i)  # every text is in one pass
        one = Written(log_probabilities(part, model), "log-probabilities").df
        out = one if out is None else out.unionByName(one)
        free_shuffles(texts.sparkSession)
    return out.select("uid", F.when(F.col("words") > F.col("marks"), F.exp(-F.col("total") / F.col("words"))).alias("perplexity"))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % HELD_OUT == 0


def judge(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """Per document: doc_id, lang, perplexity, threshold, kept.

    Trusted is what `labels` marks 1, by one mark at least; one in HELD_OUT of
    them (by the id's CRC) sets the thresholds, the others are counted.  A null
    language is one of its own; a language of fewer than LEAST_TRUSTED held-out
    documents, and any without, has the threshold of all.  Texts without words,
    null ones too, have no perplexity and are not kept.  Rows that share an id or
    have none are scored each by its own text, and repeated rows alike.  Without
    trusted documents nothing with words is rejected; an empty table gives no rows.
    """
    c = F.col
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].cast("string").alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    several = base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").take(1)
    #: What a row is known by: its id, or if ids do not tell rows apart a number made of its content.
    base = base.withColumn("uid", F.xxhash64("id", "text") if several else c("id"))
    trusted = labels.where((labels[label_col] == 1) & labels[id_col].isNotNull()).select(labels[id_col].cast("long").alias("tid")).distinct()
    trusted = Written(trusted, "trusted").df
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = fit(base.join(bounded(trusted.where(~held_out(c("tid")))), c("id") == c("tid"), "left_semi"), size // PASSES)
    scored = perplexities(base, model).withColumnRenamed("uid", "suid")
    full = base.select("id", "lang", "uid").join(scored, c("uid") == c("suid"), "left").select("id", "lang", "perplexity")
    full = Written(full, "perplexities").df
    model.tables.drop()
    good = full.where("perplexity IS NOT NULL").join(bounded(trusted), c("id") == c("tid"), "left_semi").withColumn("out", held_out(c("id")))
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    # a held-out document has the say if there is one
    everyone = good.groupBy("out").agg(cut.alias("all")).orderBy(F.desc("out")).first()
    by_lang = good.where("out").groupBy(c("lang").alias("tlang")).agg(cut.alias("own"), F.count(F.lit(1)).alias("n")).where(c("n") >= LEAST_TRUSTED)
    out = full.join(bounded(by_lang), c("lang").eqNullSafe(c("tlang")), "left")
    threshold = F.coalesce("own", F.lit(everyone["all"] if everyone is not None else float("inf")))
    return out.select(c("id").alias("doc_id"), "lang", "perplexity", threshold.alias("threshold"), F.coalesce(c("perplexity") <= threshold, F.lit(False)).alias("kept"))
