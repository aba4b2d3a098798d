"""Documents linked by the Jaccard similarity of their word shingles.

Shingles have one order for all documents, rare ones first (by the counts of a
fixed number of hash buckets over the whole corpus, then by hash).  Two sets
that are similar enough share a shingle among the first few of either: those
are the prefix, and documents meet on prefix shingles alone.  A length filter,
a positional filter (what is left after the shared place must suffice) and a
suffix filter (counts between pivots bound the overlap) drop pairs before the
exact overlap is taken, once a pair.

Documents with equal sets form one class, which takes part once.  Whoever meets
on a shingle is first held against one leader of that list, which is linear in
the list; the pairs that are left to look at are those that no link joins yet.
No pair within one component has to be verified, and none between components is
skipped, so components are exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, chunks, free_shuffles, id_text
from .components import connected_components
from .kernels import U, mix, shingle_sets

#: Hash buckets that hold shingle counts; the table that is broadcast has 4 bytes for each.
BUCKETS = 1 << 20
_PARTS = 64
#: What words are made of; only A to Z have another case.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def _ceil_div(a, b):
    return -((-a) // b)


class Threshold:
    """100 * overlap >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.p = percent

    def overlap(self, both):
        """Least overlap of two sets with so many elements together."""
        return _ceil_div(self.p * both, 100 + self.p)

    def prefix(self, n):
        """Elements of the prefix against any partner."""
        return n - _ceil_div(self.p * n, 100) + 1

    def overlap_sql(self, both: Column) -> Column:
        d = 100 + self.p
        return F.floor((F.lit(self.p) * both + (d - 1)) / d).cast("long")


def bucket_counts(texts: DataFrame, size: int) -> np.ndarray:
    """In how many documents the shingles of each bucket are, over all documents."""
    width = BUCKETS // _PARTS

    def count(batches):
        total = np.zeros(BUCKETS, np.int32)
        for _, buf, offs in chunks(batches):
            _, h = shingle_sets(buf, offs, size)
            total += np.bincount((h & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        parts = [total[i * width : (i + 1) * width].tobytes() for i in range(_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                n = np.frombuffer(raw, np.int32).astype(np.int64)
                sums[part] = sums[part] + n if part in sums else n
        out = [np.minimum(n, 2**31 - 1).astype(np.int32).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], names=["part", "n"])

    rows = texts.select("text").mapInArrow(count, "part int, n binary").repartition(_PARTS, "part").mapInArrow(add, "part int, n binary")
    out = np.zeros(BUCKETS, np.int32)
    for r in rows.collect():  # BUCKETS numbers, whatever the corpus
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["n"], np.int32)
    return out


def _signatures(texts: DataFrame, size: int, threshold: Threshold) -> DataFrame:
    """Per document: id, n, a 128-bit fingerprint of its set (two independent hashes of each shingle), its prefix in order."""
    counts = texts.sparkSession.sparkContext.broadcast(bucket_counts(texts, size))

    def run(batches):
        for batch, buf, offs in chunks(batches):
            rows = len(offs) - 1
            owner, h, other = shingle_sets(buf, offs, size, second=True)
            n = np.bincount(owner, minlength=rows)
            first = np.concatenate([[0], np.cumsum(n)])

            def total(x, n=n, first=first):
                s = np.concatenate([[U(0)], np.cumsum(x, dtype=U)])
                return mix(s[first[1:]] - s[first[:-1]] + n.astype(U)).view(np.int64)

            order = np.lexsort((h, counts.value[(h & U(BUCKETS - 1)).astype(np.int64)], owner))
            keep = np.where(n > 0, threshold.prefix(n), 0)
            place = np.arange(len(h)) - first[owner]
            chosen = place < keep[owner]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(h[order][chosen].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(total(mix(h + U(1)))), pa.array(total(mix(other ^ U(0xA5A5A5A5A5A5A5A5)))), prefix], names=["id", "n", "f1", "f2", "prefix"])

    return texts.mapInArrow(run, "id long, n long, f1 long, f2 long, prefix array<long>")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of some documents."""
    return texts.join(bounded(nodes), texts.id == nodes.node, "left_semi")


def _exact_sets(a: str, b: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of two texts as sorted numbers, alike only for the same words."""
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(m[0], len(known)) for m in _WORD.finditer(t.translate(_LOWER))], np.int64) for t in (a, b)]
    base = len(known) + 1
    k = [min(size, len(x)) for x in ids]
    if k[0] != k[1]:  # a short text has a shingle of its own length
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, n = np.zeros(sum(len(x) - k[0] + 1 for x in ids), np.int64), 1
    for j in range(k[0]):
        # numbers stay below the square of the texts' length
        code = code * base + np.concatenate([x[j : len(x) - k[0] + 1 + j] for x in ids])
        values, code = np.unique(code, return_inverse=True)
    cut = len(ids[0]) - k[0] + 1
    return np.unique(code[:cut]), np.unique(code[cut:])


def verify(pairs: DataFrame, texts: DataFrame, threshold: Threshold, size: int) -> DataFrame:
    """Those of (a, b) that link, by the exact overlap of their words' shingles."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = _exact_sets(x.as_py(), y.as_py(), size)
                need = threshold.overlap(len(x) + len(y))
                if not len(x) or min(len(x), len(y)) < need:
                    continue
                # suffix filter: what lies between pivots cannot overlap more than the smaller count
                pivots = x[len(x) // 8 :: max(1, len(x) // 8)]
                cx = np.diff(np.concatenate([[0], np.searchsorted(x, pivots), [len(x)]]))
                cy = np.diff(np.concatenate([[0], np.searchsorted(y, pivots), [len(y)]]))
                if np.minimum(cx, cy).sum() < need:
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if int((y[at] == x).sum()) >= need:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = texts.withColumnsRenamed({"id": "ida", "text": "x"})
    right = texts.withColumnsRenamed({"id": "idb", "text": "y"})
    both = pairs.join(left, F.col("a") == F.col("ida")).select("a", "b", "x").join(right, F.col("b") == F.col("idb"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, set_1 and set_2 (fingerprint of its set).

    Null text is empty; a document without words is linked with nothing.  Rows
    with one id are one node, whatever their texts.  Rows without an id are
    linked with nothing and have no component_id.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    limit = Threshold(percent)
    texts = id_text(docs, id_col, text_col)
    signatures = Written(_signatures(texts, size, limit), "signatures")
    signed = Written(signatures.df.drop("prefix"), "heads").df
    free_shuffles(spark)

    part = signed.where("n > 0 AND id IS NOT NULL")
    #: Classes of several documents, written first: the join then has the hot side alone in its stage, where it can be split.
    grouped = part.groupBy("f1", "f2", "n").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    grouped = Written(grouped.withColumnsRenamed({"f1": "g1", "f2": "g2", "n": "gn"}), "classes").df
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn"))
    member = Written(part.select("id", "f1", "f2", "n").join(grouped, same, "left").select("id", F.coalesce("node", "id").alias("node")), "members").df
    nodes = member.where("id = node").select("node").distinct()
    postings = signatures.df.where("n > 0").join(nodes, F.col("id") == F.col("node"), "left_semi")
    postings = postings.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "tok"))
    #: Place and size share a number, places first: rows are as narrow as they can be while they are shuffled.
    postings = postings.select("tok", F.col("id").alias("node"), F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n")).alias("at"))
    lists = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("tok").alias("ltok"))
    listed = Written(postings.join(lists, F.col("tok") == F.col("ltok"), "left_semi"), "postings").df
    signatures.drop()
    free_shuffles(spark)
    listed = listed.select("tok", "node", F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("n"), F.shiftright("at", 32).cast("int").alias("pos"))
    #: The leader of a list is the document with the fewest rarer shingles.
    leaders = listed.groupBy("tok").agg(F.min(F.struct("pos", "node", "n")).alias("top")).withColumnRenamed("tok", "ltok")
    led = listed.join(leaders, F.col("tok") == F.col("ltok")).select("tok", "node", "n", "pos", "top")

    def near(n1, p1, n2, p2) -> Column:
        """Length and positional filters."""
        need = limit.overlap_sql(n1 + n2)
        return (F.least(n1, n2) >= need) & (F.least(n1 - p1, n2 - p2) >= need)

    def ordered(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    c = F.col
    star = led.where((c("node") != c("top.node")) & near(c("n"), c("pos"), c("top.n"), c("top.pos")))
    star = Written(star.select(*ordered(c("node"), c("top.node"))).distinct(), "star").df
    involved = star.select(c("a").alias("node")).union(star.select(c("b").alias("node"))).distinct()
    sets = Written(_texts_of(texts, involved), "sets").df
    free_shuffles(spark)
    links = Written(verify(star, sets, limit, size), "links").df
    labels = connected_components(links)
    free_shuffles(spark)

    #: What no link joins yet, in lists where several components meet.
    own = labels.withColumnsRenamed({"node": "ln"})
    marked = listed.join(own, c("node") == c("ln"), "left").select("tok", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select(c("tok").alias("mtok"))
    open_ = Written(marked.join(mixed, c("tok") == c("mtok"), "left_semi"), "open").df
    small = open_.where(c("n") - c("pos") >= limit.overlap_sql(2 * c("n")))
    x = small.select(c("tok"), *[c(k).alias(f"{k}1") for k in ("node", "n", "pos", "label")])
    y = open_.select(c("tok").alias("tok2"), *[c(k).alias(f"{k}2") for k in ("node", "n", "pos", "label")])
    cross = x.join(y, (c("tok") == c("tok2")) & (c("label1") != c("label2")) & ((c("n1") < c("n2")) | ((c("n1") == c("n2")) & (c("node1") < c("node2")))) & near(c("n1"), c("pos1"), c("n2"), c("pos2")))
    cross = cross.select(*ordered(c("node1"), c("node2"))).distinct().join(star, ["a", "b"], "left_anti")
    cross = Written(cross, "cross").df
    free_shuffles(spark)
    more = cross.select(c("a").alias("node")).union(cross.select(c("b").alias("node"))).distinct()
    fresh = more.join(sets.select("id"), c("node") == c("id"), "left_anti")
    wanted = sets.join(more, c("id") == c("node"), "left_semi").union(_texts_of(texts, fresh))
    found = Written(verify(cross, wanted, limit, size), "links").df
    if found.take(1):
        labels = connected_components(links.union(found))
    #: A document is where its class is; the class of a linked node has the node's label.
    labelled = member.join(labels.withColumnsRenamed({"node": "ln"}), c("node") == c("ln"), "left").select("id", F.coalesce("label", "node").alias("component"))
    labelled = labelled.groupBy("id").agg(F.min("component").alias("component_id")).withColumnRenamed("id", "cid")
    out = signed.select("id", "n", "f1", "f2").join(labelled, c("id") == c("cid"), "left")
    return out.select(
        c("id").alias("doc_id"), c("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), c("f1").alias("set_1"), c("f2").alias("set_2")
    )


def ngram_jaccard(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; nulls, repeated rows and empty tables as in `components`."""
    return components(docs, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns; of each component its document with the smallest id stays, and every row without an id."""
    part = components(docs, size, percent, id_col, text_col)
    kept = part.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"))
    stays = row.join(kept, row.id == kept.kept_id, "left_semi").unionByName(row.where("id IS NULL"))
    return stays.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
