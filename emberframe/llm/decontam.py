"""Finding benchmark items inside documents by MinHash containment.

Items are dealt into partitions by size (powers of two of their number of
shingles).  An item's sketch is the shingles of the smallest hashes; how many
is set by its partition: with u the partition's largest size and t the least
containment, (1 - t) * u + 1 of them.  A document that contains at least t of
the item lacks at most (1 - t) of its shingles, so it holds one of the sketch
for certain, wherever in a long document the item stands and however long that
document is.  Sketch hits are candidates; the exact shingles of each candidate
document are then compared with those of the item, as text.

Built-in functions only; nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles

WORDS, CONTAINMENT = 5, 0.8
_BLANKS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """White-space words in lower case; none for null and blank texts."""
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _BLANKS)
    return F.filter(parts, lambda w: w != "")


def _shingles(words: Column, k: int, make) -> Column:
    """make(the k words from each place on)."""
    n = F.size(words)
    at_each = F.transform(words, lambda w, i: make([w, *(F.get(words, i + j) for j in range(1, k))]))
    return F.slice(at_each, 1, F.greatest(n - (k - 1), F.lit(0)))


def _hashed(words: Column, k: int) -> Column:
    return _shingles(words, k, lambda ws: F.xxhash64(F.lit(k), *ws))


def _texts(words: Column, k: int) -> Column:
    """A shingle as text; it says how long it is, as a short item's may be shorter."""
    return _shingles(words, k, lambda ws: F.concat_ws(" ", F.lit(str(k)), *ws))


def _items(benchmark: DataFrame, item_col: str, text_col: str, words: int, containment: float) -> DataFrame:
    """item, key (of this very item), k, size, sketch, shingles."""
    base = benchmark.select(benchmark[item_col].alias("item"), _words(benchmark[text_col]).alias("w"))
    base = base.withColumn("k", F.least(F.size("w"), F.lit(words))).where("k > 0")
    parts = []
    for k in range(1, words + 1):
        some = base.where(F.col("k") == k)
        parts.append(some.select("item", "k", F.xxhash64("item", "w").alias("key"), F.array_sort(F.array_distinct(_hashed(F.col("w"), k))).alias("hashes"), F.array_distinct(_texts(F.col("w"), k)).alias("shingles")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    size = F.size("shingles")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double"))))
    share = 1 - containment
    sketch = F.slice("hashes", 1, (F.floor(upper * share + 1e-9) + 1).cast("int"))
    return out.select("item", "key", "k", size.alias("size"), sketch.alias("sketch"), "shingles").distinct()


def contained(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, containment: float = CONTAINMENT,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, item_shingles, shared, containment.

    An item of fewer than `words` words is one shingle, all its words; an item
    without words is in no document.  Null text is empty.  Rows with the same id
    (or without one) are judged together.  Repeated items count once.  Empty
    tables give no rows.
    """
    items = Written(_items(benchmark, item_col, item_text_col, words, containment), "items").df
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # `words` values at most
    base = docs.select(docs[id_col].alias("id"), _words(docs[text_col]).alias("w"))

    def each(make, of: DataFrame) -> DataFrame:
        arrays = [make(F.col("w"), k) for k in sizes] or [make(F.col("w"), words)]
        return of.select("id", F.explode(arrays[0] if len(arrays) == 1 else F.concat(*arrays)).alias("s"))

    sketches = items.select("key", F.explode("sketch").alias("h"))
    hits = each(_hashed, base).join(bounded(sketches), F.col("s") == F.col("h"))
    candidates = Written(hits.select("id", "key").distinct(), "candidates").df
    free_shuffles(docs.sparkSession)

    suspects = candidates.select(F.col("id").alias("sid")).distinct()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    texts = texts.join(suspects, texts.id.eqNullSafe(suspects.sid), "left_semi").select("id", _words(F.col("body")).alias("w"))
    exact = items.select(F.col("key").alias("xkey"), F.explode("shingles").alias("x"))
    found = each(_texts, texts).join(bounded(exact, 200_000), F.col("s") == F.col("x")).select("id", "xkey", "x").distinct()
    counted = found.groupBy("id", "xkey").agg(F.count(F.lit(1)).alias("shared"))
    ours = candidates.withColumnsRenamed({"id": "cid"})
    counted = counted.join(ours, F.col("id").eqNullSafe(F.col("cid")) & (F.col("xkey") == F.col("key")), "left_semi")
    out = counted.join(bounded(items.select("key", "item", "size")), F.col("xkey") == F.col("key"))
    need = F.ceil(F.col("size") * containment - 1e-9)
    return out.where(F.col("shared") >= need).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("size").cast("long").alias("item_shingles"),
        "shared", (F.col("shared") / F.col("size")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, documents that contain an item left out."""
    bad = contained(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("bad")).distinct()
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"))
    left = row.join(bad, row.id.eqNullSafe(bad.bad), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL of the query over `documents` and `benchmark`.
SQL = """
    WITH doc_words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
    ), item_words AS (
        SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
    ), items AS (
        SELECT item_id, w, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0
    ), item_shingles AS (
        SELECT DISTINCT item_id, w AS item, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
    ), sizes AS (
        SELECT item_id, item, count(*) AS n FROM item_shingles GROUP BY ALL
    ), doc_shingles AS (
        SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
    )
    SELECT d.doc_id, i.item_id, z.n AS item_shingles, count(*) AS shared, count(*) / z.n AS containment
    FROM doc_shingles d JOIN item_shingles i USING (k, s) JOIN sizes z ON z.item_id = i.item_id AND z.item = i.item
    GROUP BY d.doc_id, i.item_id, i.item, z.n
    HAVING count(*) >= ceil(z.n * 0.8 - 1e-9)
"""
