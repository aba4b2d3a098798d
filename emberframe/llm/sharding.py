"""Placing documents on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose
size is prime: slot (offset + turn * skip) mod size.  Shards take turns, each
claiming the first slot of its order that is still free, until none is.  So
shards hold equal shares to within one slot, and when a shard joins or leaves,
few slots of the others move.  The table has a fixed number of rows whatever
the data, so broadcasting it is bounded, and placing a key is one lookup.

The control plane (filling the table) is ordinary driver code over a fixed
number of slots; all work on rows is built-in DataFrame functions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over 100 slots for each of up to 600 shards; the broadcast is under 2 MB.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's walk over the slots."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard in `shards`."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, as large as the number of shards at least")
    walks = [list(preference(s, size)) for s in shards]
    table, free = [-1] * size, size
    while True:
        for i, walk in enumerate(walks):
            slot, skip = walk
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot] = i
            walk[0] = (slot + skip) % size
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    rows = [(slot, i, shards[i]) for slot, i in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "slot int, shard_no int, shard string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5, so that other engines can compute it too.  A null key has the slot of ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size).cast("long")).cast("int")


def place(docs: DataFrame, key_col: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """The input's columns as struct row, and slot, shard_no, shard.

    No shuffle: a broadcast of `size` rows at most.  The key is the document's
    own id, so a source with a third of all rows spreads like any other.
    Repeated rows go to the same shard; an empty table gives no rows.
    """
    table = table_frame(docs.sparkSession, list(shards or SHARDS), size)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), slot_of(docs[key_col], size).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select("row", "slot", "shard_no", "shard")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """Per document: doc_id, slot, shard_no, shard."""
    out = place(docs.select(docs[id_col].alias("id")), "id", shards, size)
    return out.select(F.col("row.id").alias("doc_id"), "slot", "shard_no", "shard")


def shard_column(columns: list[str]) -> str:
    """The name of the folders' column: shard, or with as many underlines as no input column has."""
    name = "shard"
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE, splits: int = 8) -> str:
    """Write the documents as Parquet with all the input's columns, a folder for each shard; the name of the folders' column.

    One shuffle.  A shard's rows are dealt to `splits` tasks by their content, so
    none holds a whole shard; equal rows (repeats) are placed alike, nulls
    count as the key ''.  An empty table writes no folder.
    """
    out, name = place(docs, key_col, shards, size), shard_column(docs.columns)
    rows = out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(name))
    rows.repartition(F.col(name), F.pmod(F.xxhash64(*[rows[c] for c in docs.columns]), F.lit(splits))).write.partitionBy(name).parquet(path)
    return name
