"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by successive runs of their bytes, the digits, most
significant first: a group is the documents that agree on all digits so far, and
each level splits every group by the next digit and by whether the text ends in
it.  A group of one document is done, and so is one whose texts have ended.  The
bytes themselves are compared: no digest decides equality, and neither does a
text's length.

Each level is one partial-aggregated count by (group, digit), written as the
table of groups, and one equi-join of the documents to it.  The count collapses
a hot group to one row a task before it is shuffled; the join has no aggregate in
its stage, so that the adaptive planner can split a hot group's documents; it is a
merge join at every size, as the table of groups grows with the documents.
Digits grow by a factor, so a text of b bytes takes O(log b) levels; a document
goes on only while another one shares all its bytes so far, and takes along only
the bytes that are still to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, free_shuffles

#: Bytes of the first digit, and how much longer each next one is.
FIRST_DIGIT, DIGIT_GROWTH = 32, 16


def _digits(rows: DataFrame, width: int) -> DataFrame:
    """digit, and whether the text ends in it."""
    return rows.withColumns({"digit": F.substring("rest", 1, width), "ends": F.octet_length("rest") <= width})


def _after(width: int) -> Column:
    return F.expr(f"substring(rest, {width + 1})")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """Columns row (struct of all input columns), keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  Null text is empty.  Of
    rows that tie on the id too (repeated rows), exactly one stays; a null id
    is smaller than any other.  An empty table gives no rows.  Without
    `carry_text`, row holds the id alone, so texts are not written again.
    A text may be as long as a row can be: all its bytes are compared.
    """
    spark, c = docs.sparkSession, F.col
    row = F.struct(*[docs[x] for x in docs.columns]) if carry_text else F.struct(docs[id_col])
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    if carry_text:  # the row has the text already: shuffle it once
        base = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"))
        rest = F.coalesce(c("row").getField(text_col).cast("string"), F.lit("")).cast("binary")
    else:
        base, rest = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), body.alias("rest")), c("rest")
    heads = _digits(docs.select(body.alias("rest")), FIRST_DIGIT).groupBy("digit", "ends").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = Written(heads.select(c("digit").alias("hd"), c("ends").alias("he"), F.monotonically_increasing_id().alias("g")), "radix-heads")
    first = base.withColumns({"digit": F.substring(rest, 1, FIRST_DIGIT), "ends": F.octet_length(rest) <= FIRST_DIGIT})
    first = first.join(heads.df.hint("merge"), (c("digit") == c("hd")) & (c("ends") == c("he")), "left")
    first = first.select(
        #: Written with its row: how files are split when they are read depends on the cores there are then.
        F.monotonically_increasing_id().alias("uid"),
        "row", "id", "g",
        F.sha2(rest, 256).alias("sha"),
        F.when(c("g").isNotNull(), F.substring(rest, FIRST_DIGIT + 1, 2**31 - 1)).alias("rest"),
    )
    first = Written(first, "radix-rows").df
    heads.drop()
    free_shuffles(spark)

    level: Written | None = None
    active = first.where("g IS NOT NULL").select("uid", "id", "g", "rest")
    done: list[DataFrame] = []
    width = FIRST_DIGIT * DIGIT_GROWTH
    while active.take(1):
        active = _digits(active, width)
        top = F.max(F.struct("id", "uid"))
        groups = active.groupBy("g", "digit", "ends").agg(top.alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
        groups = Written(groups.withColumnsRenamed({"g": "hg", "digit": "hd", "ends": "he"}), "radix-groups")
        same = (c("g") == c("hg")) & (c("digit") == c("hd")) & (c("ends") == c("he"))
        several = active.join(groups.df.hint("merge"), same).select(
            "uid", "id", "keep", "size", "ends", F.when(~c("ends"), F.substring("rest", width + 1, 2**31 - 1)).alias("rest")
        )
        after = Written(several, "radix-level")
        groups.drop()
        if level is not None:
            level.drop()
        free_shuffles(spark)
        done.append(Written(after.df.where("ends").select("uid", "keep", "size"), "radix-done").df)
        level, width = after, width * DIGIT_GROWTH
        active = after.df.where("NOT ends").select("uid", "id", c("keep.uid").alias("g"), "rest")
    if level is not None:
        level.drop()
    own = F.struct("id", "uid")
    if not done:
        out = first.withColumns({"keep": own, "size": F.lit(1).cast("long")})
    else:
        found = done[0]
        for part in done[1:]:
            found = found.unionByName(part)
        out = first.join(found.withColumnRenamed("uid", "fu"), c("uid") == c("fu"), "left")
        out = out.withColumns({"keep": F.coalesce("keep", own), "size": F.coalesce("size", F.lit(1).cast("long"))})
    return out.select("row", c("keep.id").alias("keep_id"), c("size").alias("group_size"), (c("keep.uid") == c("uid")).alias("kept"), c("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    out = annotate(docs, id_col, text_col)
    return out.select(F.col("row")[id_col].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns; of equal texts one row."""
    out = annotate(docs, id_col, text_col, carry_text=True).where("kept")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
