"""Removing long repeated substrings by a sparse, range-partitioned suffix array.

A byte goes when a string of LENGTH bytes that covers it also starts earlier.

*Which suffixes.*  Every window of LENGTH bytes elects an anchor: of the
GRAM-byte strings inside it the one of the smallest hash, leftmost if tied.
Equal windows elect the same place, so it is enough to compare windows that
meet at an anchor; anchors are about 2 in 85 of all positions.  Consecutive
windows with one anchor form its run, and the run's text is its context.

*What repeats.*  Anchors whose GRAM bytes occur once (one partial-aggregated
count) are left out.  Anchors with the same context (two independent 64-bit
hashes: of the GRAM bytes and of the run's) form a class: all windows
of the later ones repeat, and only the class's first anchor is looked at again,
and only if its GRAM bytes have another class too.  This is where exact copies
and long common passages end, at the cost of one row for each class and task.

*Suffix array.*  For the rest, the suffixes at the anchors are dealt by sampled
splitters over their leading bytes into ranges.  Each range sorts its suffixes,
and the texts before them backwards, by multikey quicksort; from the common
prefix lengths of neighbours follow the classes of equal windows for every split
of LENGTH into what lies before and after the anchor.  The first window of each
class stays, the others repeat.

*Across boundaries.*  Suffixes that agree on a window's bytes can lie on both
sides of a splitter only if they agree with the splitter on them, which the
common prefix with the range's two ends tells.  Those windows, few of each
range, go to a table of their own, where equal ones meet by their bytes.  So
ranges are of like size however often a string occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Written, bounded, chunks, free_shuffles
from .kernels import U, hash_ranges, mix

LENGTH, GRAM = 100, 16
#: Rows that a range should have, ranges at most (they grow beyond), and rows that splitters are taken from for each.
RANGE_ROWS, RANGES, RANGE_SAMPLE = 8_000, 4_096, 16
_WORD = 8


def _word_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on (fewer at the end) as one number."""
    padded = np.concatenate([buf, np.zeros(_WORD, np.uint8)])
    return np.ndarray(len(buf), "<u8", padded.tobytes(), 0, (1,)).astype(U)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    w = _word_at(buf)
    after = np.concatenate([w[_WORD:], np.zeros(min(_WORD, len(w)), U)])
    return mix(w * U(0x9E3779B97F4A7C15) ^ mix(after + U(0x632BE59BD9B4E019)))


def _runs(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """(hash array, anchor, first window, last window, text number) of every run of windows with one anchor."""
    h = _gram_hashes(buf)
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return h, none, none, none, none
    key = (h >> U(32) << U(32)) | np.arange(len(h), dtype=U)
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    window = np.arange(len(buf) - length + 1)
    window = window[window + length <= offs[1:][doc[window]]]
    if not len(window):
        return h, none, none, none, none
    anchor = (key[window] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return h, anchor[first], window[first], window[last], doc[anchor[first]]


def _pieces(buf: np.ndarray, offs: np.ndarray, length: int, limit: int = CHUNK_BYTES):
    """_runs of all texts, a text over the limit in pieces that end where a run does; positions are those in buf."""
    if len(offs) != 2 or len(buf) <= 2 * limit:
        h, *rest = _runs(buf, offs, length)
        yield h[rest[0]], *rest
        return
    at = 0
    while True:
        to = min(len(buf), at + limit + length)
        h, anchor, lo, hi, doc = _runs(buf[at:to], np.array([0, to - at]), length)
        n = len(anchor) if to == len(buf) else len(anchor) - 1  # the last run may go on
        yield h[anchor[:n]], anchor[:n] + at, lo[:n] + at, hi[:n] + at, doc[:n]
        if to == len(buf):
            return
        at += int(lo[n])


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """gram, context, key, place: of each anchor; place packs its position, the bytes before it in the run, and how far the last window starts before it."""

    def run(batches):
        for batch, buf, offs in chunks(batches):
            for gram, anchor, lo, hi, doc in _pieces(buf, offs, length):
                if not len(anchor):
                    continue
                left, right = anchor - lo, anchor - hi
                context = hash_ranges(buf, lo, hi + length) ^ mix((left << 8 | right).astype(U))
                place = (anchor - offs[doc]) << 16 | left << 8 | right
                key = batch.column("key").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), key, pa.array(place)], names=["gram", "context", "key", "place"])

    return docs.select("key", "text").mapInArrow(run, "gram long, context long, key long, place long")


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of 8-byte big-endian words, by words from the left."""
    n, width = words.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == width:
            continue
        own = order[lo:hi]
        if hi - lo <= 256:
            order[lo:hi] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        w = words[own, depth]
        sample = np.sort(w[:: max(1, len(w) // 31)])
        pivot = sample[len(sample) // 2]
        less, same, more = own[w < pivot], own[w == pivot], own[w > pivot]
        order[lo:hi] = np.concatenate([less, same, more])
        a, b = lo + len(less), lo + len(less) + len(same)
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _classes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts, and the common prefix length of each with the one before it in that order."""
    wide = -(-width // _WORD) * _WORD
    raw = b"".join(t.ljust(wide, b"\0") for t in texts)
    flat = np.frombuffer(raw, np.uint8).reshape(len(texts), wide)
    order = multikey_quicksort(flat.view(">u8").astype(U))
    size = np.array([len(t) for t in texts])
    differ = flat[order[1:]] != flat[order[:-1]]
    lcp = np.where(differ.any(1), differ.argmax(1), wide) if len(texts) > 1 else np.zeros(0, np.int64)
    lcp = np.minimum(lcp, np.minimum(size[order[1:]], size[order[:-1]]))
    return order, np.concatenate([[-1], lcp])


def repeated_windows(before: list[bytes], after: list[bytes], least: np.ndarray, length: int = LENGTH, most: np.ndarray | None = None):
    """(row, bytes before the anchor) of every window that another row, further up, has as well.

    before, after: text of each row's run before and from its anchor on; least,
    most: the fewest and most bytes before the anchor that a window of the row
    has.  Rows are in the order of their places in the corpus.
    """
    n = len(before)
    most = np.array([len(b) for b in before]) if most is None else most
    back_order, back_lcp = _classes([b[::-1] for b in before], length)
    fore_order, fore_lcp = _classes(after, length)
    rows_out, split_out = [], []
    back, fore = np.empty(n, np.int64), np.empty(n, np.int64)
    for split in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= split) & (split <= most))
        if len(rows) < 2:
            continue
        back[back_order] = np.cumsum(back_lcp < split)
        fore[fore_order] = np.cumsum(fore_lcp < length - split)
        key = back[rows] * (n + 1) + fore[rows]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False
        rows_out.append(rows[again])
        split_out.append(np.full(int(again.sum()), split))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(split_out)


def _merged(key: np.ndarray, start: np.ndarray, length: int):
    """Unions of [start, start + length) by key."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], start[first], start[last] + length


_SPANS = "key long, lo long, hi long, window binary"


def _spans(key, lo, hi, window=None) -> pa.RecordBatch:
    window = pa.nulls(len(key), pa.binary()) if window is None else pa.array(window, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), window], names=["key", "lo", "hi", "window"])


def _padded(texts: list[bytes], length: int) -> np.ndarray:
    return np.array([t[:length] for t in texts], f"S{length}") if texts else np.zeros(0, f"S{length}")


def _common(a: np.ndarray, b: bytes, length: int) -> np.ndarray:
    """Length of the common prefix of each row with b, both padded."""
    rows = np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), length)
    differ = rows != np.frombuffer(b.ljust(length, b"\0"), np.uint8)
    return np.where(differ.any(1), differ.argmax(1), length)


def _splitters(segments: DataFrame, length: int) -> list[bytes]:
    """Suffixes between ranges, in order.

    Rows whose hash is under a share are collected, each task sending its own ones only:
    about RANGES * RANGE_SAMPLE at most, as the hash is of keys that do not repeat.
    """
    count = segments.count()
    n = min(count // RANGE_ROWS, RANGES)
    if n < 1:
        return []
    share = int(min(1.0, (n + 1) * RANGE_SAMPLE / count) * 2**62)
    rows = segments.where(F.shiftrightunsigned(F.xxhash64("key", "anchor"), 2) < share).select("after").collect()
    return np.unique(_padded(sorted(bytes(r["after"]) for r in rows)[RANGE_SAMPLE::RANGE_SAMPLE], length)).tolist()


def _by_suffix_array(segments: DataFrame, length: int) -> DataFrame:
    """Repeated windows that lie in one range, and with their bytes all windows that a splitter may cut."""
    marks = _splitters(segments, length)
    shared = segments.sparkSession.sparkContext.broadcast(marks)

    def deal(batches):
        marks = np.array(shared.value, f"S{length}")
        for batch in batches:
            at = np.searchsorted(marks, _padded(batch.column("after").to_pylist(), length), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    kinds = "key long, anchor long, least long, before binary, after binary"
    ranged = segments.select("key", "anchor", "least", "before", "after").mapInArrow(deal, f"range int, {kinds}").repartition(len(marks) + 1, "range")

    def run(batches):
        marks = shared.value
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by([("range", "ascending"), ("key", "ascending"), ("anchor", "ascending")])
        ranges = t["range"].to_numpy()
        for which in np.unique(ranges):
            own = t.slice(int(np.searchsorted(ranges, which)), int((ranges == which).sum()))
            key, anchor, least = (own[c].to_numpy() for c in ("key", "anchor", "least"))
            before, after = own["before"].to_pylist(), own["after"].to_pylist()
            rows = _padded(after, length)
            cut = np.zeros(len(rows), np.int64)
            for m in marks[max(0, which - 1) : which + 1]:  # the range's two ends
                cut = np.maximum(cut, _common(rows, m, length))
            most = np.array([len(b) for b in before])
            inner = np.minimum(most, length - cut - 1)  # windows of more bytes after the anchor than are common with an end
            again, split = repeated_windows(before, after, least, length, inner)
            if len(again):
                yield _spans(*_merged(key[again], anchor[again] - split, length))
            lo = np.maximum(inner + 1, least)
            n = np.maximum(most - lo + 1, 0)
            for i in range(0, len(n), 512):
                who = np.repeat(np.arange(i, min(i + 512, len(n))), n[i : i + 512])
                if len(who):
                    split = lo[who] + np.arange(len(who)) - np.repeat(np.cumsum(n[i : i + 512]) - n[i : i + 512], n[i : i + 512])
                    text = [before[w][len(before[w]) - s :] + after[w][: length - s] for w, s in zip(who.tolist(), split.tolist(), strict=True)]
                    yield _spans(key[who], anchor[who] - split, anchor[who] - split + length, text)

    return ranged.mapInArrow(run, _SPANS)


def _at_boundaries(rows: DataFrame) -> DataFrame:
    """Of equal windows all but the first."""
    c = F.col
    first = rows.groupBy("window").agg(F.min(F.struct("key", "lo")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = Written(first.select(c("window").alias("fw"), "first"), "first-windows").df
    return rows.join(first, c("window") == c("fw")).where((c("key") != c("first.key")) | (c("lo") != c("first.lo"))).select("key", "lo", "hi")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a key that orders the documents: the id, or where ids repeat or lack, the place in the order of id and text."""
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    twice = base.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR id IS NULL")
    if not twice.take(1):
        return base.withColumn("key", F.col("id"))
    ranged = Written(base.orderBy(F.col("id").asc_nulls_first(), F.sha2("text", 256)).withColumn("key", F.monotonically_increasing_id()), "keyed")
    return ranged.df


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): for each document spans (lo, hi) of bytes that repeat an earlier place; they may overlap."""
    spark, c = keyed.sparkSession, F.col

    def by_key(spans: DataFrame) -> DataFrame:
        return spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    anchors = _anchors(keyed, length)
    #: Written before it is joined, here and below: the join's stage then has no aggregate in it, and its hot keys can be split.
    twice = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(c("gram").alias("g"))
    twice_table = Written(twice, "grams")
    twice = twice_table.df
    free_shuffles(spark)
    anchor_table = Written(anchors.join(twice, c("gram") == c("g"), "left_semi"), "anchors")
    shared = anchor_table.df
    twice_table.drop()
    free_shuffles(spark)

    first = shared.groupBy("gram", "context").agg(F.min(F.struct("key", "place")).alias("first"), F.count(F.lit(1)).alias("c"))
    class_table = Written(first, "contexts")
    classes = class_table.df
    free_shuffles(spark)
    more = classes.where("c > 1").select(c("gram").alias("g"), c("context").alias("x"), "first")
    later = shared.join(more, (c("gram") == c("g")) & (c("context") == c("x"))).where((c("key") != c("first.key")) | (c("place") != c("first.place")))
    anchor, left, right = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), c("place").bitwiseAND(F.lit(255))
    copies = Written(by_key(later.select("key", (anchor - left).alias("lo"), (anchor - right + length).alias("hi"))), "copies").df
    anchor_table.drop()
    free_shuffles(spark)

    #: First anchors of GRAM strings with several classes, with the text of their runs.
    many_table = Written(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c("gram").alias("g")), "open-grams")
    open_ = classes.join(many_table.df, c("gram") == c("g")).select(c("first.key").alias("okey"), c("first.place").alias("at"))
    open_ = Written(open_.groupBy("okey").agg(F.collect_list("at").alias("at")), "open").df
    class_table.drop()
    many_table.drop()
    free_shuffles(spark)

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, at in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("at").to_pylist(), strict=True):
                raw = text.as_py().encode()
                for place in at:
                    a, lt, rt = place >> 16, place >> 8 & 255, place & 255
                    out.append((key, a, rt, raw[a - lt : a], raw[a : a - rt + length]))
                if len(out) > 20_000:
                    yield _segments(out)
                    out = []
            yield _segments(out)

    def _segments(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["key", "anchor", "least", "before", "after"])

    held = keyed.select("key", "text").join(bounded(open_, 20_000, F.size("at") * 8 + 32), c("key") == c("okey")).select("key", "text", "at")
    segment_table = Written(held.mapInArrow(cut, "key long, anchor long, least long, before binary, after binary"), "segments")
    segments = segment_table.df
    free_shuffles(spark)
    ranged = Written(_by_suffix_array(segments, length), "ranges")
    segment_table.drop()
    free_shuffles(spark)
    inner = ranged.df.where("window IS NULL").select("key", "lo", "hi")
    near = Written(by_key(inner.unionByName(_at_boundaries(ranged.df.where("window IS NOT NULL")))), "windows").df
    ranged.drop()
    free_shuffles(spark)
    return copies.unionByName(near).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, removed (array of byte spans lo, hi), kept (binary, what is left).

    Null text is empty; texts under `length` bytes lose nothing.  Rows that share
    an id, or have none, count as documents of their own in the order of their
    texts' digests, those without an id first.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, length).withColumnRenamed("key", "skey")
    both = keyed.join(spans, F.col("key") == F.col("skey"), "left").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                out, rest, at = [], [], 0
                if own.is_valid:
                    flat = own.values.flatten()
                    lo, hi = (x.to_numpy() for x in flat)
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                    for a, b in zip(lo[new].tolist(), reach[np.concatenate([new[1:], [len(lo)]]) - 1].tolist(), strict=True):
                        out.append({"lo": a, "hi": b})
                        rest.append(raw[at:a])
                        at = b
                rest.append(raw[at:])
                sizes.append(len(raw))
                removed.append(out)
                kept.append(b"".join(rest))
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<lo: long, hi: long>>, kept binary")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs, length, id_col, text_col)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
