"""Every operator on nulls, empty and repeated rows, clashing columns, and against brute force."""

import hashlib
import json
import random
import re

import pytest

from emberframe.llm import bpe, common, decontam, exact, htmlmain, licences, ngram_join, quality, sharding, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, id string, key string, n bigint"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = [" ".join(make(r.choice((1, 2, 5, 60, 150)))) for _ in range(60)]
    for t in out[40:50]:
        words = t.split()
        for _ in range(1 + len(words) // 60):
            words[r.randrange(len(words))] = "edited"
        out += [" ".join(words), t]
    return [*out, None, "", "  ", "é" * 300, "ab" * 400, out[0], "x" * 5000]


def test_exact(spark, texts):
    got = {r["doc_id"]: r for r in exact.exact_dedup(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    twice = docs_of(spark, ["a", "a"]).withColumn("doc_id", common.F.lit(None).cast("bigint"))
    assert exact.drop_copies(twice).count() == 1
    assert exact.exact_dedup(docs_of(spark, [])).count() == 0


def test_exact_of_long_texts(spark):
    """Texts that agree for long, end where a digit ends, or begin with one another."""
    edges = [n + d for n in (32, 32 + 512, 32 + 512 + 8192) for d in (-1, 0, 1)]
    rows = [("a" * n)[: n - 1] + e for n in edges for e in ("a", "b", "a")] + ["", None, "é" * 20_000, "é" * 20_000, "é" * 20_000 + "x", "z" * 2_000_000, "z" * 2_000_000]
    got = {r["doc_id"]: r for r in exact.exact_dedup(docs_of(spark, rows)).collect()}
    for i, t in enumerate(rows):
        same = [j for j, u in enumerate(rows) if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
    assert exact.drop_copies(docs_of(spark, rows)).count() == len({t or "" for t in rows})


def test_exact_under_other_splits(spark):
    """What is lazy may be read by other numbers of tasks than what was written before."""
    rows = ["x" * 200 + str(i % 7) for i in range(60)]
    out = exact.exact_dedup(docs_of(spark, rows).repartition(8))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    same = {i: [j for j in range(60) if j % 7 == i % 7] for i in range(60)}
    assert got == {i: (max(s), len(s), i == max(s)) for i, s in same.items()}


def test_sharding(spark, texts):
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert sorted(table.count(i) for i in range(3)) == [33, 34, 34]
    many = [f"s{i}" for i in range(10)]
    before, after = sharding.fill_table(many, 1009), sharding.fill_table(many[:-1], 1009)
    assert sum(x != y for x, y in zip(before, after, strict=True) if x != 9) < 200
    for r in sharding.shard_documents(docs_of(spark, texts)).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r["slot"] == slot
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def brute_table(shards, size):
    """Shards take turns by whole lists of preference."""
    lists = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        lists.append([(offset + j * skip) % size for j in range(size)])
    owner: dict = {}
    while len(owner) < size:
        for i, order in enumerate(lists):
            if len(owner) < size:
                owner[next(x for x in order if x not in owner)] = i
    return [owner[i] for i in range(size)]


def test_shards_by_brute_force(spark, tmp_path):
    shards, size = ["x", "y", "z", "w"], 211
    table = brute_table(shards, size)
    assert sharding.fill_table(shards, size) == table
    schema = "doc_id bigint, text string, shard string, SHARD_ string, slot int"
    rows = [(i, f"t{i}", "mine", "too", 5) for i in range(300)] + [(None, "n", "mine", None, None)] * 2 + [(7, "t7", "mine", "too", 5)]
    docs = spark.createDataFrame(rows, schema)
    want = {i: table[int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) % size] for i in [*range(300), None]}
    got = sharding.shard_documents(docs, shards=shards, size=size).collect()
    assert len(got) == len(rows) and all((r["shard_no"], r["shard"]) == (want[r["doc_id"]], shards[want[r["doc_id"]]]) for r in got)
    name = sharding.write_shards(docs, f"{tmp_path}/out", shards=shards, size=size)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert name == "shard__" and sorted(map(str, (tuple(r[:5]) for r in back))) == sorted(map(str, rows))
    assert all(r[name] == shards[want[r["doc_id"]]] for r in back)
    assert sharding.shard_documents(docs.where("false"), shards=shards, size=size).count() == 0
    sharding.write_shards(docs.where("false"), f"{tmp_path}/none")


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    more = [*texts, "x<|endoftext|> y\n\n  z", "don't  \t stop 123!!", "a" * 3000, "日本 語"]
    for r in bpe.tokenize(docs_of(spark, more)).collect():
        want = tokenizer.encode(more[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark):
    rows = docs_of(spark, ["same text", "same text", None]).withColumnsRenamed({"id": "ids", "key": "n_tokens"})
    got = bpe.round_trip(rows.union(rows)).collect()
    assert len(got) == 6 and len({r["ids_sha256"] for r in got}) == 2
    assert bpe.round_trip(rows.where("false")).count() == 0


def test_bpe_new_pieces_go_together(monkeypatch):
    """Pieces that no text had before, of many texts, in a few steps and not one by one; with tables that overflow, and long pieces."""
    from tokenizers import Tokenizer

    r = random.Random(8)
    sounds = ["th", "er", "ción", "sch", "é", "ä", "que", "ou", "ing", "zz", "日", "本", "\u0301", "ß", "1", "٣", "\u00a0", "🙂"]
    ends = ["", "", ",", ".", "'s", "'", "&&&", ".\nThe", "\n", "!?\n\n", "\t", "_", "-x"]
    words = ["".join(r.choice(sounds) for _ in range(r.randint(0, 7))) + r.choice(ends) for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    texts += ["a" * n + " " + "ab" * n + " " + "é" * n + " " + " " * n + "\n" * n for n in range(1, 140, 3)]
    texts += ["", " ", "  ", "\n \n x", "x \ny", "x<|endoftext|> y<|endoftext|>", "don't 'll 've", " lead", "trail ", "\r\n \r\n"]
    bpe_ = bpe.PrefixBpe(json.loads(open(bpe.default_vocabulary(), encoding="utf-8").read()))
    alone, one = [], bpe_.encode_piece
    monkeypatch.setattr(bpe_, "encode_piece", lambda piece: (alone.append(piece), one(piece))[1])
    want = [e.ids for e in Tokenizer.from_file(bpe.default_vocabulary()).encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(x).cast("I")) for x in bpe_.encode_many(texts)] == want
    assert all(len(x) > bpe.STEP_BYTES for x in alone) and alone
    for name, value in (("CACHE_PIECES", 5), ("CACHE_CHARS", 3), ("CACHE_PAIRS", 7), ("STEP_PIECES", 11), ("STEP_BYTES", 9), ("PAIR_BITS", 4)):
        monkeypatch.setattr(bpe, name, value)
    bpe_.forget()
    assert [bpe_.encode(t) for t in texts] == want
    bpe_.forget()
    monkeypatch.setattr(bpe_, "alpha", lambda _: False)  # where Python's letters are others
    assert [bpe_.encode(t) for t in texts] == want


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_ngram_join(spark, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 90 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard(docs_of(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), find(i))
    assert ngram_join.ngram_jaccard(docs_of(spark, [])).count() == 0


def brute_spans(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = [True] * n
            seen.add(w)
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("rows", [8_000, 3])
def test_substrings(spark, texts, monkeypatch, rows):
    """With few rows a range, most windows lie across boundaries."""
    monkeypatch.setattr(substrings, "RANGE_ROWS", rows)
    r = random.Random(8)
    passage, often = ("".join(r.choice("abc ") for _ in range(n)) for n in (150, 60))
    more = [*texts, *("".join(r.choice("uvw") for _ in range(r.randint(0, 90))) + often + passage[r.randint(0, 20) :] + str(i) * 70 for i in range(40))]
    want = brute_spans(more)
    for r in substrings.remove_repeats(docs_of(spark, more)).collect():
        assert bytes(r["kept"]) == want[r["doc_id"]]
    assert substrings.dedup_substrings(docs_of(spark, [])).count() == 0
    one_id = docs_of(spark, ["q w e r t y " * 20] * 2).withColumn("doc_id", common.F.lit(1).cast("bigint"))
    assert sorted(r["n_removed"] for r in substrings.dedup_substrings(one_id).collect())[1] == 240


def test_substrings_send_few_splitter_rows(spark):
    segments = spark.range(400_000, numPartitions=40).selectExpr("id AS key", "0L AS anchor", "unhex(md5(string(id))) AS after")
    marks = substrings._splitters(segments, 100)
    assert marks == sorted(marks) and 35 <= len(marks) <= 65  # 50 ranges of 8000 rows
    at = substrings.np.searchsorted(substrings.np.array(marks), [bytes(r["after"]).ljust(100, b"\0") for r in segments.collect()[:50_000]])
    assert substrings.np.bincount(at).max() < 5 * 50_000 / 50


def test_substrings_of_long_texts():
    r = random.Random(9)
    text = substrings.np.frombuffer(bytes(r.choice(b"abcdefgh \n") for _ in range(60_000)), substrings.np.uint8)
    offs = substrings.np.array([0, len(text)])
    whole = [x.tolist() for x in list(substrings._pieces(text, offs, 100))[0]]
    parts = list(substrings._pieces(text, offs, 100, limit=3_000))
    assert len(parts) > 15 and [substrings.np.concatenate(x).tolist() for x in zip(*parts, strict=True)] == whole


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_structured_words_do_not_collide(spark):
    for n in (1024, 2048, 4096):
        a = thue_morse(n)
        pair = [a, a.translate({97: "b", 98: "a"})]
        assert [r["component_id"] for r in ngram_join.ngram_jaccard(docs_of(spark, pair)).orderBy("doc_id").collect()] == [0, 1]


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (1, item)], "item_id bigint, text string")
    rows = ["pad " * 50 + item.upper() + " end", item.replace("six", "6"), "a short item here", None, "", item + " " + item, item[:-7]]
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontam.contained(docs_of(spark, rows), items).collect()}
    assert got == {(0, 1): 1.0, (2, 2): 1.0, (5, 1): 1.0, (6, 1): pytest.approx(6 / 7)}
    assert decontam.drop_contaminated(docs_of(spark, rows), items).count() == 3
    assert decontam.drop_contaminated(docs_of(spark, rows), items.where("false")).count() == len(rows)


def test_licences(spark):
    rows = ["x\nReleased under the MIT License.\ny", None, "", "nothing here", "foo " + licences.TEXTS["MIT"].replace("PROVIDED", "GIVEN")]
    got = [(r["doc_id"], r["licence"], r["dice"] == 1) for r in licences.scan_licences(docs_of(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(0, "MIT", True), (4, "MIT", False)]


def test_every_licence_text(spark):
    mit, isc = licences.TEXTS["MIT"], licences.TEXTS["ISC"]
    rows = [f"a\n{mit}\nb c d\n{isc}\nmore words\n{mit}", None, mit + " " + mit, f"{mit}"]
    extra = docs_of(spark, [*rows, rows[0]]).withColumnsRenamed({"key": "licence", "lang": "start"})
    got = {}
    for r in licences.scan_licences(extra).collect():
        assert rows[r["doc_id"] % 4][r["start"] : r["end"]] == r["span"]
        got.setdefault(r["doc_id"], []).append(r["licence"])
    assert {k: sorted(v) for k, v in got.items()} == {0: ["ISC", "MIT", "MIT"], 2: ["MIT", "MIT"], 3: ["MIT"], 4: ["ISC", "MIT", "MIT"]}
    assert licences.scan_licences(docs_of(spark, [])).count() == 0


def test_licences_with_inserted_words():
    mit = " ".join(licences.TEXTS["MIT"].split())
    words = mit.split()
    commented = " ".join("REM " * (i % 10 == 0) + w for i, w in enumerate(words))
    spread = " ".join([*words[:80], *(f"extra{i}" for i in range(30)), *words[80:]])
    scanner = licences.Scanner([("MIT", mit)])
    for text, least in ((mit, 1.0), (commented, 0.85), (spread, 0.9)):
        [(name, dice, a, b)] = scanner.scan(f"Some words before. {text} And after.")
        assert name == "MIT" and dice >= least and a == len("Some words before. ") + 4 * text.startswith("REM")
        assert text != mit or f"Some words before. {text} And after."[a:b] == mit.rstrip(".")
    r = random.Random(4)
    for _ in range(60):  # against every span
        template = [r.choice("abcdefgh") for _ in range(r.randint(4, 12))]
        text = [r.choice("xyz") for _ in range(3)] + [w for x in template for w in ([x] if r.random() < 0.8 else [x, r.choice("axyz")])] + [r.choice("abx") for _ in range(6)]
        grams = set(zip(template, template[1:], strict=False))
        pairs = list(zip(text, text[1:], strict=False))
        want = max(2 * len(grams & set(pairs[i:j])) / (len(grams) + len(set(pairs[i:j]))) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1))
        got = licences.Scanner([("T", " ".join(template))]).scan(" ".join(text))
        assert [x[1] for x in got] == [want] * (want >= 0.8)


def test_licences_by_their_own_texts():
    scanner = licences.Scanner(licences.default_templates())
    for name, text in licences.default_templates():
        assert name in {x[0] for x in scanner.scan(f"intro words\n{text}\nint main")}, text
    bsd3 = next(x for name, x in licences.HEADERS if name == "BSD-3-Clause").replace("the copyright holder nor", "Example Corporation nor")
    assert [x[0] for x in scanner.scan(bsd3)] == ["BSD-3-Clause"]
    for name in ("GPL-2.0", "LGPL-2.1", "AGPL-3.0", "LGPL-3.0", "GPL-3.0"):
        for text in (x for n, x in licences.HEADERS if n == name):
            assert [x[0] for x in scanner.scan(text)] == [name]


def test_quality(spark):
    r = random.Random(1)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur"]
    rows = [" ".join(r.choice(words) for _ in range(80)) for _ in range(60)] + ["#@!$ %%^^ ||", None, ""]
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(None, 1), (51, None)], "doc_id bigint, quality int")
    got = {x["doc_id"]: x for x in quality.judge(docs_of(spark, rows), labels).collect()}
    assert sum(got[i]["kept"] for i in range(60)) >= 55 and not got[60]["kept"] and not got[61]["kept"] and got[62]["perplexity"] is None
    assert quality.judge(docs_of(spark, rows), labels.where("false")).where("kept").count() == 61


def brute_kneser_ney(trusted, texts):
    """Perplexity of each text, by plain dictionaries; None without words."""
    import math
    from collections import Counter, defaultdict

    def pairs(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return list(zip([None, *w], [*w, None], strict=True))

    def discounts(counts):
        n = [max(1, sum(1 for c in counts if c == i)) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0.0, *(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.8), strict=True))]

    c = Counter(p for t in trusted for p in pairs(t))
    d = discounts(c.values())
    total, gamma, before = Counter(), defaultdict(float), Counter()
    for (v, w), n in c.items():
        total[v] += n
        gamma[v] += d[min(n, 3)]
        before[w] += 1
    e = discounts(before.values())
    unseen = sum(e[min(n, 3)] for n in before.values()) / len(c) / (len(before) + 1)

    def p(v, w):
        q = (before[w] - e[min(before[w], 3)]) / len(c) + unseen if w in before else unseen
        if v not in total:
            return q
        n = c[v, w]
        return ((n - d[min(n, 3)]) / total[v] if n else 0.0) + gamma[v] / total[v] * q

    return [math.exp(-sum(math.log(p(v, w)) for v, w in pairs(t)) / len(pairs(t))) if t.split() else None for t in texts]


@pytest.mark.parametrize("several_ids", [False, True])
def test_quality_by_brute_force(spark, monkeypatch, several_ids):
    """Several shards, blocks and passes, words that are heavy and words that are not."""
    for name, value in (("SHARD_WORDS", 400), ("BLOCK_WORDS", 300), ("HEAVY", 12)):
        monkeypatch.setattr(quality, name, value)
    r = random.Random(6)
    words = ["the", "the", "the", "the", "of", "of", *("w%d" % i for i in range(60))]
    rows = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(90)]
    rows += ["|".join(rows[0].split()), "the the the the the", "unseen words only", None, "", " \n", rows[3], "é " * 50]
    docs = docs_of(spark, rows)
    if several_ids:
        docs = docs.union(docs.where("doc_id = 96")).union(docs.where("doc_id = 1").withColumn("doc_id", common.F.lit(None).cast("bigint")))
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(None, 1), (81, 0)], "doc_id bigint, quality int")
    import zlib

    trusted = [rows[i] for i in range(80) if zlib.crc32(str(i).encode()) % quality.HELD_OUT]
    want = brute_kneser_ney(trusted, [t or "" for t in rows])
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) + 2 * several_ids
    for x in got:
        expected = want[1 if x["doc_id"] is None else x["doc_id"]]
        assert x["perplexity"] == (expected if expected is None else pytest.approx(expected, rel=1e-4))
        assert x["kept"] == (expected is not None and x["perplexity"] <= x["threshold"])
    out = sorted(want[i] for i in range(80) if not zlib.crc32(str(i).encode()) % quality.HELD_OUT)
    assert got[0]["threshold"] == pytest.approx(out[-1], rel=1e-4)
    assert quality.judge(docs.where("false"), labels).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    words = ["the", "water", "house", "road", "little", "paper", "green", "stone", "table", "under"]
    rows, marks = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(30)]
        if i % 3 == 0:
            w[5], w[9] = "idiot", r.choice(("moron", "loser"))
        rows.append(" ".join(w))
        marks.append((i, int(i % 3 == 0)))
    rows += ["the water 1d10t road", "the i d i o t road", "the m0r0000n house", "the little house", None, "", "the moron house", "the idiot road"]
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id bigint, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs_of(spark, rows), labels).collect()}
    assert [got[i]["predicted"] for i in (300, 301, 303, 304, 305)] == [1, 1, 0, 0, 0]
    for hidden, plain in ((300, 307), (301, 307), (302, 306)):  # never seen alone, "moron" need not reach 0.5: but hiding it changes nothing
        assert got[hidden]["score"] == got[plain]["score"] > got[303]["score"]
    assert sum(got[i]["predicted"] == int(i % 3 == 0) for i in range(300) if got[i]["held_out"]) >= 50
    assert toxicity.drop_toxic(docs_of(spark, rows), labels).columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert toxicity.score_documents(docs_of(spark, rows), labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.score_documents(docs_of(spark, []), labels).count() == 0
    for hidden in ("idio" + "t" * 61, "1d1" + "0" * 61 + "t", " ".join("xyzw" * 20) + " 1 d 1 0 t"):  # of any length
        more = docs_of(spark, [*rows, f"the {hidden} road"])
        assert toxicity.score_documents(more, labels).where(f"doc_id = {len(rows)}").first()["score"] == pytest.approx(got[307]["score"], abs=0.02)


def test_toxicity_of_hidden_words():
    words = ("idiot", "moron", "bitch", "loser")
    counts = toxicity.np.zeros(toxicity.CLASSES**3, toxicity.np.int64)
    for w in (*words, "water", "so", "you", "hey"):
        c = [0, 0, *(ord(x) - 96 for x in w), 0, 0]
        for x in zip(c, c[1:], c[2:], strict=False):
            counts[(x[0] << 12) | (x[1] << 6) | x[2]] += 100
    reader = toxicity.Reader(toxicity.letter_model(counts), dict.fromkeys((f for w in words for f in toxicity.word_features(w)), 1.0))
    hidden = {
        "idiot": ["id\u200biot", "idiot\u200b", "i#d#i#o#t", "i%diot", "i_d_i_o_t", "i%#diot", "you/1d10t", "so,1d10t", "hey!1d10t,you", "(1d10t)", "i d i o t", "x y i # d 1 o t",
                  "i" * 100 + "diot", "/".join(["water"] * 40) + "/1d10t", "1d10t" + "/water" * 40],
        "moron": ["m=o=r=o=n", "m0r0n"], "bitch": ["6itch", "6i7ch"], "loser": ["£oser", "1o$er"],
    }
    for word, texts in hidden.items():
        for text in texts:
            assert {f for f in reader.of_text(text) if f[-1] == "$"} == {word + "$"}, text
    assert not reader.of_text("the pidiots said so, b#o#o#k and water/house xidiot\u200b")


def test_restoring_by_brute_force():
    """The Viterbi path against every path through the lattice."""
    r = random.Random(11)
    counts = toxicity.np.array([r.choice((0, 0, 1, 5, 40)) for _ in range(toxicity.CLASSES**3)], toxicity.np.int64)
    restorer = toxicity.Restorer(toxicity.letter_model(counts))

    def best(seen, i, state, last, p, out):
        if i == len(seen):
            return [(p + restorer._step(state, " ")[0], out)]
        ch, found = seen[i], []
        meant = [(ch, toxicity.AS_IS)] if ch.isalpha() else []
        meant += [(to, toxicity.SWAPPED) for to in toxicity.LOOKALIKES.get(ch, "")]
        for letter, channel in meant:
            cost, to = restorer._step(state, letter)
            found += best(seen, i + 1, to, letter, p + channel + cost, out + letter)
            if letter == last:
                found += best(seen, i + 1, state, last, p + channel + toxicity.REPEATED, out)
        if not meant or ch in toxicity.SEPARATORS:
            found += best(seen, i + 1, state, last, p + toxicity.SEPARATED, out)
        return found

    for _ in range(150):
        seen = "".join(r.choice("abiloo01!6!86..-_|") for _ in range(r.randint(1, 7)))
        every = best(seen, 0, (0, 0), "", 0.0, "")
        top = max(p for p, _ in every)
        assert any(out == restorer.restore(seen) and p > top - 1e-6 for p, out in every), seen


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies, accept them.</div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>
<article><h1>The&nbsp;title &amp; more</h1><p>First   paragraph of the story, with words.</p><div class="ad">Buy now, only today.</div>
<p>Second <b>bold</b>
paragraph of it, longer than the first one was.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this story, thanks.</p></div></section>
<form><input><button>Send</button></form><footer>&copy; Site, all rights.</footer><script>x()</script></body></html>"""


def test_html_hidden_attributes():
    for shown in ('style="overflow:hidden"', 'aria-hidden="false"', 'data-hidden="0"', 'class="hidden-xs"', ""):
        assert not htmlmain.hides(" " + shown), shown
        page = htmlmain.Page(f"<html><body {shown}><p>Words of a story.</p></body></html>")
        assert not htmlmain.features(page)[2][page.tag.index("body")], shown
    for hidden in ("hidden", 'hidden=""', 'style="color:red; display : none"', "style='visibility:hidden'", 'ARIA-HIDDEN="true"'):
        assert htmlmain.hides(" " + hidden), hidden


STORY = [
    "A long first paragraph tells what the story is about, and it goes on for some time.",
    "The second one, as long as the first, adds what was left out before; it has commas, too.",
    "A third paragraph ends the story with a last remark, so that nobody has to wonder about it.",
]


def test_html_of_other_shapes():
    story = "\n".join(STORY)
    menu = "<div class=nav><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>Sport</a> <a href=/d>Contact</a></div>"
    foot = "<div id=footer>Copyright of the site. <a href=/i>Imprint</a> <a href=/p>Privacy</a></div>"
    paragraphs = [f"<p>{x}</p>" for x in STORY]
    pages = {
        "quotes in unquoted values": f"<body>{menu}<article><p data-x=a'b title=it\"s>{STORY[0]}</p>{paragraphs[1]}<p class=x'>{STORY[2]}</article>{foot}",
        "white space of other kinds": f"<body>{menu}<article><p>{STORY[0].replace(' ', '&nbsp;&#8195; ')}</p>{paragraphs[1].replace(' ', chr(0xA0) + chr(0x2028))}{paragraphs[2]}</article>{foot}",
        "comments": f"<body><!-->{menu}<!-- a > b --!><article>{'<!--->'.join(paragraphs)}</ x></article><!-- {foot}",
        "wrapping form": f"<body><form action=x>{menu}<article>{''.join(paragraphs)}</article>{foot}</form></body>",
        "labels": f"<body>{menu}<article>{paragraphs[0]}<p><label>{STORY[1][:20]}</label>{STORY[1][20:]}</p>{paragraphs[2]}</article>{foot}",
        "main without article": f"<html><body>{menu}<main>{''.join(paragraphs)}</main>{foot}</body></html>",
        "greater sign in a value": f"<body>{menu}<article><p title='a > b' data-y=\"c > d\">{STORY[0]}</p>{''.join(paragraphs[1:])}</article>{foot}",
    }
    for name, page in pages.items():
        assert htmlmain.extract(page) == story, name


def test_html_rows(spark):
    schema = "page_id bigint, url string, html string, id string, text string, n_chars string"
    rows = [(1, "u", PAGE, "x", "y", "z"), (1, "u", PAGE, "x", "y", "z"), (None, None, "<p>", None, None, None)]
    got = htmlmain.main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and len({r["text"] for r in got if r["page_id"] == 1}) == 1
    assert htmlmain.main_text(spark.createDataFrame([], schema)).count() == 0
    long = htmlmain.extract("<article>" + "".join(f"<p>Paragraph {i} of a very long page, with enough words in it.</p>" for i in range(20_000)) + "</article>")
    assert long.count("\n") == 19_999


def test_html(spark):
    want = "The title & more\nFirst paragraph of the story, with words.\nSecond bold paragraph of it, longer than the first one was."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "")], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmlmain.main_text(pages).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def brute_pipeline(rows, toxic, items):
    """What stays of (doc_id, text) rows, by plain loops; `toxic` are the ids that the first stage rejects."""
    rows = [(i, t or "") for i, t in rows if i not in toxic]
    last = {}
    for i, t in rows:
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    rows = [(i, t) for i, t in rows if (-1 if i is None else i) == last[t]]
    sets = [shingles(re.sub("[A-Z]", lambda m: m[0].lower(), t), 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted((j for j in range(len(rows)) if rows[j][0] is not None and sets[j]), key=lambda j: rows[j][0])
    place = {j: p for p, j in enumerate(order)}
    for j in order:
        for i in order[: place[j]]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[b] = a
    rows = [row for j, row in enumerate(rows) if find(j) == j]

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    wanted = [(k, grams(w, k)) for w in map(words, items) if w for k in [min(5, len(w))]]
    return [(i, t) for i, t in rows if not any(100 * len(g & grams(words(t), k)) >= 80 * len(g) for k, g in wanted)]


def test_pipeline_by_brute_force(spark, tmp_path):
    """Whole stages on real and on awkward rows: copies, near copies, benchmark passages, nulls, clashing columns."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    real = [(r["doc_id"], r["text"]) for r in read("documents").collect()]
    items = [r["text"] for r in read("benchmark").collect()]
    r = random.Random(3)
    plain = [" ".join("".join(r.choice("klmnopqr") for _ in range(6)) for _ in range(80)) for _ in range(3)]
    base = max(i for i, _ in real) + 1
    first, *rest = plain[0].split()
    extra = [plain[0], plain[0], " ".join(["changed", *rest]), plain[1] + " " + items[0].upper() + " end", None, "", " \n ", plain[1]]
    rows = real + [(base + i, t) for i, t in enumerate(extra)] + [(None, plain[2])]
    schema = "doc_id bigint, text string, lang string, id string, row string, n bigint, bad string"
    docs = spark.createDataFrame([(i, t, None, "x", "y", 1, "z") for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(name).write.parquet(f"{tmp_path}/{name}.parquet")

    scored = toxicity.score_documents(docs, read("labels")).where("predicted = 1").select("doc_id").collect()
    toxic = {x["doc_id"] for x in scored}
    assert toxic and not toxic & {None, *range(base, base + len(extra))}
    want = brute_pipeline(rows, toxic, items)
    kept = {i for i, _ in want}
    assert {None, base + 1, base + 7} <= kept and not {base, base + 2, base + 3} & kept
    assert len({i for i, t in rows if not t} & kept) == 1

    tokenizer, expected = Tokenizer.from_file(bpe.default_vocabulary()), {}
    for i, t in want:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        expected[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in out} == expected and len(out) == len(want)
    for x in out:
        assert hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x["ids"])).hexdigest() == x["ids_sha256"]

    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:  # an empty table goes through every stage
        assert f(spark, stage.where(F.lit(False)), str(tmp_path)).columns == docs.columns


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = out.collect()
    assert 0 < len(got) < len(texts)
    sets = {}
    for r in got:
        assert hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"]
        sets[r["doc_id"]] = shingles(texts[r["doc_id"]], 5)
    ids = list(sets)
    assert not any(sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i])
