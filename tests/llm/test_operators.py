"""The operators against brute force, on edge rows and small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from gridloom.llm import common, decontaminate, exact_dedup, html_extract, language_id, lm_score, mixing, quality, simhash, suffix_dedup, url_filter
from gridloom.llm.queries import QUERIES, SQL
from oracle import same

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, grp long, fp string, size int, word string, _m_at int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def edge_rows():
    r = random.Random(4)
    words = [w for w in "the quick brown fox jumps over a lazy dog while étude naïve ß 日本 THE End".split()]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(40)
    long_ = prose(20_000)
    texts = [None, "", " \t\n", "a", "A", "one two three", passage, passage, passage + " tail", prose(30) + passage + prose(9), long_, long_ + " x", prose(200), prose(200),
             "same  text", "same\ttext", " same text ", "no\x00null\x00bytes " * 9, "x" * 49, "x" * 50, "x" * 51, "x" * 5000, "ab" * 300, passage.upper(), prose(60), "\u00a0\u2003", "日本" * 400]
    rows = [(i, t, "en", f"src{i % 4}" if i % 5 else None, None, 1, 2, "f", 3, "w", 0) for i, t in enumerate(texts)]
    rows += [rows[6], rows[12], (100, passage, None, "", 5, None, None, None, None, None, None)]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name], SF)


# 1 -----------------------------------------------------------------------------


def brute_repeats(pairs):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in pairs]
    rank = lambda i: suffix_dedup.LAST if i is None else i
    for i, b in texts:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, suffix_dedup.LAST), rank(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < rank(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLS1 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_op1_edges(spark, docs, none):
    want = brute_repeats([(r[0], r[1]) for r in edge_rows()])
    assert rows(suffix_dedup.remove_repeats(docs), *COLS1) == want
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert rows(suffix_dedup.remove_repeats(docs.selectExpr("CASE WHEN doc_id <> 9 THEN doc_id END AS doc_id", "text")), *COLS1) == brute_repeats([(None if r[0] == 9 else r[0], r[1]) for r in edge_rows()])


def test_op1_table(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(QUERIES["op1_suffix_dedup"](spark, SF), *COLS1) == brute_repeats(pairs)


def test_op1_spans(spark):
    a = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, a), (2, "zz" + a[100:180] + "yy")], "doc_id long, text string"), with_text=True).where("doc_id = 2").first()
    assert bytes(got["kept"]) == b"zzyy" and [tuple(s) for s in got["spans"]] == [(2, 82)]


def test_deep_shallow():
    r = np.random.default_rng(0)
    x = r.integers(97, 99, (500, 50)).astype(np.uint8)
    x[:300, :30], x[100:200] = x[0, :30], x[7]
    order, common = suffix_dedup.deep_shallow(x)
    s = [x[i].tobytes() for i in order]
    assert s == sorted(s) and sorted(order.tolist()) == list(range(500))
    assert all(common[i] == next((k for k in range(50) if s[i][k] != s[i - 1][k]), 50) for i in range(1, 500))


def test_multikey():
    r = np.random.default_rng(3)
    for n, top in ((0, 9), (1, 9), (2, 1), (700, 3), (3000, 1 << 60), (3000, 40)):
        x = r.integers(0, top, (n, 3)).astype(np.uint64)
        order, group = suffix_dedup.multikey(x)
        rows_ = [tuple(t) for t in x[order].tolist()]
        assert rows_ == sorted(map(tuple, x.tolist()))
        assert all((rows_[i] == rows_[i - 1]) == (group[i] == group[i - 1]) for i in range(1, n))


def test_op1_contexts_of_one_print(monkeypatch):
    import zstandard

    r = random.Random(7)
    text = "".join(r.choice("abcdefghij ") for _ in range(4000)).encode()
    batch = suffix_dedup.Batch(np.array([1], np.int64).tobytes(), np.array([len(text) * 2], np.int64).tobytes(), zstandard.compress(text * 2))
    every = np.arange(len(batch.runs.anchor))
    want = suffix_dedup.Entries(batch, every, 12)
    monkeypatch.setattr(suffix_dedup, "_prints", lambda c, most, least: np.zeros(len(c), np.uint64))
    got = suffix_dedup.Entries(batch, every, 12)
    assert len(got.doc) == len(want.doc) < len(every) and (np.diff(got.shard) >= 0).all()
    pairs = lambda e: {frozenset(np.flatnonzero(e.of == k).tolist()) for k in range(len(e.doc))}
    assert pairs(got) == pairs(want)


# 2 -----------------------------------------------------------------------------


def test_op2_edges(spark, docs, none):
    got = mixing.pareto_mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in edge_rows())
    total = sum(r["size"] for r in got)
    by = {}
    for r in edge_rows():
        by[r[3]] = by.get(r[3], 0) + size(r[1])
    targets = dict({(r["source_size"], r["target"]) for r in got})
    assert all(r["taken"] <= 2 * r["size"] for r in got) and math.isclose(sum(targets[s] for s in by.values()), 1.5 * total)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.pareto_mix(docs).collect()))
    assert mixing.pareto_mix(none).count() == 0
    assert [r["taken"] for r in mixing.pareto_mix(docs.where("doc_id IN (1, 2)")).collect()] == [0, 0]


def test_op2_ranks_rows_of_one_id_apart(spark):
    from pyspark.sql import functions as F

    docs_ = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    got = mixing.pareto_mix(docs_).collect()
    by = Counter()
    for r in got:
        by[r["target"]] += r["taken"]
    assert len(got) == 3000 and all(abs(taken - target) <= 4 for target, taken in by.items())


def test_op2_many_sources(spark):
    from pyspark.sql import functions as F

    docs_ = spark.range(4000).select("id", F.concat(F.lit("a "), F.repeat(F.lit("b "), (F.col("id") % 9).cast("int"))).alias("text"), F.format_string("s%04d", F.col("id") % 1500).alias("source")).withColumnRenamed("id", "doc_id")
    got = {r["source"]: r["target"] for r in mixing.source_targets(docs_.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("source_size"))).collect()}
    size = Counter()
    for r in docs_.collect():
        size[r["source"]] += len(r["text"].split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    left, open_, want = 1.5 * sum(size.values()), set(size), {}
    while True:  # share by weight, fix those above their limit, share again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)


def test_op2_short_documents_have_lower_odds(spark):
    docs_ = spark.createDataFrame([(i, "a " * (4 if i % 2 else 200), "abc"[i // 2 % 3]) for i in range(9000)], "doc_id long, text string, source string")
    got = mixing.pareto_mix(docs_).where("target < 2 * source_size AND target > source_size").collect()
    share = lambda size: sum(r["copies"] == 2 for r in got if r["size"] == size) / sum(r["size"] == size for r in got)
    assert got and share(4) < 0.5 * share(200)


def test_op2_comes_near(spark):
    got = mixing.op2_pareto_mix(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in got:
        s = by.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] = max(s[1], r["size"])
    assert all(abs(taken - target) <= most for (_, target), (taken, most) in by.items())


# 3 -----------------------------------------------------------------------------


def test_op3_edges(docs, none):
    groups = {}
    for r in edge_rows():
        groups.setdefault(SPACE.sub("", r[1] or ""), []).append((-len(r[1] or ""), r[0]))
    want = []
    for n, g in groups.items():
        keep = min(g)[1]
        want += [(i, keep, len(g), i == keep, hashlib.sha256(n.encode()).hexdigest()) for _, i in g]
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_op3_splits_at_every_depth(spark):
    base = "q" * 20_000
    texts = [base, base, base[:-1] + "z", base[:40] + "z" + base[41:], base[:700] + "z" + base[701:], base[:9000] + "z" + base[9001:], base[:9000] + "z" + base[9001:]]
    got = exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 2), 6: (5, 2)}


# 4 -----------------------------------------------------------------------------


def distance(p, t):
    """Least edits of p to a substring of t, by the plain recurrence."""
    d = list(range(len(p) + 1))
    best = d[-1]
    for c in t:
        prev, d[0] = d[0], 0
        for i in range(1, len(p) + 1):
            prev, d[i] = d[i], min(d[i] + 1, d[i - 1] + 1, prev + (p[i - 1] != c))
        best = min(best, d[-1])
    return best


def test_op4_myers():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (90, 200))
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == min(len(p), distance(p, t))


def test_op4_finds_all_within_budget(spark, none):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(8)] + [(8, None), (9, " !? "), (10, "")]
    docs_ = []
    for i in range(40):
        t = list(items[i % 8][1])
        for _ in range(r.randint(0, 20)):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], ["z"], [t[at], "z"]])
        docs_.append((i, " ".join(word() for _ in range(30)) + " " + "".join(t).title() + "! " + " ".join(word() for _ in range(30)), 1))
    docs_ += [(90, None, 1), (91, "", 1)]
    a, b = spark.createDataFrame(docs_, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    plain = decontaminate.plain
    want = []
    for i, t, _ in docs_:
        for j, s in items:
            p = plain(s)
            if p and plain(t) and (d := distance(f" {p} ", f" {plain(t)} ")) <= int(len(p) * decontaminate.RATE):
                want.append((i, j, d))
    got = rows(decontaminate.benchmark_hits(a, b), "doc_id", "item_id", "distance")
    assert got == sorted(want, key=repr) and any(d for *_, d in want)
    assert decontaminate.benchmark_hits(none, b).count() == 0 and decontaminate.benchmark_hits(a, b.limit(0)).count() == 0


def test_op4_words_short_items_and_ids(spark):
    items = spark.createDataFrame([("mmlu-1", "is it"), ("mmlu-2", "the answer is"), ("long", "of all the answers this one is the best"), (None, "a fifth item without any id at all")], "item_id string, text string")
    texts = ["what is it", "to bathe answer isn't", "Is it?", "so: of all the answers this one is the best, he said", "xof all the answers this one is the bestx yes", "a fifth item without any id at all"]
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.benchmark_hits(docs_, items)
    assert rows(got, "doc_id", "item_id") == sorted([(2, "mmlu-1"), (3, "long"), (4, "long"), (5, None)], key=repr)
    ends = {r["doc_id"]: r["end_at"] for r in got.collect()}
    assert decontaminate.plain(texts[3])[: ends[3]].endswith("best") and ends[2] == len("is it")


def test_op4_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    items = spark.createDataFrame([(i, f"w{i} one two three four five six seven eight nine ten" * 2) for i in range(7)], "item_id int, text string")
    docs_ = items.selectExpr("item_id + 50L AS doc_id", "text")
    got = decontaminate.benchmark_hits(docs_, items, rate=0)
    assert rows(got, "doc_id", "item_id") == [(50 + i, i) for i in range(7)] and dict(got.dtypes)["item_id"] == "int"


BIG = (1 << 53) + 1


def test_ids_are_exact_beside_nulls(spark):
    text = "the thing and the other one of them that we have seen before in the house " * 4
    docs_ = spark.createDataFrame([(BIG, text, "en", "a"), (None, text, "en", "a"), (BIG + 2, "x y", None, None)], "doc_id long, text string, lang string, source string").coalesce(1)
    want = sorted([(BIG,), (None,), (BIG + 2,)], key=repr)
    assert rows(simhash.simhash_groups(docs_), "doc_id") == want
    assert rows(language_id.language_id(language_id.document_rows(docs_), language_id.fit_text(docs_)), "doc_id") == want
    assert rows(quality.quality_scores(docs_, quality.AttentionMIL()), "doc_id") == want
    assert rows(decontaminate.benchmark_hits(docs_, spark.createDataFrame([(BIG + 4, text), (None, text)], "item_id long, text string")), "doc_id", "item_id") == sorted([(a, b) for a in (BIG, None) for b in (BIG + 4, None)], key=repr)
    pages = docs_.selectExpr("doc_id AS page_id", "'u' AS url", "concat('<p>', text) AS html")
    assert rows(html_extract.extract_pages(pages), "page_id") == want


def test_small_shares_are_not_nothing(spark):
    n = spark.range(1_000_000).where(common.sampled(1e-4, "id")).count()
    assert 50 < n < 160 and spark.range(10).where(common.sampled(1.0, "id")).count() == 10
    assert 4000 / 1e11 * float(1 << 53) > 1e8  # the threshold where 4,000 rows of 1e11 are wanted


# 5 -----------------------------------------------------------------------------


def brute_lm(pairs, voc):
    texts = [(i, WORDS.findall(lower(t or ""))) for i, t in pairs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    number = lambda w: {None: lm_score.START, " ": lm_score.END}.get(w) if w in (None, " ") else voc.ids.get(w.encode(), lm_score.RARE + (xxhash.xxh3_64_intdigest(w.encode()) >> 16))
    context = lambda x, u, v: int(voc.context(*[np.array([number(w)]) for w in (x, u, v)])[0])
    grams = lambda w: [(s[j - 2], context(*s[j - 3 : j]), s[j]) for s in [[None, None, None, *w, " "]] for j in range(3, len(s))]
    c, cv, cuv, vw, uvw, types, types2 = (Counter() for _ in range(7))
    for i, w in texts:
        if not held(i):
            c.update([*w, " "])
            for u, v, x in grams(w):
                cv[v] += 1
                cuv[u, v] += 1
                vw[v, x] += 1
                uvw[u, v, x] += 1
    types.update(v for v, _ in vw)
    types2.update((u, v) for u, v, _ in uvw)
    n, kinds, d = sum(c.values()), len(c), lm_score.DISCOUNT
    p1 = lambda w: (c[w] + 1) / (n + kinds + 1)

    def after(u, v, w):
        p = p1(w)
        if cv[v]:
            p = max(vw[v, w] - d, 0) / cv[v] + d * types[v] / cv[v] * p
        if cuv[u, v]:
            p = max(uvw[u, v, w] - d, 0) / cuv[u, v] + d * types2[u, v] / cuv[u, v] * p
        return p

    if n:  # the model is one: all known words, the end and an unseen word
        for u, v in [*list(cuv)[:3], *list(cuv)[-2:], ("<unseen>", 77)]:
            assert math.isclose(sum(after(u, v, w) for w in [*c, "<unseen>"]), 1, rel_tol=1e-9)
    for i, w in texts:
        yield i, held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, " "]), n, sum(math.log10(p1(x)) for x in [*w, " "]), sum(math.log10(after(*g)) for g in grams(w))


@pytest.mark.parametrize("case", ["edges", "table", "hot", "cut"])
def test_op5(spark, docs, case, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet") if case in ("table", "hot") else docs
    pairs = [(r["doc_id"], r["text"]) for r in df.collect()]
    if case == "hot":  # many classes, few frequent words, several batches
        monkeypatch.setattr(lm_score, "PAIR_LEAST", 4)
        monkeypatch.setattr(lm_score, "SPREAD", 200)
        monkeypatch.setattr(lm_score, "FREQUENT", 500)
        monkeypatch.setattr(lm_score, "BATCH", 30_000)
    if case == "cut":  # texts in many pieces
        monkeypatch.setattr(lm_score, "BATCH", 300)
    voc = lm_score.vocabulary(common.id_text(df), 12)
    assert case != "hot" or (len(voc.pair_keys) and voc.classes.max() > 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    got = sorted(map(tuple, lm_score.lm_scores(df, voc=voc).collect()), key=key)
    want = sorted(brute_lm(pairs, voc), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and abs(g[6] - w[6]) <= 0.05 * w[2]
    assert abs(sum(g[6] - w[6] for g, w in zip(got, want, strict=True))) <= 0.01 * sum(w[2] for w in want)
    if case == "table":
        h = [g for g in got if g[1]]
        assert sum(g[6] for g in h) > sum(g[5] for g in h)


def test_op5_scores_do_not_follow_from_the_number_of_shards(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    few = rows(lm_score.lm_scores(df), "doc_id", "score")
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 20_000)  # as at a larger size: many hot words and pairs
    assert lm_score.vocabulary(common.id_text(df), 100).classes.max() > 10
    many = rows(lm_score.lm_scores(df), "doc_id", "score")
    assert len(few) == len(many) == df.count()
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(few, many, strict=True))


def test_files_of_shuffles_go_when_asked(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    ids = lambda: set(re.findall(r"\d+(?= ->)", tracker.shuffleStatuses().keySet().mkString("", " -> ", " -> ")))
    before = ids()
    common.stored(spark.range(1000).repartition(5))
    mine = ids() - before
    assert mine
    lm_score.drop_shuffles(spark)
    for _ in range(100):
        if not ids() & mine:
            return
        time.sleep(0.2)
    raise AssertionError("shuffle files stay")


def test_op5_rows_of_one_id(spark):
    docs_ = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d e"), (7, "a b c"), (7, "x")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in lm_score.lm_scores(docs_).collect()), key=repr)
    assert got == sorted([(None, 4), (None, 4), (None, 3), (7, 4), (7, 2)], key=repr)


def test_op5_empty(none, spark):
    assert lm_score.lm_scores(none).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:3], "doc_id long, text string")
    assert [(r["n_known"], r["train_tokens"]) for r in lm_score.lm_scores(only).collect()] == [(0, 0)] * 3


def test_op5_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (7, 3), (5000, 40), (5000, 1 << 40), (3000, 1 << 55)):
        x = np.sort(r.integers(0, top, n))
        e = lm_score.EliasFano.build(x)
        assert (e[np.arange(n)] == x).all()
        x = np.unique(x)
        e = lm_score.EliasFano.build(x)
        q = np.concatenate((r.integers(0, top + 1, 50), x[::7]))
        at = np.searchsorted(x, q)
        hit = np.where((at < len(x)) & (x[np.minimum(at, len(x) - 1)] == q), at, -1)
        zero = np.zeros(len(q), np.int64)
        assert (e.find(q, zero, zero + len(x)) == hit).all()
        lo, hi = zero + len(x) // 3, zero + len(x) // 2
        assert (e.find(q, lo, hi) == np.where((hit >= lo) & (hit < hi), hit, -1)).all()
    assert lm_score.EliasFano.build(np.zeros(0, np.int64)).find(np.array([3]), np.array([0]), np.array([0])).tolist() == [-1]


def test_op5_trie_is_compact(tmp_path):
    r = np.random.default_rng(2)
    t = np.unique(np.stack([r.zipf(1.5, 60_000) % 900, r.zipf(1.4, 60_000) % 4000, r.zipf(1.4, 60_000) % 4000], axis=1), axis=0)
    n = r.integers(1, 9, len(t))
    trie = lm_score.Trie.build(17, t[:, 0] << 30, t[:, 1], t[:, 2], n)
    trie.save(str(tmp_path / "t"))
    again = lm_score.Trie.mapped(str(tmp_path / "t"))
    v = np.unique(t[:, 0]) << 30
    tri_v = np.searchsorted(v, t[:, 0] << 30)
    pair, tri_pair = np.unique((tri_v << 17) | t[:, 2], return_inverse=True)
    ctx, tri_ctx = np.unique((tri_v << 17) | t[:, 1], return_inverse=True)
    ask = (v, pair >> 17, pair & 0x1FFFF, ctx >> 17, ctx & 0x1FFFF, tri_ctx, tri_pair)
    (a, b), (a2, b2) = trie.lookup(*ask), again.lookup(*ask)
    assert (a == a2).all() and (b == b2).all()
    total, pair_total = np.bincount(tri_v, n), np.bincount(tri_ctx, n)
    want = (n - 0.75) / pair_total[tri_ctx] + 0.75 * np.bincount(tri_ctx)[tri_ctx] / pair_total[tri_ctx] * (np.bincount(tri_pair, n)[tri_pair] - 0.75) / total[tri_v]
    assert np.abs(np.log10(a) - np.log10(want)).max() < 0.05
    assert (tmp_path / "t").stat().st_size < 12 * len(t)


# 6 -----------------------------------------------------------------------------


def test_op6(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in table.collect()}
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang) and sum(r["language"] == lang[r["doc_id"]] for r in got) >= 0.99 * len(got)
    assert sum(r["rejected"] for r in got) <= 0.002 * len(got)
    pages = QUERIES["op6_pages_language"](spark, "/root/testdata/sf0.01")
    assert pages.count() == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    model = language_id.fit_text(table)
    edge = {r["doc_id"]: r for r in language_id.language_id(language_id.document_rows(docs), model).collect()}
    assert edge[0]["rejected"] and edge[0]["language"] is None and edge[1]["rejected"] and edge[2]["rejected"]
    assert language_id.language_id(language_id.document_rows(none), model).count() == 0
    unlabelled = language_id.fit_text(none)
    assert all(r["rejected"] for r in language_id.language_id(language_id.document_rows(docs), unlabelled).collect())


def test_language_id_learns_rare_languages_of_a_large_table(spark):
    texts = [(i, "the thing and the other one of them " * 6, "en") for i in range(2000)] + [(5000 + i, "мы видели большой дом у реки и лес " * 6, "ru") for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source")
    model = language_id.fit_text(docs, sample=100)
    assert model.languages == ["en", "ru"]
    got = language_id.language_id(language_id.document_rows(docs), model).where("doc_id >= 5000").collect()
    assert len(got) == 8 and {(r["language"], r["rejected"]) for r in got} == {("ru", False)}


def brute_fusion(rows_, model):
    """(id, language, posterior, rejected) by the formulas of the docstring."""
    n, told = len(model.languages), []
    for r in rows_:
        k, s = model.score(r["text"])
        told.append((r, k, s, int(s.argmax()) if k else -1))
    prior = Counter(v for *_, v in told if v >= 0)
    prior = [(prior[i] + 1) / (sum(prior.values()) + n) for i in range(n)]
    counts = {c: {} for c in ("declared", "suffix", "host", "domain", "zone")}
    for r, _, _, v in told:
        if v >= 0:
            for c, by in counts.items():
                key = r[c] if c in ("declared", "suffix") else (tuple(r[x] for x in ("host", "domain", "zone")[("host", "domain", "zone").index(c) :]) if r[c] is not None else None)
                if key is not None:
                    by.setdefault(key, [0] * n)[v] += 1
    for r, k, s, _ in told:
        total = list(s / 3)
        p = prior
        for c in ("zone", "domain", "host"):
            key = tuple(r[x] for x in ("host", "domain", "zone")[("host", "domain", "zone").index(c) :])
            got = counts[c].get(key)
            if got:
                p = [(x + language_id.KAPPA * q) / (sum(got) + language_id.KAPPA) for x, q in zip(got, p, strict=True)]
        if r["host"] is not None and tuple(r[x] for x in ("host", "domain", "zone")) in counts["host"]:
            total = [t + math.log(q) for t, q in zip(total, p, strict=True)]
        for c in ("declared", "suffix"):
            by = counts[c]
            if r[c] in by:
                all_ = [sum(g[i] for g in by.values()) for i in range(n)]
                total = [t + math.log((by[r[c]][i] + 1) / (all_[i] + len(by))) for i, t in enumerate(total)]
        top = max(total)
        post = 1 / sum(math.exp(t - top) for t in total)
        noise = k >= language_id.MIN_TRIGRAMS and max(s) / k < model.floor
        yield r["doc_id"], model.languages[total.index(top)] if k else None, post, k == 0 or noise or post < language_id.MIN_POSTERIOR


@pytest.mark.parametrize("name", ["op6_language_id", "op6_pages_language"])
def test_op6_equals_brute_force(spark, name):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit_text(docs_)
    source = language_id.document_rows(docs_) if name == "op6_language_id" else language_id.page_rows(spark.read.parquet(f"{SF}/pages.parquet"))
    want = {w[0]: w for w in brute_fusion(source.collect(), model)}
    got = QUERIES[name](spark, SF).collect()
    assert len(got) == len(want)
    for g in got:
        w = want[g[0]]
        assert g["language"] == w[1] and bool(g["rejected"]) == bool(w[3]) and math.isclose(g["posterior"], w[2], rel_tol=1e-6)


def test_language_of_one_document_is_learnt(spark):
    texts = [(i, "the thing and the other one of them " * 6, "en") for i in range(40)] + [(99, "мы видели большой дом у реки и лес " * 6, "ru")]
    docs_ = spark.createDataFrame(texts, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source")
    model = language_id.fit_text(docs_)
    assert model.languages == ["en", "ru"]
    assert [(r["language"], r["rejected"]) for r in language_id.language_id(language_id.document_rows(docs_), model).where("doc_id = 99").collect()] == [("ru", False)]


def test_op6_evidence_decides(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_text(table)
    texts = {l: [r["text"] for r in table.where(f"lang = '{l}'").limit(30).collect()] for l in ("de", "fr")}
    rows_ = [(i, t, l, f"{l}.example/{l}", f"www.{l}.example", f"{l}.example", l) for l in texts for i, t in enumerate(texts[l])]
    rows_ += [(1000, "a", "fr", "fr.example/fr", "www.fr.example", "fr.example", "fr"), (1001, "a", "de", None, "new.de.example", "de.example", "de")]
    got = language_id.language_id(spark.createDataFrame(rows_, "doc_id long, text string, declared string, suffix string, host string, domain string, zone string"), model).collect()
    assert {r["doc_id"]: r["language"] for r in got if r["doc_id"] >= 1000} == {1000: "fr", 1001: "de"}


# 7 -----------------------------------------------------------------------------


def test_op7_pages(spark):
    import html

    for r in QUERIES["op7_html_extract"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", re.search(r"<article>(.*)</article>", r["html"], re.S)[1]))
        assert r["text"] == re.sub(r"\s+", " ", html.unescape(inner)).strip() and r["n_chars"] == len(r["text"])


def test_op7_edges(spark):
    p = "This is a long paragraph of the article, with commas, and it goes on for quite a while so that it counts."
    page = f"""<html><head><title>t</title></head><body><header><h1>Site name</h1></header><nav><a href=x>Home</a> <a href=y>News</a></nav>
    <div class="cookie-notice"><p>{p} We use cookies.</p></div><main><article><h1>Title</h1><p>{p}<p>Short.<p>Fish &amp; chips&nbsp;&eacute; <b>bold</b>er<br>next
    <div class="advert"><p>{p} Buy!</p></div><form><p>{p}</p><input value=1></form><p>{p}</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
    <section id="comments"><p>{p} I agree.</p></section></article></main><aside><p>{p}</p></aside><footer><p>{p}</p></footer></body></html>"""
    want = f"Title {p} Short. Fish & chips é bolder next {p}"
    pages = [(1, "u", page), (2, None, None), (3, "", ""), (4, "u", "<p>"), (5, "u", "<div><<a href='"), (6, "u", "plain"), (7, "u", "<p hidden>x</p>" + "<div>" * 5000), (1, "u", page)]
    got = html_extract.extract_pages(spark.createDataFrame([(*r, 1) for r in pages], "page_id long, url string, html string, text int")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages) and by[1]["text"] == want and by[1]["n_chars"] == len(want)
    assert by[2]["text"] == by[3]["text"] == by[4]["text"] == "" and by[2]["url"] is None
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


P20 = "This is a long paragraph of the article, with commas, and it goes on for quite a while so that it counts."
NAV = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
HARD_PAGES = {
    "wrapper": (f"{NAV}<div class='layout has-sidebar'><article><h1>Title</h1><p>{P20}</p></article></div><footer>Imprint</footer>", f"Title {P20}"),
    "paper": (f"{NAV}<article class='discussion-paper'><h1>Title</h1><p>{P20}</p></article>", f"Title {P20}"),
    "form": (f"<form id=aspnetForm>{NAV}<div><h1>Title</h1><p>{P20}</p><p>{P20}</p><p>{P20}</p></div></form><footer>Imprint</footer>", f"Title {P20} {P20} {P20}"),
    "one paragraph": (f"<div id=wrap><p>{P20}</p></div>", P20),
    "headline": (f"<article><header><h1>Title</h1></header><p>{P20}</p><footer>Filed under things</footer></article>", f"Title {P20}"),
    "closed svg": (f"<article><svg width=1 /><p>{P20}</p></article>", P20),
    "open button": (f"<article><p>{P20}</p><button>Press<p>{P20}</p></article>", None),
    "open select": (f"<article><select><option>A<p>{P20}</p></article>", None),
    "lone less-than": (f"<3 hearts and {P20}", f"<3 hearts and {P20}"),
    "less-than": (f"<article><p>{P20} Now a < b, and 1 <2.</p></article>", f"{P20} Now a < b, and 1 <2."),
    "odd quote": (f"<article><p data-x=it's>{P20}</p><p title='a>b'>{P20}</p></article>", f"{P20} {P20}"),
    "deep menu": (f"<article><p>{P20}</p></article>" + "<div>" * 500 + "<nav>Menu item one</nav>", P20),
    "deep text": ("<div>" * 3000 + f"<article><p>{P20}</p></article>", P20),
    "cards": (f"<article><h1>Title</h1><p>{P20}</p></article><aside><article><h2>Other</h2><p>{P20}</p></article></aside>", f"Title {P20}"),
    "nested comments": (f"<main><p>{P20}</p><p>{P20}</p><div id=commentList><ul><li><div class=body><div><p>{P20}</p></div></div></li></ul></div></main>", f"{P20} {P20}"),
    "no article": (f"<div class=site-header><a href=/>Name</a></div><div id=page><h1>Title</h1><p>{P20}</p><p>{P20}</p></div><div class='cookie-notice'>We use cookies.</div><div class=siteFooter>Imprint</div>", f"Title {P20} {P20}"),
    "raw text": (f"<title>x</title><article><p>{P20}</p><noscript><p>{P20}</p></noscript><textarea>{P20}</textarea><iframe src=x></iframe></article>", P20),
    "cut off": (f"<article><p>{P20}</p><p class='a", P20),
}


@pytest.mark.parametrize("name", HARD_PAGES)
def test_op7_hard_pages(name):
    page, want = HARD_PAGES[name]
    got = html_extract.main_text(f"<html><body>{page}")
    assert got == want if want else got.endswith(P20)


def test_op7_learns_marks_of_a_table():
    pages = [f"{NAV}<article><h1>T {i}</h1><p>{P20} {i}.</p></article><div class=zzstrip>{P20} {i}</div>" for i in range(60)]
    model = html_extract.Classifier.fit([e for p in pages for e in html_extract.examples(html_extract.Page(p), set())])
    assert model.weights["c:zzstrip"] < -0.5 < html_extract.prior("c:zzstrip") and model.weights["own:p"] > html_extract.prior("own:p")


def test_op7_long_pages_take_linear_time():
    import time

    page = "<article>" + f"<p>{P20}</p><ul><li>one<li>two</ul>" * 20_000
    began = time.perf_counter()
    got = html_extract.main_text(page)
    assert got.count(P20) == 20_000 and time.perf_counter() - began < 60


def test_op7_cut_is_least():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 7)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i) if r.random() < 0.5]
        side = html_extract.content(odds, edges)
        cost = lambda s: sum(o for o, x in zip(odds, s, strict=True) if o > 0 and not x) + sum(-o for o, x in zip(odds, s, strict=True) if o <= 0 and x) + sum(w for i, j, w in edges if s[i] != s[j])
        assert math.isclose(cost(side), min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n)), abs_tol=1e-6)


# 8 -----------------------------------------------------------------------------


def brute_urls(urls):
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    parsed = []
    for u in urls:
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        hit = next((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
        parsed.append((host, path, hit))
    held = lambda t: zlib.crc32(t.encode()) % 5 == 0
    n, total, types = ({"allow": Counter(), "block": Counter()} for _ in range(3))
    seen = set()

    def grams(t):
        s = "\x02" * 4 + t + "\x03"
        return [s[i : i + 5] for i in range(len(t) + 1)]

    for h, p, hit in parsed:
        if hit and not held(h + p):
            for g in grams(h + p):
                for k in range(5):
                    part = (k, g[4 - k :])
                    n[hit[0]][part] += 1
                    total[hit[0]][k, part[1][:-1]] += 1
                    if (hit[0], part) not in seen:
                        seen.add((hit[0], part))
                        types[hit[0]][k, part[1][:-1]] += 1

    def score(t):
        out = []
        for g in grams(t):
            ps = []
            for c in ("allow", "block"):
                p = 1 / 65536
                for k in range(5):
                    part = g[4 - k :]
                    if total[c][k, part[:-1]]:
                        p = (n[c][k, part] + types[c][k, part[:-1]] * p) / (total[c][k, part[:-1]] + types[c][k, part[:-1]])
                ps.append(math.log(p))
            out.append(ps[0] - ps[1])
        return sum(out) / len(out)

    mean = lambda v: [score(h + p) for h, p, hit in parsed if hit and hit[0] == v and held(h + p)]
    a, b = mean("allow"), mean("block")
    cut = (sum(a) / len(a) + sum(b) / len(b)) / 2 if a and b else 0.0
    able = sum(n["allow"].values()) and sum(n["block"].values())
    for h, p, hit in parsed:
        s = None if hit else score(h + p)
        yield h, p, hit and hit[1] + hit[2], hit[0] if hit else "block" if able and s < cut else "allow", s


def test_op8(spark):
    edge = [None, "", "nourl", "http://NET/", "HTTP://a.Example.NET/en/x?q#f", "http://example.net/EN/", "http://xnet/", "x://example.com/de/1#a", "://example.com", "a://example.org/fr/é", "a://b://c/d", "http://h?x", "http://" + "a" * 3000 + "/"]
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + edge + edge[3:5]
    got = url_filter.url_filter(spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, n int, rule string")).orderBy("page_id").collect()
    for g, w in zip(got, brute_urls(urls), strict=True):
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == w[:4]
        assert (g["score"] is None) == (w[4] is None) and (w[4] is None or math.isclose(g["score"], w[4], rel_tol=1e-6, abs_tol=1e-9))
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert [r["verdict"] for r in url_filter.url_filter(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")).collect()] == ["allow"]


def test_op8_is_native(spark):
    plan = QUERIES["op8_url_filter"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 9 -----------------------------------------------------------------------------


def test_op9(spark, docs, none):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = QUERIES["op9_quality"](spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    judged = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in judged) >= 0.97 * len(judged)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(27)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    edge = quality.quality_scores(docs, quality.train(docs, lab)).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["score"] for r in quality.quality_scores(docs, quality.train(docs, lab.limit(0))).collect()} == {0.5}
    assert quality.quality_scores(none, quality.train(docs, lab)).count() == 0


def test_op9_gradient():
    r = np.random.default_rng(0)
    bags = [r.integers(0, 30, (r.integers(1, 5), quality.WIDTH)).astype(np.uint8) for _ in range(60)]
    for b in bags:
        b[:, 3:9] = r.choice([0, 255], (len(b), 1), p=[0.7, 0.3])
    y = np.array([float(b[:, 3].max() > 178) for b in bags], np.float32)
    m = quality.AttentionMIL().fit(bags, y)
    s = np.array([m.forward(b.astype(np.float32) / 255, np.array([0]))[-1][0] for b in bags])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.9


def brute_quality(model, text):
    """The score by the formulas of the docstring, passage by passage."""
    raw = (text or "").encode("utf-8", "replace")
    p, hs, es = {k: v.astype(np.float64) for k, v in model.p.items()}, [], []
    for i in range(0, max(1, len(raw)), quality.PASSAGE):
        part = raw[i : i + quality.PASSAGE + 1]
        pairs = Counter(zip(part, part[1:], strict=False))
        size = max(1, sum(pairs.values()))
        x = np.zeros(quality.WIDTH)
        for (a, b), n in pairs.items():
            x[quality._CLASS[a] * quality.CLASSES + quality._CLASS[b]] += n
        x = np.sqrt((x / size).astype(np.float32))
        part = raw[i : i + quality.PASSAGE + 2]
        x[-2:] = len({part[j : j + 3] for j in range(len(part) - 2)}) / size, size / quality.PASSAGE
        x = np.round(x * 255) / 255
        h = np.tanh(x @ p["W"] + p["b"])
        hs.append(h)
        es.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
    a = np.exp(np.array(es) - max(es))
    return 1 / (1 + math.exp(-((a / a.sum()) @ np.array(hs) @ p["c"] + p["d"][0])))


def test_op9_equals_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, labels)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in QUERIES["op9_quality"](spark, SF).collect():
        assert math.isclose(r["score"], brute_quality(model, texts[r["doc_id"]]), abs_tol=2e-3)
    few = [r[1] for r in edge_rows()]
    for t, s in zip(few, model.scores(few), strict=True):
        assert math.isclose(s, brute_quality(model, t), abs_tol=2e-3)


def test_op9_long_texts_take_little_memory():
    import tracemalloc

    model = quality.AttentionMIL()
    model.trained = True
    text = "The quick brown fox, and the rest of it. " * 800_000  # 33 MB
    tracemalloc.start()
    model.scores([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_op9_labels_that_conflict(spark):
    docs_ = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1) for i in range(0, 60, 4)], "doc_id long, quality int")
    a, b = (sorted(map(tuple, quality.quality_scores(docs_, quality.train(docs_, x)).collect())) for x in (labels.repartition(3), labels.repartition(7)))
    assert a == b


# 10 ----------------------------------------------------------------------------


def brute_simhash(pairs):
    out = []
    for i, t in pairs:
        w = WORDS.findall(lower(t or ""))
        sh = [" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0))
    comp = list(range(len(out)))
    changed = True
    near = [[j for j in range(len(out)) if (out[i][1] ^ out[j][1]).bit_count() <= 4] for i in range(len(out))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(comp[j] for j in js)
            if m < comp[i]:
                comp[i], changed = m, True
    least = {}
    for (i, _), c in zip(out, comp, strict=True):
        least[c] = min(least.get(c, 1 << 60), i)
    return sorted((i, f"{f:016x}", least[c]) for (i, f), c in zip(out, comp, strict=True))


@pytest.mark.parametrize("edges", [True, False])
def test_op10(spark, docs, edges, monkeypatch):
    if not edges:
        monkeypatch.setattr(simhash, "BLOCK", 8)  # so that buckets are dealt out in blocks
    df = docs if edges else spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r[0], r[1]) for r in edge_rows()] if edges else [(r["doc_id"], r["text"]) for r in df.collect()]
    got = simhash.simhash_groups(df)
    assert sorted((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got.collect()) == brute_simhash(pairs)


def test_similar_groups_find_the_original(spark):
    """Copies that resemble the original only, not one another: nearly all join it."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    first = r.choices(words, k=400)
    texts = [" ".join(first)]
    for _ in range(149):
        w = list(first)
        for j in r.sample(range(400), 7):
            w[j] = r.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(r.choices(words, k=200)) for _ in range(100)]
    got = rows(simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "component_id")
    assert sum(c == 0 for i, c in got if i < 150) >= 135
    assert all(c == i for i, c in got if i >= 150)


def test_op10_empty(none):
    assert simhash.simhash_groups(none).count() == 0


def test_op10_clusters_and_plans(spark):
    """Clusters around centres, chains of links, and every number of fingerprints the plan may be made for."""
    r = random.Random(6)
    fps = []
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 60])):
            y = x
            for b in r.sample(range(64), r.randint(0, 5)):
                y ^= 1 << b
            fps.append(y)
    fps = sorted(set(fps))
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 4:
                comp[root(f)] = root(g)
    want = {frozenset(f for f in fps if root(f) == c) for c in fps if root(c) == c}
    signed = np.array(fps, np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    original = simhash.plan
    for pretend in (len(fps), 10**7, 10**10):
        simhash.plan = lambda s, n, tau=4, pretend=pretend: original(s, pretend, tau)
        try:
            from gridloom.llm.components import components

            got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
        finally:
            simhash.plan = original
        parts = {}
        for f, s in zip(fps, signed.tolist(), strict=True):
            parts.setdefault(got.get(s, s), set()).add(f)
        assert {frozenset(p) for p in parts.values()} == want
    for n in (100, 10**6, 10**9):
        p = simhash.plan(np.array(fps, np.uint64), n)
        used = sum(t + 1 for _, t in p)
        assert used == simhash.TAU + 1 and len({b for bits, _ in p for b in bits}) == sum(len(bits) for bits, _ in p)


def test_rows_are_numbered_alike_in_every_job(spark, tmp_path):
    docs_ = spark.range(500).selectExpr("id % 7 AS doc_id", "concat('t', id) AS text", "1 AS _row")
    docs_.repartition(3).write.parquet(str(tmp_path / "d"))
    read = lambda: spark.read.parquet(str(tmp_path / "d"))
    a, name = common.numbered(read())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    b, _ = common.numbered(read())
    one, two = (sorted((r["text"], r[name]) for r in x.collect()) for x in (a, b))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert name == "_row_" and one == two and len({n for _, n in one}) == 500
    for other in (docs_, read().union(read()), read().selectExpr("doc_id", "explode(array(text, text)) AS text")):
        assert common._place_in_files(other) is None
        c, name = common.numbered(other)
        assert c.select(name).distinct().count() == other.count()
