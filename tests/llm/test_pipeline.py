"""The pipeline against a brute-force version of its stages."""

import random
import sys
import types

import corpus_pipeline
import duckdb
from gridloom.llm import decontaminate, language_id, mixing, simhash
from test_operators import SCHEMA, SPACE, WORDS, edge_rows, lower

SF = "/root/testdata/sf0.001"


def brute_similar(pairs, similarity=0.8):
    """doc_id -> smallest doc_id reachable over pairs of similar sets of five-word shingles."""
    words = {i: WORDS.findall(lower(t or "")) for i, t in pairs}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j:
                union = len(sets[i] | sets[j])
                if not union or len(sets[i] & sets[j]) / union >= similarity:
                    a, b = sorted((root(i), root(j)))
                    comp[b] = a
    return {i: root(i) for i in ids}


def brute(spark, rows, sf_dir):
    """Rows (dicts of documents) that reach the last stage."""
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows], "doc_id long, text string, lang string, source string")
    model = language_id.fit_text(docs)
    noise = {r["doc_id"] for r in language_id.language_id(language_id.document_rows(docs), model).where("rejected").collect()}
    rows = [r for r in rows if r["doc_id"] not in noise]
    best = {}
    for r in rows:
        k = SPACE.sub("", r["text"] or "")
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(r["text"] or ""), r["doc_id"]))
    keep = {i for _, i in best.values()}
    rows = list({r["doc_id"]: r for r in rows if r["doc_id"] in keep}.values())
    least = brute_similar([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = [decontaminate.plain(t) for _, t in items]
    return [r for r in rows if not any(p and p in decontaminate.plain(r["text"]) for p in plain)]


def test_run_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    left = brute(spark, rows, SF)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in left)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in left])
    cur = con.execute(mixing.OP2_SQL)
    names = [c[0] for c in cur.description]
    for row in cur.fetchall():
        assert got[row[names.index("doc_id")]].asDict() == dict(zip(names, row, strict=True))


def test_stages_keep_columns_and_bear_edges(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "benchmark decontamination", "source mixing"]
    for rows in (edge_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if i < 4:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), docs.schema)
            else:
                assert out.count() == docs.count()


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (2, "ab", 2), (None, "c", 3)], "doc_id long, text string, gone int")
    got = corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a b", 1), (None, "c", 3)]


def kept(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1 AS _row", "2 AS row", "3 AS _ROW_")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    exact = corpus_pipeline.drop_exact_copies
    assert kept(spark, exact, [(5, "alpha beta gamma"), (5, "a wholly different text")]) == [(5, "a wholly different text"), (5, "alpha beta gamma")]
    assert kept(spark, exact, [(3, "alpha beta gamma"), (5, "alphabeta gamma"), (5, "unique text of five")]) == [(3, "alpha beta gamma"), (5, "unique text of five")]
    long_ = " ".join(f"w{i}" for i in range(100))
    near = corpus_pipeline.drop_near_copies
    assert kept(spark, near, [(3, long_), (5, long_ + " x"), (5, "unique text of five")]) == [(3, long_), (5, "unique text of five")]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leak = corpus_pipeline.drop_benchmark_leaks
    assert kept(spark, leak, [(5, f"so it says {item} there"), (5, "unique text of five")]) == [(5, "unique text of five")]
    noise = corpus_pipeline.identify_language
    assert kept(spark, noise, [(5, ""), (5, "the thing and the other")]) == [(5, "the thing and the other")]


def test_rows_without_id_are_judged_too(spark):
    long_ = " ".join(f"w{i}" for i in range(100))
    got = kept(spark, corpus_pipeline.drop_exact_copies, [(None, "a b c"), (None, "a b c"), (None, "d e f")])
    assert got == [(None, "a b c"), (None, "d e f")]
    assert kept(spark, corpus_pipeline.drop_near_copies, [(None, long_ + " x"), (None, long_ + " y"), (9, long_)]) == [(9, long_)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    assert kept(spark, corpus_pipeline.drop_benchmark_leaks, [(None, f"so it says {item} there"), (None, "unique text of five")]) == [(None, "unique text of five")]


def test_entry_lives_without_the_folders(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name="corpus_pipeline")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)
    assert isinstance(entry, types.ModuleType) and "pipeline" not in entry.queries() and "range_query" in entry.queries()


def test_near_copies_are_caught_and_others_stay(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(80, 400))] for _ in range(150)]
    texts += [["of", "the"], ["the", "of"], ["the", "of", "the"], [], ["x"]]
    for i in range(60):
        t = list(texts[i % 30])
        for _ in range(max(1, len(t) // 60)):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        texts.append(t)
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    want = brute_similar(pairs)
    joined = [i for i in want if want[i] != i]
    assert len(joined) > 30 and sum(got[i] == want[i] for i in joined) >= 0.97 * len(joined)
    assert all(want[i] == got[i] or got[i] == i for i in want)  # nothing is joined that is not alike


def _groups(spark, texts):
    """Components of similar_groups and of brute force over texts (lists of words)."""
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = simhash.similar_groups(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()
    return {x["doc_id"]: x["component_id"] for x in got}, brute_similar(pairs)


def test_appended_and_truncated_copies_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(40, 200))] for _ in range(80)]
    for t in list(texts):
        n = len(t)
        texts.append(t + [r.choice(vocabulary) for _ in range(int(n * r.uniform(0.05, 0.27)))])
        texts.append(t[: n - int(n * r.uniform(0.05, 0.22))])
    got, want = _groups(spark, texts)
    assert got == want and sum(i != c for i, c in want.items()) > 80


def test_dense_vocabulary_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [[r.choice(some) for _ in range(150)] for some in (r.sample(vocabulary, 37) for _ in range(120))]
    for t in list(texts):
        texts.append(t[: r.randint(122, 145)])
    got, want = _groups(spark, texts)
    assert got == want and len(set(want.values())) >= 100


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # families alike, but not near copies of one another
        t = list(template)
        for i in r.sample(range(120), 7):
            t[i] = f"x{r.randrange(10**6)}"
        texts += [t, t[: r.randint(100, 119)], [f"y{r.randrange(10**6)}", *t]]
    monkeypatch.setattr(simhash, "FEW", 6)
    monkeypatch.setattr(simhash, "BLOCK_SETS", 16)
    got, want = _groups(spark, texts)
    assert got == want and 20 < len(set(want.values())) < 120


def test_texts_of_the_same_words_equal_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    order = [r.choice(words) for _ in range(200)] + words
    texts = [sorted(order)]  # the smallest id resembles none of the others
    for _ in range(6):
        t = [r.choice(words) for _ in range(200)] + words
        texts += [t, t + t[:4], t + t[:7]]
    got, want = _groups(spark, texts)
    assert got == want and len(set(want.values())) == 7


def test_near_stage_links_by_simhash_first(spark, monkeypatch):
    """Fingerprints are those of op10 and are linked by its pigeonhole plan; pairs come from both ways."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(30)]
    texts += [t + " more" for t in texts]
    seen = []
    real = simhash.links

    def links(fps, tau=simhash.TAU):
        edges = real(fps, tau)
        seen.append(({x["fp"] % (1 << 64) for x in fps.collect()}, edges.count()))
        return edges

    monkeypatch.setattr(simhash, "links", links)
    got = kept(spark, corpus_pipeline.drop_near_copies, list(enumerate(texts)))
    assert sorted(i for i, _ in got) == list(range(30))
    assert len(seen) == 1 and seen[0][0] == {simhash.fingerprint(t, 5) for t in texts} and seen[0][1] > 10
    # without the exact join, what SimHash links is joined all the same
    monkeypatch.setattr(simhash, "prefix", lambda shingles, *a: shingles[:0])
    alone = kept(spark, corpus_pipeline.drop_near_copies, list(enumerate(texts)))
    assert len(alone) < 50


def test_few_edges_are_solved_without_rounds(spark, monkeypatch):
    """Rounds of stars are tasks for the driver to keep books on; many edges and added ones give the same roots."""
    from gridloom.llm import components as graph

    r = random.Random(9)
    ids = [r.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    path = list(zip(ids[:150], ids[1:150], strict=False))  # long, with its smallest node anywhere
    hub = [(ids[150], x) for x in ids[151:250]]
    some = [(r.choice(ids[250:]), r.choice(ids[250:])) for _ in range(90)]
    pairs = path + hub + some + some[:20] + [(ids[0], ids[0])]
    comp = {}

    def root(i):
        while comp.setdefault(i, i) != i:
            i = comp[i]
        return i

    def want(edges):
        comp.clear()
        for a, b in edges:
            low, high = sorted((root(a), root(b)))
            comp[high] = low
        return {i: root(i) for i in list(comp) if root(i) != i}

    def roots(df):
        rows = [(x["node"], x["root"]) for x in df.collect()]
        assert len(dict(rows)) == len(rows)
        return dict(rows)

    frame = lambda edges: spark.createDataFrame(edges, "u long, v long").repartition(3)
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        got = graph.components(frame(pairs))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert roots(got) == want(pairs) and jobs <= 6
    assert roots(graph.components(frame(pairs).limit(0))) == {}
    old, new = pairs[::2], pairs[1::2]
    for few in (graph.FEW_EDGES, 0):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        assert roots(graph.joined(graph.components(frame(old)), frame(new))) == want(pairs)
    assert roots(graph.components(frame(pairs))) == want(pairs)


def test_near_groups_by_rounds_equal_brute_force(spark, monkeypatch):
    from gridloom.llm import components as graph

    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    r = random.Random(10)
    texts = [[f"w{r.randrange(3000)}" for _ in range(r.randint(60, 200))] for _ in range(25)]
    for i in range(75):  # chains of copies of copies
        t = list(texts[i])
        texts.append(t + [f"x{r.randrange(10**6)}" for _ in range(len(t) // 20)] if i % 2 else t[len(t) // 25 :])
    got, want = _groups(spark, texts)
    assert got == want and sum(i != c for i, c in want.items()) > 40
