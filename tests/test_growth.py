"""Steps whose work must not grow faster than their input, against brute force on small tables."""

import random

from pyspark.sql import functions as F

from lodestar.operators import knowledge as K


def test_best_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    src, dst = [(f"s{i}", i % 3) for i in range(12)], [(f"t{i:02d}", i % 4) for i in range(20)]
    score = {(a, b): float((a * 7 + b * 5) % 6) for a in range(3) for b in range(4)}
    known = [(a, b) for a, k in src for b, t in dst if rng.random() < 0.3 or score[k, t] >= 4 and a != "s4"]  # nearly all of the best are known
    known += known[:5] + [("s0", "elsewhere")]
    for most in (1, 7, 1000):
        want = sorted(((-score[k, t], a, b) for a, k in src for b, t in dst if (a, b) not in set(known)))[:most]
        e = spark.createDataFrame(known, "src string, dst string")
        pairs = K.best_pairs(spark.createDataFrame(src, "src string, sk int"), spark.createDataFrame(dst, "dst string, tk int"), spark.createDataFrame([(*k, v) for k, v in score.items()], "sk int, tk int, score double"), e, most)
        got = K.predicted_edges(pairs, e, most).select("src", "dst", F.round("conf", 9).alias("conf")).collect()
        assert sorted((r["src"], r["dst"]) for r in got) == sorted(x[1:] for x in want)


def test_documents_are_ranked_where_they_are_stored(spark, tmp_path):
    """Ties, repeated ids, null and empty texts; more queries' terms than workers take give the same by joins."""
    import math

    from lodestar.operators import search as S

    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(120)] + [(7, "w1 w1 w2"), (200, None), (201, "")]
    ask = [(i, " ".join(rng.sample(words, 3))) for i in range(6)] + [(9, "nothing"), (10, "")]
    S.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), f"{tmp_path}/index")
    index, q = S.open_index(spark, f"{tmp_path}/index"), spark.createDataFrame(ask, "item_id long, text string")
    texts = [t.split() for _, t in docs if t is not None]
    n, avgdl = index.lengths.select("n_docs", "avgdl").first()
    assert n == len(docs) and abs(avgdl - sum(map(len, texts)) / len(texts)) < 1e-9
    held = {}
    for i, t in docs:
        held.setdefault(i, []).extend((t or "").split())
    tf = {(r["doc"], r["term"]): r["tf"] for r in index.postings.collect()}
    assert tf == {(i, w): t.count(w) for i, t in held.items() for w in set(t)}
    share = sorted(((a, -round(sum(w in held[i] for w in t.split()) / 3, 9), i) for a, t in ask[:6] for i in held if set(t.split()) & set(held[i])))
    want = [x for a in range(6) for x in [y for y in share if y[0] == a][:5]]
    assert sorted((r["qid"], -round(r["score"], 9), r["doc"]) for r in S.lexical(q, index, top=5).collect()) == want
    few = sorted(map(tuple, S.bm25(q, index, top=5).select("qid", "rk", "doc", F.round("score", 9)).collect()))
    most, S.MOST_TERMS = S.MOST_TERMS, 0
    try:
        assert few == sorted(map(tuple, S.bm25(q, index, top=5).select("qid", "rk", "doc", F.round("score", 9)).collect())) and len(few) == 30
    finally:
        S.MOST_TERMS = most
    assert all(math.isfinite(x[3]) for x in few)
    plan = S.postings(spark.createDataFrame(docs[:100], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # tokens are counted without a shuffle


def test_contained_texts_stay_where_they_are(spark):
    from lodestar.operators import search as S

    docs = spark.createDataFrame([(1, "say one big word now"), (2, "one bigger word"), (2, "xone big wordy"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "one big word"), (2, "big"), (3, None)], "item_id long, text string")
    few = S.containing(q, docs)
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2)]


def test_links_of_articles_whose_ids_have_seven_digits(spark, tmp_path):
    from lodestar.plans.intake import doc_link_chunks, doc_link_corpus

    ids = [5, 6, 900005, 999999, 1000000, 1000002, 10000000, 10000001]
    spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["src_article"], r["dst_article"]): r["src_chunk_id"] for r in doc_link_chunks(spark, str(tmp_path)).collect()}
    assert got == {(i, j): f"{i:06d}:0:0" for i in ids for j in (i + 1, i - 3) if j in ids}
    assert {(r["src_article"], r["dst_article"]) for r in doc_link_corpus(spark, str(tmp_path)).collect()} == set(got)


def test_paths_are_those_of_the_whole_beam(spark):
    """Beams and pruning against the search that goes on with every path, for one seed and several."""
    from lodestar.operators import knowledge

    rng = random.Random(11)
    e = [(f"a:{rng.randrange(9)}", rng.choice(["CAUSED_BY", "EXHIBITS", "RUNS"]), f"b:{rng.randrange(7)}", rng.choice([0.05, 0.5, 0.9, 1.0])) for _ in range(70)]
    seeds = [(1, "a:1", 1.0), (2, "a:2", 0.5), (2, "b:3", 0.9), (3, "b:0", 1.0)]
    f = {}
    for a, r, b, c in e:
        v = max(c, 0.1) * K.RELATION_WEIGHT[r] * 0.8
        f[a, b] = f[b, a] = max(v, f.get((a, b), 0))
    want = {}
    for q in (1, 2, 3):
        own = {n: w for i, n, w in seeds if i == q}
        front, found = [(w, [n]) for n, w in own.items()], []
        for _ in range(3):
            nxt = [(s * v * (1 + own.get(y, 0)), [*p, y]) for s, p in front for (x, y), v in f.items() if x == p[-1] and y not in p]
            nxt.sort(key=lambda x: (-round(x[0], 9), ">".join(x[1])))
            found, front = found + [x for x in nxt if x[1][-1].startswith("b:")], nxt[:8]
        found.sort(key=lambda x: (-round(x[0], 9), ">".join(x[1])))
        want |= {(q, i + 1): (p, round(s, 8)) for i, (s, p) in enumerate(found[:4])}
    written, scratch = [], knowledge.scratch
    knowledge.scratch = lambda d, **k: written.append(scratch(d, **k)) or written[-1]
    try:
        got = K.paths(spark.createDataFrame(e, "src string, rel string, dst string, conf double"), spark.createDataFrame(seeds, "qid int, node string, weight double"), ["b"], beam=8, top=4).collect()
    finally:
        knowledge.scratch = scratch
    assert {(r["qid"], r["rk"]): (r["path"], round(r["score"], 8)) for r in got} == want
    fronts = [d.where("qid = 1").count() for d in written if "node" in d.columns and "path" in d.columns]
    assert fronts and min(fronts) < 8  # paths of one seed that can't matter go no further


def test_names_of_equal_vectors_are_compared_once(spark):
    from lodestar.operators import search as S

    names = spark.createDataFrame([(f"n{i:03d}", i % 2, w) for i in range(400) for w in (1.0,)] + [("m", 0, 0.9), ("m", 5, 0.1)], "doc string, bucket int, w double")
    ask = spark.createDataFrame([("p", 0, 1.0), ("q", 1, 1.0)], "doc string, bucket int, w double")
    got = S.link_names(ask, names, spark.createDataFrame([("n000", 8)], "node string, n long"))
    assert sorted((r["mention"], r["node"]) for r in got.collect()) == [("p", "n000"), ("p", "n002"), ("p", "n004"), ("q", "n001"), ("q", "n003"), ("q", "n005")]


def test_records_of_one_file_are_dealt_to_tasks(spark):
    from lodestar.operators import extraction as X
    from lodestar.plans.intake import GOODS

    record = '{"products":[{"name":"hub","components":["rod","Rod"]}]}'
    rows = spark.range(300).coalesce(1).select(F.concat(F.lit("c"), "id").alias("chunk"), F.lit(record).alias("record"))
    most, X.RECORDS = X.RECORDS, 25
    try:
        raw = X.relations(rows, GOODS)
        assert raw.rdd.getNumPartitions() == 12
        d = X.distinct_relations(raw)
        assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and d.count() == 300
    finally:
        X.RECORDS = most


def test_shared_neighbours_in_pieces_and_tasks(spark):
    import math

    rng = random.Random(2)
    e = [(f"a{rng.randrange(8)}", f"b{rng.randrange(9)}") for _ in range(50)] + [("a1", "a1"), ("b1", "a1")]
    near = {}
    for a, b in e:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b): sum(1 / math.log(len(near[m])) for m in near[a] & near[b]) for a in near for b in near if a < b and near[a] & near[b]}
    sizes, K.LIST, K.TASK = (K.LIST, K.TASK), 2, 5
    try:
        got = {(r["a"], r["b"]): r["score"] for r in K.adamic_adar(spark.createDataFrame(e, "src string, dst string")).collect()}
    finally:
        K.LIST, K.TASK = sizes
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_walks_share_tables(spark):
    """Walks in columns of several tables against one by one, with a node that leads nowhere."""
    rng = random.Random(4)
    w = {(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}"): rng.random() for _ in range(20)} | {("n1", "end"): 0.5}
    seeds = [(3, "n1", 1.0), (3, "n2", 3.0), (5, "n3", 1.0), (8, "end", 2.0)]
    total = {a: sum(v for (x, _), v in w.items() if x == a) for a, _ in w}
    want = {}
    for q in (3, 5, 8):
        t = sum(x[2] for x in seeds if x[0] == q)
        start = {n: v / t for i, n, v in seeds if i == q}
        m = dict(start)
        for _ in range(6):
            lost = sum(v for n, v in m.items() if n not in total)
            nxt = {n: v * (0.5 + 0.5 * lost) for n, v in start.items()}
            for (a, b), v in w.items():
                if a in m:
                    nxt[b] = nxt.get(b, 0.0) + 0.5 * m[a] * v / total[a]
            m = nxt
        want |= {(q, n): v for n, v in m.items()}
    most, K.WALKS = K.WALKS, 2
    try:
        adj = spark.createDataFrame([(*k, v) for k, v in w.items()], "src string, dst string, w double")
        s = spark.createDataFrame(seeds, "qid int, node string, weight double")
        assert [own for own, _ in K.walks(adj, s, rounds=1, tolerance=0)] == [[3, 5], [8]]
        got = {(r["qid"], r["node"]): r["mass"] for r in K.personalized_pagerank(adj, s, rounds=6, tolerance=0).collect()}
        docs = spark.createDataFrame([("n1", 1), ("n1", 1), ("n2", 1), ("end", 2)], "node string, doc int")
        scores = {(r["qid"], r["doc"]): r["score"] for r in K.walk_scores(adj, s, docs, rounds=6, tolerance=0).collect()}
    finally:
        K.WALKS = most
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    of = lambda q, *n: sum(want.get((q, x), 0.0) for x in n)
    assert all(abs(scores.get((q, d), 0.0) - of(q, *n)) < 1e-12 for q in (3, 5, 8) for d, n in ((1, ("n1", "n2")), (2, ("end",))))
