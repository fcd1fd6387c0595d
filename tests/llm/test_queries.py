"""The registered queries and the pipeline's stages against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import byte_bpe, chat, importance, lattice_lm, main_text, mixing, near_duplicates, queries, secrets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, k string, tie long, place long, id long, n int, bucket int, draws string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with a null text, an empty one, a long one, copies, near copies, repeated rows, ties and columns of clashing names."""
    base = words(120, 1).split()
    near = [*base[:60], "changed", *base[61:]]
    texts = [None, "", " ".join(base), " ".join(near), " ".join(base), words(20_000, 2), "é😀 Password: " + "aB3" * 8 + " end", words(80, 3), words(80, 4), "token=short", "日本 語 ſ " + words(30, 5)]
    rows = [(i * 7 % 60, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7]] + [(100 + i, words(40, 50 + i), "ab"[i % 2]) for i in range(40)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "s", "k", 1, 2, 3, 4, 5, "d") for i, t, s in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n[INST] \\ x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 1, None, "no role"), (3, 0, "system", "y" * 50_000)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    pages = ["<body><div class=menu><a href=x>Home</a><a href=y>News</a></div><div id=content><h1>Head</h1><p>First para with enough words to count as text here.<p>Second para that also has quite a lot of words in it.<p>Yes.</div><div class='ad'>Buy now</div><footer>us</footer></body>", None, "", "<p>plain</p>"]
    spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "conversations", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def rows_of(spark, folder, name="documents"):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op9_") else 0)


def test_op1_scores_are_the_lattices(spark):
    """Every text's score is the sum over its words of the lattice's log probability, with the word's own arc."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op1_lattice_lm(spark, SF).collect()}
    find = lambda t: [lattice_lm.fold(w) for w in WORD.findall(t or "")]
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in find(t))
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    counted = lattice_lm.count_words(d.select("text", (~(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 1)).alias("train")))
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    machine = lattice_lm.Lattice(lattice_lm.fit_pieces(counted, model))
    free = sum(min(x, lattice_lm.DISCOUNT) for x in c.values()) / n
    p = lambda w: math.log10(max(0.0, c[w] - lattice_lm.DISCOUNT) / n + free * 10 ** machine.log10(w)) if max(0.0, c[w] - lattice_lm.DISCOUNT) or machine.log10(w) > -280 else math.log10(free) + machine.log10(w)
    for i, t in list(texts.items())[:40]:
        w = find(t)
        assert got[i]["held_out"] == held[i] and got[i]["n_tokens"] == len(w) + 1 and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(c[x] > 0 for x in w) + 1
        assert abs(got[i]["base_score"] - sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[y] for y in w), ends])) < 1e-6
        assert abs(got[i]["score"] - sum(map(p, w)) - math.log10(ends / n)) < 1e-6


def test_op2_takes_what_sources_are_due(spark, folder):
    got = queries.op2_mixing(spark, folder).toPandas()
    assert len(got) == len(rows_of(spark, folder))
    assert (got["taken"] <= 2 * got["size"]).all()
    for _, g in got.fillna({"source": "\U0010ffff"}).groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) < 1 and g["size"].sum() == g["source_size"].iloc[0]


def test_op3_is_the_librarys_and_decodes_back(spark, folder):
    ranks = byte_bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_byte_bpe(spark, folder).collect())
    want = []
    for r in rows_of(spark, folder):
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or "")))
    assert got == sorted(want)


def test_op4_ratio_and_held_out_accuracy(spark, folder):
    raw, good = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    raw[:4], good[:4] = [10, 20, 30, 40], [10, 0, 5, 5]
    ratio = importance.log_ratios(raw, good)
    assert ratio[0] > ratio[2] > ratio[1] and ratio[0] > 0 > ratio[1]
    got = queries.op4_quality(spark, folder).toPandas()
    assert len(got) == len(rows_of(spark, folder)) and not got[got["n_grams"].isna() | (got["n_grams"] == 0)]["kept"].any()
    big = queries.op4_quality(spark, "/root/testdata/sf0.1").toPandas().drop_duplicates("doc_id")
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").merge(big, on="doc_id")
    y = (labels["quality"] == 1) & (labels["toxic"] == 0)
    r = labels["log_weight"].fillna(-1e9).rank()
    auc = (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95


def test_op5_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    idf = near_duplicates.idf_of(*near_duplicates.word_frequencies(d.select("text")))
    sets = [near_duplicates.shingles(near_duplicates.word_hashes(t), idf) for _, t in texts]
    held = {}
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            held.setdefault(x, []).append(i)
    pairs = {(a, b) for at in held.values() if len(at) > 1 for a in at for b in at if a < b}
    links = {(a, b) for a, b in pairs if near_duplicates.weighted_jaccard(sets[a], sets[b]) >= 0.8}
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in sorted(links):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for t, g in pd.Series(range(len(texts))).groupby([x[1] or "" for x in texts]):
        for b in g.iloc[1:]:
            x, y = sorted((find(g.iloc[0]), find(b)))
            root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_near_duplicates(spark, sf).collect()}
    cls = [got[i] for i, _ in texts]
    together = sum(cls[a] == cls[b] for a, b in links)
    assert len(links) > 50 and together >= 0.99 * len(links)
    best = {}
    for i, (doc, _) in enumerate(texts):
        best[find(i)] = min(best.get(find(i), doc), doc)
    assert sum(cls[i] == best[find(i)] for i in range(len(texts))) >= 0.99 * len(texts)
    assert all(find(i) == find(j) for i in range(len(texts)) for j in (next(k for k, (doc, _) in enumerate(texts) if doc == cls[i]),))


def test_op6_links_against_sql(spark):
    got = {r["vec_id"]: r for r in queries.op6_embedding_dedup(spark, SF).collect()}
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.array(v["embedding"].tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = (x @ x.T >= 0.93) & (v["label"].to_numpy()[:, None] == v["label"].to_numpy()[None])
    np.fill_diagonal(m, False)
    assert [got[i]["n_links"] for i in v["vec_id"]] == m.sum(1).tolist()


def test_op7_edits_neighbours_and_search(spark, folder):
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, folder).collect()}
    rows = sorted({(r["doc_id"], r["text"] or "") for r in rows_of(spark, folder)})
    every = [int(r["fingerprint"], 16) for r in queries.op7_fingerprints(spark, folder).collect()]
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        r, nxt = got[i], rows[(k + 1) % len(rows)]
        assert r["n_chars"] == len(t)
        if sum(x["doc_id"] == i for x in rows_of(spark, folder)) == 1:
            assert r["edited_sha256"] == sha(t[: len(t) - half] + nxt[1][:half])
            apart = bin(int(r["fingerprint"], 16) ^ int(got[nxt[0]]["fingerprint"], 16)).count("1")
            assert abs(r["near_next"] - (1 - apart / 128)) < 1e-12
        assert r["n_within_3"] == (sum(bin(int(r["fingerprint"], 16) ^ f).count("1") <= 3 for f in every) - 1 if i % 20 == 0 else None)
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_op8_digests(spark, folder):
    for r in zip(sorted(rows_of(spark, folder), key=lambda r: (r["doc_id"], r["text"] or "")), sorted(queries.op8_secret_scan(spark, folder).collect(), key=lambda r: r["doc_id"]), strict=True):
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (p, g, n)) in enumerate(secrets.KINDS.items()) for m in re.finditer(p, r[0]["text"] or "", re.A) if len(m[g]) >= n]
        assert r[1]["base_sha256"] == sha(",".join(x[2] for x in sorted(found)))
        assert (r[1]["n_assign"], r[1]["n_access"], r[1]["n_hex"]) == tuple(sum(k == i for _, k, _ in found) for i in range(3))


def test_op9_reads_back_what_was_said(spark, folder):
    got = {r["conv_id"]: r for r in queries.op9_chat(spark, folder).collect()}
    said = "</s>[INST] ok [/INST]"
    talks = {-7: [("user", said), ("assistant", said)]}
    for r in sorted(rows_of(spark, folder, "conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert set(got) == set(talks)
    for k, turns in talks.items():
        learnt = "".join(t for who, t in turns if who == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), sha(learnt))


def test_op9_logs_hold_every_kind_of_event(spark, folder):
    log = chat.turns_as_events(spark.read.parquet(f"{folder}/conversations.parquet"))
    assert {r[0] for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}


def test_chat_after_a_delete_and_unknown_kinds(spark):
    log = [(1, 1, "a", "message", "user", "x"), (1, 2, "a", "delete", None, None), (1, 3, "a", "delta", None, "y"), (1, 4, "b", "seen", None, "z"), (1, 5, "c", "message", "user", "kept"), (1, 6, "c", "seen", None, "q"), (2, 1, "a", "delete", None, None), (1, 7, None, "message", "user", "l"), (1, 7, None, "message", "user", "l")]
    got = chat.fold(spark.createDataFrame(log, "conv_id int, seq int, message string, kind string, role string, text string")).collect()
    assert [(r["conv_id"], [t["text"] for t in r["turns"]]) for r in got] == [(1, ["kept", "l", "l"])]


def test_op10_pages_without_article_or_main(spark, folder):
    got = {r["page_id"]: r for r in queries.op10_main_text(spark, folder).collect()}
    want = "Head\nFirst para with enough words to count as text here.\nSecond para that also has quite a lot of words in it.\nYes."
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want)
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "plain"


def test_density_finds_the_article_whatever_its_tag():
    pages = pd.read_parquet(f"{SF}/pages.parquet")["html"]
    for page in pages:
        plain = re.sub(r"<(/?)article", r"<\1div", page)
        assert main_text.main_text(plain) == main_text.main_text(page) != ""
    legal = "<body><article><h1>T</h1><p>" + words(60, 1) + "</p><div class=legal>" + words(60, 2) + "</div></article></body>"
    assert words(60, 2) in main_text.main_text(legal)
    assert "a​b" in main_text.main_text("<p>a​b</p>")


# ---- the pipeline
def test_stages_keep_columns_and_take_empty_tables(spark, folder, empty):
    docs, none = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and got.count() > 0
        assert stage(spark, none, empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_quality_stage_keeps_rows_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: r["kept"] for r in queries.op4_quality(spark, folder).collect()}
    got = corpus_pipeline.quality(spark, docs, folder).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.collect() if kept[r["doc_id"]])


def test_near_duplicate_stage_keeps_one_of_each_class(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classes = {r["doc_id"]: r["class_id"] for r in queries.op5_near_duplicates(spark, folder).collect()}
    got = [r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, folder).collect()]
    assert sorted(got) == sorted(set(classes.values()))
    odd = spark.createDataFrame([(None, words(50, 1)), (None, words(50, 1)), (4, words(50, 1)), (5, words(50, 2))], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.deduplicate(spark, odd, folder).collect()) == ["5", "None"]


def test_secrets_stage_leaves_no_base_secret_and_clean_texts_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(corpus_pipeline.redact(spark, docs, folder).collect(), key=lambda r: (r["doc_id"], str(r["text"])))
    spans = {r["doc_id"]: r["spans"] for r in queries.op8_secret_scan(spark, folder).collect()}
    before = sorted(docs.collect(), key=lambda r: (r["doc_id"], str(r["text"])))
    for a, b in zip(before, got, strict=True):
        assert (a == b) == (not spans[a["doc_id"]])
        assert not any(len(m[g]) >= n for p, g, n in secrets.KINDS.values() for m in re.finditer(p, b["text"] or "", re.A))
        assert b["spans"] == "s"


def test_mixing_stage_repeats_what_is_taken(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, docs, folder).collect())
    sizes = {r["doc_id"]: r for r in mixing.mix(docs).collect() if r["size"]}
    single = [i for i, n in Counter(r["doc_id"] for r in docs.collect()).items() if n == 1 and i in sizes]
    assert all(got[i] == math.floor(sizes[i]["taken"] / sizes[i]["size"] + 0.5) for i in single)


def test_encoding_stage_decodes_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ranks = byte_bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    token = {i: t for t, i in ranks.items()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, docs, folder).collect():
        assert b"".join(token[i] for i in r["ids"]).decode() == texts[r["doc_id"]]


def test_contract_columns_by_sql(spark):
    """Sizes, sources and code points as DuckDB counts them."""
    c = duckdb.connect()
    want = c.execute(f"SELECT doc_id, length(text) AS n FROM '{SF}/documents.parquet'").fetchall()
    assert sorted((r["doc_id"], r["n_chars"]) for r in queries.op7_fingerprints(spark, SF).collect()) == sorted(want)


def test_near_duplicates_without_the_bitmap_and_with_null_ids(spark):
    base = [words(60, 900 + i) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " more") for i, t in enumerate(base)] + [(None, base[3] + " x"), (None, base[4] + " x"), (None, words(60, 5000))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (4, 24):
        got = [(r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates.near_duplicates(d, map_bits=bits).collect()]
        assert all(c == i % 100 for i, c, _ in got if i is not None and i % 100 not in (3, 4))
        assert sorted(str(c) for i, c, _ in got if i is None) == ["None", "None", "None"]
        assert [k for i, _, k in got if i in (3, 4, 103, 104)] == [False] * 4 and sum(k for i, _, k in got if i is None) == 3


def test_components_of_a_block():
    rng = np.random.default_rng(1)
    from lodestar.llm.embedding_dedup import _roots

    m = rng.random((60, 60)) < 0.02
    m |= m.T
    np.fill_diagonal(m, False)
    want = np.arange(60)
    for _ in range(60):
        want = np.array([min([want[i], *want[m[i]]]) for i in range(60)])
    assert (_roots(m) == want).all()


@pytest.mark.parametrize("filled", [64, 16, 4])
def test_op6_recall_over_several_cells(spark, filled):
    """Planted pairs at 0.93 to 0.95 in 64 columns, at the query's own parameters: links and counts against brute force."""
    from lodestar.llm import embedding_dedup

    rng = np.random.default_rng(filled)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0][:filled]
    n = 7000 if filled > 4 else 3500
    x = rng.normal(size=(n, filled))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.95, (n, 1))
    v = (np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * u]) @ basis).astype(np.float32)
    d = spark.createDataFrame([(i, y.tolist(), 0) for i, y in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(d, per_cell=4096 if filled > 4 else 1024).collect()}
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = (w @ w.T >= 0.93).sum(1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    assert np.mean([got[i]["component_id"] == got[n + i]["component_id"] for i in range(n)]) >= 0.99


def test_op6_work_of_a_vector_hardly_grows():
    """rows and comparisons a vector follow from the size of its label; a hundred times the vectors cost less than three times as much each."""
    from lodestar.llm import embedding_dedup

    agree, work = embedding_dedup.shared(0.93), []
    for n in (1000, 20_000, 100_000, 1_000_000, 10_000_000):
        bits, tables = embedding_dedup.plan(n, agree, 0.005, 8192)
        assert tables <= 20 and (bits == 0) == (n <= 20_000)
        work.append(tables * (8192 + n / 2**bits))
    assert work[-1] < 3 * work[2]


@pytest.mark.parametrize("filled", [64, 4])
def test_op6_recall_over_several_tables(spark, filled):
    """a label dealt into tables of buckets keeps its links and counts none twice; hot buckets are cut into blocks."""
    from lodestar.llm import embedding_dedup

    rng = np.random.default_rng(filled)
    x = rng.normal(size=(3000, filled))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.99, (3000, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * u, x[:1] + rng.normal(size=(400, filled)) * 0.01, x[:50]]).astype(np.float32)
    assert embedding_dedup.plan(len(v), embedding_dedup.shared(0.93), 0.005, 64)[1] > 5
    d = spark.createDataFrame([(i, y.tolist(), 0) for i, y in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(d, per_cell=64, block=100).collect()}
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = (w @ w.T >= 0.93).sum(1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    assert len(got) == len(v) and (links <= want).all() and links.sum() >= 0.99 * want.sum()
    assert np.mean([got[i]["component_id"] == got[3000 + i]["component_id"] for i in range(3000)]) >= 0.99
    assert all(got[6400 + i]["component_id"] == got[i]["component_id"] for i in range(50))


def test_op6_links_that_a_sample_does_not_foresee(spark):
    """vectors half way between two groups link with both; what random turns of a sample need says nothing of them."""
    from lodestar.llm import embedding_dedup

    rng = np.random.default_rng(3)
    plane = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    angle = np.radians(np.concatenate([np.zeros(100), np.full(100, 41.0), np.full(10, 20.5)]))
    arcs = [np.cos(angle)[:, None] * plane[2 * k] + np.sin(angle)[:, None] * plane[2 * k + 1] + rng.normal(size=(210, 64)) * 0.0005 for k in range(10)]
    v = np.concatenate([rng.normal(size=(4000, 64)), *arcs]).astype(np.float32)
    d = spark.createDataFrame([(i, y.tolist(), 0) for i, y in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(d, per_cell=150).collect()}
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = (w @ w.T >= 0.93).sum(1) - 1
    between = [4000 + 210 * k + i for k in range(10) for i in range(200, 210)]
    assert all(want[i] == 209 for i in between)
    assert all(got[i] <= want[i] for i in range(len(v))) and sum(got[i] for i in between) >= 0.99 * sum(want[i] for i in between)


def test_op6_balls_of_near_copies_are_counted_not_squared(spark):
    """groups of near copies beyond a block, near each other and with vectors between them, against brute force; a block leaves pairs of one ball alone."""
    import pyarrow as pa

    from lodestar.llm import embedding_dedup

    rng = np.random.default_rng(8)
    angle = np.radians(np.concatenate([np.zeros(400), np.full(400, 24.0), np.full(60, 12.0), np.full(300, 90.0)]))
    v = rng.normal(size=(1660, 32))
    v[500:] = 0
    v[500:, 0], v[500:, 1] = np.cos(angle), np.sin(angle)
    v[500:] += rng.normal(size=(1160, 32)) * 0.015
    v = np.concatenate([v, v[500:540], v[1000:1040]]).astype(np.float32)
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    m = w @ w.T >= 0.93
    d = spark.createDataFrame([(i, y.tolist(), "a") for i, y in enumerate(v)], "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(d, margin=1, block=100).collect()}
    assert [got[i]["n_links"] for i in range(len(v))] == (m.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(v))] == embedding_dedup._roots(m).tolist()
    ids, ones = np.arange(300), np.ones(300, np.int64)
    for ball, pairs in ((np.full(300, -1), 300 * 299), (np.zeros(300, int), 0), (ids % 2, 300 * 150), (ids % 2 - 1, 300 * 299 - 150 * 149)):
        part = pa.table({"dim": pa.array([32] * 300, pa.int32()), "rep": ids, "entry": ids, "copies": ones, "chunk": 0 * ids, "ball": ball, "before": pa.array([[]] * 300, pa.list_(pa.int32())), "vec": pa.array([x.tobytes() for x in v[500:800]], pa.binary())})
        assert sum(embedding_dedup._block(0.93, "<f4")((pa.scalar(0), pa.scalar(0)), part)["n"].to_pylist()) == pairs


def test_op6_results_come_from_no_sample(spark):
    """a wide group in a label of several tables: balls, and so links, follow from all vectors and not from those that a table's layout puts in a sample; chances of buckets are integrals."""
    from lodestar.llm import embedding_dedup

    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(1000, 32)), np.eye(32)[:1] + rng.normal(size=(6000, 32)) * 0.033]).astype(np.float32)
    d = spark.createDataFrame([(i, y.tolist(), 0) for i, y in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got, name = [], "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    for partitions in (4, 3):
        spark.conf.set(name, partitions)
        try:
            got.append([tuple(r) for r in embedding_dedup.near_vectors(d, per_cell=512, miss=0.1, block=256).orderBy("vec_id").collect()])
        finally:
            spark.conf.set(name, was)
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    want = (w @ w.T >= 0.93).sum(1) - 1
    links = np.array([r[1] for r in got[0]])
    assert (links <= want).all() and links.sum() >= 0.95 * want.sum()
    assert sum(a != b for a, b in zip(*got, strict=True)) == 0
    for t in (-0.3, 0.5, 0.93, 0.999, 1.0):
        assert abs(embedding_dedup.shared(t)[1] - (1 - np.arccos(t) / np.pi)) < 1e-4
