"""Operators against brute force, exact round trips and the edge cases that their texts define."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, chat, embedding_dedup, importance, lattice_lm, main_text, mixing, near_duplicates, secrets, simhash

RANKS_FILE = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS_FILE.splitlines())}
ENCODER = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, key string, id long, rest string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, rows):
    """With null texts and sources, repeated rows and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 5, "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = words(6000, 1)
    return documents(spark, [(1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (4, long, "a"), (5, long + " more", "b"), (None, "no id here", None), (7, " \n ", "b"), (8, "ſ 漢 😀", "c")])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\t'strevmlld019²½Ⅷé—_-=日\x1c\x85\xa0😀́"), max_size=40) | st.text(max_size=40))
def test_bpe_is_the_librarys(text):
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    tokens = {i: t for t, i in RANKS.items()}
    d = byte_bpe.StreamingDecoder(tokens)
    assert "".join([*(d.feed([i]) for i in ids), d.finish()]) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30))
def test_streaming_decoder_replaces_broken_bytes(data):
    d = byte_bpe.StreamingDecoder({i: bytes([i]) for i in range(256)})
    assert "".join([*(d.feed([b]) for b in data), d.finish()]) == data.decode("utf-8", "replace")


def test_encode_documents(spark, odd):
    got = byte_bpe.encode_documents(odd, RANKS_FILE, public_tokenizers.PATTERN).collect()
    want = sorted(hashlib.sha256(" ".join(map(str, REFERENCE.encode_ordinary(r["text"] or ""))).encode()).hexdigest() for r in odd.collect())
    assert sorted(r["ids_sha256"] for r in got) == want


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.3, "b": 0.15, "ab": 0.25}
    machine = lattice_lm.Lattice({k: float(np.log10(v)) for k, v in pieces.items()})

    def brute(s):
        return 1.0 if not s else sum(p * brute(s[len(k) :]) for k, p in pieces.items() if s.startswith(k))

    for w in ("a", "ab", "aab", "abab"):
        assert abs(10 ** machine.log10(w) - brute("▁" + w)) < 1e-12
    assert machine.log10("日") < -20


def test_lm_base_and_mass(spark, odd):
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    got = lattice_lm.score_documents(odd, model, F.col("doc_id") == 5).collect()
    find = lambda t: [lattice_lm.fold(w) for w in lattice_lm.FIND.findall(t or "")] + ["\n"]
    from collections import Counter

    rows = odd.collect()
    c = Counter(w for r in rows if r["doc_id"] != 5 for w in find(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((len(find(r["text"])), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in find(r["text"])), 6)) for r in rows)
    assert sorted((r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lattice_lm.score_documents(odd.limit(0), model, F.lit(False)).count() == 0


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, words(rng.randint(0, 60), i), ["a", "b", "c", "d", None][min(4, int(rng.expovariate(1)))]) for i in range(400)]
    d = documents(spark, rows)
    got = mixing.mix(d, bins=8).fillna({"source": "\U0010ffff"}).toPandas()
    sizes = {s: int(g["size"].sum()) for s, g in got.groupby("source")}
    order = sorted(sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
            open_.discard(s)
    target |= {s: level * w[s] for s in open_}
    for s, g in got.groupby("source"):
        assert abs(g["target"].iloc[0] - target[s]) < 1e-6
        assert abs(g["taken"].sum() - target[s]) < 1
        full = int(target[s] // sizes[s])
        assert ((g["taken"] >= full * g["size"]) & (g["taken"] <= (full + 1) * g["size"]) & (g["taken"] <= 2 * g["size"])).all()
    again = mixing.mix(d.repartition(7), bins=8).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == got.sort_values("doc_id")["taken"].tolist()


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_classifier_on_held_out_labels(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = " ".join(rng.choice(["spam###", "buy$$$", "now!!"] if bad else ["river", "stone", "quiet", "water", "light"]) for _ in range(60))
        rows.append((i, t, "a"))
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    d = documents(spark, rows)
    got = {r["doc_id"]: r["kept"] for r in importance.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(400))


def test_classifier_without_labels_keeps_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = importance.classify(odd, none).collect()
    assert all(r["kept"] == bool((r["text"] or "").strip()) for r in got)
    assert importance.classify(odd.limit(0), none).count() == 0


def test_cut_of_top_k(spark):
    keys = [random.Random(9).gauss(0, 1) for _ in range(3000)] + [1.5] * 50
    d = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 2, 100, 2999, 3050):
        assert importance.cut_of_top_k(d, k, bins=16) == sorted(keys, reverse=True)[k - 1]


def near(a, b, n=5):
    s = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_near_duplicates_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    rows, origin = [], {}
    for i in range(60):
        t = words(200, 1000 + i).split()
        for j in range(rng.choice([1, 2, 3])):
            x = list(t)
            if j:
                x[rng.randrange(len(x))] = "changed"
            origin[len(rows)] = i
            rows.append((len(rows), " ".join(x), "a"))
    passage = words(60, 77)
    for i in range(30):
        origin[len(rows)] = 100 + i
        rows.append((len(rows), words(150, 5000 + i) + " " + passage, "a"))
    base = words(150, 9).split()
    for _ in range(40):
        x = list(base)
        x[rng.randrange(len(x))] = words(1, rng.random())
        origin[len(rows)] = 999
        rows.append((len(rows), " ".join(x), "a"))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(documents(spark, rows)).collect()}
    first = {}
    for i in sorted(origin):
        first.setdefault(origin[i], i)
    assert got == {i: first[o] for i, o in origin.items()}


def test_copies_alike_only_to_their_source_are_one_class(spark):
    base = words(200, 21).split()
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 1001):
        rng = random.Random(i)
        x = list(base)
        for at in rng.sample(range(0, 200, 5), 4):
            x[at] = rng.choice([v for v in base if v != x[at]])
        rows.append((i, " ".join(x), "a"))
    docs = documents(spark, rows)
    idf = near_duplicates.idf_of(*near_duplicates.word_frequencies(docs.select("text")))
    sets = [near_duplicates.shingles(near_duplicates.word_hashes(r[1]), idf) for r in rows]
    assert all(near_duplicates.weighted_jaccard(sets[0], x) >= 0.8 for x in sets[1:])
    assert max(near_duplicates.weighted_jaccard(sets[i], sets[i + 1]) for i in range(1, 100)) < 0.8
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == 1001 and {r["class_id"] for r in got} == {0}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = near_duplicates.near_duplicates(odd).collect()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == odd.count() and by[2] == 1 and by[5] == 4 and by[8] == 8 and by[7] == 7
    assert near_duplicates.near_duplicates(odd.limit(0)).count() == 0


def test_draws_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(4)
    idf = np.ones(near_duplicates.DF_BUCKETS, np.float32)
    hits = []
    for i in range(60):
        w = words(300, i).split()
        v = list(w)
        for at in rng.choice(300, 6, replace=False):
            v[at] = "zz"
        a, b = (near_duplicates.shingles(near_duplicates.word_hashes(" ".join(x)).copy(), idf) for x in (w, v))
        x = near_duplicates.draws([a, b])
        hits.append(((x[0] == x[1]).mean(), near_duplicates.weighted_jaccard(a, b)))
    assert abs(np.mean([h for h, _ in hits]) - np.mean([s for _, s in hits])) < 0.03


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16)).astype(np.float32)
    vecs = [v.tolist() for v in base] + [(base[i] + rng.normal(size=16) * 0.08).astype(np.float32).tolist() for i in range(60)] + [base[0].tolist()] * 30
    rows = [(i, v, i % 3 if i < 180 else 0) for i, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, vecs[0], None), (904, [], 0), (905, [1.0, 2.0], 0), (906, [float("inf")] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(d, margin=0.3676, per_cell=40, block=16).collect()}
    x = np.array([v for _, v, _ in rows[: len(vecs)]], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([y for _, _, y in rows[: len(vecs)]])
    m = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(m, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([comp[i], *comp[m[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert [got[i]["n_links"] for i in range(len(x))] == m.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == comp.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert embedding_dedup.near_vectors(d.limit(0)).count() == 0


def test_embedding_links_of_several_cells_are_whole_by_default(spark):
    x = np.random.default_rng(6).normal(size=(9000, 4)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = np.array([r["n_links"] for r in embedding_dedup.near_vectors(d).orderBy("vec_id").collect()])
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert got.sum() == want.sum() and (got == want).all()


def test_hamming_search_against_brute_force(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(128) for _ in range(60)]
    for i in range(60):
        x = fps[i]
        for b in rng.sample(range(128), rng.randint(1, 9)):
            x ^= 1 << b
        fps.append(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    d = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in fps], "hi long, lo long")
    got = {(r["q_hi"], r["q_lo"], r["hi"], r["lo"]) for r in simhash.within_radius(d, d, 6).collect()}
    want = {(signed(a >> 64), signed(a & (1 << 64) - 1), signed(b >> 64), signed(b & (1 << 64) - 1)) for a in fps for b in fps if bin(a ^ b).count("1") <= 6}
    assert got == want


def test_fingerprints_and_next(spark, odd):
    got = simhash.with_next(odd, parts=4).where("not ghost").collect()
    assert len(got) == odd.count()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.where("doc_id > 3").collect()))
    by = {r["id"]: r for r in simhash.with_next(odd.where("doc_id > 3"), parts=3).where("not ghost").collect()}
    for (i, _), (_, t) in zip(rows, rows[1:] + rows[:1], strict=True):
        assert by[i]["next_text"] == t
    fp = simhash.fingerprints(odd.where("doc_id in (1, 2, 7)").select("doc_id", "text"), ["doc_id"], "text").collect()
    assert len({(r["hi"], r["lo"]) for r in fp}) == 1


def test_secret_spans_against_brute_force(spark):
    rng = random.Random(7)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", "token=short", 'é😀 Password: "' + key(20, b64) + '" and api-key', "api_key = " + key(14, b64) + " secret:" + key(12, b64), "AKIA" + key(16, "ABCDEFGH234") + " AKIA123", key(15, "0123456789abcdef") + " " + key(40, "0123456789abcdef"), "ſecret=" + key(15, b64)]
    texts += [words(30, i) + " " + key(40, b64) for i in range(3)] + [words(30, i) + " a-very-ordinary-hyphenated-word /usr/share/local/lib/python" for i in range(3)]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.scan(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, (p, group, least) in enumerate(secrets.KINDS.values()):
            want += [(m.start(), k, m.end()) for m in re.finditer(p, t or "", re.A) if len(m[group]) >= least]
        assert [s for s in got[i] if s[1] < 3] == sorted(want)
    assert all(any(s[1] == 3 for s in got[i]) for i in range(8, 11))
    assert not any(s[1] == 3 for i in range(11, 14) for s in got[i])


def test_random_tokens_of_each_encoding_and_length_are_kept(spark):
    up, low, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    symbols = {"hex": digits + "abcdef", "HEX": digits + "ABCDEF", "base32": up + "234567", "base32 lower": low + "234567", "base36": digits + up, "base36 lower": digits + low}
    symbols |= {"base58": "".join(sorted(set(digits + up + low) - set("0OIl"))), "base62": digits + up + low, "base64": up + low + digits + "+/", "base64url": up + low + digits + "-_"}
    rng = random.Random(3)
    rows = [(e, n, "".join(rng.choice(a) for _ in range(n))) for e, a in symbols.items() for n in (20, 32, 40, 64, 128) for _ in range(200)]
    d = spark.createDataFrame(rows, "encoding string, n int, token string").repartition(8)
    s = secrets.battery(F.col("token"))
    got = {(r["encoding"], r["n"]): r["kept"] for r in d.groupBy("encoding", "n").agg(F.avg((s["p"] >= 0.001).cast("int")).alias("kept")).collect()}
    assert len(got) == 50 and min(got.values()) >= 0.95
    texts = [(i, f"{words(20, i)} {t} {words(20, i + 9000)}", "a") for i, (_, _, t) in enumerate(rows) if i % 10 == 0]
    found = secrets.scan(documents(spark, texts)).select(F.exists("spans", lambda x: x["kind"] != 0)).collect()
    assert sum(r[0] for r in found) >= 0.95 * len(texts)


def test_redaction(spark):
    d = spark.createDataFrame([("ab password=" + "x" * 12 + "f" * 20 + " cd é",)], "text string")
    d = secrets.scan(d)
    assert d.select(secrets.redacted(F.col("text"), F.col("spans")).alias("t")).first()["t"] == "ab [secret] cd é"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|x|>\n"]), st.text(alphabet=st.sampled_from("ab\\<|>/s[INST]\n😀_end"), max_size=20)), min_size=1, max_size=5))
def test_chat_round_trip(spark, turns):
    d = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")
    formatted = chat.render(chat.fold(chat.turns_as_events(d)))
    got = chat.read_back(formatted).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert got["loss_texts"] == [t for r, t in turns if r == "assistant"]
    assert not re.search(r"</?s>|\[/?INST\]", formatted.first()["formatted"])


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "message", "assistant", ""), (1, 3, "m2", "delta", None, "He"), (1, 4, "m2", "delta", None, "llo"), (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, "Hey"), (1, 7, "m1", "edit", None, "hi there"), (1, 8, "m3", "message", "user", "x"), (1, 9, "m3", "delete", None, None)]
    got = chat.fold(spark.createDataFrame(log, "conv_id int, seq int, message string, kind string, role string, text string")).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "hi there"), ("assistant", "Hey")]


def test_main_text():
    page = """<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><main><article><header><h2>Head&amp;line</h2></header>
      <p>First  <b>bold</b> text.<p>Second para<br>graph with enough words to count.</p><form><input>Sign up</form><div id="comments"><p>Great post, I liked it a lot and more.</p></div></article></main><aside>Side</aside><footer>&copy; us</footer><script>var a="</p>";</script></body>"""
    assert main_text.main_text(page) == "Head&line\nFirst bold text.\nSecond para graph with enough words to count."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>x</nav>") == ""
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    assert main_text.main_text(deep) == "text"


