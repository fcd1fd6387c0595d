"""Hand-computed cases and properties of the operators."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.functions.udfs import best_window_ratio
from lodestar.operators import corpus, evaluation
from lodestar.operators.components import connected_components


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.2), ("b", 0.004), ("c", 0.02), ("d", 0.02)], "k string, p double")
    assert {r["k"]: round(r["p_holm"], 9) for r in evaluation.holm(d, "p", "k").collect()} == {"a": 0.2, "b": 0.016, "c": 0.06, "d": 0.06}


def test_auroc_and_ties(spark):
    d = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert evaluation.auroc(d, "s", "y").first()["auroc"] == 0.875


def test_four_ties_rank_in_the_middle(spark):
    s = spark.createDataFrame([(1, i, 0.0) for i in range(5)], "qid int, doc int, score double")
    known = spark.createDataFrame([(1, 2)], "qid int, doc int")
    assert evaluation.filtered_ranks(s, known).first()["rank"] == 3


def test_kappa_of_one_value(spark):
    d = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert evaluation.cohens_kappa(d, "a", "b").first()["kappa"] == 1.0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 160)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=30))
def test_chunks_cover_every_unit(sizes):
    spans = corpus._chunk_lines(sizes, 200, 500, 60, 1)
    covered = set()
    for lo, hi, _ in spans:
        assert lo < hi
        covered |= set(range(lo, hi))
        assert sum(sizes[lo:hi]) <= 500 or hi - lo == 1
    assert covered == set(range(len(sizes)))


def test_chunk_text_is_the_documents(spark):
    text = "\n".join(" ".join(["word"] * n) for n in (10, 300, 250, 700, 3))
    got = corpus.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert all(r["text"] == (text if r["doc"] == "1" else "")[r["start"] : r["end"]] for r in got)


def test_context_pack_stops_at_the_first_overflow(spark):
    d = spark.createDataFrame([(1, 0, 100), (1, 1, 400), (1, 2, 10)], "qid int, pos int, n int")
    assert [(r["pos"], r["take"]) for r in corpus.context_pack(d, 300).orderBy("pos").collect()] == [(0, 100), (1, 140)]


def test_best_window_ratio():
    assert best_window_ratio("restart the phone", "please restart the phone now") == 1.0
    assert best_window_ratio("restart the phone", "restart your phone") > 0.7
    assert best_window_ratio("zebra", "quick brown fox") < 0.6
    assert best_window_ratio("", "x") == 0.0
