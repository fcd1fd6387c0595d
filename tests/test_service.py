"""Models behind interfaces, the service's limits, the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import cli, service
from lodestar.operators import models as M


class Down:
    def complete(self, requests):
        raise RuntimeError("no model")


class Cites:
    def complete(self, requests):
        return [json.dumps({"sentences": [{"text": "So it is.", "citations": ["1", "99"]}]}) for _ in requests]


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame([(1, "a kettle hums"), (2, "a pot"), (3, None)], "doc_id long, text string").write.parquet(at)
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("a", "R", "b")], "src string, rel string, dst string")
    return service.Service(spark, at, edges)


def test_replies_that_fit_no_schema_are_asked_for_once_more(spark):
    d = spark.createDataFrame([("ab",), ("abc",)], "r string")
    assert [(r["reply"], r["calls"]) for r in M.complete(d, "r", M.Echo(odd=3), ("n",)).collect()] == [('{"n": 2}', 1), ('{"n": 25}', 2)]
    assert [(r["reply"], r["error"], r["calls"]) for r in M.complete(d, "r", Down(), ("n",)).collect()] == [(None, "no model", 2)] * 2


def test_service_reads_and_limits(served):
    assert [r["doc"] for r in served.retrieve("kettle").collect()] == [1]
    assert served.retrieve("kettle", "S0").count() == 0 and served.health()["systems"] == ["L", "S0", "S1"]
    assert served.entity("b").count() == 2 and [tuple(r) for r in served.subgraph(["a", "b"]).collect()] == [("a", "R", "b")]
    for bad in (lambda: served.retrieve("x", "S9"), lambda: served.retrieve("x", k=0), lambda: served.retrieve("x", k=51), lambda: served.subgraph([]), lambda: served.subgraph(["a"] * 201)):
        with pytest.raises(service.BadRequest):
            bad()


def test_answers_cite_only_what_was_found(served):
    got = served.answer("kettle", Cites())
    assert got == {"abstained": False, "sentences": [{"text": "So it is.", "citations": ["1"]}], "sources": ["1"]}
    assert served.answer("zebra", Cites())["abstained"] and served.answer("kettle", Down())["abstained"]


def test_report_as_text(spark, tmp_path):
    t = spark.createDataFrame([("S1", "recall", 0.5, 4), ("S2", "recall", None, 0)], "system string, metric string, mean double, n long")
    assert service.markdown(t, ["S1", "S2"], ["recall"]) == "| metric | S1 | S2 |\n|-|-|-|\n| recall | 0.500 (n=4) | - |\n"
    service.write_report(t, f"{tmp_path}/r", ["S1"], ["recall"])
    assert spark.read.text(f"{tmp_path}/r/markdown").count() == 3 and spark.read.json(f"{tmp_path}/r/json").count() == 2


def test_distmult_learns_a_pattern(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 20, 400)
    t = 20 + (h % 4) * 5 + rng.integers(0, 5, 400)
    m = M.DistMult(40, 1, seed=1).fit(h, np.zeros(400, int), t, epochs=300, rate=0.05)
    bad = 20 + ((h + 1) % 4) * 5
    assert (m.score(h, np.zeros(400, int), t) > m.score(h, np.zeros(400, int), bad)).mean() > 0.9
    e = spark.createDataFrame([("a", "R", "x"), ("b", "R", "y"), ("a", "Q", "b")], "src string, rel string, dst string")
    assert M.distmult_scores(e, "R", epochs=5).count() == 2


def test_commands_end_to_end(spark, tmp_path):
    pages = "<h1>T</h1><p>See <a href='/2'>the pot</a>.</p>", "<h1>Pot</h1><p>Text</p>"
    spark.createDataFrame([("1", pages[0]), ("2", pages[1])], "page_id string, html string").write.parquet(f"{tmp_path}/pages")
    cli.main(["ingest-parse", f"{tmp_path}/pages", f"{tmp_path}/arts"])
    cli.main(["ingest-chunk", f"{tmp_path}/arts", f"{tmp_path}/chunks"])
    cli.main(["ingest-links", f"{tmp_path}/arts", f"{tmp_path}/chunks", f"{tmp_path}/links"])
    assert [(r["src_article"], r["dst_article"], r["src_chunk_id"]) for r in spark.read.parquet(f"{tmp_path}/links").collect()] == [("1", "2", "1:0:0")]
    record = json.dumps({"problems": [{"symptom": "it hums", "fixes": [{"action": "shake it"}]}]})
    spark.createDataFrame([("c", record, "if it hums, shake it", "2024", "m")], "chunk string, record string, seen string, ts string, model string").write.parquet(f"{tmp_path}/records")
    cli.main(["kg-build", f"{tmp_path}/records", f"{tmp_path}/kg"])
    assert [r["rel"] for r in spark.read.parquet(f"{tmp_path}/kg/edges").collect()] == ["RESOLVED_BY"]
    cli.main(["kg-stats", f"{tmp_path}/kg/nodes", f"{tmp_path}/kg/edges"])
    spark.read.parquet(f"{tmp_path}/chunks").select(F.col("chunk_id").alias("doc_id"), "text").write.parquet(f"{tmp_path}/d")
    cli.main(["index-build", f"{tmp_path}/d", f"{tmp_path}/index"])
    cli.main(["query", "txt_mix", "/root/testdata/sf0.001", f"{tmp_path}/q"])
    assert spark.read.parquet(f"{tmp_path}/q").count() == 1500
