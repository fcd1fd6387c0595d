"""Graph and text queries over whole tables, against brute force."""

import pytest

from lodestar.plans.studies import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    customer = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    return [(f"cust:{customer[r['l_orderkey']]}", f"part:{r['l_partkey']}") for r in li if r["l_orderkey"] in customer]


def test_components_of_the_whole_graph(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in QUERIES["kg_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_service_reads_see_every_edge(spark, edges):
    e = QUERIES["svc_entity"](spark, SF).select("src", "dst").distinct().collect()
    assert {tuple(r) for r in e} == {x for x in edges if int(x[0].split(":")[1]) % 20 == 0}


def test_words_late_in_a_text_and_other_languages_count(spark, tmp_path):
    item = "rare zebra question"
    rows = [(1, "filler " * 400 + item, "en", "a", 2819), (2, "der Hund, que when", "de", "a", 18)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
    leaks = run("txt_anchor_leak")
    assert [r["doc"] for r in leaks] == [1] and "zebra" in leaks[0]["leak"].split()
    assert {r["doc_id"]: r["names"] for r in run("txt_alias_mentions")}[2] == "article,that"
    assert {r["doc_id"]: (r["conditional"], r["n_when"]) for r in run("txt_conditional_sentences")}[2] == (True, 1)


def test_term_ids_are_the_checksums(spark):
    import zlib

    got = QUERIES["txt_term_id"](spark, SF).collect()
    assert len(got) > 1000 and all(r["id"] == zlib.crc32(r["term"].encode()) & 0x7FFFFFFF for r in got)
