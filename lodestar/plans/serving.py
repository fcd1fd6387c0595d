"""Queries of models behind interfaces, screening, linking, studies and service reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import evaluation as E
from lodestar.operators import knowledge as K
from lodestar.operators import models as M
from lodestar.operators import search as S
from lodestar.plans.catalogue import BM, GOLD, KG_ALL, LEX, RRF, _bm25, _docs, _gold, _lexical, _q, content, query, tok
from lodestar.service import Service
from lodestar.sources.tables import kg_edges, table


# ---- requests and replies
@query("SELECT p_partkey, 'Title: '||p_name||chr(10)||'Section: '||p_brand||chr(10)||chr(10)||p_type AS prompt FROM part")
def kg_request(s, d):
    """What an extraction model is sent for each chunk, read back from the request's JSON."""
    r = table(s, d, "part").select("p_partkey", M.request("m", "Extract.", M.extraction_prompt(F.col("p_name"), F.col("p_brand"), F.col("p_type")), "graph", 800).alias("r"))
    return r.select("p_partkey", F.get_json_object("r", "$.messages[1].content").alias("prompt"))


@query("SELECT item_id, string_agg('['||doc_id||']'||chr(10)||left(text,20), chr(10)||chr(10) ORDER BY doc_id)||chr(10)||chr(10)||'Question: '||any_value(q) AS prompt FROM (SELECT item_id, b.text AS q, d.doc_id, d.text FROM benchmark b JOIN documents d ON d.doc_id=b.item_id OR d.doc_id=b.item_id+1) GROUP BY 1")
def ans_prompt(s, d):
    """Questions under two sources each, as a grounded answer is asked for."""
    q = _q(s, d).select("item_id", F.col("text").alias("q"), F.explode(F.array("item_id", F.col("item_id") + 1)).alias("doc_id"))
    x = q.join(_docs(s, d).select("doc_id", F.substring("text", 1, 20).alias("text")), "doc_id").groupBy("item_id", "q").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("doc_id").cast("string").alias("id"), "text"))).alias("c"))
    return x.select("item_id", M.sources_prompt(F.col("q"), F.col("c")).alias("prompt"))


@query("SELECT p_partkey, CASE WHEN (length(p_name)+2)%3=0 THEN length(p_name)+2+length(chr(10)||'Reply with JSON only.') ELSE length(p_name)+2 END AS n, CASE WHEN (length(p_name)+2)%3=0 THEN 2 ELSE 1 END AS calls FROM part")
def ans_structured(s, d):
    """Replies that must be JSON, asked for once more where they are not."""
    x = table(s, d, "part").select("p_partkey", F.concat(F.lit("<"), "p_name", F.lit(">")).alias("request"))
    return M.complete(x, "request", M.Echo(odd=3), ("n",)).select("p_partkey", F.get_json_object("reply", "$.n").cast("int").alias("n"), "calls")


# ---- screening and bridging
@query(f"WITH x AS (SELECT item_id, {content('text')} AS q, {content('left(text,40)')} AS a, item_id%3<>0 AS said, length(text)>=15 AS long FROM benchmark), y AS (SELECT item_id, said, long, CASE WHEN item_id%2=0 AND len(a)>0 THEN len(list_intersect(a,q))/len(a) ELSE 0.0 END>=0.6 AS leaks FROM x) SELECT item_id, said AND long AND NOT leaks AS passed, leaks FROM y")
def ben_screen(s, d):
    """Questions that pass: the model says that the evidence answers them, its quote stands there, and the answer isn't given away."""
    b = table(s, d, "benchmark").withColumn("answer", F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 40)).otherwise(""))
    leaks = T.leak_of_answers(F.col("text"), F.array("answer"), ()) >= 0.6
    x = b.select("item_id", E.screened(F.col("item_id") % 3 != 0, F.col("item_id") % 3 != 0, F.col("text"), F.lit(1.0), leaks).alias("x"))
    return x.select("item_id", "x.passed", "x.leaks")


# ---- names and links
@query(f"WITH t AS (SELECT 'part:'||p_partkey AS node, unnest({tok('p_name')}) AS w FROM part), b AS (SELECT node, ('0x'||right(md5(w),8))::BIGINT%64 AS bucket, count(*) AS n FROM t GROUP BY 1,2) SELECT node, bucket, round(n/sqrt(sum(n*n) OVER (PARTITION BY node)),6) AS w FROM b")
def src_name_index(s, d):
    """The index of node names: their hashed vectors."""
    p = table(s, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return S.hash_embed(p, 64).select(F.col("doc").alias("node"), "bucket", F.round("w", 6).alias("w"))


VEC = lambda name, key, text, src: f"{name}t AS (SELECT {key} AS k, unnest({tok(text)}) AS w FROM {src}), {name}b AS (SELECT k, ('0x'||right(md5(w),8))::BIGINT%1024 AS bucket, count(*) AS n FROM {name}t GROUP BY 1,2), {name} AS (SELECT k, bucket, n/sqrt(sum(n*n) OVER (PARTITION BY k)) AS w FROM {name}b)"
LINK = f"""{VEC('m', 'p_name', 'p_name', '(SELECT DISTINCT p_name FROM part)')}, {VEC('aa', 'node', 'alias', "(SELECT 'part:'||p_partkey AS node, p_name||' '||p_type AS alias FROM part)")},
 sim AS (SELECT m.k AS mention, aa.k AS node, sum(m.w*aa.w) AS sim FROM m JOIN aa USING(bucket) GROUP BY 1,2), top AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY round(sim,9) DESC, node) AS r FROM sim WHERE round(sim,9)>=0.72)"""


@query(f"WITH {LINK}, c AS (SELECT 'part:'||l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1) SELECT mention, node, round(sim/ln(2+coalesce(n,0)),6) AS weight FROM top LEFT JOIN c USING(node) WHERE r<=3")
def ret_entity_links(s, d):
    """Phrases to nodes by their names' vectors, three each at most, weighted by how rarely a node is mentioned."""
    p = table(s, d, "part")
    phrases = p.select(F.col("p_name").alias("doc_id"), F.col("p_name").alias("text")).distinct()
    names = p.select(F.concat(F.lit("part:"), "p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    counts = table(s, d, "lineitem").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("node")).agg(F.count("*").alias("n"))
    x = S.link_names(S.hash_embed(phrases, 1024), S.hash_embed(names, 1024), counts)
    return x.select("mention", "node", F.round("weight", 6).alias("weight"))


@query(f"WITH {GOLD} SELECT qid, doc, round(len(list_intersect(list_distinct({tok('b.text')}), {tok('d.text')}))/greatest(len(list_distinct({tok('b.text')})),1)+0.5,6) AS score FROM gold g JOIN benchmark b ON b.item_id=g.qid JOIN documents d ON d.doc_id=g.doc")
def ret_reranker_by_name(s, d):
    """A reranker taken from the registry, on the pairs of questions and the documents that hold them."""
    x = _gold(s, d).join(_q(s, d).select(F.col("item_id").alias("qid"), F.col("text").alias("q")), "qid").join(_docs(s, d).select(F.col("doc_id").alias("doc"), "text"), "doc")
    return x.select("qid", "doc", F.round(M.RERANKERS["phrase"](F.col("q"), F.col("text")), 6).alias("score"))


# ---- studies
@query(f"WITH {BM}, {LEX}, {RRF}, {GOLD}, g AS (SELECT w, k FROM (VALUES (0.1),(0.25),(0.5)) a(w), (VALUES (10),(30)) b(k)), c AS (SELECT w, k, r.qid, r.doc, (1-w)*r.score*30+w*coalesce(l.score,0) AS score FROM g JOIN rrf r ON r.rk<=k LEFT JOIN lexs l USING(qid,doc)), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w,k,qid ORDER BY round(score,9) DESC, doc) AS rk FROM c) WHERE rk<=8) SELECT w, k, count(*) AS n, round(avg((t.doc IS NOT NULL)::INT),6) AS recall FROM (SELECT g.w, g.k, gold.qid, gold.doc FROM g, gold) x LEFT JOIN t USING(w,k,qid,doc) GROUP BY 1,2")
def bench_rerank_grid(s, d):
    """Recall at 8 of every weight and pool size of a reranking study."""
    grid = s.createDataFrame([(w, k) for w in (0.1, 0.25, 0.5) for k in (10, 30)], "w double, k int")
    fused = S.fuse(_bm25(s, d), _lexical(s, d)).select("qid", "doc", F.col("score").alias("s1"), "rk")
    from lodestar.plans.catalogue import _index

    x = S.lexical_scores(fused, _q(s, d), _index(s, d)).join(F.broadcast(grid), F.col("rk") <= F.col("k"))  # a grid of six
    x = x.withColumn("score", (1 - F.col("w")) * F.col("s1") * 30 + F.col("w") * F.col("s2"))
    w = Window.partitionBy("w", "k", "qid").orderBy(F.round("score", 9).desc(), "doc")
    top = x.withColumn("r", F.row_number().over(w)).where("r <= 8").select("w", "k", "qid", "doc", F.lit(1).alias("hit"))
    want = _gold(s, d).join(F.broadcast(grid), F.lit(True))
    return want.join(top, ["w", "k", "qid", "doc"], "left").groupBy("w", "k").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


# ---- tables beside each other
@query(f"WITH {KG_ALL} SELECT origin, count(*) AS n FROM (SELECT 'extracted' AS origin FROM kg_edges UNION ALL SELECT 'predicted' FROM customer JOIN part ON p_partkey=c_custkey) GROUP BY 1")
def grf_mixed_origins(s, d):
    p = table(s, d, "customer").join(table(s, d, "part"), F.col("p_partkey") == F.col("c_custkey")).select(F.concat(F.lit("cust:"), "c_custkey").alias("src"), F.lit("RESOLVED_BY").alias("rel"), F.concat(F.lit("part:"), "p_partkey").alias("dst"))
    return K.mixed_edges(kg_edges(s, d), p).groupBy("origin").agg(F.count("*").alias("n"))


@query(f"WITH {KG_ALL} SELECT split_part(chunk,':',1)::BIGINT AS o_orderkey, count(*) AS n FROM kg_edges WHERE split_part(chunk,':',1)::BIGINT NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT') GROUP BY 1")
def src_outside_corpus(s, d):
    """Chunks of articles that the working corpus leaves out."""
    corpus = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    c = kg_edges(s, d).select(F.split_part("chunk", F.lit(":"), F.lit(1)).cast("long").alias("o_orderkey"))
    return c.join(corpus, "o_orderkey", "left_anti").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {KG_ALL} SELECT dst AS node, split_part(chunk,':',1) AS article, arg_min(model, chunk||model) AS surface FROM kg_edges GROUP BY 1,2")
def kg_first_surface(s, d):
    """The first surface of each node in each article."""
    e = kg_edges(s, d).withColumn("article", T.article_of(F.col("chunk")))
    return e.groupBy(F.col("dst").alias("node"), "article").agg(F.min_by("model", F.concat("chunk", "model")).alias("surface"))


# ---- service
def _service(s: SparkSession, d: str) -> Service:
    return Service(s, f"{d}/documents.parquet", kg_edges(s, d))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def svc_chunks(s, d):
    """The first 50 ids, as the service lists them."""
    return _service(s, d).chunk_ids()


@query(f"WITH {BM} SELECT doc, round(score,6) AS score, rk FROM bm WHERE qid=0 AND rk<=8")
def svc_retrieve(s, d):
    first: DataFrame = _q(s, d).where("item_id = 0").select("text")
    return _service(s, d).retrieve(first.first()["text"]).select("doc", F.round("score", 6).alias("score"), "rk")


@query(f"WITH {KG_ALL} SELECT DISTINCT src, rel, dst FROM kg_edges WHERE dst='part:1' OR src='part:1'")
def svc_entity_edges(s, d):
    return _service(s, d).entity("part:1")
