"""Further queries: question generation, document layer, studies, exact tests, service reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import evaluation as E
from lodestar.operators import knowledge as K
from lodestar.operators import search as S
from lodestar.plans.catalogue import ADJ, BM, EID, FR, GOLD, KG_ALL, LEX, MERGED, ORACLE_SQL, QUERIES, RANKED, RECALL, RRF, SEEDS, STEP, _bm25, _docs, _gold, _hop, _index, _lexical, _q, _seeds, content, query, tok  # noqa: F401
from lodestar.sources.tables import kg_edges, table
from lodestar.streaming import logs as L

GENERIC = ("the", "erin", "than", "tion")


@query(f"WITH {GOLD} SELECT qid, doc, array_to_string(list_sort(list_intersect(list_filter(a, w -> NOT list_contains(['the','erin','than','tion'], w)), q)),' ') AS leak FROM (SELECT g.qid, g.doc, {content('b.text')} AS q, {content('d.text')} AS a FROM gold g JOIN benchmark b ON b.item_id=g.qid JOIN documents d ON d.doc_id=g.doc)".replace("w -> NOT", "lambda w: NOT"))
def txt_anchor_leak(s, d):
    g = _gold(s, d).join(_q(s, d).select(F.col("item_id").alias("qid"), T.content_words(F.col("text")).alias("q")), "qid").join(_docs(s, d).select(F.col("doc_id").alias("doc"), T.content_words(F.col("text")).alias("a")), "doc")
    return g.select("qid", "doc", F.array_join(F.array_sort(T.anchor_leak(F.col("a"), F.col("q"), GENERIC)), " ").alias("leak"))


@query(r"SELECT doc_id, nullif(regexp_extract(text,'\b([A-Z]{2,}[0-9]+|[0-9]{3,})\b',1),'') AS code FROM documents")
def txt_error_codes(s, d):
    return _docs(s, d).select("doc_id", F.nullif(F.regexp_extract("text", r"\b([A-Z]{2,}[0-9]+|[0-9]{3,})\b", 1), F.lit("")).alias("code"))


@query(r"SELECT doc_id, round(CASE WHEN lang='en' THEN 2.0 ELSE 0.5 END + 0.3*least(3,len(regexp_extract_all(text,'\bthe\b'))) + CASE WHEN n_chars BETWEEN 200 AND 20000 THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(text,'\bwhen\b') THEN 0.5 ELSE 0.0 END,6) AS relevance FROM documents")
def txt_relevance(s, d):
    score = F.when(F.col("lang") == "en", 2.0).otherwise(0.5) + 0.3 * F.least(F.lit(3), F.regexp_count("text", F.lit(r"\bthe\b"))) + F.when(F.col("n_chars").between(200, 20000), 1.0).otherwise(0.0) + F.when(F.col("text").rlike(r"\bwhen\b"), 0.5).otherwise(0.0)
    return _docs(s, d).select("doc_id", F.round(score, 6).alias("relevance"))


@query("SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT n_name FROM nation)")
def src_names(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_name").alias("name")).unionAll(p.select("p_brand")).unionAll(table(s, d, "nation").select("n_name")).distinct()


# ---- graph
@query(f"WITH {KG_ALL} SELECT {EID} AS edge_id, count(*) AS n_claims, count_if(conf>=0.95)::BIGINT AS n_supported FROM kg_edges GROUP BY src,rel,dst")
def kg_support(s, d):
    return kg_edges(s, d).groupBy("src", "rel", "dst").agg(F.count("*").alias("n_claims"), F.count_if(F.col("conf") >= 0.95).alias("n_supported")).select(T.edge_id(F.col("src"), F.col("rel"), F.col("dst")).alias("edge_id"), "n_claims", "n_supported")


@query(f"WITH {KG_ALL}, {MERGED} SELECT round(100*avg(CASE WHEN len(chunks)>0 THEN 1.0 ELSE 0.0 END),6) AS provenance_pct, round(100*avg(CASE WHEN n_support>1 THEN 1.0 ELSE 0.0 END),6) AS multi_pct FROM merged")
def kg_provenance(s, d):
    m = K.merge_edges(kg_edges(s, d))
    return m.agg(F.round(100 * F.avg(F.when(F.size("chunks") > 0, 1.0).otherwise(0.0)), 6).alias("provenance_pct"), F.round(100 * F.avg(F.when(F.col("n_support") > 1, 1.0).otherwise(0.0)), 6).alias("multi_pct"))


@query(f"WITH {KG_ALL} SELECT DISTINCT src, dst, p_type AS version FROM kg_edges JOIN part ON 'part:'||p_partkey=dst WHERE p_size>40")
def gen_version(s, d):
    v = table(s, d, "part").where("p_size > 40").select(F.concat(F.lit("part:"), "p_partkey").alias("dst"), F.col("p_type").alias("version"))
    return kg_edges(s, d).join(v, "dst").select("src", "dst", "version").distinct()


@query(f"WITH {KG_ALL}, c AS (SELECT c_nationkey AS code, min('cust:'||c_custkey) AS symptom FROM customer WHERE 'cust:'||c_custkey IN (SELECT src FROM kg_edges) GROUP BY 1) SELECT code, symptom, min(dst) AS fix FROM c JOIN kg_edges ON src=symptom GROUP BY 1,2")
def gen_error(s, d):
    e = kg_edges(s, d).select("src", "dst")
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("code"), F.concat(F.lit("cust:"), "c_custkey").alias("src")).join(e, "src", "left_semi")
    first = c.groupBy("code").agg(F.min("src").alias("symptom"))
    return first.join(e, F.col("symptom") == F.col("src")).groupBy("code", "symptom").agg(F.min("dst").alias("fix"))


@query(f"WITH {KG_ALL}, {ADJ}, m AS (SELECT src AS node, split_part(chunk,':',1) AS a FROM kg_edges UNION ALL SELECT dst, split_part(chunk,':',1) FROM kg_edges), l AS (SELECT node AS src, 'article:'||a AS dst, 0.2*count(*) AS w FROM m GROUP BY 1,2) SELECT src, dst, round(sum(w),6) AS w FROM (SELECT src,dst,w FROM adj UNION ALL SELECT src,dst,w FROM l UNION ALL SELECT dst,src,w FROM l) GROUP BY 1,2")
def grf_doc_layer(s, d):
    e = kg_edges(s, d)
    mentions = e.select(F.col("src").alias("node"), "chunk").unionAll(e.select("dst", "chunk"))
    return K.document_layer(K.adjacency(e), mentions).select("src", "dst", F.round("w", 6).alias("w"))


PATHS = f"{KG_ALL}, {STEP}, s0 AS ({SEEDS}), f0 AS (SELECT node AS qid, [node] AS path, 1.0 AS score, node FROM s0), {_hop(1)}, {_hop(2)}, {_hop(3)}, pt AS (SELECT qid, path, score, rk FROM (SELECT *, {RANKED} AS rk FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3) WHERE node LIKE 'part:%') WHERE rk<=20)"


def _paths(s, d):
    e = kg_edges(s, d)
    return K.paths(e, _seeds(e).select(F.col("node").alias("qid"), "node", F.lit(1.0).alias("weight")), ["part"])


@query(f"WITH {PATHS}, ex AS (SELECT qid, rk, path, unnest(range(1,len(path))) AS i FROM pt WHERE rk<=8) SELECT qid, rk, string_agg(CASE WHEN EXISTS (SELECT 1 FROM kg_edges k WHERE k.src=path[i] AND k.dst=path[i+1]) THEN path[i]||' -> '||path[i+1] ELSE path[i]||' <- '||path[i+1] END, '; ' ORDER BY i) AS shown FROM ex GROUP BY qid, rk")
def grf_path_text(s, d):
    return K.path_text(_paths(s, d).where("rk <= 8"), kg_edges(s, d))


@query(f"WITH {PATHS}, x AS (SELECT qid, unnest(path) AS node, score FROM pt), m AS (SELECT DISTINCT node, chunk FROM (SELECT src AS node, chunk FROM kg_edges UNION ALL SELECT dst, chunk FROM kg_edges)), c AS (SELECT qid, chunk AS doc, max(score) AS score FROM x JOIN m USING(node) GROUP BY 1,2) SELECT qid, doc, round(score,6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, doc) AS rk FROM c) WHERE rk<=8")
def ret_s3(s, d):
    e = kg_edges(s, d)
    nodes = _paths(s, d).select("qid", "score", F.explode("path").alias("node")).groupBy("qid", "node").agg(F.max("score").alias("score"))
    asked = nodes.select("node").distinct()
    m = e.select(F.col("src").alias("node"), "chunk").unionAll(e.select("dst", "chunk")).join(asked, "node", "left_semi").distinct()
    # chunks of a node score the same, so of each node only the first eight can be among a question's first eight
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("chunk"))).where("r <= 8").drop("r")
    c = nodes.join(m, "node").groupBy("qid", F.col("chunk").alias("doc")).agg(F.max("score").alias("score"))
    return S.top_k(c, 8).select("qid", "doc", F.round("score", 6).alias("score"), "rk")


@query(f"WITH {KG_ALL}, {MERGED}, a AS (SELECT DISTINCT split_part(chunk,':',1) AS a FROM kg_edges), h AS (SELECT a FROM (SELECT a, row_number() OVER (ORDER BY md5('13|'||a), a) AS r, count(*) OVER () AS n FROM a) WHERE r<=round_even(0.2*n,0)) SELECT edge_id, len(list_filter(chunks, lambda c: split_part(c,':',1) NOT IN (SELECT a FROM h)))=0 AS held_out FROM merged".replace("len(list_filter(chunks, lambda c: split_part(c,':',1) NOT IN (SELECT a FROM h)))=0 AS held_out FROM merged", "bool_and(h.a IS NOT NULL) AS held_out FROM (SELECT edge_id, split_part(unnest(chunks),':',1) AS a FROM merged) m LEFT JOIN h USING(a) GROUP BY edge_id"))
def grf_holdout(s, d):
    return K.hold_out(K.merge_edges(kg_edges(s, d)), 0.2, "13")


# ---- retrieval
@query(f"WITH {KG_ALL}, m AS (SELECT DISTINCT node, chunk FROM (SELECT src AS node, chunk FROM kg_edges UNION ALL SELECT dst, chunk FROM kg_edges)) SELECT node, count(*) AS n_chunks, round(1/ln(2+count(*)),6) AS specificity FROM m GROUP BY node")
def ret_specificity(s, d):
    e = kg_edges(s, d)
    m = e.select(F.col("src").alias("node"), "chunk").unionAll(e.select("dst", "chunk")).distinct()
    return m.groupBy("node").agg(F.count("*").alias("n_chunks"), F.round(1 / F.ln(2 + F.count("*")), 6).alias("specificity"))


@query(f"WITH t AS (SELECT doc_id AS doc, unnest({tok('text')}) AS w FROM documents), b AS (SELECT doc, ('0x'||right(md5(w),8))::BIGINT%64 AS bucket, count(*) AS n FROM t GROUP BY 1,2) SELECT doc, bucket, round(n/sqrt(sum(n*n) OVER (PARTITION BY doc)),6) AS w FROM b")
def ret_hash_embed(s, d):
    return S.hash_embed(_docs(s, d), 64).select("doc", "bucket", F.round("w", 6).alias("w"))


RERANK = "rr AS (SELECT qid, doc, score, rk FROM (SELECT r.qid, r.doc, coalesce(l.score,0) AS score, row_number() OVER (PARTITION BY r.qid ORDER BY round(coalesce(l.score,0),9) DESC, r.rk) AS rk FROM rrf r LEFT JOIN lexs l USING(qid,doc)) WHERE rk<=8)"


def _rerank(s, d):
    fused = S.fuse(_bm25(s, d), _lexical(s, d)).select("qid", "doc", F.col("rk").alias("first"))
    return S.top_k(S.lexical_scores(fused, _q(s, d), _index(s, d)).withColumnRenamed("s2", "score"), 8, tie="first").drop("first")


@query(f"WITH {BM}, {LEX}, {RRF}, {RERANK} SELECT qid, doc, round(score,6) AS score, rk FROM rr")
def ret_rerank(s, d):
    return _rerank(s, d).select("qid", "doc", F.round("score", 6).alias("score"), "rk")


@query(f"WITH {BM}, {LEX}, {RRF}, {RERANK} SELECT qid, doc, round(score,6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, doc) AS rk FROM (SELECT qid, doc, sum(1.0/(60+rk)) AS score FROM (SELECT qid,doc,rk FROM bm UNION ALL SELECT qid,doc,rk FROM rr) GROUP BY 1,2)) WHERE rk<=30")
def ret_s4(s, d):
    return S.fuse(_bm25(s, d), _rerank(s, d)).select("qid", "doc", F.round("score", 6).alias("score"), "rk")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT q.vec_id AS qid, v.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c, n.n FROM embeddings q JOIN embeddings v ON q.vec_id<>v.vec_id JOIN n ON n.label=v.label WHERE q.vec_id%20=0), f AS (SELECT qid, doc, c/ln(2+n) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(c,9) DESC, doc) AS rk FROM r WHERE c>=0.1) SELECT qid, doc, round(score,6) AS weight FROM f WHERE rk<=3")
def ret_link_seeds(s, d):
    v = table(s, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    n = v.groupBy("label").agg(F.count("*").alias("n"))
    c = v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), "label")
    near = S.dense(q, c, 3).where("score >= 0.1").join(c.select("doc", "label"), "doc").join(n, "label")
    return near.select("qid", "doc", F.round(F.col("score") / F.ln(2 + F.col("n")), 6).alias("weight"))


POOL = "pool AS (SELECT DISTINCT h.qid, n.doc FROM (SELECT qid, doc FROM bm WHERE rk<=3) h JOIN (SELECT doc_id AS a, doc_id+1 AS doc FROM documents WHERE doc_id+1 IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, doc_id-1 FROM documents WHERE doc_id-1 IN (SELECT doc_id FROM documents)) n ON n.a=h.doc WHERE NOT EXISTS (SELECT 1 FROM bm b WHERE b.qid=h.qid AND b.doc=n.doc AND b.rk<=8))"


def _links(s, d):
    ids = _docs(s, d).select("doc_id")
    return ids.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst")).join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")


@query(f"WITH {BM}, {POOL} SELECT qid, doc FROM pool")
def ret_link_pool(s, d):
    return S.link_pool(_bm25(s, d), _links(s, d), 3, 8)


@query(f"WITH {BM}, {POOL}, z AS (SELECT qid, doc, CASE WHEN rk<=6 THEN 0 ELSE 2 END AS p, rk FROM bm WHERE rk<=8 UNION ALL SELECT qid, doc, 1, row_number() OVER (PARTITION BY qid ORDER BY doc) FROM pool), o AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY p, rk, doc) AS pos FROM z) SELECT qid, doc, pos FROM o WHERE pos<=8")
def ret_combo(s, d):
    ranked = _bm25(s, d)
    pool = S.link_pool(ranked, _links(s, d), 3, 8).withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("doc")).cast("long"))
    return S.protected_fill(ranked, pool)


# ---- evaluation
@query(f"WITH {BM}, {GOLD} SELECT k, count(*) AS n, round(avg(ok::INT),6) AS complete FROM (SELECT k.k, g.qid, bool_and(EXISTS (SELECT 1 FROM bm b WHERE b.qid=g.qid AND b.doc=g.doc AND b.rk<=k.k)) AS ok FROM gold g, (VALUES (1),(3),(8)) k(k) GROUP BY 1,2) GROUP BY k".replace("bool_and(EXISTS (SELECT 1 FROM bm b WHERE b.qid=g.qid AND b.doc=g.doc AND b.rk<=k.k)) AS ok FROM gold g,", "bool_and(coalesce(b.rk,1000)<=k.k) AS ok FROM gold g LEFT JOIN bm b USING(qid,doc),"))
def m_support_complete(s, d):
    r = _bm25(s, d)
    out = None
    for k in (1, 3, 8):
        x = E.recall_at_k(r, _gold(s, d), k).agg(F.count("*").alias("n"), F.round(F.avg(F.col("complete").cast("int")), 6).alias("complete")).select(F.lit(k).alias("k"), "n", "complete")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"WITH {BM}, {GOLD}, c AS (SELECT qid, doc FROM bm WHERE rk<=5), h AS (SELECT c.qid, count(*) AS cited, count(g.doc) AS hit FROM c LEFT JOIN gold g USING(qid,doc) GROUP BY c.qid), t AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid) SELECT qid, round(hit/cited,6) AS precision, round(hit/n,6) AS recall FROM h JOIN t USING(qid)")
def m_citation(s, d):
    return E.citations(_bm25(s, d).where("rk <= 5"), _gold(s, d)).select("qid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {BM}, {GOLD}, {RECALL} SELECT CASE WHEN n_gold>1 THEN 'multi' ELSE 'single' END AS span, count(*) AS n, round(avg(recall),6) AS recall FROM rec GROUP BY 1")
def m_by_span(s, d):
    r = E.recall_at_k(_bm25(s, d), _gold(s, d))
    return r.groupBy(F.when(F.col("n_gold") > 1, "multi").otherwise("single").alias("span")).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"))


@query("WITH c AS (SELECT coalesce(lang,'ALL') AS type, count_if(toxic=1 AND quality=0)::BIGINT AS tp, count_if(toxic=1 AND quality=1)::BIGINT AS fp, count_if(toxic=0 AND quality=0)::BIGINT AS fn FROM labels JOIN documents USING(doc_id) GROUP BY ROLLUP(lang)) SELECT type, tp, fp, fn, round(coalesce(tp/nullif(tp+fp,0),0),6) AS p, round(coalesce(tp/nullif(tp+fn,0),0),6) AS r, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1 FROM c")
def m_rollup_prf(s, d):
    x = table(s, d, "labels").join(_docs(s, d).select("doc_id", "lang"), "doc_id")
    return E.prf_rollup(x, "lang", F.expr("toxic = 1"), F.expr("quality = 0"))


@query(f"WITH {BM}, {LEX}, {GOLD}, x AS (SELECT g.qid, g.doc, EXISTS (SELECT 1 FROM bm b WHERE b.qid=g.qid AND b.doc=g.doc AND b.rk<=2) AS a, EXISTS (SELECT 1 FROM lex l WHERE l.qid=g.qid AND l.doc=g.doc AND l.rk<=2) AS b FROM gold g) SELECT count_if(b AND NOT a)::BIGINT AS recovered, count_if(a AND NOT b)::BIGINT AS broken, count(*) AS n FROM x")
def m_recovered_broken(s, d):
    return E.recovered_broken(_gold(s, d), _bm25(s, d).where("rk <= 2"), _lexical(s, d).where("rk <= 2"))


@query("WITH x AS (SELECT v, row_number() OVER (ORDER BY k)-1 AS i FROM (SELECT user_id AS k, round(avg(value)-50,6) AS v FROM events WHERE user_id<10 GROUP BY 1)), n AS (SELECT count(*) AS n, avg(v) AS mean FROM x), f AS (SELECT b, avg(CASE WHEN (b>>i)&1=1 THEN -v ELSE v END) AS m FROM x, (SELECT unnest(range(0,(1<<(SELECT count(*) FROM x)::INT)::BIGINT)) AS b) GROUP BY b) SELECT n, round(mean,6) AS mean, round((SELECT avg(CASE WHEN abs(m)>=abs(mean)-1e-12 THEN 1.0 ELSE 0.0 END) FROM f),6) AS p FROM n")
def s_permutation_exact(s, d):
    x = table(s, d, "events").where("user_id < 10").groupBy(F.col("user_id").alias("k")).agg(F.round(F.avg("value") - 50, 6).alias("v"))
    return E.permutation_exact(x, "v", "k")


@query()
def s_bootstrap_exact(s, d):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values("doc_id")["quality"].to_numpy(dtype=float)
        rng = np.random.default_rng(13)
        m = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(500)])
        return pd.DataFrame({"source": [part["source"].iloc[0]], "n": [len(v)], "mean": [v.mean()], "low": [np.percentile(m, 2.5)], "high": [np.percentile(m, 97.5)]})

    x = table(s, d, "labels").join(_docs(s, d).select("doc_id", "source"), "doc_id")
    return x.select("source", "doc_id", "quality").groupBy("source").applyInPandas(run, "source string, n long, mean double, low double, high double")


# ---- service and streams
@query(f"WITH {KG_ALL}, ids AS ({SEEDS}), near AS (SELECT node FROM ids UNION SELECT dst FROM kg_edges WHERE src IN (SELECT node FROM ids)) SELECT DISTINCT src, rel, dst FROM kg_edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)")
def svc_subgraph(s, d):
    e = kg_edges(s, d)
    seeds = _seeds(e)
    near = seeds.unionByName(e.join(seeds, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))).distinct()
    return K.induced(e.select("src", "rel", "dst").distinct(), near)


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r=1")
def st_latest(s, d):
    return L.latest(table(s, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=1)")
def st_resume(s, d):
    return _docs(s, d).join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_anti").select("doc_id")
