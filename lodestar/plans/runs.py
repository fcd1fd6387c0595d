"""Queries of runs: graph retrieval with fallback, fusion, answers and judges, metric vectors, reports, samples and studies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import evaluation as E
from lodestar.operators import knowledge as K
from lodestar.operators import search as S
from lodestar.plans import intake  # noqa: F401  its SQL is used below
from lodestar.plans.catalogue import ADJ, BM, GOLD, KG_ALL, LEX, ORACLE_SQL, RRF, _bm25, _docs, _gold, _index, _lexical, _q, query
from lodestar.sources import tables as I
from lodestar.sources.storage import scratch, shared_dir
from lodestar.sources.tables import kg_edges, table
from lodestar.streaming import logs as L

# ---- graph retrieval
SEEDED = "sd AS (SELECT item_id AS qid, 'cust:'||c_custkey AS node, count(*) OVER (PARTITION BY item_id) AS n FROM benchmark JOIN customer ON c_custkey%40=item_id AND item_id%5<>0 WHERE 'cust:'||c_custkey IN (SELECT src FROM kg_edges))"
PPR = f"""{ADJ}, tot AS (SELECT src, sum(w) AS t FROM adj GROUP BY src), mv AS (SELECT a.src, a.dst, a.w/t AS p FROM adj a JOIN tot USING(src)), {SEEDED},
 pr AS (SELECT 0 AS i, qid, node, 1.0::DOUBLE/n AS m FROM sd UNION ALL SELECT i, qid, node, sum(m) FROM (SELECT pr.i+1 AS i, pr.qid, mv.dst AS node, 0.5*pr.m*mv.p AS m FROM pr JOIN mv ON mv.src=pr.node WHERE pr.i<10 UNION ALL SELECT x.i+1, sd.qid, sd.node, 0.5/sd.n FROM sd, (SELECT DISTINCT i FROM pr WHERE i<10) x) GROUP BY i, qid, node)"""
MENTIONED = "men AS (SELECT DISTINCT node, doc FROM (SELECT src AS node, split_part(chunk,':',1)::BIGINT%(SELECT count(*) FROM documents) AS doc FROM kg_edges UNION ALL SELECT dst, split_part(chunk,':',1)::BIGINT%(SELECT count(*) FROM documents) FROM kg_edges))"
TOP = lambda k, src: f"SELECT qid, doc, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, doc) AS rk FROM {src}) WHERE rk<={k}"
GRAPH = f"gs AS (SELECT qid, doc, sum(m) AS score FROM pr JOIN men USING(node) WHERE i=10 AND m>1e-9 GROUP BY 1,2), gr AS ({TOP(30, 'gs')})"
FALLEN = "cand AS (SELECT qid, doc, score, false AS fallback FROM gr UNION ALL SELECT qid, doc, score, true FROM bm WHERE rk<=30 AND qid NOT IN (SELECT qid FROM gr))"


def _seeded(s: SparkSession, d: str) -> DataFrame:
    """(qid, node, weight): customers that each question is linked to; every fifth question has none."""
    c = table(s, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("node"), (F.col("c_custkey") % 40).alias("qid"))
    held = kg_edges(s, d).select(F.col("src").alias("node")).distinct()
    return _q(s, d).select(F.col("item_id").alias("qid")).where("qid % 5 != 0").join(c, "qid").join(held, "node", "left_semi").withColumn("weight", F.lit(1.0))


def _graph(s: SparkSession, d: str) -> DataFrame:
    """(qid, doc, score, rk): documents by the mass of the nodes that they mention."""
    e = kg_edges(s, d)
    n = _docs(s, d).agg(F.count("*").alias("n"))
    ends = e.select(F.col("src").alias("node"), "chunk").unionAll(e.select("dst", "chunk")).join(n, F.lit(True))
    mentions = ends.select("node", (F.split_part("chunk", F.lit(":"), F.lit(1)).cast("long") % F.col("n")).alias("doc"))
    return scratch(S.top_k(K.walk_scores(K.adjacency(e), _seeded(s, d), mentions, rounds=10, tolerance=0), 30))


def _reranked(s: SparkSession, d: str, candidates: DataFrame, k: int = 8) -> DataFrame:
    return S.top_k(S.lexical_scores(candidates, _q(s, d), _index(s, d)).withColumnRenamed("s2", "score"), k)


RERANKED = lambda src, extra="": f"SELECT qid, doc, round(score,6) AS score, rk{extra} FROM (SELECT c.*, row_number() OVER (PARTITION BY qid ORDER BY round(score,9) DESC, doc) AS rk FROM (SELECT c.qid, c.doc{extra}, coalesce(l.score,0) AS score FROM {src} c LEFT JOIN lexs l USING(qid,doc)) c) WHERE rk<=8"


@query(f"WITH RECURSIVE {KG_ALL}, {PPR}, {MENTIONED}, {GRAPH}, {BM}, {LEX}, {FALLEN} {RERANKED('cand', ', fallback')}")
def ret_s2(s, d):
    """Page rank to documents, lexical search where a question has no seed, then the reranker."""
    g = _graph(s, d).select("qid", "doc", F.lit(False).alias("fallback"))
    rest = _bm25(s, d).where("rk <= 30").select("qid", "doc", F.lit(True).alias("fallback")).join(g.select("qid").distinct(), "qid", "left_anti")
    return _reranked(s, d, g.unionByName(rest)).select("qid", "doc", F.round("score", 6).alias("score"), "rk", "fallback")


@query(f"WITH RECURSIVE {KG_ALL}, {PPR}, {MENTIONED}, {GRAPH}, {BM}, {LEX}, fu AS ({TOP(30, '(SELECT qid, doc, sum(1.0/(60+rk)) AS score FROM (SELECT qid,doc,rk FROM bm UNION ALL SELECT qid,doc,rk FROM gr) GROUP BY 1,2)')}) {RERANKED('fu')}")
def ret_s4_graph(s, d):
    """Lexical and graph ranks fused, then the reranker; without seeds it is the lexical list."""
    fused = S.fuse(_bm25(s, d), _graph(s, d)).select("qid", "doc")
    return _reranked(s, d, fused).select("qid", "doc", F.round("score", 6).alias("score"), "rk")


@query("SELECT item_id AS qid, NULL::BIGINT AS doc, NULL::DOUBLE AS score, NULL::BIGINT AS rk FROM benchmark WHERE false")
def ret_s0(s, d):
    """The system that retrieves nothing."""
    return _q(s, d).select(F.col("item_id").alias("qid"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("rk")).where("false")


@query(f"WITH {BM}, {LEX}, l AS (SELECT qid, doc, score FROM bm UNION ALL SELECT qid, doc, score*10 FROM lex) {TOP(8, '(SELECT qid, doc, max(score) AS score FROM l GROUP BY 1,2)').replace('SELECT qid, doc, score, rk', 'SELECT qid, doc, round(score,6) AS score, rk')}")
def ret_merge_max(s, d):
    """Lists of a decomposed question merged by each document's best score."""
    lists = _bm25(s, d).select("qid", "doc", "score").unionByName(_lexical(s, d).select("qid", "doc", (F.col("score") * 10).alias("score")))
    return S.top_k(lists.groupBy("qid", "doc").agg(F.max("score").alias("score")), 8).select("qid", "doc", F.round("score", 6).alias("score"), "rk")


@query(f"WITH {BM}, {LEX}, l AS (SELECT DISTINCT qid, doc FROM (SELECT qid, doc FROM bm WHERE rk<=10 UNION ALL SELECT qid, doc FROM lex WHERE rk<=10)) {RERANKED('l')}")
def ret_merge_orig(s, d):
    """Lists of a decomposed question pooled and ranked by the whole question's score."""
    pool = _bm25(s, d).where("rk <= 10").select("qid", "doc").unionByName(_lexical(s, d).where("rk <= 10").select("qid", "doc")).distinct()
    return _reranked(s, d, pool).select("qid", "doc", F.round("score", 6).alias("score"), "rk")


# ---- answers and judges
@query("WITH c AS (SELECT conv_id, turn, CASE WHEN turn%3=0 THEN 'unsupported' WHEN role='user' THEN 'partial' ELSE 'supported' END AS v FROM conversations) SELECT conv_id, count(*) AS n, round(avg((v='unsupported')::INT),6) AS unsupported_rate, count_if(v<>'unsupported')::BIGINT AS kept, count_if(v<>'unsupported')=0 AS abstained FROM c GROUP BY 1")
def ans_verify(s, d):
    """Verdicts of answers' sentences: one without citations is unsupported whatever is said of it; an answer that keeps none abstains."""
    c = table(s, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 0, F.array()).otherwise(F.array(F.lit("c"))).alias("cites"), F.when(F.col("role") == "user", "partial").otherwise("supported").alias("said"))
    return E.verified_answers(c, "conv_id")


@query("SELECT event_id, CASE WHEN user_id%10=0 THEN CASE WHEN event_type='error' THEN 1.0 ELSE 0.0 END WHEN event_type='error' THEN 0.0 WHEN value/100<=0.25 THEN 0.0 WHEN value/100<=0.75 THEN 0.5 ELSE 1.0 END AS score, CASE WHEN user_id%10=0 THEN 0 ELSE 2 END AS n_facts, CASE WHEN user_id%10=0 OR event_type='error' THEN 0 ELSE (event_id%2)::INT END AS covered FROM events")
def ans_judge(s, d):
    """Scores of a judge snapped to 0, 0.5 and 1, unanswerable questions scored by abstention, one flag per key fact."""
    e = table(s, d, "events")
    flags = F.when(F.col("event_id") % 2 == 1, F.array(F.lit(True), F.lit(False), F.lit(False))).otherwise(F.array(F.lit(False)))
    x = e.select("event_id", E.judged(F.col("user_id") % 10 != 0, F.col("event_type") == "error", F.col("value") / 100, flags, F.when(F.col("user_id") % 10 == 0, 0).otherwise(2)).alias("j"))
    return x.select("event_id", "j.score", F.size("j.covered").alias("n_facts"), F.size(F.filter("j.covered", lambda c: c)).alias("covered"))


# ---- metric vectors and reports
SYSTEMS = f"sys AS (SELECT 'S1' AS system, qid, doc, rk FROM bm UNION ALL SELECT 'S2', qid, doc, rk FROM lex UNION ALL SELECT 'S3', qid, doc, rk FROM rrf)"
VECTOR = """gq AS (SELECT DISTINCT qid FROM gold), pairs AS (SELECT system, item_id AS qid, item_id IN (SELECT qid FROM gq) AS answerable FROM benchmark, (VALUES ('S1'),('S2'),('S3')) t(system)),
 hit AS (SELECT s.system, g.qid, count(*) FILTER (WHERE rk<=8) AS h8, count(*) FILTER (WHERE rk<=4) AS h4, count(*) FILTER (WHERE rk<=3) AS h3 FROM gold g JOIN sys s USING(qid,doc) GROUP BY 1,2), ng AS (SELECT qid, count(*) AS n FROM gold GROUP BY 1), nc AS (SELECT system, qid, count(*) FILTER (WHERE rk<=3) AS cited FROM sys GROUP BY 1,2),
 vec AS (SELECT p.system, p.qid, CASE WHEN answerable THEN coalesce(h8,0)/n END AS recall8, CASE WHEN answerable THEN coalesce(h4,0)/n END AS recall4, CASE WHEN answerable THEN CASE WHEN coalesce(h8,0)=n THEN 1.0 ELSE 0.0 END END AS complete8, CASE WHEN answerable AND cited>0 THEN coalesce(h3,0)/cited END AS citation_precision, CASE WHEN answerable AND cited>0 THEN coalesce(h3,0)/n END AS citation_recall
 FROM pairs p LEFT JOIN hit USING(system,qid) LEFT JOIN ng USING(qid) LEFT JOIN nc USING(system,qid))"""
NAMES = ("recall8", "recall4", "complete8", "citation_precision", "citation_recall")


def _systems(s: SparkSession, d: str) -> DataFrame:
    bm, lex = _bm25(s, d), _lexical(s, d)
    lists = {"S1": bm, "S2": lex, "S3": S.fuse(bm, lex)}
    out = None
    for name, x in lists.items():
        x = x.select(F.lit(name).alias("system"), "qid", "doc", "rk")
        out = x if out is None else out.unionByName(x)
    return out


def _vector(s: SparkSession, d: str) -> DataFrame:
    return E.metric_vectors(_systems(s, d), _gold(s, d), _q(s, d).select(F.col("item_id").alias("qid")), ["S1", "S2", "S3"])


@query(f"WITH {BM}, {LEX}, {RRF}, {GOLD}, {SYSTEMS}, {VECTOR} SELECT system, qid, " + ", ".join(f"round({n},6) AS {n}" for n in NAMES) + " FROM vec")
def m_vector(s, d):
    return _vector(s, d).select("system", "qid", *[F.round(n, 6).alias(n) for n in NAMES])


LONG = " UNION ALL ".join(f"SELECT system, qid, '{n}' AS metric, {n}::DOUBLE AS v FROM vec" for n in NAMES)


@query(f"WITH {BM}, {LEX}, {RRF}, {GOLD}, {SYSTEMS}, {VECTOR} SELECT system, metric, round(avg(v),6) AS mean, count(v) AS n FROM ({LONG}) GROUP BY 1,2")
def m_table(s, d):
    """The report's table: mean and number of questions for each system and metric."""
    return E.report_table(_vector(s, d), NAMES).select("system", "metric", F.round("mean", 6).alias("mean"), "n")


SIGN = "CASE WHEN substr(md5('13|'||b||'|'||qid),1,1)<'8' THEN diff ELSE -diff END"


@query(f"WITH {BM}, {LEX}, {RRF}, {GOLD}, {SYSTEMS}, {VECTOR}, l AS ({LONG}), pr AS (SELECT a.system, a.metric, a.qid, a.v-b.v AS diff FROM l a JOIN l b ON b.system='S1' AND a.system<>'S1' AND a.metric=b.metric AND a.qid=b.qid WHERE a.v IS NOT NULL AND b.v IS NOT NULL), o AS (SELECT system, metric, count(*) AS n, avg(diff) AS diff FROM pr GROUP BY 1,2 HAVING count(*)>=3), bs AS (SELECT system, metric, b, avg({SIGN}) AS m FROM pr, range(1,201) t(b) GROUP BY 1,2,3), p AS (SELECT o.system, o.metric, any_value(o.n) AS n, any_value(o.diff) AS diff, (count_if(abs(m)>=abs(o.diff)-1e-12)+1)/201 AS p FROM o JOIN bs USING(system,metric) GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, system) AS r, count(*) OVER (PARTITION BY metric) AS k FROM p) SELECT system, metric, n, round(diff,6) AS diff, round(p,6) AS p, round(max(least(1.0,(k-r+1)*p)) OVER (PARTITION BY metric ORDER BY p, system ROWS UNBOUNDED PRECEDING),6) AS p_holm FROM r")
def m_paired_tests(s, d):
    """Each system against the first on the questions that both have a value for, corrected within each metric."""
    x = E.paired_tests(E.long_metrics(_vector(s, d), NAMES), "S1")
    return x.select("system", "metric", "n", *[F.round(c, 6).alias(c) for c in ("diff", "p", "p_holm")])


@query("SELECT kind, count(*) AS n, round(avg(quality),6) AS mean FROM (SELECT unnest(list_concat(['all'], CASE WHEN toxic=1 THEN ['toxic'] ELSE ['clean'] END, ['lang '||lang])) AS kind, quality FROM labels JOIN documents USING(doc_id)) GROUP BY 1")
def m_subsets(s, d):
    x = table(s, d, "labels").join(_docs(s, d).select("doc_id", "lang"), "doc_id")
    kinds = F.array(F.lit("all"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"), F.concat(F.lit("lang "), F.col("lang")))
    return x.select(F.explode(kinds).alias("kind"), "quality").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"))


@query("SELECT coalesce(lang,'total') AS verified_by, count(*) AS total, count_if(quality=1 AND toxic=0)::BIGINT AS verified, count_if(quality=1)::BIGINT AS screened FROM labels JOIN documents USING(doc_id) GROUP BY ROLLUP(lang)")
def m_provenance(s, d):
    x = table(s, d, "labels").join(_docs(s, d).select("doc_id", "lang"), "doc_id")
    return x.rollup("lang").agg(F.count("*").alias("total"), F.count_if(F.expr("quality = 1 and toxic = 0")).alias("verified"), F.count_if(F.expr("quality = 1")).alias("screened")).select(F.coalesce("lang", F.lit("total")).alias("verified_by"), "total", "verified", "screened")


@query("SELECT metric, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, count(v) AS n FROM (SELECT event_type AS metric, user_id%3 AS seed, avg(value) AS v FROM events GROUP BY 1,2) GROUP BY 1")
def gnn_over_seeds(s, d):
    x = table(s, d, "events").groupBy(F.col("event_type").alias("metric"), F.col("user_id") % 3).agg(F.avg("value").alias("v"))
    return E.over_seeds(x, "metric", "v").select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("WITH x AS (SELECT o_custkey AS pair, avg(o_totalprice) FILTER (WHERE o_orderstatus='F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus='O') AS b FROM orders GROUP BY 1) SELECT count(*) AS n, round(avg(round(a-b,2)),2) AS mean_cost FROM x WHERE a IS NOT NULL AND b IS NOT NULL".replace("round(avg(round(a-b,2)),2)", "round(avg((a-b>0)::INT),6)"))
def bridge_hop_cost(s, d):
    """Pairs that have both twins, and the share for which the direct one does better."""
    o = table(s, d, "orders")
    side = lambda v: o.where(F.col("o_orderstatus") == v).groupBy(F.col("o_custkey").alias("pair")).agg(F.avg("o_totalprice").alias("v"))
    x = E.twins(side("F"), side("O"), "pair", "v")
    return x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("cost") > 0).cast("int")), 6).alias("mean_cost"))


@query(f"WITH {BM}, {GOLD}, m AS (SELECT qid, doc FROM gold WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.qid=gold.qid AND bm.doc=gold.doc AND rk<=1)), r AS (SELECT h.qid, 'source' AS route, d2.doc_id AS doc FROM (SELECT qid, doc FROM bm WHERE rk<=3) h JOIN documents d1 ON d1.doc_id=h.doc JOIN documents d2 ON d2.source=d1.source AND d2.lang=d1.lang UNION SELECT h.qid, 'next', d2.doc_id FROM (SELECT qid, doc FROM bm WHERE rk<=3) h JOIN documents d2 ON abs(d2.doc_id-h.doc)=1), p AS (SELECT route, median(n) AS pool FROM (SELECT route, qid, count(*) AS n FROM r GROUP BY 1,2) GROUP BY 1) SELECT route, count(*) AS misses, round(avg((r.doc IS NOT NULL)::INT),6) AS reach, any_value(pool) AS pool FROM (SELECT m.qid, m.doc, p.route, p.pool FROM m, p) x LEFT JOIN r USING(route,qid,doc) GROUP BY route")
def m_reach(s, d):
    """How many misses each way of expanding the first three would reach, and how large a pool that takes."""
    ranked, docs = _bm25(s, d), _docs(s, d).select(F.col("doc_id").alias("doc"), "source", "lang")
    head = ranked.where("rk <= 3").select("qid", "doc")
    source = head.join(docs, "doc").select("qid", "source", "lang").join(docs, ["source", "lang"]).select("qid", F.lit("source").alias("route"), "doc")
    beside = head.select("qid", F.explode(F.array(F.col("doc") - 1, F.col("doc") + 1)).alias("doc")).join(docs.select("doc"), "doc", "left_semi").select("qid", F.lit("next").alias("route"), "doc")
    misses = _gold(s, d).join(ranked.where("rk <= 1").select("qid", "doc"), ["qid", "doc"], "left_anti")
    return E.reach(misses, source.unionByName(beside).distinct()).select("route", "misses", F.round("reach", 6).alias("reach"), "pool")


@query("SELECT event_type, count(*) AS n, round(count(*)/86400.0/31,9) AS per_s, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, round(max(value),6) AS max, round(avg((user_id%3=0)::INT),6) AS hit_rate FROM events WHERE value IS NOT NULL GROUP BY 1")
def st_load_cells(s, d):
    return E.load_cells(table(s, d, "events"), "event_type", "value", F.col("user_id") % 3 == 0, 86400.0 * 31).select("event_type", "n", F.round("per_s", 9).alias("per_s"), *[F.round(c, 6).alias(c) for c in ("p50", "p95", "max", "hit_rate")])


# ---- samples and orders
H = lambda k: f"md5('13|'||{k})"


@query(f"SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {H('o_orderkey')}, o_orderkey) AS c FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY {H('o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r=1) WHERE c<=2")
def win_source_cap(s, d):
    """One candidate for each pair of ends, two for each source."""
    return E.cap_pairs(table(s, d, "orders"), "o_orderkey", "o_custkey", "o_orderpriority", 2).select("o_orderkey", "o_custkey", "o_orderpriority")


@query(f"SELECT doc_id, CASE WHEN r<=round_even(n/3.0,0) THEN 'dev' ELSE 'heldout' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def win_label_split(s, d):
    x = E.stratified_split(table(s, d, "labels"), "doc_id", "quality", 1 / 3)
    return x.select("doc_id", F.when(F.col("split") == "dev", "dev").otherwise("heldout").alias("part"))


@query(f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {H('o_orderkey')}, o_orderkey) AS one FROM orders WHERE o_totalprice>=1000), k AS (SELECT *, o_orderstatus='F' AS cue FROM c WHERE one=1), r AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY {H('o_orderkey')}, o_orderkey) AS r FROM k) SELECT o_orderkey, cue FROM r WHERE r<=25")
def win_gold_sample(s, d):
    """50 rows to label: half with a cue, half without, one a customer: a sampling operator."""
    x = table(s, d, "orders").where("o_totalprice >= 1000").withColumn("cue", F.col("o_orderstatus") == "F")
    return E.gold_sample(x, "o_orderkey", "o_custkey", "cue", 25).select("o_orderkey", "cue")


@query("SELECT quality, min(doc_id) AS doc_id FROM labels GROUP BY 1")
def win_first_examples(s, d):
    return E.first_of_each(table(s, d, "labels"), "quality", "doc_id").select("quality", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY quality DESC, toxic DESC, doc_id) AS place FROM labels")
def win_review_order(s, d):
    """The order in which questions are looked through: those that passed, of several articles first, then by id."""
    return E.places(table(s, d, "labels"), [F.col("quality").desc(), F.col("toxic").desc(), F.col("doc_id")]).select("doc_id", "place")


@query("WITH x AS (SELECT event_type||':'||(user_id%5) AS config, round(avg(value),6) AS recall, max(value) AS latency FROM events GROUP BY 1), b AS (SELECT * FROM x WHERE config='click:0') SELECT config, round(recall,6) AS recall, 'best' AS why FROM (SELECT * FROM x WHERE recall>(SELECT recall FROM b) ORDER BY recall DESC, latency, config LIMIT 1) UNION ALL SELECT config, round(recall,6), 'fast' FROM (SELECT * FROM x WHERE latency<=1.1*(SELECT latency FROM b) AND recall>(SELECT recall FROM b) ORDER BY recall DESC, latency, config LIMIT 1)")
def bench_finalists(s, d):
    """The configuration that beats the baseline most, and the one that does so at no more than 1.1 of its latency."""
    x = table(s, d, "events").groupBy(F.concat_ws(":", "event_type", F.col("user_id") % 5).alias("config")).agg(F.round(F.avg("value"), 6).alias("recall"), F.max("value").alias("latency"))
    return E.finalists(x, "click:0").select("config", F.round("recall", 6).alias("recall"), "why")


@query("SELECT pool, round(sum(CASE WHEN rank<=pool THEN value ELSE 0 END),6) AS seconds FROM (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events), (VALUES (30),(50),(100)) p(pool) GROUP BY 1".replace("round(sum(CASE WHEN rank<=pool THEN value ELSE 0 END),6)", "sum(CASE WHEN rank<=pool THEN round(value*100)::BIGINT ELSE 0 END)::BIGINT"))
def bench_latency_slices(s, d):
    """Hundredths of a second that reranking the first 30, 50 and 100 of each list takes."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    x = table(s, d, "events").select(r.alias("rank"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return E.latency_slices(x, "rank", "v", (30, 50, 100))


@query("SELECT conv_id, round(ln(sum(exp(s)))-max(CASE WHEN turn=0 THEN s END),6) AS loss FROM (SELECT conv_id, turn, length(text)%50/10.0::DOUBLE AS s FROM conversations) GROUP BY 1 HAVING count(*) FILTER (WHERE turn=0)>0")
def ret_listwise_loss(s, d):
    c = table(s, d, "conversations").select("conv_id", (F.length("text") % 50 / 10.0).alias("s"), (F.col("turn") == 0).alias("positive"))
    return E.listwise_loss(c, "conv_id", "s", "positive").select("conv_id", F.round("loss", 6).alias("loss"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN substr(md5('13|'||l_orderkey||'|'||l_linenumber),1,2)<'34' THEN 'test' ELSE 'train' END AS part FROM lineitem")
def gnn_random_split(s, d):
    """A fifth of the links held out by a hash, whatever their articles."""
    key = F.concat_ws("|", "l_orderkey", "l_linenumber")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", E.random_part(key, 52).alias("part"))


# ---- streams
@query(ORACLE_SQL["st_latency_window"])
def st_latency_stream(s, d):
    """The latency windows of the event log read as a stream."""
    return L.drained(L.latency_windows(L.read_table_log(s, d, "events")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")
def st_latest_stream(s, d):
    return L.drained(L.latest_stream(L.read_table_log(s, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"])).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, n_chars*2 AS twice FROM documents")
def st_resume_stream(s, d):
    """Documents worked through as a stream, run twice: the second run finds nothing left to do."""
    at = f"{shared_dir(s)}/resume-{uuid.uuid4().hex}"
    for _ in range(2):
        L.append_once(L.read_table_log(s, d, "documents").select("doc_id", "n_chars"), f"{at}/out", f"{at}/state", "doc_id", lambda b: b.select("doc_id", (F.col("n_chars") * 2).alias("twice"))).awaitTermination()
    return s.read.parquet(f"{at}/out").select("doc_id", "twice")


@query(ORACLE_SQL["st_cache_counters"])
def st_cache_stream(s, d):
    request = F.to_json(F.struct(F.concat(F.lit("m"), F.col("turn") % 2).alias("model"), F.col("role").alias("text")))
    return L.drained(I.cache_counters(L.read_table_log(s, d, "conversations").select(I.cache_key(request).alias("cache_key"))))
