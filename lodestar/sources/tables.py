"""Readers and writers with explicit schemas, and the views that queries bind to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lodestar.functions.text import model_slug

_s = lambda *names: [StructField(n, StringType()) for n in names]
CHUNKS = StructType([*_s("chunk_id", "article_id"), StructField("section_idx", LongType()), StructField("chunk_idx", LongType()), *_s("heading", "text"), StructField("char_start", LongType()), StructField("char_end", LongType()), StructField("n_tokens", LongType())])
LINKS = StructType(_s("src_article", "dst_article", "anchor", "sentence", "src_chunk_id"))
NODES = StructType(_s("node_id", "label", "canonical_text", "props_json"))
EDGES = StructType([*_s("edge_id", "src", "rel", "dst"), StructField("source_chunk_ids", ArrayType(StringType())), *_s("extraction_model"), StructField("extraction_confidence", DoubleType()), *_s("extracted_at", "origin"), StructField("n_support", LongType())])
MENTIONS = StructType(_s("node_id", "chunk_id", "surface"))
VERDICTS = StructType([*_s("edge_id", "chunk_id"), StructField("llm_supported", BooleanType()), *_s("quote"), StructField("quote_score", DoubleType()), StructField("supported", BooleanType()), *_s("error")])
_UNITS = ArrayType(StructType(_s("kind", "text")))
_SECTIONS = ArrayType(StructType([*_s("heading"), StructField("level", LongType()), StructField("units", _UNITS)]))
_list = lambda *names: [StructField(n, ArrayType(StringType())) for n in names]
_flag = lambda *names: [StructField(n, BooleanType()) for n in names]
#: Articles as they are stored: sections as JSON.
ARTICLES = StructType([*_s("article_id", "url", "title", "summary"), *_list("product_tags", "os_versions_mentioned"), *_s("last_updated", "sections_json")])
SCREEN = StructType([*_flag("passed"), *_s("reason"), *_flag("answerable", "answer_supported", "leaks_answer"), *_s("support_quote"), *_flag("quote_found", "needs_multiple_articles"), *_s("model")])
QUESTIONS = StructType([*_s("qid", "question", "qtype"), *_flag("answerable"), *_s("gold_answer"), *_list("key_facts", "gold_chunk_ids", "gold_seed_nodes", "gold_answer_nodes"), *_s("source", "split"), *_flag("verified"), *_s("verified_by"), StructField("screen", SCREEN)])
SENTENCES = ArrayType(StructType([*_s("text"), *_list("citations")]))
ANSWERS = StructType([*_s("qid", "system"), StructField("answer", StructType([*_s("question"), *_flag("abstained"), StructField("sentences", SENTENCES), *_list("context_chunk_ids"), StructField("latency_s", DoubleType())]))])
JUDGED = StructType([*_s("qid", "system"), StructField("judge", StructType([StructField("score", DoubleType()), StructField("key_facts_covered", ArrayType(BooleanType()))]))])
GOLD = StructType([*_s("chunk_id", "type", "text"), StructField("ord", LongType()), *_s("annotator", "status")])
LABELS = StructType([*_s("qid", "system"), StructField("score", DoubleType()), *_s("labeler")])
SCHEMAS = {"articles": ARTICLES, "questions": QUESTIONS, "answers": ANSWERS, "judged": JUDGED, "gold": GOLD, "judge_labels": LABELS, "chunks": CHUNKS, "links": LINKS, "nodes": NODES, "edges": EDGES, "mentions": MENTIONS, "verdicts": VERDICTS}


def read(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """A table of a known kind; JSON lines fail on rows that don't fit."""
    reader = spark.read.schema(SCHEMAS[kind])
    return reader.option("mode", "FAILFAST").json(path) if fmt == "json" else reader.parquet(path)


def read_or_empty(spark: SparkSession, path: str, kind: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(spark, path, kind) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else spark.createDataFrame([], SCHEMAS[kind])


def write(df: DataFrame, path: str, kind: str, fmt: str = "parquet") -> None:
    df.select(*SCHEMAS[kind].names).write.mode("overwrite").format(fmt).save(path)


def pages_from_folder(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, html) of a folder of HTML files named by id."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html?$", 1).alias("article_id"), F.col("value").alias("html"))


def write_articles(arts: DataFrame, path: str) -> None:
    """articles (with sections as rows) as the stored table."""
    write(arts.withColumn("sections_json", F.to_json("sections")), path, "articles")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its sections as rows again."""
    return read(spark, path, "articles").withColumn("sections", F.from_json("sections_json", _SECTIONS)).drop("sections_json")


def load_run(spark: SparkSession, answers: str, judged: str) -> DataFrame:
    """(qid, system, text, abstained, score) of a run: its answers' sentences in one text, joined to their scores."""
    a = read(spark, answers, "answers", "json").select("qid", "system", F.concat_ws(" ", F.transform("answer.sentences", lambda x: x["text"])).alias("text"), "answer.abstained")
    return a.join(read(spark, judged, "judged", "json").select("qid", "system", "judge.score"), ["qid", "system"], "left")


def output_path(root: Column, model: Column, prompt: Column) -> Column:
    """Where the output of a model and prompt version belongs."""
    return F.concat(root, F.lit("/model="), model_slug(model), F.lit("/prompt="), prompt)


def fetch_plan(urls: DataFrame, rules: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, url, status) of (id, url): ``disallowed`` by the longest robots rule for its path, ``cached`` already, or to ``fetch``.

    rules: (agent, prefix, allow), a site's few lines; without a rule a path is allowed.
    """
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)?", 1)
    u = urls.withColumn("path", F.when(path == "", "/").otherwise(path))
    r = rules.agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("rules"))
    u = u.join(r, F.lit(True))
    best = F.array_max(F.filter("rules", lambda x: F.startswith(F.col("path"), x["prefix"])))
    u = u.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "path")
    u = u.join(cached.select("id", F.lit(True).alias("held")), "id", "left")
    return u.withColumn("status", F.when(~F.col("allowed"), "disallowed").when(F.col("held"), "cached").otherwise("fetch")).drop("allowed", "held")


def cache_key(request: Column) -> Column:
    """The digest of a request's canonical JSON."""
    return F.sha2(F.encode(request, "UTF-8"), 256)


def cache_get(asked: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their replies, requests without one) by cache_key."""
    return asked.join(held.select("cache_key", "reply"), "cache_key"), asked.join(held, "cache_key", "left_anti")


def cache_put(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """(cache_key, reply, seq): the latest reply of each key."""
    every = held.select("cache_key", "reply", "seq").unionByName(fresh.select("cache_key", "reply", "seq"))
    return every.groupBy("cache_key").agg(F.max_by("reply", "seq").alias("reply"), F.max("seq").alias("seq"))


def cache_counters(requests: DataFrame) -> DataFrame:
    """(cache_key, requests, hits) of a log of requests, also as a stream."""
    return requests.groupBy("cache_key").agg(F.count("*").alias("requests"), (F.count("*") - 1).alias("hits"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as typed edges from customers to parts, with provenance."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    rel = F.when(flag == "A", "RESOLVED_BY").when(flag == "N", "CAUSED_BY").otherwise("EXHIBITS")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("cust:"), "o_custkey").alias("src"), rel.alias("rel"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.round(1 - F.col("l_discount"), 3).alias("conf"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", F.lit("0")).alias("chunk"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"), F.concat(F.lit("supp"), F.col("l_suppkey") % 4).alias("model"),
    )


def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "cust", "c_custkey", "Symptom", "c_name"), ("part", "part", "p_partkey", "Fix", "p_name"), ("supplier", "supp", "s_suppkey", "Cause", "s_name"), ("nation", "nation", "n_nationkey", "Component", "n_name"), ("region", "region", "r_regionkey", "ProductFamily", "r_name")]
    out = None
    for name, prefix, key, label, text in parts:
        d = table(spark, sf_dir, name).select(F.concat(F.lit(prefix + ":"), key).alias("node_id"), F.lit(label).alias("label"), F.col(text).alias("text"))
        out = d if out is None else out.unionByName(d)
    return out
