"""BM25, dense search, rank fusion, reranking and combinations, all per query as windows over long tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import search_tokens
from lodestar.sources.storage import scratch, shared_dir, ship_package


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dl, x array of (term, tf)): one row per document with tokens. They are counted where they are; only rows of a repeated id are shuffled."""
    again = docs.groupBy(F.col(id_col).alias("doc")).agg(F.count("*").alias("k")).where("k > 1").select("doc")
    tokens = docs.select(F.col(id_col).alias("doc"), F.sort_array(search_tokens(F.col(text_col))).alias("t"))
    if again.isEmpty():
        return _counted(tokens)
    same = tokens["doc"].eqNullSafe(again["doc"])
    more = flat(_counted(tokens.join(again, same, "left_semi"))).groupBy("doc", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    more = more.groupBy("doc").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("x"))
    return _counted(tokens.join(again, same, "left_anti")).unionByName(more)


def _counted(tokens: DataFrame) -> DataFrame:
    """(doc, dl, x) of (doc, sorted tokens t), row by row: a term stands where the token differs from the one before."""
    n = F.size("t")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    d = tokens.select("doc", n.alias("dl"), "t", F.when(n > 0, starts).alias("at"))
    return d.select("doc", "dl", F.transform("at", lambda i, k: F.struct(F.get("t", i - 1).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("dl") + 1) - i).cast("long").alias("tf"))).alias("x"))


def flat(p: DataFrame) -> DataFrame:
    """(doc, term, tf, dl) of (doc, dl, x). The outer explode lets no filter on x down to where it is made, which would make it twice."""
    return p.select("doc", F.explode_outer("x").alias("x"), "dl").select("doc", "x.term", "x.tf", "dl").where("term is not null")


def average_length(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents and avgdl (1 for none)."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size(search_tokens(F.col(text_col)))), F.lit(1.0)).alias("avgdl"))


class Index(NamedTuple):
    """A stored search index: postings (doc, dl, x array of (term, tf)) by document and one row of lengths (n_docs, avgdl)."""

    documents: DataFrame
    lengths: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(doc, term, tf, dl)."""
        return flat(self.documents)


_INDEXES: dict[tuple, Index] = {}


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of documents: texts are tokenised once, whatever is asked later."""
    postings(docs, id_col, text_col).write.mode("overwrite").parquet(f"{path}/postings")
    held = docs.sparkSession.read.parquet(f"{path}/postings")
    tokens = held.agg(F.coalesce(F.sum(F.aggregate("x.tf", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("tokens"))
    counts = docs.agg(F.count("*").alias("n_docs"), F.count(text_col).alias("texts")).join(F.broadcast(tokens), F.lit(True))
    lengths = counts.select("n_docs", F.coalesce(F.try_divide(F.col("tokens"), F.col("texts")), F.lit(1.0)).alias("avgdl"))
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/lengths")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths")))


def index_of(spark: SparkSession, table_path: str) -> Index:
    """The index of a documents table, built in the shared folder when first asked for and again when its files change."""
    docs = spark.read.parquet(table_path)
    hadoop, stamps = spark._jsc.hadoopConfiguration(), []
    for f in docs.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        stamps.append((f, p.getFileSystem(hadoop).getFileStatus(p).getModificationTime()))
    key = (spark.sparkContext.applicationId, table_path, tuple(sorted(stamps)))
    if key not in _INDEXES:
        at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        build_index(docs, at)
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(hadoop).deleteOnExit(p)
        _INDEXES[key] = open_index(spark, at)
    return _INDEXES[key]


def idf(p: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs.select("n_docs")), how="inner", on=F.lit(True)).select("term", "df", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def weights(p: DataFrame, lengths: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, term, w): BM25 weights. lengths is one row."""
    w = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return p.join(F.broadcast(lengths.select("avgdl")), F.lit(True)).select("doc", "term", w.alias("w"))


def query_terms(queries: DataFrame, qid: str = "item_id", qtext: str = "text") -> DataFrame:
    """(qid, n, term): the distinct terms of each query and their number."""
    t = queries.select(F.col(qid).alias("qid"), F.array_distinct(search_tokens(F.col(qtext))).alias("t"))
    return t.select("qid", F.size("t").alias("n"), F.explode("t").alias("term"))


#: So many (document, query) pairs a worker scores at a time, and so many rows of (query, term) go to the workers.
PAIRS, MOST_TERMS = 1 << 21, 2_000_000


def _scan(q: pd.DataFrame, qid: np.ndarray, top: int, k1: float, b: float, avgdl: float | None):
    """The ``top`` documents of each query among a task's documents. q: (at, term, weight), ``at`` being the query's place in qid.

    With avgdl the weight is multiplied by the term's BM25 weight in the document.
    """
    terms, code = np.unique(q["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
    order = np.argsort(code, kind="stable")
    at, weight = q["at"].to_numpy()[order], q["weight"].to_numpy(dtype=float)[order]
    first = np.searchsorted(code[order], np.arange(len(terms) + 1))
    asked, n = pa.array(terms, pa.string()), len(qid)

    def cut(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["q", "r", "doc"], ascending=[True, False, True], na_position="first")
        return d[d.groupby("q").cumcount() < top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least, kind = None, np.full(n, -np.inf), None
        for batch in batches:
            kind = batch.schema.field("doc").type
            step = max(1, PAIRS // max(n, 1))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                x = pc.fill_null(part.column("x"), pa.scalar([], part.column("x").type))
                rows, x = pc.list_parent_indices(x).to_numpy(zero_copy_only=False), pc.list_flatten(x)
                found = pc.index_in(x.field("term"), value_set=asked)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                rows, c = rows[hit], found.drop_null().to_numpy(zero_copy_only=False)
                if not len(c):
                    continue
                w = np.ones(len(c))
                if avgdl is not None:
                    tf, dl = x.field("tf").to_numpy(zero_copy_only=False)[hit], part.column("dl").to_numpy(zero_copy_only=False)[rows]
                    w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                each = first[c + 1] - first[c]
                place = np.repeat(first[c] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
                key = np.repeat(rows, each) * n + at[place]
                score = np.bincount(key, np.repeat(w, each) * weight[place], len(part) * n)
                got = np.unique(key) if len(key) < len(score) // 8 else np.flatnonzero(np.bincount(key, minlength=len(score)))
                r = np.floor(score[got] * 1e9 + 0.5)
                got, r = got[r >= least[got % n]], r[r >= least[got % n]]
                if not len(got):
                    continue
                docs = part.column("doc").take(pa.array(got // n)).to_pandas()
                d = cut(pd.DataFrame({"q": got % n, "r": r, "doc": docs.to_numpy(), "score": score[got]}))
                best = d if best is None else cut(pd.concat([best, d]))
                full = best.groupby("q")["r"].agg(["size", "min"])
                full = full[full["size"] >= top]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(qid[best["q"].to_numpy()]), pa.array(best["doc"].to_numpy(), kind), pa.array(best["score"].to_numpy(dtype=float))], ["qid", "doc", "score"])

    return run


def _ranked(q: DataFrame, index: Index, top: int, k1: float = 1.2, b: float = 0.75, avgdl: float | None = None) -> DataFrame:
    """(qid, doc, score, rk) for (qid, term, weight): every document is scored where it is stored, and a task yields its ``top`` of each query."""
    spark = index.documents.sparkSession
    ship_package(spark)
    asked = q.where("term is not null").toPandas()
    qid, at = np.unique(asked["qid"].to_numpy(), return_inverse=True)
    asked["at"] = at
    kinds = [q.schema["qid"].dataType.simpleString(), index.documents.schema["doc"].dataType.simpleString()]
    found = index.documents.select("doc", "dl", "x").mapInArrow(_scan(asked[["at", "term", "weight"]], qid, top, k1, b, avgdl), f"qid {kinds[0]}, doc {kinds[1]}, score double")
    return scratch(top_k(found, top))


def bm25(queries: DataFrame, index: Index, qid: str = "item_id", qtext: str = "text", top: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc, score, rk): the best documents of each query.

    Documents stay where they are stored and meet the queries' terms, which go to every worker; queries of more than
    ``MOST_TERMS`` terms are joined by term instead.
    """
    q = query_terms(queries, qid, qtext).drop("n")
    few = q.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    terms = q.select("term").distinct()
    p = index.postings.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    rare = idf(p, index.lengths).select("term", "idf")
    if few:
        return _ranked(q.join(scratch(rare), "term").select("qid", "term", F.col("idf").alias("weight")), index, top, k1, b, index.lengths.first()["avgdl"])
    scored = weights(p, index.lengths, k1, b).join(rare, "term").join(q, "term")
    return top_k(scored.groupBy("qid", "doc").agg(F.sum(F.col("w") * F.col("idf")).alias("score")), top)


def lexical(queries: DataFrame, index: Index, qid: str = "item_id", qtext: str = "text", top: int = 50) -> DataFrame:
    """(qid, doc, score, rk) by the share of the query's distinct terms that the document has."""
    q = query_terms(queries, qid, qtext)
    if q.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        n = q.groupBy("qid").agg(F.first("n").alias("n"))
        shares = _ranked(q.select("qid", "term", F.lit(1.0).alias("weight")), index, top).join(n, "qid")
        return shares.select("qid", "doc", (F.col("score") / F.greatest("n", F.lit(1))).alias("score"), "rk")
    hits = index.postings.join(q, "term").groupBy("qid", "doc").agg((F.count("*") / F.greatest(F.first("n"), F.lit(1))).alias("score"))
    return top_k(hits, top)


def lexical_scores(ranked: DataFrame, queries: DataFrame, index: Index, qid: str = "item_id", qtext: str = "text") -> DataFrame:
    """ranked with s2, the share of the query's distinct terms that the document has; read from the ranked documents' postings, never from texts."""
    asked = ranked.select("qid", "doc").join(query_terms(queries, qid, qtext), "qid")
    own = flat(index.documents.join(ranked.select("doc").distinct(), "doc", "left_semi"))
    hit = asked.join(own.select("doc", "term"), ["doc", "term"]).groupBy("qid", "doc").agg((F.count("*") / F.first("n")).alias("s2"))
    return ranked.join(hit, ["qid", "doc"], "left").fillna({"s2": 0.0})


#: A word for finding where a text may stand: between its first and last word, words of the text are words of what holds it.
PLAIN_WORD = r"[\p{L}\p{N}]+"


def containing(queries: DataFrame, docs: DataFrame, qid: str = "item_id", qtext: str = "text", doc: str = "doc_id", text: str = "text", most: int = 100_000) -> DataFrame:
    """(qid, doc) of the documents whose text holds the query's text.

    Documents are looked up by the longest inner word of the query and then compared; only a query
    without an inner word, of two words or fewer, is compared with every document. Up to ``most`` queries go to the
    documents, and texts stay where they are; more are joined by word.
    """
    words = F.regexp_extract_all(F.col(qtext), F.lit(PLAIN_WORD), F.lit(0))
    longest = F.array_max(F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("q"), longest.alias("word"))
    few = q.limit(most + 1).count() <= most
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    held = d.select("doc", *(["text"] if few else []), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLAIN_WORD), F.lit(0)))).alias("word"))
    long = q.where("word is not null")
    pairs = held.join(F.broadcast(long), "word") if few else held.join(long, "word").select("qid", "doc", "q").join(d, "doc")
    short = q.where("word is null").select("qid", "q").join(d, F.contains("text", F.col("q"))).select("qid", "doc")
    return pairs.where(F.contains("text", F.col("q"))).select("qid", "doc").unionByName(short)


def top_k(scored: DataFrame, k: int, by: str = "score", group: str = "qid", tie: str = "doc") -> DataFrame:
    """The k largest per group, ties by id, with their rank."""
    w = Window.partitionBy(group).orderBy(F.round(by, 9).desc(), F.col(tie).asc())
    return scored.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


def _best(k: int):
    """The k nearest vectors of a block for each query of a block; ties by id."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asked = part["asked"].to_numpy()
        ids, x = part["id"].to_numpy(), np.array(part["vec"].tolist(), dtype=np.float64).reshape(len(part), -1)
        length = np.linalg.norm(x, axis=1)
        x = x / np.where(length > 0, length, 1.0)[:, None]
        q, v = np.flatnonzero(asked), np.flatnonzero(~asked)
        v = v[np.argsort(ids[v], kind="stable")]
        out = []
        for i in q:
            if length[i] == 0 or not len(v):
                continue
            score = x[v] @ x[i]
            ok = (ids[v] != ids[i]) & (length[v] > 0)
            order = np.argsort(-np.round(score, 9), kind="stable")
            order = order[ok[order]][:k]
            out.append(pd.DataFrame({"qid": ids[i], "doc": ids[v[order]], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "doc": [], "score": []}).astype({"qid": "int64", "doc": "int64", "score": "float64"})

    return run


def dense(queries: DataFrame, vectors: DataFrame, top: int = 50, block: int = 2048) -> DataFrame:
    """(qid, doc, score, rk) by exact cosine: a stated set of queries against all vectors, block by block.

    A pair of blocks is one task's product and yields ``top`` rows a query at most, so memory is bounded
    whatever the numbers. Null and zero vectors are near nothing.
    """
    ship_package(vectors.sparkSession)
    queries, vectors = queries.where("qid is not null and qvec is not null"), vectors.where("doc is not null and vec is not null")
    nq, nv = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // block))
    q = queries.select(F.lit(True).alias("asked"), F.col("qid").alias("id"), F.col("qvec").alias("vec"), F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("bq"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("bv"))
    v = vectors.select(F.lit(False).alias("asked"), F.col("doc").alias("id"), "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("bq"), F.pmod(F.xxhash64("doc"), F.lit(nv)).alias("bv"))
    best = q.unionByName(v).groupBy("bq", "bv", F.size("vec").alias("dim")).applyInPandas(_best(top), "qid long, doc long, score double")
    return top_k(best, top)


def _near(threshold: float):
    """Links (a, b) of a pair of blocks that join the same vectors as all pairs at the threshold do."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["id"].to_numpy(), np.array(part["vec"].tolist(), dtype=np.float64).reshape(len(part), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        near, root, links = x @ x.T >= threshold, np.arange(len(x)), []
        for a in range(len(x)):
            for b in np.flatnonzero(near[a] & (root != root[a])):
                if root[b] != root[a]:
                    links.append((ids[a], ids[b]))
                    root[root == root[b]] = root[a]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def near_links(vectors: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(a, b) of (id, grp, vec): links whose components are those of all pairs of a group at the threshold, block by block."""
    ship_package(vectors.sparkSession)
    n = vectors.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    v = vectors.join(n, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    v = v.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "vec")
    kind = vectors.schema["id"].dataType.simpleString()
    return v.groupBy("grp", "x", "y").applyInPandas(_near(threshold), f"a {kind}, b {kind}")


def fuse(*ranked: DataFrame, k: int = 60, cut: int = 50, keep: int = 30) -> DataFrame:
    """Reciprocal rank fusion of (qid, doc, rk) lists: (qid, doc, score, rk)."""
    every = None
    for r in ranked:
        part = r.where(F.col("rk") <= cut).select("qid", "doc", (1.0 / (k + F.col("rk"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return top_k(every.groupBy("qid", "doc").agg(F.sum("s").alias("score")), keep)


def zscore(x: str, group: str = "qid") -> Column:
    w = Window.partitionBy(group)
    return F.coalesce((F.col(x) - F.avg(x).over(w)) / F.nullif(F.round(F.stddev_pop(x).over(w), 12), F.lit(0.0)), F.lit(0.0))


def merge_round_robin(lists: DataFrame) -> DataFrame:
    """(qid, doc, pos) from (qid, doc, list, rk): first place of each by rank, then list."""
    first = lists.groupBy("qid", "doc").agg(F.min(F.struct("rk", "list")).alias("m"))
    return first.select("qid", "doc", F.row_number().over(Window.partitionBy("qid").orderBy("m.rk", "m.list", "doc")).cast("long").alias("pos"))


def hard_negatives(ranked: DataFrame, group_of: DataFrame, skip: int = 2, n: int = 7) -> DataFrame:
    """Candidates of other groups than the query's, after the first ``skip``, n of them."""
    g = group_of.select(F.col("doc").alias("q"), F.col("grp").alias("qgrp"))
    d = ranked.join(group_of, "doc").join(g, F.col("qid") == F.col("q")).where("grp != qgrp")
    w = Window.partitionBy("qid").orderBy("rk")
    return d.withColumn("pos", F.row_number().over(w).cast("long")).where((F.col("pos") > skip) & (F.col("pos") <= skip + n)).select("qid", "doc", "pos")


def hash_embed(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, bucket, w): bag of hashed tokens, of unit length; dim is a power of two."""
    t = docs.select(F.col(id_col).alias("doc"), F.explode(search_tokens(F.col(text_col))).alias("t"))
    b = t.groupBy("doc", F.pmod(F.conv(F.substring(F.md5(F.encode("t", "UTF-8")), 25, 8), 16, 10).cast("long"), F.lit(dim)).alias("bucket")).agg(F.count("*").alias("n"))
    return b.select("doc", "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc")))).alias("w"))


def link_pool(ranked: DataFrame, links: DataFrame, depth: int, head: int) -> DataFrame:
    """(qid, doc) that the first ``depth`` link to, either way, and that aren't in the head already."""
    both = links.select("src", "dst").unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = ranked.where(F.col("rk") <= depth).join(both, F.col("doc") == F.col("src")).select("qid", F.col("dst").alias("doc")).distinct()
    return reached.join(ranked.where(F.col("rk") <= head).select("qid", "doc"), ["qid", "doc"], "left_anti")


def protected_fill(ranked: DataFrame, extras: DataFrame, keep: int = 6, k: int = 8) -> DataFrame:
    """(qid, doc, pos): the first ``keep``, then extras in their order, then the rest up to k."""
    own = ranked.where(F.col("rk") <= k).select("qid", "doc", F.when(F.col("rk") <= keep, 0).otherwise(2).alias("p"), "rk")
    every = own.unionByName(extras.select("qid", "doc", F.lit(1).alias("p"), "rk"))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("p", "rk", "doc")).cast("long")
    return every.withColumn("pos", pos).where(F.col("pos") <= k).select("qid", "doc", "pos")


def link_names(mentions: DataFrame, names: DataFrame, counts: DataFrame, threshold: float = 0.72, per_mention: int = 3, factor: float = 1.0) -> DataFrame:
    """(mention, node, weight): the nearest node names of each phrase, both as (doc, bucket, w), weighted by rarity.

    The join is on hashed tokens, so only names that share one are compared; a node's best alias counts. ``factor`` is for whole questions.
    Nodes of equal vectors are equally near, so a vector is compared once, and its first ``per_mention`` nodes stand for it.
    """
    m = mentions.select(F.col("doc").alias("mention"), "bucket", F.col("w").alias("wm"))
    vectors = names.groupBy(F.col("doc").alias("node")).agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("v"))
    first = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("node"))).where(F.col("r") <= per_mention)
    first = scratch(first.withColumn("kind", F.min("node").over(Window.partitionBy("v"))))
    n = first.where("r = 1").select("kind", F.explode("v").alias("x")).select("kind", "x.bucket", "x.w")
    sim = m.join(n, "bucket").groupBy("mention", "kind").agg(F.sum(F.col("wm") * F.col("w")).alias("sim")).where(F.round("sim", 9) >= threshold)
    top = top_k(sim.join(first.select("kind", "node"), "kind").select("mention", "node", "sim"), per_mention, "sim", "mention", "node")
    rare = 1 / F.ln(2 + F.coalesce("n", F.lit(0)))
    return top.join(counts.select("node", "n"), "node", "left").groupBy("mention", "node").agg(F.max(F.col("sim") * factor * rare).alias("weight"))
