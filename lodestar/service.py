"""The service's reads as functions of the tables, with its limits; a web layer only has to call them and show rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import knowledge as K
from lodestar.operators import models as M
from lodestar.operators import search as S

MOST_K, MOST_IDS = 50, 200


class BadRequest(ValueError):
    """What a client asked for is unknown or outside the limits."""


class Service:
    """Retrievers by name, built when first used, over documents (doc_id, text) and edges."""

    def __init__(self, spark: SparkSession, documents: str, edges: DataFrame | None = None):
        self.spark, self.documents, self.edges = spark, documents, edges
        self.systems = {"S0": self._none, "S1": self._lexical, "L": self._share}

    def health(self) -> dict:
        return {"status": "ok", "systems": sorted(self.systems), "graph": self.edges is not None}

    def _index(self) -> S.Index:
        return S.index_of(self.spark, self.documents)

    def _none(self, q: DataFrame, k: int) -> DataFrame:
        return S.bm25(q, self._index(), top=k).limit(0)

    def _lexical(self, q: DataFrame, k: int) -> DataFrame:
        return S.bm25(q, self._index(), top=k)

    def _share(self, q: DataFrame, k: int) -> DataFrame:
        return S.lexical(q, self._index(), top=k)

    def retrieve(self, question: str, system: str = "S1", k: int = 8) -> DataFrame:
        """(doc, score, rk) of one question."""
        if system not in self.systems:
            raise BadRequest(f"unknown system {system}")
        if not 1 <= k <= MOST_K:
            raise BadRequest(f"k must be 1 to {MOST_K}")
        q = self.spark.createDataFrame([(0, question)], "item_id long, text string")
        return self.systems[system](q, k).select("doc", "score", "rk")

    def answer(self, question: str, client, system: str = "S1", k: int = 8) -> dict:
        """The model's reply under the sources found; without any it abstains. Citations outside the sources are dropped."""
        found = self.retrieve(question, system, k)
        texts = self.spark.read.parquet(self.documents).select(F.col("doc_id").alias("doc"), "text")
        rows = found.join(texts, "doc").agg(F.sort_array(F.collect_list(F.struct("rk", F.col("doc").cast("string").alias("id"), "text"))).alias("c")).withColumn("q", F.lit(question))  # k sources
        asked = rows.where(F.size("c") > 0).select(F.transform("c", lambda x: x["id"]).alias("sources"), M.request("answer", "Answer from the sources and cite them.", M.sources_prompt(F.col("q"), F.col("c")), "answer", 400).alias("request"))
        got = M.complete(asked, "request", client, ("sentences",)).first()
        if got is None or got["reply"] is None:
            return {"abstained": True, "sentences": [], "sources": [] if got is None else got["sources"]}
        reply = self.spark.createDataFrame([(got["reply"], got["sources"])], "reply string, sources array<string>")
        kept = reply.select(F.transform(F.from_json("reply", "sentences array<struct<text:string,citations:array<string>>>")["sentences"], lambda s: F.struct(s["text"].alias("text"), F.array_intersect(s["citations"], F.col("sources")).alias("citations"))).alias("s")).first()["s"]
        return {"abstained": not kept, "sentences": [x.asDict() for x in kept], "sources": got["sources"]}

    def entity(self, node: str) -> DataFrame:
        """The edges at a node, either way."""
        e = self.edges.select("src", "rel", "dst")
        return e.where((F.col("src") == node) | (F.col("dst") == node)).distinct()

    def subgraph(self, ids: list[str]) -> DataFrame:
        if not 1 <= len(ids) <= MOST_IDS:
            raise BadRequest(f"1 to {MOST_IDS} nodes")
        return K.induced(self.edges.select("src", "rel", "dst").distinct(), self.spark.createDataFrame([(i,) for i in ids], "node string"))

    def suggestions(self, scores: DataFrame, most: int = 20) -> DataFrame:
        return K.predicted_edges(scores, self.edges, most=most)

    def chunk_ids(self, most: int = 50) -> DataFrame:
        """The first ids, to look around."""
        return self.spark.read.parquet(self.documents).select("doc_id").orderBy("doc_id").limit(most)


def markdown(table: DataFrame, systems: list[str], metrics: list[str]) -> str:
    """A report's (system, metric, mean, n), as many rows as systems times metrics, as a table of text."""
    got = {(r["system"], r["metric"]): r for r in table.where(F.col("system").isin(systems) & F.col("metric").isin(metrics)).collect()}
    cell = lambda s, m: f"{got[s, m]['mean']:.3f} (n={got[s, m]['n']})" if (s, m) in got and got[s, m]["mean"] is not None else "-"
    lines = ["| metric | " + " | ".join(systems) + " |", "|" + "-|" * (len(systems) + 1)]
    return "\n".join([*lines, *(f"| {m} | " + " | ".join(cell(s, m) for s in systems) + " |" for m in metrics)]) + "\n"


def write_report(table: DataFrame, path: str, systems: list[str], metrics: list[str]) -> None:
    """A report as JSON lines and as text, where Spark can write."""
    table.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    text = markdown(table, systems, metrics).rstrip()
    table.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
