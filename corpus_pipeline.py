"""Training corpus from documents: quality, near duplicates, secrets, mixing and encoding, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, and further columns pass through whatever their names.

Edge cases: a null text is an empty one, which the quality stage rejects, for nothing speaks for it. Rows of one id, null
being one, are one document, of which the near-duplicate stage keeps the row of the least hash of its text. Ties are
broken by ids and hashes of texts, so reruns agree. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, importance, mixing, near_duplicates, secrets
from lodestar.llm.common import drop, read_table, scratch, text_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    got = importance.classify(docs, read_table(spark, sf_dir, "labels")).where("kept")
    return got.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the least id, once."""
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(near_duplicates.NO_ID))
    kept = near_duplicates.near_duplicates(docs).where("kept").select(key("doc_id").alias("k")).distinct()
    rows = docs.select(key("doc_id").alias("k"), F.xxhash64(text_of()).alias("tie"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(kept, "k")
    # the join has dealt rows out by k already
    first = F.row_number().over(Window.partitionBy("k").orderBy("tie"))
    return rows.withColumn("place", first).where("place = 1").select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    rows = docs.select(text_of().alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = secrets.scan(rows, out="spans")
    hit = F.size("spans") > 0
    text = F.when(hit, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("row").getField("text"))
    done = rows.select("row", hit.alias("hit"), text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded documents, with the ids themselves."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=True, memo=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("secrets", redact),
    ("mixing", mix),
    ("encoding", encode),
]

#: Sampled sketches, fitted models and transducers aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs)
            drop(before)
    return docs
