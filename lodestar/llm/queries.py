"""The operators' queries over whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, chat, embedding_dedup, importance, lattice_lm, main_text, mixing, near_duplicates, secrets, simhash
from lodestar.llm.common import read_table, scratch


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1
    return lattice_lm.score_documents(read_table(spark, sf_dir, "documents"), model, held_out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.classify(docs, read_table(spark, sf_dir, "labels")).drop("text", "rest")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within_3: other documents whose fingerprint differs in three bits at most, for ids divisible by 20 (else null)."""
    d = simhash.with_next(read_table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    d = d.select("bucket", "n", "ghost", "id", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), edited.alias("t")))).alias("x"))
    d = d.where("not (ghost and x.which = 1)").select("bucket", "n", "ghost", "id", "n_chars", F.when(F.col("x.which") == 1, F.sha2(F.encode("x.t", "UTF-8"), 256)).alias("sha"), "x.which", "x.t")
    f = simhash.fingerprints(d, ["bucket", "n", "ghost", "id", "n_chars", "which", "sha"], "t")
    f = f.groupBy("bucket", "n", "ghost", "id", "n_chars").agg(F.max("sha").alias("edited_sha256"), *[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{c}{w}") for w in (0, 1) for c in ("hi", "lo")])
    w = Window.partitionBy("bucket").orderBy("n")
    c = F.col
    f = f.select("*", F.lead("hi0").over(w).alias("hi2"), F.lead("lo0").over(w).alias("lo2")).where("not ghost")
    f = scratch(f.select(
        "id", "n_chars", F.unhex("edited_sha256").alias("sha"), "hi0", "lo0", "hi1", "lo1", simhash.likeness(c("hi0"), c("lo0"), c("hi1"), c("lo1")).alias("near_edited"),
        simhash.likeness(c("hi0"), c("lo0"), c("hi2"), c("lo2")).alias("near_next"),
    ))
    # the search by tables: documents whose id is divisible by 20 against all
    asked = F.coalesce(c("id") % 20 == 0, F.lit(False))
    prints = scratch(f.groupBy(c("hi0").alias("hi"), c("lo0").alias("lo")).agg(F.count("*").alias("copies"), F.bool_or(asked).alias("asked")), even=True)
    near = simhash.within_radius(prints.where("asked"), prints.drop("asked")).groupBy(c("q_hi").alias("hi0"), c("q_lo").alias("lo0")).agg(F.sum("copies").alias("near"))
    # only the rows that ask meet what was found
    near = f.where(asked).join(near, ["hi0", "lo0"]).unionByName(f.where(~asked).withColumn("near", F.lit(None).cast("long")))
    return near.select(
        c("id").alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), simhash.shown(c("hi0"), c("lo0")).alias("fingerprint"), simhash.shown(c("hi1"), c("lo1")).alias("edited_fingerprint"),
        "near_edited", "near_next", (c("near") - 1).alias("n_within_3"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    names = F.array(*map(F.lit, [*secrets.KINDS, "random"]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.KINDS))
    return d.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)], F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _digest(texts: Column) -> Column:
    return F.sha2(F.encode(F.array_join(texts, ""), "UTF-8"), 256)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    back = chat.read_back(chat.render(chat.fold(chat.turns_as_events(rows))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _digest(turns).alias("turns_sha256"), F.length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        _digest(F.col("loss_texts")).alias("loss_sha256"), "formatted_chars",
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lattice_lm, op2_mixing, op3_byte_bpe, op4_quality, op5_near_duplicates, op6_embedding_dedup, op7_fingerprints, op8_secret_scan, op9_chat, op10_main_text)
}
ORACLE_SQL: dict[str, str] = {}
