"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets. The sources, in order of their names by code point with null last, have the weights
given, repeated as often as needed. They share ``share`` times the size of all documents by
weight, where no source may get more than ``most`` times its own size: what is above goes to the
others by weight, until none is above. That fixed point is min(most * size, level * weight) for
one level, which a prefix sum over the sources, in the order in which they fill, gives directly.

Selection. A source whose target is e times its size and a rest takes e whole epochs, every
document once for each, and then a sample of the rest without replacement: a document's key is
-ln(u) / quality, u uniform from a hash of its id, and documents are taken in order of the key
until their sizes, summed up, meet the rest. The document that crosses it is taken in part.

Scale. A source may hold any share of the rows, so no task ever sorts a source. Keys are dealt to
``bins`` slices of each source, the slices are summed, the prefix sum over the slices of a source
tells which are taken whole, and only the one slice that the rest falls into is sorted. The
slices' table joins on source and slice, so a hot source is spread over as many keys.

Edge cases: null and empty texts have size 0 and take 0; a source of size 0 has target 0; a null
source is a source of its own; repeated rows and equal ids are separate documents, told apart by
source and text where ids are equal, and interchangeable where all are; a quality that is null or not
above 0 counts as the least quality; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, scratch, text_of, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
LEAST_QUALITY = 0.05


def size_in_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def letter_quality(text: Column) -> Column:
    """Share of letters and single spaces in the text: prose is near 1, symbol and number noise well below."""
    n = F.length(text)
    other = F.regexp_count(text, F.lit(r"[^\p{L}\x20]|\x20\x20"))
    return F.when(n > 0, 1.0 - F.least(other.cast("double") / n, F.lit(1.0))).otherwise(0.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target. One row per source: small, so its windows may run in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    fills = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    rest = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("budget", share * F.sum("source_size").over(everything))
    # the level if the sources before this one are full and this one and all later ones aren't
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, bins: int = 1024) -> DataFrame:
    """One row per document: id, source, size, source_size, target and taken."""
    text = text_of(text_col)
    weight = F.greatest(F.coalesce(quality if quality is not None else letter_quality(text), F.lit(0.0)), F.lit(LEAST_QUALITY))
    tie = F.xxhash64(F.col(source_col), text)
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_in_words(text).alias("size"), weight.alias("q"), tie.alias("tie"))
    # exp(-key), the u^(1/w) of the paper: it is uniform where all weights are equal, so even slices of it hold about as many rows
    d = d.withColumn("draw", F.pow(unit_interval(F.lit(seed), F.col("id"), F.col("tie")), 1.0 / F.col("q"))).drop("q")
    d = scratch(d.withColumn("bin", (bins * (1.0 - F.col("draw"))).cast("int")))
    slices = scratch(d.groupBy("source", "bin").agg(F.sum("size").alias("slice")), even=True)
    per = source_targets(slices.groupBy("source").agg(F.sum("slice").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = slices.withColumn("before", F.coalesce(F.sum("slice").over(upto), F.lit(0)))
    plan = plan.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    left = F.col("rest") - F.col("before")
    plan = plan.withColumn("state", F.when(left >= F.col("slice"), F.lit(1)).when(left <= 0, F.lit(0)).otherwise(F.lit(2)))
    plan = plan.withColumn("left", left).select(F.col("source").alias("s"), F.col("bin").alias("b"), "source_size", "target", "epochs", "left", "state")
    d = d.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    plain = d.where("state < 2").withColumn("part", F.col("size") * F.col("state"))
    within = Window.partitionBy("source").orderBy(F.col("draw").desc(), "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    crossed = d.where("state = 2").withColumn("done", F.coalesce(F.sum("size").over(within), F.lit(0)))
    crossed = crossed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("done")))).drop("done")
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return plain.unionByName(crossed).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), "tie")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: each document as many times as it is taken, a part of at least half rounded up."""
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    got = mix(docs, **options).select(F.col(id_col).alias("id"), "tie", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int").alias("n"))
    # copies of a row share a tie; they get the mean of what they took, so a row of docs meets one row here
    got = got.groupBy("id", "tie").agg(F.round(F.avg("n")).cast("int").alias("n")).where("n > 0")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(F.col(source_col), text_of(text_col)).alias("own_tie"))
    rows = rows.join(got, F.col("row").getField(id_col).eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
