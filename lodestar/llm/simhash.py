"""SimHash fingerprints and search within a Hamming radius, with DataFrame functions only.

Fingerprint: 128 bits. The terms of a text are the pairs of neighbouring lower-case words, with a
mark before the first and after the last; a term weighs as many votes as it has characters (31 at
most), for longer terms are rarer. Each term's hash votes on each bit, and a bit is set if more
than half of all votes are for it. Votes are added up two bits to a long (32 bits apart), so a
text of 2^27 words still counts right.

Search: fingerprints are cut into radius + lead blocks. Two of them within the radius differ in at
most ``radius`` blocks, so they agree on ``lead`` blocks at least: one table for each choice of that many
blocks, permuted to lead with them, holds both under the same key. Equal fingerprints are one entry
there. That is exact: no pair within the radius is missed.

Edge cases: a null text is an empty one; empty texts and texts without words have the same one
term (mark, mark) and so the same fingerprint; equal texts have equal fingerprints; repeated rows
are rows of their own; an empty table gives an empty result; columns other than those named are left alone and
not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, text_of

BITS = 128
LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """array<struct<h long, w long>>: each term's hash and votes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    mark = F.array(F.lit("\n"))
    return F.zip_with(F.concat(mark, words), F.concat(words, mark), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.least(F.length(a) + F.length(b), F.lit(31)).cast("long").alias("w")))


def fingerprints(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, hi, lo): the fingerprint of each row, which the keys must tell apart.

    If df is partitioned by some of the keys already, the votes are counted without a shuffle.
    """
    votes = df.select(*keys, F.explode(terms(text_of(text_col))).alias("t")).select(*keys, F.col("t.w").alias("w"), F.col("t.h").alias("h0"), F.xxhash64("t.h", F.lit(1)).alias("h1"))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)]
    counted = votes.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)

    def half(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"{h}_{i}"), 32)
            out = out.bitwiseOR(F.when(2 * low > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
            out = out.bitwiseOR(F.when(2 * high > F.col("all"), F.lit((1 << (i + 32)) - (1 << 64) * (i == 31))).otherwise(F.lit(0)).cast("long"))
        return out

    return counted.select(*keys, half("h0").alias("hi"), half("h1").alias("lo"))


def shown(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return 1.0 - distance(hi, lo, hi2, lo2).cast("double") / F.lit(float(BITS))


def _bits(hi: Column, lo: Column, start: int, end: int) -> Column:
    """Bits [start, end) counted from lo's lowest."""
    out = None
    for word, base in ((lo, 0), (hi, 64)):
        a, b = max(start, base) - base, min(end, base + 64) - base
        if a < b:
            mask = (1 << (b - a)) - 1
            x = F.shiftrightunsigned(word, a).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))
            out = x if out is None else F.xxhash64(out, x)
    return out


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, lead: int = 1, block: int = 4096) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance and what else the corpus has) of all pairs of distinct fingerprints within the radius, each once.

    Both inputs have hi and lo; rows of one fingerprint are one entry, with the other columns of any of
    them. More ``lead`` means more tables whose keys have more bits. A pair is told in the first table
    that it shares. Keys of more than ``block`` entries are dealt into parts of about that many, and
    queries go to each part, so no task grows with a group of near copies.
    """
    if not (0 <= radius and 1 <= lead and radius + lead <= 16):
        raise ValueError("radius and lead must be 0 and 1 at least and 16 together at most")
    n = radius + lead
    edges = [BITS * i // n for i in range(n + 1)]
    chosen = list(combinations(range(n), lead))

    def tables(df: DataFrame) -> DataFrame:
        cut = [_bits(F.col("hi"), F.col("lo"), edges[i], edges[i + 1]) for i in range(n)]
        keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), *[cut[i] for i in at]).alias("k")) for t, at in enumerate(chosen)]
        d = df.dropDuplicates(["hi", "lo"])
        return d.select(*df.columns, F.explode(F.array(*keys)).alias("x")).select(*df.columns, "x.*")

    every = tables(corpus)
    parts = every.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block).select("k", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = lambda d: d.join(parts, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    c = dealt(every).withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int")).drop("parts")
    q = dealt(tables(queries.select("hi", "lo"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "table").withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"})
    own, other = (F.col("q_hi"), F.col("q_lo")), (F.col("hi"), F.col("lo"))
    same = [_bits(*own, edges[i], edges[i + 1]) == _bits(*other, edges[i], edges[i + 1]) for i in range(n)]
    first = F.coalesce(*[F.when(reduce(lambda x, y: x & y, [same[i] for i in at]), F.lit(t)) for t, at in enumerate(chosen)])
    near = q.join(c, ["k", "part"]).withColumn("distance", distance(*own, *other))
    return near.where((F.col("distance") <= radius) & (F.col("table") == first)).select("q_hi", "q_lo", *corpus.columns, "distance")


def _place(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most x. The bounds are compared in two steps, so twice the root of their number is enough."""
    width = max(1, round(len(bounds) ** 0.5))
    heads, every = (F.lit(b or [0]).cast("array<bigint>") for b in (bounds[width - 1 :: width], bounds))
    full = F.size(F.filter(heads, lambda b: b <= x)) * width if len(bounds) >= width and bounds else F.lit(0)
    return F.transform(F.array(full), lambda f: f + F.size(F.filter(F.slice(every, f + 1, F.lit(width)), lambda b: b <= x)))[0]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(bucket, n, ghost, id, text, next_id, next_text): each row with the one that follows by id; the first follows the last.

    Rows go to ranges of ids of about equal numbers, and each range also gets a copy of the next
    range's first row, so one shuffle of the texts is enough and no task sees more than a range.
    Rows of equal ids are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    parts = parts or 6 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    bounds = sorted(set(d.select(F.col("id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)))
    bucket = _place(F.coalesce(F.col("id"), F.lit(-(1 << 63))), [int(b) for b in bounds])
    d = d.withColumn("bucket", bucket).withColumn("tie", F.xxhash64("text"))
    heads = d.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("h")).select("bucket", "h.*")
    order = Window.orderBy("bucket")
    # a row per range: each range gets the head of the next
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = heads.select(F.col("bucket").alias("hb"), F.col("id").alias("hid"), F.col("tie").alias("ht"), "to")
    ghosts = d.join(heads, (d.bucket == F.col("hb")) & d.id.eqNullSafe(F.col("hid")) & (d.tie == F.col("ht"))).dropDuplicates(["to"])
    ghosts = ghosts.select("id", "text", F.col("to").alias("bucket"), "tie", F.lit(True).alias("ghost"))
    rows = d.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), "tie")
    return rows.select("bucket", F.row_number().over(w).alias("n"), "ghost", "id", "text", F.lead("id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text"))
