"""Metrics, agreement, tests and splits over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.storage import scratch


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """(qid, n_gold, recall, complete) for each query with gold; gold (qid, doc) counts once."""
    g = gold.select("qid", "doc").distinct()
    hit = g.join(ranked.where(F.col("rk") <= k).select("qid", "doc").distinct().withColumn("hit", F.lit(1)), ["qid", "doc"], "left")
    return hit.groupBy("qid").agg(F.count("*").alias("n_gold"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), (F.count("hit") == F.count("*")).alias("complete"))


def percentiles(df: DataFrame, group: str, value: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles, linearly interpolated; nulls and NaNs are left out."""
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return d.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, q).alias(f"p{round(q * 100)}") for q in qs])


def order_p95(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The order statistic at place max(0, int(0.95 n) - 1)."""
    w = Window.partitionBy(group)
    d = df.withColumn("r", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("at", F.greatest(F.lit(0), F.floor(0.95 * F.count("*").over(w)).cast("int") - 1))
    return d.where("r = at").select(group, F.col(value).alias("p95_order"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed agreement, kappa (1 where chance agreement is 1)."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("na")).join(cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("nb")), "v").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    d = total.join(F.broadcast(chance), F.lit(True)).withColumn("po", F.col("same") / F.col("t")).withColumn("pe", F.col("c") / (F.col("t") * F.col("t")))
    return d.select(F.col("t").alias("n"), "po", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Linear weights over the span of the values; one row (n, weighted_kappa). Marginals are as many as there are score levels."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    cells = d.groupBy("a", "b").agg(F.count("*").alias("n"))
    one = cells.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))).alias("seen"))
    pa, pb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = pa.join(F.broadcast(pb), F.lit(True)).agg(F.sum(F.col("na") * F.col("nb") * F.abs(F.col("a") - F.col("b"))).alias("e"))
    x = one.join(F.broadcast(expected), F.lit(True))
    return x.select(F.col("t").alias("n"), F.when(F.col("e") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("t") / F.col("e")).alias("weighted_kappa"))


def holm(df: DataFrame, p: str, key: str, family: str | None = None) -> DataFrame:
    """Adjusted p-values by Holm's step-down rule, within each family of tests."""
    part = Window.partitionBy(*([family] if family else [F.lit(0)]))
    order = part.orderBy(p, key)
    r = df.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(part))
    step = F.least(F.lit(1.0), (F.col("m") - F.col("rank") + 1) * F.col(p))
    return r.withColumn("p_holm", F.max(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("rank", "m")


def effect_size(df: DataFrame, d: str) -> DataFrame:
    """Mean over standard deviation of paired differences; 0 where that is undefined."""
    x = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return x.select("n", F.round("mean", 6).alias("mean"), F.round(F.when((F.col("n") < 2) | (F.col("sd") == 0), 0.0).otherwise(F.col("mean") / F.col("sd")), 6).alias("d_z"))


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve from mean ranks, ties one half: counts per distinct score, then a running sum."""
    c = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("u", F.col("p") * (below + F.col("n") / 2)).agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def filtered_ranks(scores: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, doc, rank) of each known positive among all but the query's other positives; ties count one half."""
    s = scores.join(known.select("qid", "doc").distinct().withColumn("pos", F.lit(1)), ["qid", "doc"], "left").fillna({"pos": 0})
    w = Window.partitionBy("qid").orderBy(F.col("score").desc())
    other = F.when(F.col("pos") == 0, 1).otherwise(0)
    same = Window.partitionBy("qid", "score")
    above = F.coalesce(F.sum(other).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum(other).over(same)
    return s.withColumn("rank", 1 + above + F.sum(other).over(same) / 2).where("pos = 1").select("qid", "doc", "rank")


def stable_order(seed: str, key: Column) -> Column:
    """A portable random order: the MD5 of seed and key."""
    return F.md5(F.encode(F.concat_ws("|", F.lit(seed), key.cast("string")), "UTF-8"))


def ranked_by_hash(df: DataFrame, key: str, stratum: str, seed: str) -> DataFrame:
    """df with _rank, the place in the stable order of its stratum, and _n, the stratum's size.

    Rows are counted per prefix of their hash, sums over prefixes give what stands before each, and only rows of one
    prefix are ordered together: no task sorts a stratum.
    """
    d = df.withColumn("_h", stable_order(seed, F.col(key))).withColumn("_p", F.substring("_h", 1, 3))
    w = Window.partitionBy("_s")
    per = d.groupBy(F.col(stratum).alias("_s"), F.col("_p").alias("_q")).agg(F.count("*").alias("_k"))
    per = per.withColumn("_before", F.coalesce(F.sum("_k").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_k").over(w)).drop("_k")
    d = d.join(per, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    place = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key))
    return d.withColumn("_rank", place + F.col("_before")).drop("_h", "_p", "_q", "_s", "_before")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.4, seed: str = "13") -> DataFrame:
    """split = 'dev' for the first round(share * n) of each stratum in the stable order, else 'test'."""
    d = ranked_by_hash(df, key, stratum, seed)
    return d.withColumn("split", F.when(F.col("_rank") <= F.bround(share * F.col("_n")), "dev").otherwise("test")).drop("_rank", "_n")


def cap_per_group(df: DataFrame, key: str, group: str, cap: int, n: int, seed: str = "13") -> DataFrame:
    """At most ``cap`` rows of a group and n in all, in the stable order."""
    o = stable_order(seed, F.col(key))
    return df.withColumn("h", o).withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("h", key))).where(F.col("r") <= cap).orderBy("h", key).limit(n).drop("h", "r")


def bootstrap_mean(df: DataFrame, value: str, key: str, draws: int = 200, seed: str = "13") -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: a row's count in each draw comes from a hash, so no row moves.

    (n, mean, low, high). Each draw keeps two sums, so the state is 2 * draws numbers whatever the rows.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    h = F.conv(F.substring(F.md5(F.encode(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("k").cast("string")), "UTF-8")), 1, 8), 16, 10).cast("double") / 4294967296.0
    cut = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    count = sum((F.when(h >= c, 1).otherwise(0) for c in cut), F.lit(0))
    means = d.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("c", count).groupBy("b").agg((F.sum(F.col("c") * F.col("v")) / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    ci = means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean")).join(F.broadcast(ci), F.lit(True))


def permutation_test(df: DataFrame, diff: str, key: str, draws: int = 200, seed: str = "13") -> DataFrame:
    """Sign-flip test of paired differences, signs from a hash: (n, mean, p) with p = (extreme + 1) / (draws + 1)."""
    d = df.where(F.col(diff).isNotNull()).select(F.col(key).alias("k"), F.col(diff).cast("double").alias("v"))
    sign = F.when(F.substring(F.md5(F.encode(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("k").cast("string")), "UTF-8")), 1, 1) < "8", 1.0).otherwise(-1.0)
    means = d.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("b").agg(F.avg(sign * F.col("v")).alias("m"))
    seen = d.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    got = means.join(F.broadcast(seen), F.lit(True)).agg(F.first("n").alias("n"), F.round(F.first("mean"), 6).alias("mean"), F.sum(F.when(F.abs("m") >= F.abs("mean") - 1e-12, 1).otherwise(0)).alias("x"))
    return got.select("n", "mean", F.round((F.col("x") + 1) / (draws + 1), 6).alias("p"))


def citations(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, precision, recall) of cited documents, for queries that have gold."""
    g = gold.select("qid", "doc").distinct()
    hit = cited.select("qid", "doc").distinct().join(g.withColumn("hit", F.lit(1)), ["qid", "doc"], "left").groupBy("qid").agg(F.count("*").alias("cited"), F.count("hit").alias("hits"))
    return hit.join(g.groupBy("qid").agg(F.count("*").alias("n")), "qid").select("qid", (F.col("hits") / F.col("cited")).alias("precision"), (F.col("hits") / F.col("n")).alias("recall"))


def prf_rollup(df: DataFrame, kind: str, predicted: Column, actual: Column) -> DataFrame:
    """Precision, recall and F1 per type and for all (``ALL``); 0 where undefined."""
    c = df.rollup(kind).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.coalesce(kind, F.lit("ALL")).alias("type"), "tp", "fp", "fn", ratio(tp, tp + fp).alias("p"), ratio(tp, tp + fn).alias("r"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def recovered_broken(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: gold that only the second system finds, gold that only the first finds, and all gold."""
    mark = lambda d, c: d.select("qid", "doc").distinct().withColumn(c, F.lit(True))
    x = gold.select("qid", "doc").distinct().join(mark(before, "a"), ["qid", "doc"], "left").join(mark(after, "b"), ["qid", "doc"], "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return x.agg(F.count_if(b & ~a).alias("recovered"), F.count_if(a & ~b).alias("broken"), F.count("*").alias("n"))


def permutation_exact(df: DataFrame, diff: str, key: str, most: int = 16) -> DataFrame:
    """Sign-flip test over all 2^n signs of at most ``most`` differences (more fail): (n, mean, p)."""
    d = df.where(F.col(diff).isNotNull())
    if d.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} differences; use permutation_test")
    x = d.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(diff).cast("double").alias("v")))).alias("a"), F.count("*").alias("n"), F.avg(diff).alias("mean"))
    x = x.select("n", "mean", F.transform("a", lambda y: y["v"]).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(n as int)) - 1"))).alias("b"))
    flipped = F.expr("aggregate(transform(v, (y, i) -> if(getbit(b, i) = 1, -y, y)), 0D, (s, y) -> s + y) / n")
    out = x.groupBy("n", "mean").agg(F.avg(F.when(F.abs(flipped) >= F.abs("mean") - 1e-12, 1.0).otherwise(0.0)).alias("p"))
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("p", 6).alias("p"))


def verified_answers(sentences: DataFrame, key: str) -> DataFrame:
    """(key, n, unsupported_rate, kept, abstained) of answers' sentences (key, cites, said).

    A sentence without citations is unsupported, and so is one that nothing was said of; an answer without a kept one abstains.
    """
    v = F.when(F.size("cites") > 0, F.coalesce("said", F.lit("unsupported"))).otherwise("unsupported")
    bad = v == "unsupported"
    return sentences.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(bad.cast("int")), 6).alias("unsupported_rate"), F.count_if(~bad).alias("kept"), (F.count_if(~bad) == 0).alias("abstained"))


def judged(answerable: Column, abstained: Column, score: Column, covered: Column, n_facts: Column) -> Column:
    """struct<score, covered>: unanswerable questions by abstention, an abstention 0, else the nearest of 0, 0.5 and 1 (the lower of two); a flag per key fact."""
    snapped = F.array_min(F.transform(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), lambda s: F.struct(F.abs(s - score).alias("d"), s.alias("s"))))["s"]
    none = F.array_repeat(F.lit(False), n_facts)
    flags = F.slice(F.concat(F.coalesce(covered, F.expr("cast(array() as array<boolean>)")), none), F.lit(1), n_facts)
    return F.struct(
        F.when(~answerable, F.when(abstained, 1.0).otherwise(0.0)).when(abstained | score.isNull(), 0.0).otherwise(snapped).alias("score"),
        F.when(~answerable, F.expr("cast(array() as array<boolean>)")).when(abstained, none).otherwise(flags).alias("covered"),
    )


def metric_vectors(systems: DataFrame, gold: DataFrame, questions: DataFrame, names: list[str], cited: int = 3) -> DataFrame:
    """One row per (system, qid): recall at 8 and 4, complete support, precision and recall of the first ``cited`` as citations.

    Null where a metric doesn't apply: for questions without gold, and for citations where nothing was found.
    """
    g = gold.select("qid", "doc").distinct()
    hits = [F.count_if(F.col("gold").isNotNull() & (F.col("rk") <= k)).alias(f"h{k}") for k in (8, 4, cited)]
    x = systems.join(g.withColumn("gold", F.lit(True)), ["qid", "doc"], "left").groupBy("system", "qid").agg(*hits, F.count_if(F.col("rk") <= cited).alias("cited"))
    every = questions.select("qid", F.explode(F.array(*map(F.lit, names))).alias("system"))
    x = every.join(x, ["system", "qid"], "left").join(g.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    c = lambda name: F.coalesce(name, F.lit(0))
    has = F.col("n").isNotNull()
    cites = has & (c("cited") > 0)
    return x.select(
        "system", "qid", F.when(has, c("h8") / F.col("n")).alias("recall8"), F.when(has, c("h4") / F.col("n")).alias("recall4"), F.when(has, (c("h8") == F.col("n")).cast("double")).alias("complete8"),
        F.when(cites, c(f"h{cited}") / F.col("cited")).alias("citation_precision"), F.when(cites, c(f"h{cited}") / F.col("n")).alias("citation_recall"),
    )


def long_metrics(vectors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(system, qid, metric, v)."""
    return vectors.unpivot(["system", "qid"], list(names), "metric", "v")


def report_table(vectors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(system, metric, mean, n) over the questions that have a value."""
    return long_metrics(vectors, names).groupBy("system", "metric").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def paired_tests(long: DataFrame, baseline: str, least: int = 3, draws: int = 200, seed: str = "13") -> DataFrame:
    """(system, metric, n, diff, p, p_holm) of each system against the baseline on shared questions, sign-flip test, Holm within a metric."""
    v = long.where("v is not null")
    b = v.where(F.col("system") == baseline).select("metric", "qid", F.col("v").alias("base"))
    d = v.where(F.col("system") != baseline).join(b, ["metric", "qid"]).select("system", "metric", "qid", (F.col("v") - F.col("base")).alias("diff"))
    seen = d.groupBy("system", "metric").agg(F.count("*").alias("n"), F.avg("diff").alias("diff")).where(F.col("n") >= least)
    sign = F.when(F.substring(F.md5(F.encode(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("qid").cast("string")), "UTF-8")), 1, 1) < "8", 1.0).otherwise(-1.0)
    means = d.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("system", "metric", "b").agg(F.avg(sign * F.col("diff")).alias("m"))
    p = seen.join(means, ["system", "metric"]).groupBy("system", "metric").agg(F.first("n").alias("n"), F.first("diff").alias("diff"), ((F.count_if(F.abs("m") >= F.abs("diff") - 1e-12) + 1) / (draws + 1)).alias("p"))
    return holm(p, "p", "system", "metric")


def over_seeds(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, std, n) across runs; the deviation is the population's, and NaNs are left out."""
    return df.where(~F.isnan(value)).groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def twins(direct: DataFrame, bridge: DataFrame, pair: str, value: str) -> DataFrame:
    """(pair, direct, bridge, cost) of the pairs that have both."""
    x = direct.select(pair, F.col(value).alias("direct")).join(bridge.select(pair, F.col(value).alias("bridge")), pair)
    return x.where("direct is not null and bridge is not null").withColumn("cost", F.col("direct") - F.col("bridge"))


def reach(misses: DataFrame, pools: DataFrame) -> DataFrame:
    """(route, misses, reach, pool): the share of missed (qid, doc) that a route's pool (qid, route, doc) holds, and its median size."""
    size = pools.groupBy("route", "qid").agg(F.count("*").alias("n")).groupBy("route").agg(F.percentile("n", 0.5).alias("pool"))
    x = misses.select("qid", "doc").distinct().join(size, F.lit(True)).join(pools.withColumn("held", F.lit(1)), ["route", "qid", "doc"], "left")
    return x.groupBy("route").agg(F.count("*").alias("misses"), F.avg(F.coalesce("held", F.lit(0))).alias("reach"), F.first("pool").alias("pool"))


def load_cells(log: DataFrame, cell: str, latency: str, hit: Column, seconds: float) -> DataFrame:
    """(cell, n, per_s, p50, p95, max, hit_rate) of a request log over a time."""
    x = log.where(F.col(latency).isNotNull()).withColumn("_hit", hit.cast("int"))
    return x.groupBy(cell).agg(F.count("*").alias("n"), (F.count("*") / seconds).alias("per_s"), F.percentile(latency, 0.5).alias("p50"), F.percentile(latency, 0.95).alias("p95"), F.max(latency).alias("max"), F.avg("_hit").alias("hit_rate"))


def cap_pairs(df: DataFrame, key: str, source: str, target: str, cap: int, seed: str = "13") -> DataFrame:
    """One row for each (source, target), then ``cap`` for each source, the first in the stable order."""
    d = df.withColumn("_h", stable_order(seed, F.col(key)))
    one = d.withColumn("_r", F.row_number().over(Window.partitionBy(source, target).orderBy("_h", key))).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy("_h", key))).where(F.col("_r") <= cap).drop("_h", "_r")


def gold_sample(df: DataFrame, key: str, unit: str, cue: str, half: int, seed: str = "13") -> DataFrame:
    """``half`` rows with the cue and as many without, one per unit, the first in the stable order."""
    d = df.withColumn("_h", stable_order(seed, F.col(key)))
    one = d.groupBy(unit).agg(F.min_by(F.struct(*d.columns), F.struct("_h", key)).alias("x")).select("x.*")
    every = [one.where(F.col(cue) == F.lit(v)).orderBy("_h", key).limit(half) for v in (True, False)]
    return every[0].unionByName(every[1]).drop("_h")


def first_of_each(df: DataFrame, level: str, key: str) -> DataFrame:
    """The row of the least key for each level."""
    return df.groupBy(level).agg(F.min_by(F.struct(*df.columns), key).alias("x")).select("x.*")


def places(df: DataFrame, order: list[Column], parts: str = "place") -> DataFrame:
    """df with each row's place in a total order, counted by ranges: no task sorts more than its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = scratch(ranged)
    n = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    n = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(n.select("_p", "first", "before"), "_p").withColumn(parts, F.col("before") + F.col("_i") - F.col("first") + 1).select(*df.columns, parts)


def finalists(configs: DataFrame, baseline: str, slack: float = 1.1) -> DataFrame:
    """(config, recall, latency, why): the best that beats the baseline, and the best of those within ``slack`` of its latency."""
    b = configs.where(F.col("config") == baseline).select(F.col("recall").alias("r0"), F.col("latency").alias("l0"))
    better = configs.join(b, F.lit(True)).where("recall > r0")
    order = [F.col("recall").desc(), "latency", "config"]
    best = lambda d, why: d.orderBy(*order).limit(1).select("config", "recall", "latency", F.lit(why).alias("why"))
    return best(better, "best").unionByName(best(better.where(F.col("latency") <= slack * F.col("l0")), "fast"))


def latency_slices(df: DataFrame, rank: str, seconds: str, pools: tuple[int, ...]) -> DataFrame:
    """(pool, seconds) of reranking the first rows of each list."""
    sums = df.agg(*[F.sum(F.when(F.col(rank) <= p, F.col(seconds)).otherwise(0)).alias(str(p)) for p in pools])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("pool"), F.col(str(p)).alias("seconds")) for p in pools])))


def listwise_loss(df: DataFrame, key: str, score: str, positive: str) -> DataFrame:
    """(key, loss): ln of the sum of exp(score) less the positive's score, for lists that have one."""
    top = F.max(score)
    x = df.groupBy(key).agg(top.alias("m"), F.collect_list(score).alias("s"), F.max(F.when(F.col(positive), F.col(score))).alias("p")).where("p is not null")
    total = F.aggregate("s", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m")))
    return x.select(key, (F.ln(total) + F.col("m") - F.col("p")).alias("loss"))


def random_part(key: Column, cut: int, seed: str = "13") -> Column:
    """``test`` for the keys whose hash's first byte is below ``cut``, else ``train``."""
    return F.when(F.conv(F.substring(stable_order(seed, key), 1, 2), 16, 10).cast("int") < cut, "test").otherwise("train")


def screened(answerable: Column, supported: Column, quote: Column, quote_score: Column, leaks: Column, least: int = 15, ratio: float = 0.85) -> Column:
    """struct<passed, quote_found, leaks>: the evidence answers and supports, the quote is long enough and stands in it, and the answer isn't given away. A missing verdict fails."""
    found = (F.length(F.trim(quote)) >= least) & (quote_score >= ratio)
    return F.struct(F.coalesce(answerable & supported & found & ~leaks, F.lit(False)).alias("passed"), F.coalesce(found, F.lit(False)).alias("quote_found"), leaks.alias("leaks"))
