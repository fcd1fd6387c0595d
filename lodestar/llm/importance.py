"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and marks, alone and in pairs, 2^18 buckets): one of
all texts, counted over every row, and one of the target, the labelled good texts, with the first
as its prior. A text's log ratio per n-gram is its importance against the raw data, free of its
length. A few telling words can condemn a long text, so beside it stands the sum of the log odds of
the n-grams that are found in labelled bad texts far more often than in good ones (standard score above
``z``). A logistic map, fitted on other labelled texts than those models, turns both into the log
weight of the text, log odds of good.

Resampling: Gumbel top-k. A text's key is log weight + temperature * Gumbel noise, drawn from a
hash of its id, and the k largest keys are kept, k being the number of texts whose weight is
above 1. The cut is found by histograms of fixed size; no rows are sorted in one place.

Labels: at most ``sample`` labelled rows are used, the first by a hash of their ids; half of them fit the
target model, half the logistic map. All counts of the raw model cover all rows.

Edge cases: a null text is an empty one; a text without n-grams has weight 0 and isn't kept; with
no labels of both kinds, in either half, nothing is known and every other text is kept; several
labels of one id: the worst counts; rows with one id and text get one key and stay or go together;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestar.llm.common import lean, scratch, ship_package
from lodestar.llm.near_duplicates import MULTIPLIERS, token_hashes

BUCKETS = 1 << 18


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the words and marks of a text and of their neighbouring pairs."""
    h = token_hashes(text or "", marks=True)
    if not len(h):
        return np.zeros(0, np.int64)
    pairs = (h[:-1] ^ (h[1:] * MULTIPLIERS[50])) * MULTIPLIERS[51]
    return (np.concatenate([h * MULTIPLIERS[52], pairs]) >> np.uint64(64 - 18)).astype(np.int64)


def log_ratios(raw: np.ndarray, good: np.ndarray, prior: float = 3.0) -> np.ndarray:
    """log P(target) / P(raw) of each bucket."""
    p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    mass = prior * BUCKETS
    return np.log((good + mass * p) / (good.sum() + mass) / p)


def telling(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, z: float) -> np.ndarray:
    """Log odds (below 0) of the buckets that mark bad texts, from numbers of texts; 0 for all others."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    share = n_bad / max(n_bad + n_good, 1)
    expected = (bad + good) * share
    return np.where((odds > 2) & (bad - expected > z * np.sqrt(np.maximum(expected * (1 - share), 1e-9))), -odds, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights and offset by Newton steps on standardised columns, told for the columns as given."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w)), a.T @ (p - y) + ridge * len(x) * np.append(w[:-1], 0))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def cut_of_top_k(df: DataFrame, k: int, key: str = "key", bins: int = 4096) -> float:
    """The k-th largest key, found by histograms of ever narrower ranges: ``bins`` rows come to the driver at a time."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return math.inf
    above = 0
    for _ in range(8):
        if not high > low or (high - low) / bins <= abs(high) * 1e-15:
            break
        width = (high - low) / bins
        b = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        got = df.where(F.col(key).between(low, high)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
        if above + 1 == k:
            return high
    return low


class Classifier:
    """The fitted models; apply() gives every row its log weight and key."""

    def __init__(self, spark, ratio: np.ndarray, sure: np.ndarray, w: np.ndarray | None):
        self.shared = spark.sparkContext.broadcast((ratio, sure))  # 4 MB
        self.w = w

    @staticmethod
    def labelled(labels: DataFrame, sample: int) -> dict[int, int]:
        """id -> 1 good, 0 bad, of at most ``sample`` labelled rows."""
        known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
        return {r["doc_id"]: r["good"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = 20_000, z: float = 8.0) -> Classifier:
        spark = docs.sparkSession
        ship_package(spark)
        known = cls.labelled(labels, sample)
        first = {i: y for n, (i, y) in enumerate(known.items()) if n % 2 == 0}
        shared = spark.sparkContext.broadcast(first)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, good, marks, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros((2, BUCKETS), np.int32), shared.value
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    at = ngrams(text)
                    np.add.at(raw, at, 1)
                    y = own.get(i)
                    if y is not None:
                        marks[y, np.unique(at)] += 1
                        if y:
                            np.add.at(good, at, 1)
            at = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x[at], pa.int64()) for x in (raw, good, *marks))], names=["b", "raw", "good", "bad_texts", "good_texts"])

        sums = [F.sum(c).alias(c) for c in ("raw", "good", "bad_texts", "good_texts")]
        got = docs.select("doc_id", "text").mapInArrow(lean(count), "b int, raw long, good long, bad_texts long, good_texts long").groupBy("b").agg(*sums).toPandas()
        table = np.zeros((4, BUCKETS))
        table[:, got["b"].to_numpy(dtype=np.int64)] = got[["raw", "good", "bad_texts", "good_texts"]].to_numpy().T
        n_good = sum(first.values())
        model = cls(spark, log_ratios(table[0], table[1]), telling(table[2], table[3], len(first) - n_good, n_good, z), None)
        kind = docs.schema["doc_id"].dataType.simpleString()
        # at most half of the sample, which bounds what is broadcast
        rest = spark.createDataFrame([(i, y) for n, (i, y) in enumerate(known.items()) if n % 2], f"doc_id {kind}, y int")
        seen = model.features(docs.select("doc_id", "text").join(F.broadcast(rest), "doc_id")).select("mean", "sure", "y").where("mean is not null").toPandas()
        if len(set(first.values())) == 2 and seen["y"].nunique() == 2:
            x = seen[["mean", "sure"]].to_numpy()
            model.w = fit_logistic(np.column_stack([x, np.log1p(-x[:, 1])]), seen["y"].to_numpy(dtype=float))
        return model

    def features(self, df: DataFrame) -> DataFrame:
        """df with n_grams, mean and sure (null for texts without n-grams)."""
        shared, at = self.shared, df.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio, sure = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    n, a, b = [], [], []
                    for text in batch.column(at).to_pylist():
                        f = ngrams(text)
                        n.append(len(f))
                        a.append(float(ratio[f].mean()) if len(f) else None)
                        b.append(float(sure[np.unique(f)].sum()) if len(f) else None)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], names=[*names, "n_grams", "mean", "sure"])

        names = df.columns
        more = [StructField("n_grams", LongType()), StructField("mean", DoubleType()), StructField("sure", DoubleType())]
        return df.mapInArrow(lean(run), StructType([*df.schema.fields, *more]))

    def keyed(self, df: DataFrame, temperature: float = 0.1, seed: int = 3) -> DataFrame:
        """df with log_weight and key, null for texts without n-grams."""
        w = self.w if self.w is not None else (0.0, 0.0, 0.0, 1.0)
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.col("mean"), F.col("sure")), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        noise = F.lit(0.0) if self.w is None else -F.ln(-F.ln(u)) * temperature
        d = self.features(df).withColumn("log_weight", F.lit(float(w[0])) * F.col("mean") + F.lit(float(w[1])) * F.col("sure") + F.lit(float(w[2])) * F.log1p(-F.col("sure")) + F.lit(float(w[3])))
        return d.withColumn("key", F.col("log_weight") + noise)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, text, rest, n_grams, log_weight, key, kept); rest is a struct of the other columns of docs, whatever their names."""
    free = docs.select("doc_id", "text")
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("rest"))
    model = Classifier.fit(free, labels, **options)
    keys = scratch(model.keyed(free).select("log_weight", "key").where("key is not null"))
    k = keys.where("log_weight > 0").count()
    cut = cut_of_top_k(keys, k)
    return model.keyed(docs).withColumn("kept", F.coalesce(F.col("key") >= F.lit(cut), F.lit(False))).drop("mean", "sure")
