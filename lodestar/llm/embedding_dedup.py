"""Embedding near-dedup: tables of random-projection buckets, blocked cosine products, one representative per group.

1. Equal vectors of one label are one entry with its number of copies.
2. A label of few entries is one bucket, compared whole: exact. One of more entries is dealt into several tables
   of 2**bits buckets. A bucket is named by the largest of some random projections and its sign, once for each 5
   bits, so whether two vectors share it depends on their angle alone, not on the data: nothing is fitted. Enough
   tables are taken that a pair at the threshold itself shares no bucket with a probability of ``miss`` at
   most; closer pairs are missed far less. Bits and tables follow from the number of a label's entries (``plan``).
   ``margin=1`` compares all pairs of each label: exact.
3. Within a bucket, rows are cut into blocks of ``block`` rows, and each pair of blocks is
   one task's product: memory is bounded, and a hot bucket is spread over many tasks. Single precision
   screens; what is near the threshold is decided in double. A task returns
   for each vector how many it links with and the root of its group there: rows in proportion to
   its input, never pairs.
4. Vectors within half the threshold's angle of one direction link with each other, by the triangle inequality of
   angles: such a ball is counted, not compared, so a large group of near copies isn't squared. Balls are looked
   for where a bucket of the first table has more than a block of rows, in all of its rows: each small chunk, cut by
   content, gives its dense places, and those of all chunks are put together to means. No row is left out and nothing
   depends on how the table lies, so neither do links. Each vector of the label is measured against the means in
   double precision, and pairs that share no ball are compared as all others.
5. A pair counts in the first table that holds it in one bucket, and nowhere else. The roots
   are edges of a graph whose components are the groups; the least id represents each.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite components, and those
whose label is null, link with nothing; vectors of different lengths never link; repeated rows
are copies; rows of one id count as separate vectors but share a group; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop, lean, scratch, ship_package
from lodestar.operators.components import connected_components

#: Bits of one part of a bucket's name, at most: 16 projections with their signs.
PART = 5


def parts(bits: int) -> list[int]:
    return [PART] * (bits // PART) + [bits % PART] * (bits % PART > 0)


def shared(threshold: float, cells: int = 800, most: float = 7.0) -> list[float]:
    """The probability that two vectors at the threshold agree in a part of 0 to PART bits, by integration over a grid: it depends on nothing else."""
    t = min(1.0, max(-1.0, threshold))
    s, edge, fine = max(math.sqrt(1 - t * t), 1e-9), np.linspace(0, most, cells + 1), np.linspace(-9, 9, 36_001)
    below = lambda z: np.interp(z, fine, [0.5 * math.erfc(-v / math.sqrt(2)) for v in fine])
    x, weight = (edge[1:] + edge[:-1]) / 2, np.diff(below(edge))
    same, across = (weight[:, None] * np.diff(below((edge - sign * t * x[:, None]) / s), axis=1) for sign in (1, -1))
    both = 2 * (same + across).cumsum(0).cumsum(1)  # of one projection: that neither vector's is larger in size
    both = np.pad(both, ((1, 0), (1, 0)))
    both = (both[1:, 1:] + both[1:, :-1] + both[:-1, 1:] + both[:-1, :-1]) / 4
    return [1.0] + [float(2 * n * (same * both ** (n - 1)).sum()) for n in (1 << b for b in range(PART))]


def plan(n: int, agree: list[float], miss: float, per_cell: int, most_bits: int = 24) -> tuple[int, int]:
    """(bits, tables) of least work for n entries. A row in one more table weighs as much as per_cell comparisons."""
    best = (per_cell + 1.5 * n, 0, 1)
    for bits in range(1, most_bits + 1):
        together = math.prod(agree[b] for b in parts(bits))
        tables = 1 if together >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-together)) if together > 1e-9 else 1 << 40
        best = min(best, (tables * (per_cell + 1.5 * n / (1 << bits)), bits, tables))
    return best[1:]


def _unit(vec: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, also of components whose squares leave its range."""
    x = vec.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _buckets(kind: str):
    """Each row with its bucket in every table and its components as bytes, which move faster than lists; projections are a function of length, bits and seed."""
    drawn: dict[tuple[int, int, int], np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bits, tables = (batch.column(c).to_numpy() for c in ("dim", "bits", "tables"))
            keys, packed = [[0]] * len(dims), [b""] * len(dims)
            for dim, b, n in {*zip(dims.tolist(), bits.tolist(), tables.tolist(), strict=True)}:
                at = np.flatnonzero((dims == dim) & (bits == b))
                x = batch.column("vec").take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                for r, v in zip(at.tolist(), x.astype(kind), strict=True):
                    packed[r] = v.tobytes()
                if not b:
                    continue
                if (dim, b, n) not in drawn:
                    width = sum(1 << p - 1 for p in parts(b))
                    drawn[dim, b, n] = np.random.default_rng([5, dim, b]).normal(size=(n * width, dim)).T
                y = _unit(x) @ drawn[dim, b, n]
                row, out, left = np.arange(len(at)), np.zeros((len(at), n), np.int32), 0
                for t in range(n):
                    for p in parts(b):
                        own = y[:, left : left + (1 << p - 1)]
                        most = np.abs(own).argmax(1)
                        out[:, t] = (out[:, t] << p) + 2 * most + (own[row, most] > 0)
                        left += 1 << p - 1
                for r, k in zip(at.tolist(), out.tolist(), strict=True):
                    keys[r] = k
            batch = batch.set_column(batch.schema.get_field_index("vec"), "vec", pa.array(packed, pa.binary()))
            yield batch.append_column("keys", pa.array(keys, pa.list_(pa.int32())))

    return run


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, where each place names the least one of its group, after linking places a with b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least place that each place reaches by links; linked is symmetric."""
    return _union(np.arange(len(linked)), *np.nonzero(linked))


def _places(threshold: float, kind: str):
    """Sums and numbers of a chunk's rows in balls that hold an eighth or more of it."""
    half = math.sqrt(max(0.0, (1 + threshold) / 2))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("h1", "ascending"), ("h2", "ascending")])
        x, sums, held = _unit(np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).reshape(-1, key[1].as_py())), [], []
        few = max(8, len(x) // 8)
        while len(x) >= few:
            near = x @ x.T >= half
            mean = x[near[near.sum(1).argmax()]].sum(0)
            inside = x @ (mean / np.linalg.norm(mean)) >= half
            if inside.sum() < few:
                break
            sums.append(x[inside].sum(0).tobytes())
            held.append(int(inside.sum()))
            x = x[~inside]
        own = [pa.array([k.as_py()] * len(sums), part.schema.field(c).type) for c, k in zip(("label", "dim", "key"), key, strict=False)]
        return pa.table([*own, pa.array([part.column("n")[0].as_py()] * len(sums), pa.int64()), pa.array(held, pa.int64()), pa.array(sums, pa.binary())], names=["label", "dim", "key", "n", "held", "place"])

    return run


def _directions(threshold: float):
    """A bucket's places of all chunks, those within half the threshold's angle of a larger one put together: directions of balls."""
    half = math.sqrt(max(0.0, (1 + threshold) / 2))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("held", "descending"), ("place", "ascending")])
        x, found = np.frombuffer(b"".join(part.column("place").to_pylist())).reshape(-1, key[1].as_py()), []
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        while len(x):
            near = unit @ unit[0] >= half
            near[0] = True
            mean = x[near].sum(0)
            found.append((mean / np.linalg.norm(mean)).tobytes())
            x, unit = x[~near], unit[~near]
        own = [pa.array([part.column(c)[0].as_py()] * len(found), part.schema.field(c).type) for c in ("label", "dim", "n")]
        return pa.table([*own, pa.array(found, pa.binary())], names=["label", "dim", "n", "place"])

    return run


def _balls(places: dict[tuple, tuple[np.ndarray, np.ndarray]], threshold: float, kind: str):
    """Each row with the first ball of its label that holds it, or -1. The slack is far more than double precision can be off."""
    half = math.sqrt(max(0.0, (1 + threshold) / 2)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ball = {}, np.full(batch.num_rows, -1, np.int32)
            for r, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                if k in places:
                    at.setdefault(k, []).append(r)
            for k, own in at.items():
                number, place = places[k]
                inside = _unit(np.frombuffer(b"".join(batch.column("vec").take(pa.array(own)).to_pylist()), kind).reshape(-1, k[1])) @ place.T >= half
                ball[own] = np.where(inside.any(1), number[inside.argmax(1)], -1)
            yield batch.append_column("ball", pa.array(ball))

    return run


def _block(threshold: float, kind: str):
    last = np.iinfo(np.int64).max

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        column = lambda c: part.column(c).chunk(0)
        i, j, dim = key[-2].as_py(), key[-1].as_py(), column("dim")[0].as_py()
        rep = column("rep").fill_null(last).to_numpy()
        order = np.argsort(rep, kind="stable")  # the least id leads
        rep = rep[order]
        entry, copies, chunk, ball = (column(c).to_numpy()[order] for c in ("entry", "copies", "chunk", "ball"))
        before = column("before").flatten().to_numpy().reshape(len(rep), -1)[order]
        x = _unit(np.frombuffer(b"".join(column("vec").to_pylist()), kind).reshape(-1, dim))[order]
        rough, slack = x.astype(np.float32), 1e-7 * (dim + 16)  # more than single precision can be off
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        n, root, step = np.zeros(len(x)), np.arange(len(x)), max(1, (1 << 22) // dim)
        for v in np.unique(ball[left]):
            mine, rest = left[ball[left] == v], right if v < 0 else right[ball[right] != v]
            for at in range(0, len(mine), 256):
                own, others = mine[at : at + 256], rest[at:] if i == j and len(mine) == len(left) else rest
                near = rough[own] @ rough[others].T
                r, c = np.nonzero(near >= threshold - slack)
                a, b, sure = own[r], others[c], near[r, c] >= threshold + slack
                open_ = np.flatnonzero(~sure)
                for k in range(0, len(open_), step):
                    o = open_[k : k + step]
                    sure[o] = (x[a[o]] * x[b[o]]).sum(1) >= threshold
                if i == j:
                    sure &= a < b
                a, b = a[sure], b[sure]
                for t in range(before.shape[1]):  # tables that had the pair before this one
                    new = before[a, t] != before[b, t]
                    a, b = a[new], b[new]
                if len(a):
                    n += np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
                    root = _union(root, a, b)
        got = np.flatnonzero(n)
        ids = lambda v: pa.array(v, pa.int64(), mask=v == last)
        return pa.table({"entry": entry[got], "rep": ids(rep[got]), "n": n[got].astype(np.int64), "root": ids(rep[root[got]])})

    return run


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Within it, the files of a query's shuffles go when the query has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, margin: float | None = None, per_cell: int = 8192, miss: float = 0.005, block: int = 8192) -> DataFrame:
    """(id, n_links, component_id, kept) for each row. A ``margin`` as wide as the threshold's angle, 1 always, compares all pairs: exact."""
    if margin is not None and margin < 1 and margin * margin < 1 - threshold * threshold:
        raise ValueError(f"margin {margin} is narrower than the threshold's angle; leave it out, or take 1 for all pairs")
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", ok) & F.exists("vec", lambda x: x != 0), F.lit(False))
    digests = [F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit(1), "vec", "label").alias("h2")]
    usable = rows.where(valid).select("id", "label", "vec", *digests)
    with _shuffles_go(spark):
        reps = scratch(usable.groupBy("label", "h1", "h2", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")).withColumn("entry", F.monotonically_increasing_id()))
        plans = {}  # of labels with too many entries to be compared whole: few
        if margin is None:
            agree = shared(threshold)
            least = next((n for n in (1 << b for b in range(40)) if plan(n, agree, miss, per_cell)[0]), 1 << 40)
            large = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") >= least // 2).collect()
            plans = {(r["label"], r["dim"]): (bits, tables) for r in large for bits, tables in [plan(r["n"], agree, miss, per_cell)] if bits}
        label = reps.schema["label"].dataType.simpleString()
        kind = "<f4" if reps.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
        known = spark.createDataFrame([(*k, *v) for k, v in plans.items()], f"label {label}, dim int, bits int, tables int")
        dealt = reps.join(F.broadcast(known), ["label", "dim"], "left").withColumn("bits", F.coalesce("bits", F.lit(0))).withColumn("tables", F.coalesce("tables", F.lit(1)))
        dealt = dealt.select("label", "dim", "h1", "h2", "vec", "rep", "copies", "entry", "bits", "tables")
        unpacked, reps = reps, scratch(dealt.mapInArrow(lean(_buckets(kind)), f"label {label}, dim int, h1 long, h2 long, vec binary, rep long, copies long, entry long, bits int, tables int, keys array<int>"))
        drop(unpacked)
        rows_of = F.least(F.lit(block), F.greatest(F.lit(256), F.floor(F.lit(1 << 23) / F.col("dim"))))  # long vectors: smaller blocks
        cell = ["label", "dim", "key"]
        first = reps.withColumn("key", F.col("keys")[0])
        sizes = first.groupBy(cell).agg(F.count("*").alias("n"), F.first(rows_of).alias("rows")).where("n > rows")
        chunked = first.join(F.broadcast(sizes), cell).select(*cell, F.pmod("h1", F.ceil(F.col("n") / F.least(F.lit(1024), "rows"))).alias("chunk"), "n", "h1", "h2", "vec")
        dense = chunked.groupBy(*cell, "chunk").applyInArrow(_places(threshold, kind), f"label {label}, dim int, key int, n long, held long, place binary")
        places = dense.groupBy(cell).applyInArrow(_directions(threshold), f"label {label}, dim int, n long, place binary").orderBy(F.desc("n"), "place").collect() if sizes.count() else []
        by_label: dict[tuple, list] = {}
        for number, r in enumerate(places):
            by_label.setdefault((r["label"], r["dim"]), []).append((number, np.frombuffer(r["place"])))
        if places:
            put = {k: (np.array([m for m, _ in v]), np.array([p for _, p in v])) for k, v in by_label.items()}
            bare, reps = reps, scratch(reps.mapInArrow(lean(_balls(put, threshold, kind)), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema) + ", ball int"))
            drop(bare)
            held = reps.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("all"), F.min("rep").alias("root"))
            found = reps.where("ball >= 0").join(F.broadcast(held), "ball").select("entry", "rep", (F.col("all") - F.col("copies")).alias("n"), "root")
        else:
            reps, found = reps.withColumn("ball", F.lit(-1)), None
        for t in range(max([v[1] for v in plans.values()], default=1)):
            s = reps.where(F.size("keys") > t).select("label", "dim", F.col("keys")[t].alias("key"), F.slice("keys", 1, t).alias("before"), "entry", "rep", "copies", "ball", "vec")
            # a bucket of more rows than a block has is cut into chunks, each ball and the rest apart; chunks of one ball don't meet
            units = s.groupBy(*cell, "ball").agg(F.count("*").alias("n"), F.first(rows_of).alias("rows")).groupBy(cell).agg(F.sum("n").alias("n"), F.first("rows").alias("rows"), F.collect_list(F.struct("ball", F.ceil(F.col("n") / F.col("rows")).cast("int").alias("own"))).alias("units"))
            hot = units.where("n > rows").select(*cell, "units", F.inline("units")).select(*cell, "ball", "own", F.expr("aggregate(units, 0, (s, u) -> s + u.own)").alias("chunks"), F.expr("aggregate(filter(units, u -> u.ball < ball), 0, (s, u) -> s + u.own)").alias("start"))
            s = s.join(F.broadcast(hot), [*cell, "ball"], "left")
            s = s.withColumn("chunk", F.coalesce(F.col("start") + F.pmod(F.xxhash64("entry"), F.col("own")).cast("int"), F.lit(0)))
            s = s.withColumn("other", F.explode(F.expr("case when chunks is null then array(0) else filter(sequence(0, chunks - 1), o -> ball < 0 or o < start or o >= start + own) end")))
            s = s.select(*cell, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "before", "entry", "rep", "copies", "ball", "vec")
            got = scratch(s.groupBy(*cell, "i", "j").applyInArrow(_block(threshold, kind), "entry long, rep long, n long, root long"))
            found = got if found is None else found.unionByName(got)
        groups = connected_components(found.select("rep", "root"), "rep", "root")
    links = found.groupBy("entry").agg(F.sum("n").alias("n"))
    entry = reps.select("entry", "h1", "h2", "rep", "copies").join(links, "entry", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    entry = entry.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = usable.select("id", "h1", "h2").join(entry, ["h1", "h2"]).select("id", F.col("n").alias("n_links"), "component")
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
