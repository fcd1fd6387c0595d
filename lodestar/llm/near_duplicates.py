"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. Weights. A shingle is five words in a row (all words of a shorter text); it weighs its count in
   the text times the mean IDF of its words. Document frequencies of words are counted over all
   documents, in 2^18 hashed buckets: a table of fixed size. A shingle's own frequency would weigh
   down what copies share and so miss large groups of copies; its words' frequencies do not.
2. Sampling. Improved consistent weighted sampling draws 30 shingles for each text; two texts draw
   the same one with the probability of their weighted Jaccard similarity. Its random triples
   come from a table of 2^16 that each draw enters by a hash of its own.
3. Bands of 3 draws, ten of them: texts at 0.8 share a band with probability 0.9992.
4. Candidates. In a bucket of at most 8 different texts each is compared with each. In a larger one
   each is first compared with ``leaders`` of its members, drawn by hashes, which proves most groups
   of copies. Buckets that still hold several groups are then compared whole: their members are
   dealt into blocks of bounded size, and each pair of blocks is one small task that compares all
   pairs of texts of different groups, so no pair of a bucket rests on the draw of leaders.
   Members that no text of another group resembles by its draws leave before shingles are read.
5. Verification. A pair whose draws agree in at least half the places (0.8 misses that with a
   probability below 1e-4) is linked if its exact weighted Jaccard similarity is 0.8 or more.
6. Classes are the components of links and exact copies; the least id is a class's representative.

No text is shuffled: passes over the documents yield draws of 60 bytes and, only for texts that
share a bucket, shingle lists. Equal texts are one entry from the start, and their classes come
from an equi-join on the text's digest.

Edge cases: a null text is an empty one; texts without words link with equal texts only; equal
texts are one class; rows of one id, null being one, each belong to the class of their text, and the row of a class's
least id is kept; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, scratch, ship_package, text_of
from lodestar.operators.components import connected_components

DF_BUCKETS = 1 << 18
BANDS, ROWS = 10, 3
DRAWS = BANDS * ROWS
#: Shingles of a block, about: 6 MB.
BLOCK_SHINGLES = 1 << 19
#: Stands for a null id.
NO_ID = -(1 << 63)
MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 part of a word, 2 a mark."""
    kinds = np.full(0x110000, 2, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((0, r"\s+"), (1, r"\w+")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def token_hashes(text: str, marks: bool) -> np.ndarray:
    """64-bit hashes of the words in order, and of the runs of marks if asked for, all computed at once: a polynomial of the code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    inside = kind > 0 if marks else kind == 1
    starts = np.flatnonzero(inside & (kind != np.concatenate([np.zeros(1, np.uint8), kind[:-1]])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(codes))
    place -= place[starts][np.maximum(np.cumsum(np.bincount(starts, minlength=len(codes))) - 1, 0)]
    terms = np.where(inside, (codes.astype(np.uint64) + np.uint64(1)) * _powers(int(place[inside].max()) + 1)[np.where(inside, place, 0)], np.uint64(0))
    h = np.add.reduceat(terms, starts)
    h ^= h >> np.uint64(31)
    h *= MULTIPLIERS[50]
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    return token_hashes((text or "").lower(), marks=False)


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, at least n of them."""
    while len(_POWERS[0]) < n:
        p = _POWERS[0]
        _POWERS[0] = np.concatenate([p, p * (p[-1:] * MULTIPLIERS[49:50])])
    return _POWERS[0]


def shingles(hashes: np.ndarray, idf: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes, ascending, and their weights."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    size = min(size, n)
    own = idf[(hashes % np.uint64(DF_BUCKETS)).astype(np.int64)]
    mixed, weight = np.zeros(n - size + 1, np.uint64), np.zeros(n - size + 1)
    for i in range(size):
        part = slice(i, n - size + 1 + i)
        mixed = (mixed ^ hashes[part]) * MULTIPLIERS[40 + i]
        mixed ^= mixed >> np.uint64(29)
        weight += own[part]
    distinct, first, counts = np.unique(mixed, return_index=True, return_counts=True)
    return distinct, (weight[first] / size * counts).astype(np.float32)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and c ~ Gamma(2, 1), beta uniform: the triples of consistent weighted sampling (ln c is kept)."""
    rng = np.random.default_rng(29)
    return rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16).astype(np.float32)


R, LN_C, BETA = _tables()
INV_R = (1 / R).astype(np.float32)


def draws(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, DRAWS) of 16-bit names of the drawn shingles. No set may be empty."""
    lengths = np.array([len(h) for h, _ in sets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = np.concatenate([x for x, _ in sets])
    ln_w = np.log(np.maximum(np.concatenate([w for _, w in sets]), 1e-9)).astype(np.float32)
    out = np.empty((len(sets), DRAWS), np.uint16)
    top = np.uint64((1 << 64) - 1)
    for k in range(DRAWS):
        mixed = h * MULTIPLIERS[k]
        at = (mixed >> np.uint64(48)).astype(np.int64)
        r = R[at]
        t = np.floor(ln_w * INV_R[at] + BETA[at])
        a = LN_C[at] - r * (t - BETA[at] + 1)
        hit = a == np.repeat(np.minimum.reduceat(a, starts), lengths)
        name = (mixed ^ (t.astype(np.int64).astype(np.uint64) * MULTIPLIERS[60])) * MULTIPLIERS[61]
        out[:, k] = (np.minimum.reduceat(np.where(hit, name, top), starts) >> np.uint64(48)).astype(np.uint16)
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low, high = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64), a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)
    return float(low / (high - low)) if high > 0 else 0.0


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per bucket of words, documents), counted over all rows of (text). At most 2^18 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                hashes = word_hashes(text)
                if len(hashes):
                    total[np.unique((hashes % np.uint64(DF_BUCKETS)).astype(np.int64))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *total[at]], pa.int64())], names=["b", "n"])

    got = docs.select("text").mapInArrow(lean(run), "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DF_BUCKETS, np.int64)
    words = got[got["b"] >= 0]
    df[words["b"].to_numpy(dtype=np.int64)] = words["n"].to_numpy(dtype=np.int64)
    return df, int(got.loc[got["b"] < 0, "n"].sum())


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / (1.0 + df)).astype(np.float32)


def _draw_pass(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                sets = [shingles(word_hashes(x), table) for x in texts]
                full = [i for i, (h, _) in enumerate(sets) if len(h)]
                names: list[bytes | None] = [None] * len(texts)
                if full:
                    for i, row in zip(full, draws([sets[i] for i in full]), strict=True):
                        names[i] = row.tobytes()
                digest = [hashlib.md5(x.encode("utf-8", "replace")).digest() for x in texts]
                key = pa.array(np.frombuffer(b"".join(digest), np.int64)[::2])
                yield pa.RecordBatch.from_arrays([batch.column(0), key, pa.array(digest, pa.binary()), pa.array(names, pa.binary())], names=["doc", "id", "digest", "draws"])

    return run


def _shingle_pass(idf, wanted):
    """(id, h, w, size) of the texts in (id, text) whose place p in the bitmap is set; of all texts without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bitmap = idf.value, wanted.value if wanted else None
        for whole in batches:
            if bitmap is not None:
                key = whole.column(2).to_numpy()
                whole = whole.filter(pa.array((bitmap[key >> 3] >> (key & 7)) & 1 == 1))
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(word_hashes(x), table) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array([w.tobytes() for _, w in sets], pa.binary()), pa.array([len(h) for h, _ in sets], pa.int32())], names=["id", "h", "w", "size"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a, b = ((np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(k + 1)[i].as_buffer(), np.float32)) for k in (2, 4))
                low, high = sorted((float(a[1].sum(dtype=np.float64)), float(b[1].sum(dtype=np.float64))))
                if high > 0 and low / high >= threshold and weighted_jaccard(a, b) >= threshold:
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return run


def _agreeing() -> Column:
    """How many of the draws da and db agree."""
    place = F.sequence(F.lit(1), F.lit(2 * DRAWS - 1), F.lit(2))
    return F.size(F.filter(place, lambda i: F.substring("da", i, F.lit(2)) == F.substring("db", i, F.lit(2))))


def _candidates(rows: DataFrame, leaders: int, small: int) -> tuple[DataFrame, DataFrame]:
    """(rows of buckets with several groups, with their number n; pairs (a, b) of different groups) from (key, id, group)."""
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 != g2").select("key", "n")
    own = scratch(rows.join(mixed, "key"))
    few = own.where(F.col("n") <= small).groupBy("key").agg(F.collect_list(F.struct("id", "group")).alias("m"))
    few = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.id < y.id and x.group != y.group").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = own.where(F.col("n") > small)
    drawn_by = [F.min(F.struct(F.xxhash64("group", F.lit(j)).alias("h"), F.xxhash64("id", F.lit(j)).alias("k"), "id", "group")) for j in range(leaders)]
    led = large.groupBy("key").agg(F.array_distinct(F.transform(F.array(*drawn_by), lambda x: F.struct(x["id"].alias("to"), x["group"].alias("to_group")))).alias("leaders"))
    many = large.join(led, "key").select("id", "group", F.inline("leaders")).where("group != to_group").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
    return own, few.unionByName(many)


def _block_pairs(rows: DataFrame, size: DataFrame) -> DataFrame:
    """Rows of (key, id, ...), once for each pair (x, y) of blocks of their key that they take part in; ``size`` is (key, blocks). Each pair of rows of a key meets in one pair of blocks."""
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    dealt = rows.join(size, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other")


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of the first block, places of the second, whether they are one block)."""
    own, x, y = (t.column(c).to_numpy() for c in ("own", "x", "y"))
    return np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0]), bool(x[0] == y[0])


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, DRAWS)


def _resembled(least: float):
    """Members (key, id) of a pair of blocks whose draws agree with those of a text of another group."""

    def run(t: pa.Table) -> pa.Table:
        left, right, _ = _sides(t)
        group, d, found = t.column("group").to_numpy(), _stacked(t.column("draws")), np.zeros(t.num_rows, bool)
        for a in left:
            hit = right[(group[right] != group[a]) & ((d[right] == d[a]).sum(1) >= least * DRAWS)]
            found[hit] = True
            found[a] |= len(hit) > 0
        return t.select(["key", "id"]).filter(pa.array(found))

    return run


def _block_links(threshold: float, least: float):
    """Links (a, b) of a pair of blocks: all pairs of different groups are compared exactly, and a link merges two groups."""

    def run(t: pa.Table) -> pa.Table:
        left, right, one = _sides(t)
        ids, d = t.column("id").to_numpy(), _stacked(t.column("draws"))
        group = np.unique(t.column("group").to_numpy(), return_inverse=True)[1]
        hashes = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
        w = np.frombuffer(b"".join(t.column("w").to_pylist()), np.float32)
        lengths = np.array([len(x) for x in hashes])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = np.add.reduceat(w, starts, dtype=np.float64)
        names, at = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.zeros(len(names), np.float32)
        links: list[tuple[int, int]] = []
        for a in left:
            other = right[group[right] != group[a]]
            other = other[other > a] if one else other
            other = other[np.minimum(total[other], total[a]) >= threshold * np.maximum(total[other], total[a])]
            other = other[(d[other] == d[a]).sum(1) >= least * DRAWS]
            if not len(other):
                continue
            mine = at[starts[a] : ends[a]]
            own[mine] = w[starts[a] : ends[a]]
            # the others' lists, end to end
            from_ = np.cumsum(lengths[other]) - lengths[other]
            place = np.arange(lengths[other].sum()) + np.repeat(starts[other] - from_, lengths[other])
            low = np.add.reduceat(np.minimum(own[at[place]], w[place]), from_, dtype=np.float64)
            own[mine] = 0
            for b in other[low >= threshold * (total[a] + total[other] - low)]:
                if group[b] != group[a]:
                    links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                    group[group == group[b]] = group[a]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _digest_key(text: Column) -> Column:
    """The first eight bytes of a text's MD5 as a little-endian whole number: its key wherever texts are compared."""
    h = F.md5(F.encode(text, "UTF-8"))
    turned = F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    high, low = (F.conv(F.substring(turned, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, leaders: int = 2, small: int = 8, block: int = 512, map_bits: int = 24) -> DataFrame:
    """(id, class_id, kept) for each row: the least id of its class, and whether it is that one. A block has about ``block`` texts, fewer where they are long."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(idf_of(*word_frequencies(d)))  # 1 MB
    drawn = scratch(d.mapInArrow(lean(_draw_pass(idf)), "doc long, id long, digest binary, draws binary"))
    copies = drawn.groupBy("digest").agg(F.min("doc").alias("rep"), F.min("id").alias("id"))
    texts = scratch(drawn.where("draws is not null").groupBy("digest").agg(F.min(F.struct("id", "draws")).alias("x")).select("x.*"), even=True)
    draw = lambda i, n=1: F.substring("draws", 2 * i + 1, 2 * n)
    keys = F.array(*[F.xxhash64(F.lit(b), draw(ROWS * b, ROWS)) for b in range(BANDS)])
    shared, pairs = _candidates(texts.select("id", F.col("id").alias("group"), F.explode(keys).alias("key")), leaders, small)
    asked = shared.select("id").distinct()
    whole = d.select(_digest_key(F.col("text")).alias("id"), "text")
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - map_bits).cast("int")
    if asked.count() <= 1 << (map_bits - 2):  # a bitmap of fixed size; strays that hash alike are filtered by the joins below
        bits = asked.select(place(F.col("id")).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 31)")).alias("b")).toPandas()
        bitmap = np.zeros(max(1, 1 << max(0, map_bits - 5)), np.uint32)
        bitmap[bits["w"].to_numpy(dtype=np.int64)] = bits["b"].to_numpy(dtype=np.uint64).astype(np.uint32)
        wanted = spark.sparkContext.broadcast(bitmap.view(np.uint8))  # 2 MB
        whole = whole.withColumn("p", place(F.col("id")))
    else:  # more texts than it tells apart: they are picked by a join
        wanted, whole = None, whole.join(asked, "id", "left_semi")
    lists = whole.mapInArrow(lean(_shingle_pass(idf, wanted)), "id long, h binary, w binary, size int")
    lists = scratch(lists.dropDuplicates(["id"]))

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("id").alias(c), F.col("draws").alias(f"d{c}")) for c in "ab")
        pairs = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "da", "db")
        pairs = pairs.where(_agreeing() >= 0.5 * DRAWS).select("a", "b")
        one, two = (lists.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"), F.col("w").alias(f"w{c}")) for c in "ab")
        full = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "wa", "hb", "wb")
        return scratch(full.mapInArrow(lean(_verify(threshold)), "a long, b long"))

    links = verified(pairs)
    # two rounds give nearly the components; buckets that still hold several groups are compared whole
    groups = connected_components(links, "a", "b", rounds=2).withColumnRenamed("node", "id")
    large = shared.where(F.col("n") > small).select("key", "id", "n").join(groups, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("group"))
    mixed = large.groupBy("key").agg(F.ceil(F.first("n") / block).alias("blocks"), F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 != g2").select("key", "blocks")
    members = large.select("key", "id", "group").join(texts, "id")
    near = _block_pairs(members, mixed).groupBy("key", "x", "y").applyInArrow(_resembled(0.5), "key long, id long").distinct()
    members = scratch(members.join(near, ["key", "id"]).join(lists.select("id", "size"), "id"))
    blocks = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    whole = _block_pairs(members.drop("size"), blocks).join(lists.drop("size"), "id")
    links = links.unionByName(scratch(whole.groupBy("key", "x", "y").applyInArrow(_block_links(threshold, 0.5), "a long, b long")))
    classes = connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    entry = copies.join(classes, "id", "left").select("digest", "rep", "component")
    least = entry.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    entry = entry.join(least, "component", "left").select("digest", F.coalesce("least", "rep").alias("class_id"))
    out = drawn.select(F.col("doc").alias("id"), "digest").join(entry, "digest")
    given = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(given("id").alias(id_col), given("class_id").alias("class_id"), (F.col("id") == F.col("class_id")).alias("kept"))
