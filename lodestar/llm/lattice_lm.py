"""Language-model scoring by subword lattice likelihood.

Model. Tokens are words (ASCII letters in lower case) and one end per text. A word's probability
is the sum over all ways to cut it: as a whole, by its count in the training texts less a discount,
and, with the mass that the discounts leave, into pieces of an existing subword vocabulary, all of
its segmentations weighted by the pieces' probabilities. That sum is a forward recursion in log
space over the word's lattice. A text's words are independent, so its lattice is the chain of
theirs, and its log probability the sum. Piece probabilities come from the training words as the
vocabulary itself cuts them; each piece keeps half a count, and characters that no piece has are spelt in bytes. All adds up to one
over all texts.

Base. The sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))).

Scale. Words are counted per task, in a table that is emptied into the shuffle when it is full, then added up:
the table of words grows with the corpus and stays distributed. The ``head`` most frequent words (a fixed
number) go to every task; the rest of a text's words meet the word table in one equi-join, which
no frequent word can skew, for those are in the head.

Edge cases: a null text is an empty one and has the end alone; a word that is in held-out texts
only counts 0 and is spelt in pieces; repeated rows are texts of their own; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, lean, scratch, ship_package

FIND = re.compile(WORD)
END = "\n"
DISCOUNT = 0.75
LOWER = {c: c + 32 for c in range(65, 91)}


def fold(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(LOWER)


class Lattice:
    """log10 probabilities of words, spelt in the pieces given with their log10 probabilities."""

    def __init__(self, pieces: dict[str, float]):
        self.bytes = [pieces.get(f"<0x{b:02X}>", -8.0) for b in range(256)]
        self.pieces = {p: v for p, v in pieces.items() if not re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        self.longest = max(map(len, self.pieces), default=1)
        self.first = {p[0] for p in self.pieces}

    def log10(self, word: str) -> float:
        return self.each([word])[0]

    def each(self, words: list[str]) -> list[float]:
        """Log-space forward recursion: at[j] is the log10 probability of all ways to spell the first j characters.

        What a word shares with the one before it is not computed again, so sorted words are the quickest.
        """
        get, longest, pieces, spelt = self.pieces.get, self.longest, self.pieces, self.bytes
        log10, out, before, at = math.log10, [], "", [0.0]
        for word in words:
            s = "\u2581" + word
            n, same = len(s), 0
            for x, y in zip(s, before):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                same += 1
            del at[same + 1 :]
            before = s
            for j in range(same + 1, n + 1):
                ways = []
                for i in range(j - longest if j > longest else 0, j):
                    p = get(s[i:j])
                    if p is not None:
                        ways.append(p + at[i])
                if s[j - 1] not in pieces:  # spelt in bytes
                    ways.append(at[j - 1] + sum([spelt[b] for b in s[j - 1].encode("utf-8", "replace")]))
                if len(ways) == 1:
                    at.append(ways[0])
                else:
                    best = max(ways)
                    at.append(best + log10(sum([10.0 ** (p - best) for p in ways])))
            out.append(at[n])
        return out


def count_words(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c): each word's count in rows of (text, train); 0 for words of held-out texts only. END counts training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: set = set()
        ends = 0

        def flush() -> pa.RecordBatch:
            folded: Counter = Counter()
            for w, c in train.items():
                folded[fold(w)] += c
            for w in held:
                folded[fold(w)] += 0
            train.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(folded), pa.string()), pa.array(list(folded.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if learn:
                    ends += 1
                    train.update(FIND.findall(text or ""))
                else:
                    held.update(FIND.findall(text or ""))
                if len(train) + len(held) > most:
                    yield flush()
        train[END] += ends
        yield flush()

    return docs.select("text", "train").mapInArrow(lean(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, model: bytes) -> dict[str, float]:
    """log10 probabilities of the vocabulary's pieces, from (word, c). At most a row per piece comes to the driver."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total: Counter = Counter()
        for batch in batches:
            kept = [(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if c > 0 and w != END]
            for ids, (_, c) in zip(sp.encode([w for w, _ in kept], num_threads=1), kept, strict=True):
                for i in ids:
                    total[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    counts = {r["piece"]: r["n"] for r in words.mapInArrow(lean(run), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    usable = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    total = sum(counts.get(i, 0) + 0.5 for i in usable)
    return {sp.id_to_piece(i): math.log10((counts.get(i, 0) + 0.5) / total) for i in usable}


def score_documents(docs: DataFrame, model: bytes, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = 50_000) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    model is a sentencepiece model's content: its pieces are the vocabulary. It is broadcast; 64 MB bound it.
    """
    spark = docs.sparkSession
    if len(model) > 64 << 20:
        raise ValueError("a model of more than 64 MB is not broadcast")
    ship_package(spark)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = scratch(count_words(d.withColumn("train", ~F.col("held_out"))))
    lattice = spark.sparkContext.broadcast(fit_pieces(counted, model))  # a few MB: the vocabulary's size

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Lattice(lattice.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(machine.each(batch.column(0).to_pylist()), pa.float64())], names=["word", "c", "spelt"])

    words = scratch(counted.sortWithinPartitions("word").mapInArrow(lean(spell), "word string, c long, spelt double").withColumn("spelt", F.when(F.col("word") == END, 0.0).otherwise(F.col("spelt"))))
    known = F.col("c") > 0
    got = words.agg(F.sum("c").alias("n"), F.count_if(known).alias("v"), F.sum(F.when(known & (F.col("word") != END), F.least(F.col("c").cast("double"), F.lit(DISCOUNT)))).alias("left")).first()
    n, v, left = got["n"] or 0, got["v"], got["left"] or 0.0
    floor = n + 0.5 * (v + 1)
    free = left / n if n else 1.0

    def values(word: str, c: int, spelt: float) -> tuple[float, float, int]:
        base = math.log10((c + 0.5) / floor)
        if word == END:
            return base, math.log10(c / n) if c else 0.0, int(c > 0)
        whole = max(0.0, c - DISCOUNT) / n if n else 0.0
        spelt += math.log10(free) if free else -math.inf
        return base, spelt + math.log10(1 + whole * 10.0**-spelt) if spelt > -300 else math.log10(whole) if whole else spelt, int(c > 0)

    top = words.where(F.col("word") == END).unionByName(words.where(F.col("word") != END).orderBy(F.col("c").desc(), "word").limit(head))
    frequent = spark.sparkContext.broadcast({r["word"]: values(*r) for r in top.collect()})  # head + 1 words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        end = table.get(END) or values(END, 0, 0.0)
        memo: dict[str, tuple | str] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                cols: list[list] = [[] for _ in range(5)]
                for text in batch.column(2).to_pylist():
                    seen = FIND.findall(text)
                    base, score, hits = end
                    tail = []
                    for w in seen:
                        x = memo.get(w)
                        if x is None:
                            if len(memo) > 300_000:
                                memo.clear()
                            f = fold(w)
                            x = memo[w] = table.get(f, f)
                        if type(x) is str:
                            tail.append(x)
                        else:
                            base += x[0]
                            score += x[1]
                            hits += x[2]
                    for col, value in zip(cols, (len(seen) + 1, hits, base, score, tail), strict=True):
                        col.append(value)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=["id", "held_out", "n_tokens", "hits", "base", "score", "tail"])

    kind = docs.schema[id_col].dataType.simpleString()
    parts = scratch(d.mapInArrow(lean(read), f"id {kind}, held_out boolean, n_tokens long, hits long, base double, score double, tail array<string>").withColumn("row", F.monotonically_increasing_id()))
    rest = parts.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    c = F.col("c").cast("double")
    # log10(whole + free * spelt), kept in logs for words that are only spelt
    spelt = F.col("spelt") + F.lit(math.log10(free) if free else -1e9)
    whole = F.greatest(c - DISCOUNT, F.lit(0.0)) / F.lit(float(n or 1))
    score = F.when(whole > 0, F.log10(whole + F.pow(F.lit(10.0), spelt))).otherwise(spelt)
    rest = rest.join(words, "word").groupBy("row").agg(
        F.sum(F.col("k") * F.log10((c + 0.5) / F.lit(floor))).alias("base2"), F.sum(F.col("k") * score).alias("score2"), F.sum(F.when(known, F.col("k")).otherwise(0)).alias("hits2")
    )
    out = parts.drop("tail").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", plus("hits", "hits2").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), plus("score", "score2").alias("score"),
    )
