"""Documents to chunks: units, offsets, grouping, windows, budgets and context packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import count_tokens
from lodestar.sources.storage import ship_package


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, unit, start, end): the lines of a text with their code point offsets."""
    d = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "unit"))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("unit") + 1).over(before), F.lit(0))
    return d.select("doc", "pos", "unit", start.alias("start"), (start + F.length("unit")).alias("end"))


def _chunk_lines(sizes: list[int], low: int, high: int, tiny: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first unit, end unit, window) of each chunk: groups of units, large ones cut to overlapping windows."""
    groups: list[list[int]] = []
    for i, n in enumerate(sizes):
        if groups and groups[-1][2] < low and groups[-1][2] + n <= high:
            groups[-1][1] = i + 1
            groups[-1][2] += n
        else:
            groups.append([i, i + 1, n])
    if len(groups) >= 2 and groups[-1][2] < tiny and groups[-2][2] + groups[-1][2] <= high:
        last = groups.pop()
        groups[-1][1], groups[-1][2] = last[1], groups[-1][2] + last[2]
    out = []
    for lo, hi, total in groups:
        if total <= high:
            out.append((lo, hi, 0))
            continue
        at, window = lo, 0
        while True:
            end, n = at, 0
            while end < hi and (end == at or n + sizes[end] <= high):
                n += sizes[end]
                end += 1
            out.append((at, end, window))
            if end >= hi:
                break
            at, window = max(end - overlap, at + 1), window + 1
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 200, high: int = 500, tiny: int = 60, overlap: int = 1) -> DataFrame:
    """(chunk_id, doc, start, end, n_tokens, text): a chunk's text is the document's between its offsets.

    The fold is stateful along a document, so it runs in Python; a document is one row, and rows are
    independent: no shuffle.
    """
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("lines", F.split("text", "\n")).withColumn("sizes", F.transform("lines", lambda x: count_tokens(x).cast("int"))).withColumn("widths", F.transform("lines", F.length)).drop("lines")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, sizes, widths in frame.itertuples(index=False):
                starts = [0]
                for w in widths:
                    starts.append(starts[-1] + int(w) + 1)
                for n, (lo, hi, window) in enumerate(_chunk_lines([int(s) for s in sizes], low, high, tiny, overlap)):
                    a, b = starts[lo], starts[hi] - 1
                    rows.append((f"{doc}:{lo}:{n}", doc, window, a, b, int(sum(sizes[lo:hi])), text[a:b]))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc", "window", "start", "end", "n_tokens", "text"])

    return d.mapInPandas(run, "chunk_id string, doc string, window int, start long, end long, n_tokens int, text string")


def context_pack(ranked: DataFrame, budget: int, floor: int = 80, share: float = 0.7) -> DataFrame:
    """(qid, pos, take) from (qid, pos, n): whole items while the sum fits, then a part of the first that doesn't, then nothing.

    A part has 70 % of the room left, if more than ``floor`` is left.
    """
    w = Window.partitionBy("qid").orderBy("pos")
    d = ranked.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.max((F.col("upto") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    left = budget - (F.col("upto") - F.col("n"))
    take = F.when(F.coalesce(over, F.lit(0)) == 1, 0).when(F.col("upto") <= budget, F.col("n")).when(left > floor, F.floor(left * share)).otherwise(0)
    return d.withColumn("take", take.cast("long")).where("take > 0").select("qid", "pos", "take")


def budget_fold(items: Column, budget: int) -> Column:
    """Greedy selection that skips what doesn't fit: array<struct<id, n, must>> in order -> array of kept ids."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.filter(F.transform(items, lambda x: x["id"]), lambda _: F.lit(False)).alias("ids"))

    def step(a: Column, x: Column) -> Column:
        fits = x["must"] | (a["used"] + x["n"] <= budget)
        return F.struct((a["used"] + F.when(fits, x["n"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(a["ids"], F.array(x["id"]))).otherwise(a["ids"]).alias("ids"))

    return F.aggregate(items, zero, step)["ids"]


def page_parts(pages: DataFrame) -> DataFrame:
    """(page_id, title, paragraphs, links) by patterns, for pages whose blocks are plainly marked."""
    html = F.col("html")
    title = F.regexp_replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), "&amp;", "&")
    paragraphs = F.regexp_count(html, F.lit("<p>"))
    return pages.select("page_id", title.alias("title"), paragraphs.cast("long").alias("n_paragraphs"), F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)).alias("links"))
