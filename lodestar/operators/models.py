"""Language models and rerankers behind small interfaces: requests as columns, replies checked, scorers by name.

A client is a picklable object whose ``complete(requests)`` turns request JSON strings into reply strings; it runs in
the workers, batch by batch. Stand-ins that need no model serve tests and queries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import search_tokens
from lodestar.sources.storage import ship_package


def request(model: str, system: str, user: Column, schema: str, most: int, context: int = 4096) -> Column:
    """The canonical JSON of a request at temperature 0 whose reply must fit a schema."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    parts = [F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(0.0).alias("temperature"), F.lit(context).alias("num_ctx"), F.lit(most).alias("max_tokens"), F.lit(schema).alias("schema")]
    return F.to_json(F.struct(*parts))


def extraction_prompt(title: Column, heading: Column, text: Column) -> Column:
    """What a model sees of a chunk: its title and heading, then the text."""
    return F.concat(F.lit("Title: "), title, F.lit("\nSection: "), heading, F.lit("\n\n"), text)


def sources_prompt(question: Column, chunks: Column) -> Column:
    """A question under its sources, array<struct<id, text>>, each under its id in brackets."""
    shown = F.transform(chunks, lambda c: F.concat(F.lit("["), c["id"], F.lit("]\n"), c["text"]))
    return F.concat(F.array_join(shown, "\n\n"), F.lit("\n\nQuestion: "), question)


def complete(df: DataFrame, request_col: str, client, required: tuple[str, ...], tries: int = 2) -> DataFrame:
    """df with reply (JSON, or null), error and calls: a reply that isn't an object with the required names is asked for once more.

    A failed call leaves a null reply: what depends on it fails closed.
    """
    ship_package(df.sparkSession)
    schema = df.schema

    def fits(reply: str | None) -> bool:
        try:
            got = json.loads(reply or "")
        except ValueError:
            return False
        return isinstance(got, dict) and all(n in got for n in required)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked, reply, error, calls = list(frame[request_col]), [None] * len(frame), [None] * len(frame), [0] * len(frame)
            left = list(range(len(frame)))
            for k in range(tries):
                if not left:
                    break
                try:
                    said = client.complete([asked[i] if k == 0 else asked[i] + "\nReply with JSON only." for i in left])
                except Exception as e:  # a model that is down
                    said = [None] * len(left)
                    for i in left:
                        error[i] = str(e)[:300]
                for i, s in zip(left, said, strict=True):
                    calls[i] += 1
                    if fits(s):
                        reply[i], error[i] = s, None
                left = [i for i in left if reply[i] is None]
            for i in left:
                error[i] = error[i] or "no valid reply"
            yield frame.assign(reply=reply, error=error, calls=calls)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.mapInPandas(run, f"{fields}, reply string, error string, calls int")


class Echo:
    """A stand-in: replies with the length of the request; the first time for every ``odd``-th it talks instead."""

    def __init__(self, odd: int = 0):
        self.odd = odd

    def complete(self, requests: list[str]) -> list[str]:
        return ["let me think" if self.odd and len(r) % self.odd == 0 and not r.endswith("JSON only.") else json.dumps({"n": len(r)}) for r in requests]


#: Rerankers by name: (question, text) -> score. A cross-encoder is one more entry, a pandas UDF of the same two columns.
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {}


def reranker(name: str):
    def add(f: Callable[[Column, Column], Column]):
        RERANKERS[name] = f
        return f

    return add


@reranker("lexical")
def _lexical(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has."""
    q = F.array_distinct(search_tokens(question))
    return F.size(F.array_intersect(q, search_tokens(text))) / F.greatest(F.size(q), F.lit(1))


@reranker("phrase")
def _phrase(question: Column, text: Column) -> Column:
    """The lexical share, and one half more where the text holds the question as it is."""
    return RERANKERS["lexical"](question, text) + F.when(F.contains(text, question), 0.5).otherwise(0.0)


class DistMult:
    """Vectors of nodes and relations whose three-way product scores a triple; Adam on the logistic loss with random tails."""

    def __init__(self, nodes: int, relations: int, dim: int = 32, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        bound = lambda n: np.sqrt(6 / (n + dim))
        self.e = self.rng.uniform(-bound(nodes), bound(nodes), (nodes, dim))
        self.r = self.rng.uniform(-bound(relations), bound(relations), (relations, dim))

    def score(self, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (self.e[h] * self.r[r] * self.e[t]).sum(1)

    def fit(self, h: np.ndarray, r: np.ndarray, t: np.ndarray, epochs: int = 200, rate: float = 0.01) -> DistMult:
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.e, self.r)]
        for step in range(1, epochs + 1):
            hs, rs = np.concatenate([h, h]), np.concatenate([r, r])
            ts = np.concatenate([t, self.rng.integers(0, len(self.e), len(t))])
            y = np.concatenate([np.ones(len(t)), np.zeros(len(t))])
            g = ((1 / (1 + np.exp(-self.score(hs, rs, ts))) - y) / len(y))[:, None]
            ge, gr = np.zeros_like(self.e), np.zeros_like(self.r)
            np.add.at(ge, hs, g * self.r[rs] * self.e[ts])
            np.add.at(ge, ts, g * self.r[rs] * self.e[hs])
            np.add.at(gr, rs, g * self.e[hs] * self.e[ts])
            for p, d, (m, v) in zip((self.e, self.r), (ge, gr), state, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def distmult_scores(e: DataFrame, rel: str, sample: int = 200_000, epochs: int = 200, rate: float = 0.01, **options) -> DataFrame:
    """(src, dst, score) of the relation's heads against its tails' known pairs, by a model fitted on at most ``sample`` edges (the first by hash).

    Vectors of the sampled nodes come to the driver, so the bound is also one of memory; nodes outside the sample have no score.
    """
    got = e.select("src", "rel", "dst").distinct().orderBy(F.xxhash64("src", "rel", "dst"), "src", "dst").limit(sample).toPandas()
    nodes = {n: i for i, n in enumerate(sorted(set(got["src"]) | set(got["dst"])))}
    rels = {n: i for i, n in enumerate(sorted(set(got["rel"]) | {rel}))}
    m = DistMult(max(1, len(nodes)), len(rels), **options)
    if len(got):
        m.fit(got["src"].map(nodes).to_numpy(), got["rel"].map(rels).to_numpy(), got["dst"].map(nodes).to_numpy(), epochs, rate)
    own = got[got["rel"] == rel]
    score = m.score(own["src"].map(nodes).to_numpy(dtype=int), np.full(len(own), rels[rel]), own["dst"].map(nodes).to_numpy(dtype=int))
    return e.sparkSession.createDataFrame(pd.DataFrame({"src": own["src"], "dst": own["dst"], "score": score}), "src string, dst string, score double")
