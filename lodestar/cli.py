"""Commands over tables: python -m lodestar.cli GROUP COMMAND ... (see --help)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lodestar.operators import articles as A
from lodestar.operators import extraction as X
from lodestar.operators import knowledge as K
from lodestar.operators import search as S
from lodestar.operators.ontology import Ontology
from lodestar.session import build
from lodestar.sources import tables as I


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    groups = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **more: str) -> None:
        c = groups.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in more.items():
            c.add_argument(f"--{k}", default=v, type=type(v))

    add("ingest-parse", "pages", "out", ontology="")
    add("ingest-chunk", "articles", "out")
    add("ingest-links", "articles", "chunks", "out", pattern=r"/(\d+)(?:$|[/?#])")
    add("kg-build", "records", "out", ontology="")
    add("kg-stats", "nodes", "edges")
    add("index-build", "documents", "out")
    add("bench-run", "questions", "documents", "out", k=8)
    add("query", "name", "folder", "out")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build("lodestar")
    read = spark.read.parquet
    ontology = Ontology.load(spark, a.ontology) if getattr(a, "ontology", "") else Ontology()
    write = lambda d, path: d.write.mode("overwrite").parquet(path)
    if a.command == "ingest-parse":
        write(A.articles(read(a.pages), ontology=ontology), a.out)
    elif a.command == "ingest-chunk":
        c = A.chunks(read(a.articles))
        write(c, a.out)
        A.size_summary(read(a.out)).show()
    elif a.command == "ingest-links":
        write(A.attach_chunks(A.links_in_corpus(read(a.articles), a.pattern), read(a.chunks)), a.out)
    elif a.command == "kg-build":
        r = read(a.records)  # (chunk, record, seen, ts, model)
        raw = X.relations(r, ontology)
        kept = X.validate(raw.where("rel != ''"), r).where("reason = 'kept'").join(r.select("chunk", "ts", "model"), "chunk")
        for name, d in zip(("nodes", "edges", "mentions"), X.build_graph(X.canonical_mentions(X.grounding(X.named_phrases(raw), r), ontology, None), kept, ontology), strict=True):
            write(d, f"{a.out}/{name}")
    elif a.command == "kg-stats":
        K.degree_by_label(read(a.nodes), read(a.edges)).show()
    elif a.command == "index-build":
        S.build_index(read(a.documents), a.out)
    elif a.command == "bench-run":
        q = I.read(spark, a.questions, "questions", "json").select(F.col("qid").alias("item_id"), F.col("question").alias("text"))
        write(S.bm25(q, S.index_of(spark, a.documents), top=a.k), a.out)
    else:
        from lodestar.plans import build as _build  # noqa: F401
        from lodestar.plans import runs, studies  # noqa: F401
        from lodestar.plans.catalogue import QUERIES

        write(QUERIES[a.name](spark, a.folder), a.out)


if __name__ == "__main__":
    main()
