"""Secret scans, with DataFrame functions only.

Base kinds, each leftmost and non-overlapping: ``assign`` (a secret's name, a sign and a value of 12 or
more characters), ``access`` (key ids) and ``hex``.

Random tokens. Candidates are runs of 20 or more characters of the usual encodings. The encoding
is inferred from the characters (hex, base32, base36, base58, base62, base64, base64url), the narrowest first, and three tests ask whether the
token's symbols are uniform and independent in its alphabet: chi-squared uniformity, Wald-Wolfowitz
runs about the alphabet's middle, and the serial correlation at lag 1. Fisher's method combines
their p-values, and a token stays if it can't be told from random at 0.1 %.

False discoveries. Against a model of ordinary long tokens (words, paths, numbers: they keep to one
class of characters for long) a token has the likelihood ratio e = P(token | uniform) / P(token |
ordinary), divided by the number of encodings, for the encoding is inferred; this is an e-value: its expectation over ordinary tokens is at most 1, whatever the length, and its
evidence grows with the length. The e-value form of Benjamini and Hochberg's rule over all candidates of
the table keeps the k largest, for the largest k whose k-th is at least candidates / (rate * k). It
holds under any dependence. The cut is found from counts per tenth of log e: a table of fixed
size, however many the candidates. A token inside a base span is reported as that span only.

Edge cases: a null text is an empty one and has no span; positions count code points; a text may have any
number of spans; repeated rows are scanned alike; an empty table gives an empty result; a column of the
name given for the spans is replaced, and others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, group that is measured, least length)
KINDS = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}
#: Patterns whose matches are just those of the kind's pattern that are long enough: shorter runs are never made into spans.
LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Quick tests that a text must pass to hold a span at all.
MAY = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings with their symbols in order, each before those that hold all of its symbols: a token counts as of the first that it fits.
ALPHABETS = {
    "hex": (r"^[0-9a-f]+$", "0123456789abcdef"), "HEX": (r"^[0-9A-F]+$", "0123456789ABCDEF"), "base32": (r"^[A-Z2-7]+$", _UP + "234567"), "base32 lower": (r"^[a-z2-7]+$", _LOW + "234567"),
    "base36": (r"^[0-9A-Z]+$", _DIGITS + _UP), "base36 lower": (r"^[0-9a-z]+$", _DIGITS + _LOW), "base58": (r"^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    "base62": (r"^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW), "base64": (r"^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"), "base64url": (r"^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"), "mixed": (r"", _UP + _LOW + _DIGITS + "-_+/"),
}
SPAN = "array<struct<start:int,end:int,kind:int>>"


def matches(text: Column, pattern: str, may: str | None = None, group: int = 0, least: int = 1, kind: int = 0, keep_text: bool = False) -> Column:
    """Spans of the pattern's matches whose group has ``least`` characters: array<struct<start, end, kind[, token]>>.

    The pieces between the matches and the matches themselves, laid end to end, give the positions.
    """
    # the last piece has no match after it and so no span: n is null there
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    extra = ",token:string" if keep_text else ""
    empty = F.expr(f"cast(array() as array<struct<start:int,end:int,kind:int{extra}>>)")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["g"]
        measured = p["n"] if group == 0 else F.when(p["n"].isNotNull(), F.length(F.regexp_extract(p["m"], pattern, group)))
        span = F.struct(start.alias("start"), (start + p["n"]).alias("end"), F.lit(kind).alias("kind"), *[p["m"].alias("token")] * keep_text)
        return F.struct((start + p["n"]).alias("at"), F.when(measured >= least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate(parts, zero, step)["spans"]
    return F.when(text.rlike(may or pattern), spans).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of the normal law (Abramowitz and Stegun 26.2.17), at least 1e-12."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) * F.lit(1 / math.sqrt(2 * math.pi)) * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1.0 - tail), F.lit(1e-12))


def battery(token: Column) -> Column:
    """struct<encoding, p_chi, p_runs, p_serial, p, log_e> of a candidate token."""
    t = F.regexp_replace(token, "=+$", "")
    inferred = None
    for name, (pattern, letters) in reversed(ALPHABETS.items()):
        this = F.struct(F.lit(name).alias("encoding"), F.lit(letters).alias("alphabet"))
        inferred = this if inferred is None else F.when(t.rlike(pattern), this).otherwise(inferred)
    first = F.struct(t.alias("t"), inferred["encoding"].alias("encoding"), inferred["alphabet"].alias("alphabet"))

    def stats(x: Column) -> Column:
        chars = F.split(x["t"], "")
        v = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(x["alphabet"], c) - 1)
        # character classes: 0 lower, 1 upper, 2 digit, 3 sign
        k = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3))
        return F.struct(x["encoding"].alias("encoding"), F.length(x["alphabet"]).cast("double").alias("k"), v.alias("v"), k.alias("c"), F.length(x["t"]).cast("double").alias("n"))

    def tests(x: Column) -> Column:
        v, n, k = x["v"], x["n"], x["k"]
        total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, y: a + y)
        squares = total(F.transform(F.array_distinct(v), lambda d: F.pow(F.size(F.filter(v, lambda y: y == d)).cast("double"), F.lit(2.0))))
        z_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = total(F.transform(v, lambda y: F.when(y >= k / 2, 1.0).otherwise(0.0)))
        runs = 1 + total(F.transform(pairs, lambda p: F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0)))
        mu = 2 * high * (n - high) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        z_runs = F.when(var > 0, (runs - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(9.0))
        mean = (k - 1) / 2.0
        around = total(F.transform(v, lambda y: (y - mean) * (y - mean)))
        serial = total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)))
        z_serial = F.when(around > 0, serial / around * F.sqrt(n)).otherwise(F.lit(9.0))
        sizes = lambda c: F.when(c == 0, 26.0).when(c == 1, 26.0).when(c == 2, 10.0).otherwise(5.0)
        steps = F.zip_with(F.slice(x["c"], F.lit(1), F.size(v) - 1), F.slice(x["c"], F.lit(2), F.size(v) - 1), lambda a, b: F.when(a == b, F.lit(math.log(0.95))).otherwise(F.lit(math.log(0.05 / 3))) - F.ln(sizes(b)))
        ordinary = total(steps) - F.lit(math.log(4.0)) - F.ln(sizes(F.element_at(x["c"], 1)))
        return F.struct(x["encoding"].alias("encoding"), _upper_tail(z_chi).alias("p_chi"), F.least(2 * _upper_tail(F.abs(z_runs)), F.lit(1.0)).alias("p_runs"), F.least(2 * _upper_tail(F.abs(z_serial)), F.lit(1.0)).alias("p_serial"), (-n * F.ln(k) - F.lit(math.log(len(ALPHABETS))) - ordinary).alias("log_e"))

    def combined(x: Column) -> Column:
        y = -(F.ln(x["p_chi"]) + F.ln(x["p_runs"]) + F.ln(x["p_serial"]))
        return F.struct(x["encoding"], x["p_chi"], x["p_runs"], x["p_serial"], (F.exp(-y) * (1 + y + y * y / 2)).alias("p"), x["log_e"])

    # each level is bound once: a lambda's variable stands for the computed struct
    for f in (stats, tests, combined):
        first = F.transform(F.array(first), f)[0] if f is stats else F.transform(F.array(first), f)[0]
    return first


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, token, s struct>> of the candidate tokens with their figures."""
    found = matches(text, CANDIDATE, r"[A-Za-z0-9+/_-]{20}", kind=len(KINDS), keep_text=True)
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["kind"], x["token"], battery(x["token"]).alias("s")))


def discovery_cut(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> float:
    """The least log e that is kept; infinity if none is. One row of one number comes to the driver."""
    found = docs.select(F.explode(candidates(text_of(text_col))).alias("x")).select(F.floor(F.least(F.greatest(F.col("x.s.log_e"), F.lit(-50.0)), F.lit(500.0)) * 10).cast("int").alias("b"))
    counts = found.groupBy("b").agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sort_array(F.collect_list(F.struct("b", "n")), asc=False).alias("bins")).first()["bins"] or []  # 5,501 bins at most
    total, above, cut = sum(x["n"] for x in all_), 0, math.inf
    for x in all_:
        above += x["n"]
        if x["b"] / 10 >= math.log(total / (rate * above)):
            cut = x["b"] / 10
    return cut


def spans_of(text: Column, cut: float, random_p: float = 0.001) -> Column:
    """array<struct<start, end, kind>> by start, then kind (3: random token)."""
    base = F.concat(*(matches(text, LONG.get(name, p), MAY[name], group, least, i) for i, (name, (p, group, least)) in enumerate(KINDS.items())))
    if cut == math.inf:
        return F.array_sort(base).cast(SPAN)
    keep = lambda x: (x["s"]["log_e"] >= F.lit(cut)) & (x["s"]["p"] >= F.lit(random_p))
    more = F.transform(F.filter(candidates(text), keep), lambda x: F.struct(x["start"], x["end"], x["kind"]))
    both = F.struct(base.alias("base"), more.alias("more"))
    return F.transform(F.array(both), lambda b: F.array_sort(F.concat(b["base"], F.filter(b["more"], lambda x: ~F.exists(b["base"], lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))))))[0].cast(SPAN)


def scan(docs: DataFrame, text_col: str = "text", rate: float = 0.01, out: str = "spans") -> DataFrame:
    """docs with one more column, named by ``out``."""
    return docs.withColumn(out, spans_of(text_of(text_col), discovery_cut(docs, text_col, rate)))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by the mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))[0])
