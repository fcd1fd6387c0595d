"""Vectorised functions for what the JVM lacks: compatibility normalisation and sequence matching."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def best_window_ratio(needle: str, hay: str) -> float:
    """How well a phrase stands in a text, both normal: 1 for a substring, else the best matching ratio over windows.

    Windows are of the phrase's length where matching blocks line up, and of as many words as it has, one
    less and one more, unless their lengths differ by more than a third and eight characters. A phrase as long as the text is compared with it whole.
    """
    if not needle:
        return 0.0
    if needle in hay:
        return 1.0
    n = len(needle)
    if n >= len(hay):
        return SequenceMatcher(None, needle, hay).ratio()
    starts = {min(max(0, x.b - x.a), len(hay) - n) for x in SequenceMatcher(None, needle, hay, autojunk=False).get_matching_blocks()}
    windows = [hay[at : at + n] for at in sorted(starts)]
    words, size = hay.split(" "), needle.count(" ") + 1
    for width in range(max(1, size - 1), size + 2):
        windows += [" ".join(words[at : at + width]) for at in range(max(1, len(words) - width + 1))]
    best, slack = 0.0, max(8, n // 3)
    for k, window in enumerate(windows):
        if k >= len(starts) and abs(len(window) - n) > slack:
            continue
        m = SequenceMatcher(None, needle, window)
        if m.real_quick_ratio() > best and m.quick_ratio() > best:
            best = max(best, m.ratio())
        if best == 1.0:
            break
    return best


def normal(text: str) -> str:
    """Compatibility form, straight quotes, lower case, single spaces, no marks at the ends."""
    plain = unicodedata.normalize("NFKC", text).translate(str.maketrans("‘’“”", "''\"\"")).lower()
    return " ".join(plain.split()).strip(" .,:;!?\"'")


def same_phrase(a: str, b: str, threshold: float = 0.8) -> bool:
    """Equal, one in the other at no less than half its length, or alike by sequence."""
    x, y = normal(a or ""), normal(b or "")
    if not x or not y or x == y:
        return x == y != ""
    if x in y or y in x:
        return min(len(x), len(y)) / max(len(x), len(y)) >= 0.5
    return SequenceMatcher(None, x, y).ratio() >= threshold


@F.pandas_udf(DoubleType())
def partial_ratio(needle: pd.Series, hay: pd.Series) -> pd.Series:
    return pd.Series([best_window_ratio(a or "", b or "") for a, b in zip(needle, hay, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)
