"""Label text: normal forms and similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_text(text: Column) -> Column:
    """Upper case letter by letter, so that sharp s stays; only letters, digits and line feeds."""
    held = F.replace(F.upper(F.replace(text, F.lit("\u00df"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("\u00df"))
    return F.regexp_replace(held, r"[^\p{L}\p{Nd}\n]", "")


def text_lines(text: Column) -> Column:
    """The lines that are not blank; CR LF and CR count as line feeds."""
    return F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")


def without_logos(text: Column) -> Column:
    return F.regexp_replace(text, "<[A-Z]{2,4}>", "")


def trigram_share(found: Column, truth: Column) -> Column:
    """The share of truth's trigrams that found contains; 0 for a truth of fewer than three characters."""
    grams = F.transform(F.sequence(F.lit(1), F.length(truth) - 2), lambda i: F.substr(truth, i, F.lit(3)))
    return F.when(F.length(truth) >= 3, F.size(F.filter(grams, lambda g: F.contains(found, g))) / (F.length(truth) - 2)).otherwise(0.0)


def char_overlap(found: Column, truth: Column) -> Column:
    """The share of truth's characters, as a multiset, that found has too."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c))
    common = F.aggregate(F.array_distinct(chars(truth)), F.lit(0), lambda n, c: n + F.least(count(found, c), count(truth, c)))
    return F.when(F.length(truth) > 0, common / F.length(truth)).otherwise(0.0)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    state, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = state & rows.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x or "", y or "") for x, y in zip(a, b, strict=True)])


def text_similarity(found: Column, truth: Column) -> Column:
    """0.35 * common subsequence + 0.25 * characters + 0.25 * lines + 0.15 * trigrams, on normal forms.

    Lines count by their best match; a line that is only logos counts as a miss. Character lengths are used.
    """
    plain = without_logos(truth)
    f, t = normal_text(found), normal_text(plain)
    f_lines, t_lines = text_lines(found), text_lines(plain)
    whole = lcs_length(f, t) / F.greatest(F.length(f), F.length(t))
    lines = line_score(F.transform(f_lines, normal_text), F.transform(t_lines, normal_text))
    score = 0.35 * whole + 0.25 * char_overlap(f, t) + 0.25 * lines + 0.15 * trigram_share(f, t)
    return F.when(t == "", F.when(found != "", 0.5).otherwise(0.0)).when(f == t, 1.0).otherwise(score)


@F.pandas_udf(T.DoubleType())
def line_score(found: pd.Series, truth: pd.Series) -> pd.Series:
    def one(fs, ts) -> float:
        best = [max((common_subsequence(f, t) / max(len(f), len(t)) for f in fs if f or t), default=0.0) if t else 0.0 for t in ts]
        return sum(best) / len(best) if best else 0.0

    return pd.Series([one(f, t) for f, t in zip(found, truth, strict=True)])
