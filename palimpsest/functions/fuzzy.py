"""Substring and subsequence scores: natively where an expression says it, by a batched function where it can't."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def subsequence_pattern(query: str) -> str:
    return ".*".join(re.escape(c) for c in query.lower())


def match_score(name: Column | str, query: str) -> Column:
    """Substring: (100 - place) + (100 - difference of lengths); subsequence: 10 a character; else null."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    place = F.locate(query.lower(), c) - 1
    inside = F.lit(200) - place - F.abs(F.length(c) - len(query))
    return F.when(place >= 0, inside).when(c.rlike("(?s)" + subsequence_pattern(query)), F.lit(10 * len(query))).cast("long")


def best_alignment(target: str, query: str) -> float | None:
    """The best score of a query's characters in order within a target, null if it isn't a subsequence.

    A character scores 1 and, early on, up to 10 more; 5 at a word's beginning; six times the length of the run that
    it continues. Each target character passed over costs a half, and the target's length 0.6 a character. Rows of a
    table over (place, run length) follow the query; a run goes on from the place before with its length plus one,
    and starts at 1 for the query's first character and at 0 for others.
    """
    low, q = target.lower(), query.lower()
    if len(low) != len(target):  # characters whose lower case is longer: places wouldn't agree
        target = low
    n = len(low)
    at = np.arange(n)
    begins = np.array([i == 0 or low[i - 1] in "_-" or ("A" <= target[i] <= "Z" and "a" <= target[i - 1] <= "z") for i in range(n)], bool)
    value = 1 + 5.0 * begins + np.maximum(0, 10 - at)
    ends: dict[int, dict[int, float]] = {}  # by place of the last matched character: length of its run -> best score
    for k, c in enumerate(q):
        now: dict[int, dict[int, float]] = {}
        for i in (i for i in range(n) if low[i] == c):
            options = {1: value[i] - i * 0.5} if k == 0 else {}
            for p, runs in ends.items():
                for run, score in runs.items() if p < i else ():
                    on = p == i - 1 and run > 0
                    gained = score + value[i] + (6 * (run + 1) if on else -(i - p - 1) * 0.5)
                    options[run + 1 if on else 0] = max(options.get(run + 1 if on else 0, -np.inf), gained)
            if options:
                now[i] = options
        if not now:
            return None
        ends = now
    return max(s for runs in ends.values() for s in runs.values()) - 0.6 * n


def _alignment(target: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else best_alignment(t, q) for t, q in zip(target, query, strict=True)], dtype="float64")


def fuzzy_score(target: Column | str, query: str) -> Column:
    """0 for an empty query; 10000 - 10 * place - length for a substring; else the best alignment or null.

    Only targets that have the query as a subsequence, but not as a substring, reach the Python function.
    """
    c = F.col(target) if isinstance(target, str) else target
    if not query:
        return F.lit(0.0)
    place = F.locate(query.lower(), F.lower(c))
    loose = F.when((place == 0) & F.lower(c).rlike("(?s)" + subsequence_pattern(query)), c)
    return F.when(place > 0, (F.lit(10000) - (place - 1) * 10 - F.length(F.lower(c))).cast("double")).otherwise(F.pandas_udf(_alignment, "double")(loose, F.lit(query)))


def _highlight(text: pd.Series, query: pd.Series) -> pd.Series:
    from html import escape

    def mark(t: str | None, q: str) -> str:
        out, k = [], 0
        for c in t or "":
            shown = escape(c, quote=False).replace('"', "&quot;")
            if k < len(q) and c.lower() == q[k]:
                k += 1
                shown = f"<mark>{shown}</mark>"
            out.append(shown)
        return "".join(out)

    return pd.Series([mark(t, q.lower()) for t, q in zip(text, query, strict=True)])


def fuzzy_highlight(text: Column | str, query: str) -> Column:
    """The text as HTML with the query's characters marked, each where it first fits."""
    return F.pandas_udf(_highlight, "string")(F.col(text) if isinstance(text, str) else text, F.lit(query))
