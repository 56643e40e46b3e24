"""Weighted vocabulary scores and bands."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_score(text: Column, vocabulary: Iterable[tuple[str, int]], cap: int) -> Column:
    """The weights of all terms that the text contains, summed and capped. Null text scores zero."""
    parts = [F.when(F.contains(text, F.lit(term)), F.lit(weight)).otherwise(F.lit(0)) for term, weight in vocabulary]
    return F.least(F.lit(cap), reduce(add, parts, F.lit(0)))


def band(score: Column, steps: Iterable[tuple[int, str]], lowest: str) -> Column:
    """The name of the first step, given in descending order, that the score reaches."""
    chain = None
    for least, name in steps:
        chain = F.when(score >= least, name) if chain is None else chain.when(score >= least, name)
    return chain.otherwise(lowest)
