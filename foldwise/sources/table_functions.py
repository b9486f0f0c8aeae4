"""Table functions for SQL text: rounds of cross-validation and bootstrap draws of a row, by the library's hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def number(*keys) -> float:
    """The number of :func:`foldwise.functions.hashing.uniform`."""
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16) / (1 << 52)


class FoldRounds:
    """``(round, is_test)``: a row once for each of k rounds, tested in the one that its key's hash deals it to."""

    def eval(self, key: str, k: int, seed: str) -> Iterator[tuple[int, bool]]:
        if key is not None:
            fold = int(number(key, seed) * k)
            for i in range(k):
                yield i, i == fold


class Draws:
    """``(boot_id, n_drawn)``: in which of so many resamples a row is, and how often, by Poisson draws of its key."""

    def eval(self, key: str, resamples: int, seed: str) -> Iterator[tuple[int, int]]:
        if key is not None:
            for b in range(resamples):
                u, n, term = number(key, b, seed), 0, 0.36787944117144233
                upto = term
                while u >= upto and n < 12:
                    n += 1
                    term /= n
                    upto += term
                if n:
                    yield b, n


def register(spark: SparkSession) -> None:
    """Make ``fold_rounds(key, k, seed)`` and ``draws(key, resamples, seed)`` callable from this session's SQL."""
    spark.udtf.register("fold_rounds", udtf(FoldRounds, returnType="round int, is_test boolean", useArrow=True))
    spark.udtf.register("draws", udtf(Draws, returnType="boot_id int, n_drawn int", useArrow=True))
