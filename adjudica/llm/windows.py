"""Hashes of word windows as array columns, inside the JVM.

A window of n words is hashed by doubling: hashes of 1, 2, 4, ... neighbouring
words are paired at growing distance, so a window costs log2(n) + 1 steps per
word and no text is copied.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted(values: Column, by: int) -> Column:
    """values from place ``by`` on."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def paired(a: Column, b: Column, by: int) -> Column:
    """hash(a[i], b[i + by]) for every i that has both."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(x, y))


def steps(n: int) -> list[tuple[int, int, int]]:
    """(length made, length of the left part, offset of the right part); lengths are 1 or made before."""
    made, out, size = {1}, [], 1
    while size * 2 <= n:
        out.append((size * 2, size, size))
        size *= 2
        made.add(size)
    while size < n:
        tail = max(m for m in made if size + m <= n)
        out.append((size + tail, size, size))
        size += tail
        made.add(size)
    return out
