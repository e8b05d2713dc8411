"""Fixed-size pieces of sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rechunk(samples: Column, size: int, pad: Column | None = None) -> Column:
    """Array of arrays of ``size`` samples; the last one is padded, or left short without ``pad``. [STR7]"""
    starts = F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), F.lit(size))
    pieces = F.transform(starts, lambda i: F.slice(samples, i + 1, F.lit(size)))
    return pieces if pad is None else F.transform(pieces, lambda p: F.concat(p, F.array_repeat(pad, F.lit(size) - F.size(p))))
