"""A bounded sample of rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, size: int, total: int | None = None) -> DataFrame:
    """About ``size`` rows (at most 1.1 times that), chosen by a hash of ``key``.

    Each task sends only its own share, so what reaches the driver doesn't grow with the tasks.
    """
    total = df.count() if total is None else total
    if total <= size:
        return df.limit(size)
    share = min(1.0, size / total)
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(size + size // 10)
