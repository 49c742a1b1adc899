"""Repeatable per-row randomness from a hash of (seed, key...).

A row's uniform draw depends only on its key, never on partitioning or task
order, so splits and samples are identical after a re-partition or a lost
executor's recomputation, and an independent SQL engine can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def hash_uniform(seed, *keys) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5("seed:key1:key2...")."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def sql_hash_uniform(seed, *key_sql: str) -> str:
    """The same draw written for DuckDB (used by oracle SQL)."""
    parts = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT) / 4294967296.0)"
