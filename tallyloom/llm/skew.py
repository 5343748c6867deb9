"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this share of all rows, so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1024


def join_counted(rows: DataFrame, side: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one narrow row a key and in ``n`` how many of ``rows`` the key has.

    The hot keys, fewer than 1 / ``HOT_SHARE`` at any size, are sent to where
    the rows are; only rows of the other keys are shuffled.  Both tables are
    read twice: pass written ones.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > total * HOT_SHARE
    hot = F.broadcast(side.where(is_hot))
    rest = rows.join(F.broadcast(side.where(is_hot).select(*keys)), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(rest.join(side.where(~is_hot), list(keys)))
