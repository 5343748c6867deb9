"""Columns of any name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(names: Iterable[str]) -> list[Column]:
    """The columns of these names, which may hold dots, blanks or quotes."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]
