"""Joins of rows to a table with one row a key, where a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.sizes import dealt

#: A key with more than this share of all rows is hot; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int, deal: bool = False) -> DataFrame:
    """``rows`` left-joined to ``keyed``, which has one row for each value of ``keys``.

    ``size`` is the column of ``keyed`` with the number of rows of the key, of
    ``total`` in all; it is dropped. Rows of hot keys meet theirs by a
    broadcast of at most 1 / HOT_SHARE rows, all others by a shuffle in which
    no key has more than HOT_SHARE of the rows; ``deal`` has its partitions
    follow from the rows, see ``dealt``. Rows with a null key find
    nothing and stay.
    """
    hot = keyed.where(F.col(size) > HOT_SHARE * total).drop(size)
    cold = keyed.where(F.col(size) <= HOT_SHARE * total).drop(size)
    names = hot.select(keys).withColumn("hot_", F.lit(True))
    marked = rows.join(F.broadcast(names), keys, "left")
    there = marked.where("hot_").drop("hot_").join(F.broadcast(hot), keys)
    rest = marked.where("hot_ is null").drop("hot_")
    rest = (dealt(rest, total, *keys) if deal else rest).join(cold, keys, "left")
    return there.unionByName(rest)
