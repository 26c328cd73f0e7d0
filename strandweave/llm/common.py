"""Helpers shared by the text-corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group holding over one row in so many is joined by broadcast; there are fewer than this many such groups.
HOT_SHARE = 1000


def text_of(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``doc``, so that none can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"))


def unpacked(rows: DataFrame, *own: str) -> DataFrame:
    """The columns of ``doc`` followed by ``own`` ones; where names clash the operator's wins."""
    taken = {name.lower() for name in own}
    names = [name for name in rows.schema["doc"].dataType.names if name.lower() not in taken]
    return rows.select(*[F.col(f"doc.`{name}`").alias(name) for name in names], *own)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, safe when a group holds much of the data.

    ``size`` is a group's number of rows, ``total`` that of all rows. Groups of more than
    ``total / HOT_SHARE`` rows (so fewer than ``HOT_SHARE`` groups) are broadcast; what is left
    is joined by shuffle, where no key is hot any more. ``key`` must not be null.
    """
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    direct = rows.join(F.broadcast(hot), key)
    shuffled = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return direct.unionByName(shuffled)
