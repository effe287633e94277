"""Names for inner columns that no column of the caller's has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores after it as make it unlike every column of ``df``, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of just this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: list[str]) -> list[Column]:
    return [col(c) for c in names]


def without(names: list[str], *dropped: str) -> list[str]:
    """``names`` but the dropped ones, letter case aside."""
    gone = {d.lower() for d in dropped}
    return [c for c in names if c.lower() not in gone]
