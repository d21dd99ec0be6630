"""Equi-joins whose keys may be very unevenly frequent.

A join on a key sends all rows of one key to one task.  ``hot_split_join``
takes the most frequent keys out of the exchange: their side of the join is a
broadcast table of at most ``HOT_KEYS`` rows, whatever the input, and a key that
is left over has at most 1/``HOT_KEYS`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys joined by broadcast.  Of any table, the keys beyond its HOT_KEYS most
#: frequent ones have fewer than 1/HOT_KEYS of its rows each.
HOT_KEYS = 1024


def hot_split_join(rows: DataFrame, groups: DataFrame, on: list[str], count_col: str,
                   how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` (one row for each value of ``on``, with the
    number of its rows in ``count_col``), with no hot key in an exchange.

    ``how`` is ``inner`` or ``left``.  ``rows`` is read twice: once for the hot
    keys, once for the others.  Null keys match nothing; a left join keeps their
    rows out of the exchange too.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how={how!r}")
    hot = groups.dropna(subset=on).orderBy(F.col(count_col).desc(), *on).limit(HOT_KEYS)
    names = F.broadcast(hot.select(*on))
    known = rows.dropna(subset=on)
    rare = known.join(names, on, "left_anti").join(groups.join(names, on, "left_anti"), on, how)
    out = known.join(F.broadcast(hot), on, "inner").unionByName(rare)
    if how == "left":
        absent = F.lit(False)
        for c in on:
            absent = absent | F.col(c).isNull()
        out = out.unionByName(rows.filter(absent), allowMissingColumns=True)
    return out
