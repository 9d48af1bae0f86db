"""A join that no hot key can stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with so many rows is hot, and is joined by broadcast, if it also has this share of all rows. So no task gets more of
#: one key than the greater of both, and there are at most as many hot keys as the inverse of the share.
HOT_ROWS = 10_000
HOT_SHARE = 1 / (1 << 17)


def hot_bound(total: int | None) -> float:
    """From how many rows on a key is hot, if all keys have so many."""
    return max(HOT_ROWS, (total or 0) * HOT_SHARE)


def by_counted_key(rows: DataFrame, known: DataFrame, on: str, n: str) -> DataFrame:
    """rows joined to known, which has one row per key and says in n how many of rows have it.

    Hot keys go by broadcast and never meet in a task; the others are joined by shuffle. rows and known are read twice,
    but where no key is hot the join is a plain one.
    """
    seen = known.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    bound = hot_bound(seen["total"])
    if (seen["most"] or 0) < bound:
        return rows.join(known, on)
    hot = known.where(F.col(n) >= bound)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(known.where(F.col(n) < bound), on))
