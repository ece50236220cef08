"""Range joins: which half-open intervals [lo, hi) of two tables overlap.

Both sides are dealt to the bins they touch and joined by key and bin, so a key
with very many intervals is spread over its bins, and no pair is tried that
shares none. Bins have levels, each ``STEP`` times as wide as the one below. An
interval's own level is the lowest whose bins are not much narrower than it, and
it stands also in the bins of the wider levels that occur. Two intervals meet at
the higher of their own levels, in the first bin they share there, and only
there: so no interval stands in more than ``STEP + 1`` bins of a level, however
long it is, and no pair is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 16


def _widths(width: int) -> list[int]:
    return [w for k in range(16) if (w := width * STEP**k) < 2**59]


def _own_level(lo: str, hi: str, width: int) -> Column:
    """Lowest level at which [lo, hi) is at most ``STEP`` bins long."""
    length = F.col(hi) - F.col(lo)
    return sum((F.when(length > w * STEP, 1).otherwise(0) for w in _widths(width)[:-1]), F.lit(0))


def _in_bins(df: DataFrame, keys: list[str], lo: str, hi: str, width: int, levels: list[int], side: str) -> DataFrame:
    """The columns of ``df``, with ``side`` before their names, once for each bin they touch at their own level and the wider ones of ``levels``."""
    lo_, hi_ = F.col(lo).cast("long"), F.col(hi).cast("long")
    down = lambda a, b: F.call_function("div", a - F.pmod(a, b), b)
    wide = lambda k: F.element_at(F.array(*[F.lit(w).cast("long") for w in _widths(width)]), k + 1)
    bins = lambda k: F.transform(F.sequence(down(lo_, wide(k)), down(hi_ - 1, wide(k))), lambda b: F.struct(k.alias("level"), b.alias("bin"), down(lo_, wide(k)).alias("first"), (k == _own_level(lo, hi, width)).alias("own")))
    every = F.flatten(F.transform(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= _own_level(lo, hi, width)), bins))
    rows = df.where(F.col(lo) < F.col(hi)).select(*keys, *(F.col(c).alias(f"_{side}_{c}") for c in df.columns), F.explode(every).alias("_at"))
    return rows.withColumns({"_level": F.col("_at.level"), "_bin": F.col("_at.bin"), f"_first{side}": F.col("_at.first"), f"_own{side}": F.col("_at.own")}).drop("_at")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of equal ``keys`` whose ranges overlap: the keys, the rows as structs ``l`` and ``r``, and their ``overlap``.

    ``width`` is that of the narrowest bins; it should be near the length of the
    shorter intervals. Empty ranges and those with null ends overlap nothing,
    and neither do null keys.
    """
    if width < 1:
        raise ValueError("bins are at least one wide")
    found = [df.where(F.col(a) < F.col(b)).select(_own_level(a, b, width).alias("level")) for df, (a, b) in ((left, left_range), (right, right_range))]
    # at most as many rows as there are levels
    levels = sorted(r["level"] for r in found[0].union(found[1]).distinct().collect())
    sides = [_in_bins(df, keys, *ends, width, levels, side) for df, ends, side in ((left, left_range, "l"), (right, right_range, "r"))]
    # Spark's estimate of a side does not count the rows that explode makes, so by it a side of any length may be broadcast
    pairs = sides[0].hint("merge").join(sides[1], [*keys, "_level", "_bin"]).where("(_ownl or _ownr) and _bin = greatest(_firstl, _firstr)")
    end = lambda k: [F.col(f"_{side}_{ends[k]}") for side, ends in (("l", left_range), ("r", right_range))]
    overlap = F.least(*end(1)) - F.greatest(*end(0))
    whole = lambda df, side: F.struct(*(F.col(f"_{side}_{c}").alias(c) for c in df.columns)).alias(side)
    return pairs.where(overlap > 0).select(*keys, whole(left, "l"), whole(right, "r"), overlap.alias("overlap"))


def owners(chunks: DataFrame, events: DataFrame, keys: list[str], chunk: str, chunk_range: tuple[str, str], event: str, event_range: tuple[str, str], width: int) -> DataFrame:
    """(keys, chunk, event): the event that each chunk overlaps most, the first of ties, event 0 where it overlaps none.

    Chunks and events are two tables. A chunk's best event comes from one
    aggregation that also holds the chunk itself, so chunks without an event
    need no second join.
    """
    kind = events.schema[event].dataType
    met = overlapping(chunks, events, keys, chunk_range, event_range, width)
    met = met.select(*keys, F.col("l")[chunk].alias(chunk), F.struct("overlap", (-F.col("r")[event]).alias("_less")).alias("_x"))
    own = chunks.select(*keys, chunk, F.struct(F.lit(0).cast(met.schema["_x"].dataType["overlap"].dataType).alias("overlap"), F.lit(0).cast(kind).alias("_less")).alias("_x"))
    best = met.unionByName(own).groupBy(*keys, chunk).agg(F.max("_x").alias("_x"))
    return best.select(*keys, chunk, (-F.col("_x")["_less"]).cast(kind).alias(event))
