"""Ordered computations over long per-key logs, without one task per key.

A plain window puts all rows of a key into one task, which fails when a single page owns a large
share of a log. Keys are counted first; a key with no more rows than a piece may have stays whole and needs
nothing else. The order of the few others is cut into ranges of equal rank (a busy hour gets more cuts than a
quiet month). Pieces are processed independently; what flows from piece to piece is a row per piece, and only
those rows meet in a window per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import materialize

#: Pieces of a log for each shuffle partition, if keys are cut at all, and the least rows of a piece.
PIECES, LEAST = 8, 100_000
#: Rows that are looked at for each cut.
SAMPLES = 32


@dataclass(frozen=True)
class Ranks:
    """Where the order of hot keys is cut; ``cuts`` is None if no key is hot. It has at most ``PIECES`` rows and cuts
    for each shuffle partition, however large the log, so it is broadcast."""

    keys: list[str]
    order: list[str]
    cuts: DataFrame | None = None
    steps: int = 0


def _same(keys: list[str], a: str, b: str) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return test


def rank_ranges(df: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> Ranks:
    """Cuts for the keys with more than ``most`` rows (an eighth of a shuffle partition's share, ``LEAST`` at least).

    Counts keys with partial sums and, only if some are hot, reads those again for a sample. The sample goes by
    a hash of the row, so a repeated task finds the same cuts."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if most is None:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
        most = max(LEAST, (total or 0) // (PIECES * width))
        if (top or 0) <= most:
            return Ranks(keys, order)
    hot = materialize(counts.filter(F.col("_n") > most))
    if not hot.limit(1).count():
        return Ranks(keys, order)
    rate = int(min(1.0, SAMPLES / most) * (1 << 31))
    seen = df.select(*keys, *[c for c in order if c not in keys]).filter(
        F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 31)) < rate)
    sample = seen.alias("s").join(F.broadcast(hot.alias("h")), _same(keys, "s", "h"), "left_semi")
    cuts = materialize(sample.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_cuts")).select(
        *keys, F.filter("_cuts", lambda _, i: (i + 1) % SAMPLES == 0).alias("_cuts")).filter(F.size("_cuts") > 0))
    longest = cuts.agg(F.max(F.size("_cuts"))).first()[0]
    return Ranks(keys, order, cuts if longest else None, (longest or 0).bit_length())


def in_pieces(df: DataFrame, ranks: Ranks) -> DataFrame:
    """Adds ``_piece``: how many cuts of its key lie up to a row, null for keys that are whole."""
    if ranks.cuts is None:
        return df
    d = df.alias("d").join(F.broadcast(ranks.cuts.alias("c")), _same(ranks.keys, "d", "c"), "left").select("d.*", "c._cuts")
    here = F.struct(*ranks.order)
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(ranks.steps))])
    at = F.aggregate(powers, F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get("_cuts", low + step - 1) <= here, F.lit(False)), low + step).otherwise(low))
    return d.withColumn("_piece", F.when(F.col("_cuts").isNotNull(), at)).drop("_cuts")


def _carried(d: DataFrame, carry: DataFrame, keys: list[str], ranks: Ranks) -> DataFrame:
    """Joins what comes from earlier pieces. It is computed at once, so that scans of scans do not read a log twice as
    often with each level, and broadcast where its keys are those of the cuts, one row a piece."""
    carry = materialize(carry)
    return d.join(F.broadcast(carry) if keys == ranks.keys else carry, [*keys, "_piece"], "left")


def ordered_scan(df: DataFrame, keys: list[str], order: list[str],
                 outputs: dict[str, tuple[str, Column]], ranks: Ranks | None = None) -> DataFrame:
    """Add ordered columns.  Each output is (function, column) with function one of

    ``sum``   running total including the row      ``last``  latest non-null value up to the row
    ``lag``   value of the row before              ``lead``  value of the row after
    ``next``  earliest non-null value after the row     ``total`` sum over all rows of the key

    ``order`` must be a total order within a key. ``ranks`` are cuts in that order, of the keys or of fewer keys, which
    several scans of one log share; without them the log is counted here."""
    ranks = rank_ranges(df, keys, order) if ranks is None else ranks
    whole = ranks.cuts is None
    d = in_pieces(df, ranks)
    for name, (_, column) in outputs.items():
        d = d.withColumn(f"_in_{name}", column)
    pieces = [] if whole else ["_piece"]
    local = W.partitionBy(*keys, *pieces).orderBy(*order)
    # A descending frame grows by one row at a time; an ascending one would be rescanned.
    back = W.partitionBy(*keys, *pieces).orderBy(*[F.desc(o) for o in order]).rowsBetween(W.unboundedPreceding, -1)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    if not whole:
        d = _carried(d, _carry(d, keys, order, outputs), keys, ranks)
    results = []
    for name, (fn, _) in outputs.items():
        v, c = F.col(f"_in_{name}"), F.lit(None) if whole else F.col(f"_carry_{name}")
        if fn == "sum":
            here = F.coalesce(F.sum(v).over(upto), F.lit(0))
            here = here if whole else here + F.coalesce(c, F.lit(0))
        elif fn == "total":
            here = F.coalesce(F.sum(v).over(W.partitionBy(*keys, *pieces)), F.lit(0))
            here = here if whole else here + F.coalesce(c, F.lit(0))
        elif fn in ("last", "next"):
            here = F.last(v, ignorenulls=True).over(upto if fn == "last" else back)
            here = here if whole else F.coalesce(here, c)
        elif fn in ("lag", "lead"):
            near = F.lag if fn == "lag" else F.lead
            here = near(v).over(local) if whole else F.coalesce(near(F.struct(v.alias("v"))).over(local), c).getField("v")
        else:
            raise ValueError(f"unknown function {fn!r}")
        results.append((name, here))
    for name, here in results:
        d = d.withColumn(name, here)
    return d.drop("_piece", *[f"_in_{n}" for n in outputs], *[f"_carry_{n}" for n in outputs])


def _carry(d: DataFrame, keys: list[str], order: list[str], outputs: dict[str, tuple[str, Column]]) -> DataFrame:
    """What each piece of a hot key gets from the pieces before it (after it, for lead and next)."""
    pieces = W.partitionBy(*keys).orderBy("_piece")
    earlier = pieces.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(W.unboundedPreceding, -1)
    position = F.struct(*order)
    totals, carries = [], []
    for name, (fn, _) in outputs.items():
        v, t, c = F.col(f"_in_{name}"), f"_total_{name}", f"_carry_{name}"
        if fn == "sum":
            total, carry = F.sum(v), F.sum(t).over(earlier)
        elif fn == "total":
            total, carry = F.sum(v), F.sum(t).over(W.partitionBy(*keys)) - F.col(t)
        elif fn == "last":
            total, carry = F.max_by(v, F.when(v.isNotNull(), position)), F.last(t, ignorenulls=True).over(earlier)
        elif fn == "next":
            total, carry = F.min_by(v, F.when(v.isNotNull(), position)), F.last(t, ignorenulls=True).over(later)
        else:
            edge, near = (F.max_by, F.lag) if fn == "lag" else (F.min_by, F.lead)
            total, carry = edge(F.struct(v.alias("v")), position), near(t).over(pieces)
        totals.append(total.alias(t))
        carries.append(carry.alias(c))
    return d.filter(F.col("_piece").isNotNull()).groupBy(*keys, "_piece").agg(*totals).select(*keys, "_piece", *carries)


def reflected_sum(df: DataFrame, keys: list[str], order: list[str], delta: Column, out: str,
                  ranks: Ranks | None = None) -> DataFrame:
    """Running total that never goes below zero: ``S - min(0, lowest prefix of S)``."""
    ranks = rank_ranges(df, keys, order) if ranks is None else ranks
    d = in_pieces(df, ranks).withColumn("_delta", delta)
    pieces = [] if ranks.cuts is None else ["_piece"]
    upto = W.partitionBy(*keys, *pieces).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum("_delta").over(upto))
    d = d.withColumn("_low", F.min("_s").over(upto))
    if ranks.cuts is None:
        return d.withColumn(out, F.col("_s") - F.least(F.lit(0), F.col("_low"))).drop("_delta", "_s", "_low")
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        d.filter(F.col("_piece").isNotNull())
        .groupBy(*keys, "_piece").agg(F.sum("_delta").alias("_t"), F.min("_s").alias("_m"))
        .withColumn("_base", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_base") + F.col("_m")).over(earlier))
        .select(*keys, "_piece", "_base", "_floor")
    )
    base = F.coalesce("_base", F.lit(0))
    low = F.least(F.lit(0), F.col("_floor"), base + F.col("_low"))
    return _carried(d, carry, keys, ranks).withColumn(out, base + F.col("_s") - low).drop(
        "_piece", "_delta", "_s", "_low", "_base", "_floor")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank",
          spread: int = 64) -> DataFrame:
    """First ``n`` rows per key in ``order``.  Every key is first reduced within ``spread`` salted
    parts, so the final window sees at most ``spread * n`` rows of it."""
    plain = [c for c in df.columns
             if c not in keys and "map<" not in df.schema[c].dataType.simpleString()]
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(spread)))
    first = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
    part = part.withColumn("_r", first).filter(F.col("_r") <= n).drop("_r", "_salt")
    return part.withColumn(rank, F.row_number().over(
        W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def micros(ts) -> Column:
    """Epoch microseconds of a timestamp column."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))
