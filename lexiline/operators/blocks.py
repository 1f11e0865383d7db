"""Ordered computations that never put a whole key into one task.

A key (a track, a user) may hold a large share of all rows, so a plain window over the key is a
single-task bottleneck. Rows are cut into blocks of the ordering axis instead:

* `scan` computes running sums, maxima and last/next values. Windows run inside (key, block); one
  aggregated row per block is carried over the block boundaries.
* `dense_pos` numbers the rows of a key from 0, the exact `row_number`, by the same route.
* `neighbours` reads the rows around a row. Chunks of consecutive positions are extended by copies
  of the few rows next to their borders.
* `exact_median` selects the middle values of a key from a histogram; only the bin that holds the
  median is ordered.

Only block summaries meet in a window over the key: one row where the data has thousands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiline import session

BLOCK_MS = 600_000
CHUNK = 4096
#: Bins up to which their hashes, a long each, are broadcast to leave out rows before they move.
FEW_BINS = 1_000_000


def block_of(order_col, width: int = BLOCK_MS) -> Column:
    c = F.col(order_col) if isinstance(order_col, str) else order_col
    return F.floor(c / width)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    width: int = BLOCK_MS,
) -> DataFrame:
    """Add running values per key, in the total order given by `order` (the first is numeric).

    `specs` maps an output column to (kind, expression):
    `sum` is inclusive; `max_before` and `last_before` look at earlier rows only;
    `next_after` looks at later rows only. Nulls are skipped by all of them.
    """
    keys = list(keys)
    part = [*keys, "__blk"]
    src = df.withColumn("__blk", block_of(order[0], width))
    for name, (_, expr) in specs.items():
        src = src.withColumn(f"__v_{name}", expr)
    ordering = [F.col(c) for c in order]
    tag = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])

    totals = []
    for name, (kind, _) in specs.items():
        v = F.col(f"__v_{name}")
        if kind == "sum":
            agg = F.sum(v)
        elif kind == "max_before":
            agg = F.max(v)
        elif kind == "last_before":
            agg = F.max_by(v, F.when(v.isNotNull(), tag))
        elif kind == "next_after":
            agg = F.min_by(v, F.when(v.isNotNull(), tag))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
        totals.append(agg.alias(f"__t_{name}"))
    blocks = src.groupBy(*part).agg(*totals)

    over_blocks = W.partitionBy(*keys).orderBy("__blk")
    earlier = over_blocks.rowsBetween(W.unboundedPreceding, -1)
    later = over_blocks.rowsBetween(1, W.unboundedFollowing)
    carried = []
    for name, (kind, _) in specs.items():
        t = F.col(f"__t_{name}")
        carry = {
            "sum": lambda: F.sum(t).over(earlier),
            "max_before": lambda: F.max(t).over(earlier),
            "last_before": lambda: F.last(t, ignorenulls=True).over(earlier),
            "next_after": lambda: F.first(t, ignorenulls=True).over(later),
        }[kind]()
        carried.append(carry.alias(f"__c_{name}"))
    blocks = blocks.select(*part, *carried)

    inside = W.partitionBy(*part).orderBy(*ordering)
    joined = src.join(blocks, part)
    cols = [F.col(c) for c in df.columns if c not in specs]
    for name, (kind, _) in specs.items():
        v, c = F.col(f"__v_{name}"), F.col(f"__c_{name}")
        before = inside.rowsBetween(W.unboundedPreceding, -1)
        if kind == "sum":
            value = F.sum(v).over(inside.rowsBetween(W.unboundedPreceding, 0))
            out = F.coalesce(value + c, value, c)
        elif kind == "max_before":
            out = F.greatest(F.max(v).over(before), c)
        elif kind == "last_before":
            out = F.coalesce(F.last(v, ignorenulls=True).over(before), c)
        else:
            out = F.coalesce(F.first(v, ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing)), c)
        cols.append(out.alias(name))
    return joined.select(*cols)


def dense_pos(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos", width: int = BLOCK_MS
) -> DataFrame:
    """Number the rows of each key from 0 in the given total order."""
    numbered = scan(df.drop(out), keys, order, {out: ("sum", F.lit(1).cast("long"))}, width)
    return numbered.withColumn(out, F.col(out) - 1)


def neighbours(
    df: DataFrame, keys: Sequence[str], shifts: dict[str, tuple[Column, int]], pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Add values of the row `offset` positions away (negative: earlier); null past the ends.

    `pos` must number the rows of each key densely, as `dense_pos` does.
    """
    ahead = max([0, *[o for _, o in shifts.values()]])
    behind = max([0, *[-o for _, o in shifts.values()]])
    home = F.floor(F.col(pos) / chunk)
    inside = F.col(pos) % chunk
    copies = F.array(
        home,
        F.when(inside < ahead, home - 1),
        F.when(inside >= chunk - behind, home + 1),
    )
    spread = df.withColumn("__chunk", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    w = W.partitionBy(*keys, "__chunk").orderBy(pos)
    for name, (expr, offset) in shifts.items():
        shifted = F.lead(expr, offset) if offset > 0 else F.lag(expr, -offset)
        spread = spread.withColumn(name, shifted.over(w))
    return spread.filter(F.col("__chunk") == home).drop("__chunk")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, bin_width: float, out: str = "median") -> DataFrame:
    """Median per key (mean of the two middle values) without ordering a whole key."""
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__bin", F.floor(F.col(value) / bin_width))
    bins = counted.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__m"))
    by_bin = W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    bins = bins.select(
        *keys,
        "__bin",
        (F.sum("__m").over(by_bin) - F.col("__m")).alias("__below"),
        F.sum("__m").over(whole).alias("__total"),
    ).withColumn("__lo", F.floor((F.col("__total") + 1) / 2)).withColumn("__hi", F.floor(F.col("__total") / 2) + 1)
    rows = counted.join(bins, [*keys, "__bin"])
    in_bin = W.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("__below") + F.sum("__n").over(in_bin)
    rows = rows.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__n"))
    take = (
        F.when((F.col("__from") < F.col("__lo")) & (F.col("__lo") <= F.col("__upto")), 1).otherwise(0)
        + F.when((F.col("__from") < F.col("__hi")) & (F.col("__hi") <= F.col("__upto")), 1).otherwise(0)
    )
    rows = rows.withColumn("__take", take).filter(F.col("__take") > 0)
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col("__take")) / 2).alias(out))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, bin_width: float, out: str = "quantile") -> DataFrame:
    """The quantile `p` per key, interpolated between neighbouring values, without ordering a whole key.

    A histogram tells which bins hold the two ranks around it; only these are looked at value by value. Equal values are counted
    before they meet. Keys without a value give no row.
    """
    keys = list(keys)
    part = [*keys, "__bin"]
    binned = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__x"), F.floor(F.col(value) / bin_width).alias("__bin"))
    bins = binned.groupBy(*part).agg(F.count("*").alias("__m"))
    by_bin = W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto, total = F.sum("__m").over(by_bin), F.sum("__m").over(W.partitionBy(*keys))
    place = p * (F.col("__total") - 1)
    near = (
        bins.select(*part, (upto - F.col("__m")).alias("__below"), upto.alias("__until"), total.alias("__total"))
        .withColumn("__lo", F.floor(place))
        .withColumn("__share", place - F.col("__lo"))
        .filter((F.col("__until") > F.col("__lo")) & (F.col("__below") <= F.col("__lo") + 1))
    )
    # The bins looked at are few; rows outside them do not move.
    near = session.cut_lineage(near)
    counted = possible(binned, near, part, near.count() <= FEW_BINS).groupBy(*part, "__x").agg(F.count("*").alias("__n"))
    rows = counted.join(near, part)
    in_bin = W.partitionBy(*keys, "__bin").orderBy("__x").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__last", F.col("__below") + F.sum("__n").over(in_bin)).withColumn("__first", F.col("__last") - F.col("__n"))
    holds = lambda rank: (F.col("__first") <= rank) & (rank < F.col("__last"))
    high = F.least(F.col("__lo") + 1, F.col("__total") - 1)
    weight = F.when(holds(F.col("__lo")), 1 - F.col("__share")).otherwise(0.0) + F.when(holds(high), F.col("__share")).otherwise(0.0)
    return rows.groupBy(*keys).agg(F.sum(F.col("__x") * weight).alias(out))


def possible(rows: DataFrame, wanted: DataFrame, by: Sequence[str], few: bool) -> DataFrame:
    """Rows that share a hash of `by` with a wanted one, and so all that share `by`; every row unless the wanted are few."""
    key = lambda df: df.withColumn("__h", F.xxhash64(*by))
    return key(rows).join(F.broadcast(key(wanted).select("__h").distinct()), "__h", "left_semi").drop("__h") if few else rows
