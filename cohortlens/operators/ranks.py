"""Distributed running sums over an ordered column (midranks, the U statistic,
running numbers, positions: anything that needs "how many before me").

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
Here the rows are range-partitioned by the whole order (groups, order column,
tie-break), so ties and hot groups are split too, and the partition number is
written down with the rows (a checkpoint: a second evaluation of a range
partitioning may cut elsewhere). The running sum inside a partition is a window
over that partition; what came before is one row for each partition that
continues a group of the one before it: fewer rows than partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir


def running_sums(df: DataFrame, order_col: str, cols: Sequence[str], by: Sequence[str] = (),
                 n_buckets: int | None = None, suffix: str = "_cum", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_cum``: sum of ``c`` over rows up to this one in the order of
    ``(order_col, *tiebreak)``, nulls first, per ``by`` (a null group is a
    group). Rows equal in all of these are taken in any order."""
    by = list(by)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if n_buckets is None:
        n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    b = (df.repartitionByRange(n_buckets, *[F.col(c) for c in (*by, order_col, *tiebreak)])
         .withColumn("_bk", F.spark_partition_id()).checkpoint())
    totals = b.groupBy(*by, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*by).orderBy("_bk")
    offsets = (totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_bk").alias("_gb"),
                             F.lag("_bk").over(before).alias("_continues"),
                             *[F.sum(f"_t_{c}").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_o_{c}")
                               for c in cols])
               .where(F.col("_continues").isNotNull()))
    inside = (Window.partitionBy(*by, "_bk").orderBy(order_col, *tiebreak)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("_bk") == F.col("_gb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    # groups lie side by side in the range order, so only the first group of a
    # partition can have begun before it: at most n_buckets rows
    j = b.join(F.broadcast(offsets), same, "left")
    return j.select(*[F.col(c) for c in df.columns],
                    *[(F.coalesce(F.col(f"_o_{c}"), F.lit(0)) + F.sum(c).over(inside)).alias(c + suffix) for c in cols])


def positions(values: DataFrame, col: str, name: str, start: int = 0) -> DataFrame:
    """``(col, name)``: the place of each row of ``values`` in the order of ``col``."""
    r = running_sums(values.select(F.col(col), F.lit(1).alias("_one")), col, ["_one"])
    return r.select(col, (F.col("_one_cum") - 1 + start).cast("long").alias(name))


def ranked_value(df: DataFrame, col: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of ``col`` (nulls left out), interpolated between the two
    neighbouring ranks. Equal values are one row before anything is ordered."""
    per = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(per, "_v", ["_n"]).select("_v", "_n_cum").checkpoint()
    n = cum.agg(F.max("_n_cum")).first()[0]
    if not n:
        return [None for _ in shares]
    at = [(n - 1) * s for s in shares]
    need = sorted({int(a) + 1 for a in at} | {min(int(a) + 2, n) for a in at})
    row = cum.agg(*[F.min(F.when(F.col("_n_cum") >= k, F.col("_v"))).alias(f"r{k}") for k in need]).first()
    return [row[f"r{int(a) + 1}"] + (a - int(a)) * (row[f"r{min(int(a) + 2, n)}"] - row[f"r{int(a) + 1}"]) for a in at]


FETCH = 10_000  # keys of the last, small range that reach the driver


def keys_at(df: DataFrame, key: str, places: Sequence[int], cuts: int = 200) -> list | None:
    """The key at each 0-based place of the order of the unique, numeric ``key`` (nulls left
    out); beyond the last: None. None in all if some key repeats so often that its place is no single row.

    A sketch cuts the range into some two hundred parts and one count of each says in which a place
    lies; the part is cut again until it is small. Every round reads the key alone, with partial
    counts, and nothing is sorted, shuffled by row, or written.
    """
    values = df.select(F.col(f"`{key}`").alias("k")).where(F.col("k").isNotNull())
    out = []
    for place in places:
        part, left, size = values, place, None
        while True:
            if size is None:
                size = part.count()
            if left >= size:
                out.append(None)
                break
            if size <= FETCH:
                out.append(sorted(r["k"] for r in part.collect())[left])
                break
            grid = part.agg(F.percentile_approx("k", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("c"), F.min("k").alias("lo"),
                            F.max("k").alias("hi")).first()
            edges = sorted(set(grid["c"]) - {grid["hi"]})
            if not edges:
                return None  # one key alone
            index = sum(((F.col("k") > e).cast("int") for e in edges[1:]), (F.col("k") > edges[0]).cast("int"))
            counts = {r["i"]: r["n"] for r in part.groupBy(index.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
            i = 0
            while left >= counts.get(i, 0):
                left -= counts.get(i, 0)
                i += 1
            size = counts[i]
            if i > 0:
                part = part.where(F.col("k") > edges[i - 1])
            if i < len(edges):
                part = part.where(F.col("k") <= edges[i])
    return out
