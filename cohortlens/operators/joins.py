"""Joins with the reference's suffix rule (J1-J5, J9 helpers).

Join strategy is left to the optimizer: with adaptive execution on, Spark
broadcasts a side only when its measured size at runtime is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, and splits
skewed partitions. Null keys never match (unlike pandas, which matches NaN to
NaN): callers drop null keys first where that matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir


def suffix_overlaps(left: DataFrame, right: DataFrame, keep: Sequence[str], suffix: str = "_tomerge") -> DataFrame:
    """Rename right-hand columns that also exist on the left (except the
    join keys in ``keep``) by appending ``suffix``; the left keeps its names."""
    lcols = set(left.columns)
    return right.select(*[F.col(c).alias(c + suffix) if (c in lcols and c not in keep) else F.col(c)
                          for c in right.columns])


def merge(left: DataFrame, right: DataFrame, how: str, on: Sequence[str] | None = None,
          left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None,
          suffix: str = "_tomerge", fill: dict | float | None = None) -> DataFrame:
    """Pandas-style merge.

    ``on``: same key names on both sides, output has them once. ``left_on`` /
    ``right_on``: different names; the right keys are kept (suffixed if they
    clash). ``fill`` is applied after the join (``fillna``), as in J1.
    """
    if on is not None:
        r = suffix_overlaps(left, right, keep=on, suffix=suffix)
        if how == "right":
            # keys come from the right side on a right join
            out = left.join(r, on=list(on), how="right")
        else:
            out = left.join(r, on=list(on), how=how)
    else:
        assert left_on is not None and right_on is not None
        r = suffix_overlaps(left, right, keep=(), suffix=suffix)
        rnames = [c + suffix if c in set(left.columns) else c for c in right_on]
        cond = [left[lk] == r[rk] for lk, rk in zip(left_on, rnames)]
        out = left.join(r, on=cond, how=how)
    if fill is not None:
        out = out.fillna(fill)
    return out


def not_equal_keep_null(c, value) -> Column:
    """Pandas ``!=`` keeps missing values (``NaN != x`` is true); SQL
    ``<>`` drops them. This keeps them: ``NOT (c <=> value)``."""
    col = F.col(c) if isinstance(c, str) else c
    return ~col.eqNullSafe(F.lit(value))


def with_unknown_flag(df: DataFrame, flags: Sequence[str], name: str = "diag_unknown", drop_constant: bool = False) -> DataFrame:
    """1 where none of the 0/1 ``flags`` is set. With ``drop_constant`` the
    column is left out when all rows agree on it (one aggregate finds out)."""
    out = df.withColumn(name, F.lit(1) - F.least(F.lit(1), sum((F.coalesce(F.col(c), F.lit(0)) for c in flags), F.lit(0))))
    if drop_constant:
        lo, hi = out.agg(F.min(name), F.max(name)).first()
        if lo == hi:
            return out.drop(name)
    return out


def stack(frames) -> DataFrame:
    """Stack result tables by column name; missing columns are null."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def measured_bytes(df: DataFrame) -> int:
    """Size of a table from its own values: every row as JSON, and 16 bytes a
    row and 8 a column on top."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*cols)))).alias("b")).first()
    return int(row["b"] or 0) + row["n"] * (16 + 8 * len(cols))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int = 32 << 20) -> DataFrame:
    """Join, broadcasting ``small`` if its measured size is under ``max_bytes``,
    else a shuffle join (adaptive execution splits skewed keys). ``small`` is
    evaluated once, into the session's checkpoint folder: nothing stays behind
    on executors, and a lost one does not bring the work back."""
    small, fits = checkpointed(small, max_bytes)
    return big.join(F.broadcast(small) if fits else small, on, how)


def checkpointed(small: DataFrame, max_bytes: int = 32 << 20) -> tuple[DataFrame, bool]:
    """``small`` from the checkpoint folder, and whether its measured size is under ``max_bytes``."""
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint()
    return small, measured_bytes(small) <= max_bytes
