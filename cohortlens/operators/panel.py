"""Panel preparation: roles, buckets, baselines, running numbers, dummies,
scaling (S3, A3, A4, W1-W3, J6, J7, P24, P27-P29).

Everything that is "per subject" is a window or an aggregate keyed on the
subject column, so a chain of them plans under one hash exchange on the subject.
Ordering is always completed with a unique tie-break column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import round_nearest
from cohortlens.sources.tables import select_roles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Panel:
    """Column roles of a longitudinal table (the reference's dataset object)."""
    group: str
    timestamp: str
    target: str
    covariates: tuple[str, ...] = ()
    to_bucket: str | None = None
    bucket_min: float = 50.0
    bucket_max: float = 90.0
    interval: float = 0.5
    min_obs: int = 3
    tiebreak: tuple[str, ...] = field(default_factory=tuple)

    def order_cols(self) -> list[Column]:
        return [F.col(self.timestamp)] + [F.col(c) for c in self.tiebreak]


def load_panel(df: DataFrame, panel: Panel) -> DataFrame:
    """S3: keep covariates, group, target, timestamp (and bucket column),
    de-duplicated; keep everything when a name is missing."""
    cols = [*panel.covariates, panel.group, panel.target, panel.timestamp]
    if panel.to_bucket is not None:
        cols.append(panel.to_bucket)
    cols += list(panel.tiebreak)
    return select_roles(df, cols)


# ---------------------------------------------------------------- discovery --

def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """P29 by dtype (costs no job)."""
    cols = df.columns if cols is None else cols
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in cols if isinstance(types[c], NUMERIC_TYPES)]


def text_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = df.columns if cols is None else cols
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in cols if isinstance(types[c], T.StringType)]


def binary_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """P29 by values: columns whose non-null values all lie in {0, 1}; an
    all-null column counts as binary.

    One aggregate for all columns; only one flag a column reaches the driver."""
    cols = list(cols)
    if not cols:
        return []
    row = df.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"b{i}"] is not False]


# ------------------------------------------------------------------ windows --

def subject_window(panel: Panel, ordered: bool = True):
    w = Window.partitionBy(panel.group)
    return w.orderBy(*panel.order_cols()) if ordered else w


def with_running_number(df: DataFrame, group: str, order: Sequence[str], name: str = "counter") -> DataFrame:
    """1-based running number per subject in the order of ``order`` (its
    first column sets the order; the rest break ties, so make them unique).

    Skew-safe: a distributed running count (``ranks.running_sums``) instead of
    a window per subject, so a subject with a third of all rows is split over
    many partitions rather than sorted in one task."""
    from cohortlens.operators.ranks import running_sums
    order = list(order)
    r = running_sums(df.withColumn("_one", F.lit(1)), order[0], ["_one"], by=[group], tiebreak=order[1:])
    return r.withColumn(name, F.col("_one_cum").cast("long")).drop("_one", "_one_cum")


def subject_aggregate(df: DataFrame, group: str, aggs: Sequence[Column], how: str = "left") -> DataFrame:
    """Per-subject aggregates joined back to every row. The aggregate reduces
    map-side (a hot subject costs one partial row per task) and the per-subject
    table is broadcast when its measured size allows (``join_small``), so the
    rows themselves are never shuffled by subject."""
    from cohortlens.operators.joins import join_small
    per = df.groupBy(group).agg(*aggs)
    return join_small(df, per, group, how)


def with_group_size(df: DataFrame, group: str, name: str = "size") -> DataFrame:
    """Rows per subject on every row (aggregate + join back)."""
    return subject_aggregate(df, group, [F.count(F.lit(1)).alias(name)])


def keep_min_obs(df: DataFrame, group: str, min_obs: int = 3) -> DataFrame:
    """Keep subjects with at least ``min_obs`` rows: counts per subject
    (partial aggregation), then a semi join."""
    from cohortlens.operators.joins import join_small
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_obs).select(group)
    return join_small(df, per, group, "left_semi")


def with_baseline(df: DataFrame, group: str, order: Sequence[str | Column], cols: Sequence[str],
                  suffix: str = "_baseline") -> DataFrame:
    """Value of the subject's first row (in ``order``) on every row,
    as ``<c>_baseline``. The first row's value is taken even when null.
    ``min_by`` over the order key is an ordinary aggregate (partial map-side),
    joined back per subject."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    okey = F.struct(*keys) if len(keys) > 1 else keys[0]
    agg = F.min_by(F.struct(*[F.col(c).alias(c + suffix) for c in cols]), okey).alias("_first")
    out = subject_aggregate(df, group, [agg])
    return out.select(*[F.col(c) for c in df.columns], *[F.col(f"_first.{c}{suffix}") for c in cols])


def join_baseline_rows(df: DataFrame, group: str, baseline_filter: Column, cols: Sequence[str],
                       order: Sequence[str | Column], suffix: str = "_baseline") -> DataFrame:
    """J6 join form: the baseline row chosen by a filter (e.g. ``centred == 1``)
    joined back to all rows of the subject, right-hand names suffixed (J5).
    Of several rows that pass the filter the first in ``order`` is the baseline,
    so each row comes out once; subjects without one get nulls."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    first = F.min_by(F.struct(*[F.col(c).alias(c + suffix) for c in cols]), F.struct(*keys)).alias("_first")
    base = df.filter(baseline_filter).groupBy(group).agg(first)
    from cohortlens.operators.joins import join_small
    out = join_small(df, base, group, "left")
    return out.select(*[F.col(c) for c in df.columns], *[F.col(f"_first.{c}{suffix}") for c in cols])


# ------------------------------------------------------------------ buckets --

def first_by_time(c: str, order: Sequence[Column]) -> Column:
    """A3 'first': first non-null value in time order (min_by over the order
    key, nulls excluded)."""
    key = F.struct(*order) if len(order) > 1 else order[0]
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), key))


def bucket_data(df: DataFrame, panel: Panel, binary_cols: Sequence[str] | None = None) -> DataFrame:
    """A4: bucket a panel on ``to_bucket``.

    Range filter ``bucket_min <= x <= bucket_max``; 0/1 columns become
    ``'no'``/``'yes'`` text; ``<x>_upbound = ceil(x/interval)*interval``; per
    (subject, bucket): mean of numeric columns, first non-null (in time order) of
    text columns; ``occur`` = buckets of the subject; keep ``occur >= min_obs``;
    ``counter`` = running number by bucket. Columns neither numeric nor text
    (dates) are dropped, as in the reference.

    The plan has one exchange on the subject: the aggregate is keyed on
    (subject, bucket) and partial-aggregates map-side, so a hot subject never
    lands in one task before the rows are reduced to one per bucket; the two
    windows after it reuse the subject partitioning.
    """
    if panel.to_bucket is None:
        raise ValueError("Panel.to_bucket is not set")
    x = panel.to_bucket
    df = df.filter((F.col(x) >= panel.bucket_min) & (F.col(x) <= panel.bucket_max))
    skip = {panel.group, *panel.tiebreak}
    num = [c for c in numeric_columns(df) if c not in skip]
    if binary_cols is None:
        binary_cols = binary_columns(df, [c for c in num if c != x])
    binary_cols = [c for c in binary_cols if c in num]
    for c in binary_cols:
        df = df.withColumn(c, F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no"))
    num = [c for c in num if c not in binary_cols]
    # reference: any column whose name contains the group name is left out of the text columns
    txt = [c for c in text_columns(df) if panel.group not in c]
    bucket = x + "_upbound"
    order = [F.col(panel.timestamp)] + [F.col(c) for c in panel.tiebreak]
    aggs = ([first_by_time(c, order).alias(c) for c in txt]
            + [F.avg(F.col(c)).alias(c) for c in num])
    g = df.withColumn(bucket, round_nearest(F.col(x), panel.interval, "up")).groupBy(panel.group, bucket).agg(*aggs)
    g = g.withColumn("occur", F.count(F.lit(1)).over(Window.partitionBy(panel.group)))
    g = g.filter(F.col("occur") >= panel.min_obs)
    return g.withColumn("counter", F.row_number().over(
        Window.partitionBy(panel.group).orderBy(F.col(bucket))).cast("long"))


# ------------------------------------------------------------------ scaling --

def normalize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min-max scaling fitted on the data: ``(x - min) / (max - min)``;
    a constant column gives 0; nulls are ignored in the fit and kept.

    Fit is one aggregate returning 2 numbers per column to the driver; the
    transform is plain arithmetic with literals (no join, no extra shuffle).
    """
    cols = list(cols)
    row = df.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mn, mx = row[f"mn{i}"], row[f"mx{i}"]
        if mn is None:
            expr = F.col(c).cast("double")
        else:
            rng = float(mx) - float(mn)
            scale = 1.0 / rng if rng != 0 else 1.0
            expr = (F.col(c).cast("double") - F.lit(float(mn))) * F.lit(scale)
        out.append(expr.alias(c))
    return df.select(*[out[cols.index(c)] if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ dummies --

def levels(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Distinct non-null levels of several text columns in one job (unpivot +
    distinct). Refuses (raises) rather than silently capping a column with more
    than ``max_levels`` levels: a one-hot that wide is a modelling error."""
    cols = list(cols)
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                         for c in cols])).alias("kv")).select("kv.k", "kv.v")
    rows = long.filter(F.col("v").isNotNull()).distinct().limit(max_levels * len(cols) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["k"]].append(r["v"])
    for c, v in out.items():
        if len(v) > max_levels:
            raise ValueError(f"column {c} has more than {max_levels} levels")
        v.sort()
    return out


def dummyfy(df: DataFrame, cols: Sequence[str] | None = None, drop: bool = True, drop_first: bool = False,
            level_map: dict[str, list[str]] | None = None, max_levels: int = 1000) -> DataFrame:
    """One 0/1 column ``<col>_<level>`` per level (sorted), null gives
    all zeros. ``drop=False`` keeps the source columns; ``drop_first`` leaves out
    the first sorted level (reference coding for regression). A column with more
    than ``max_levels`` levels is refused."""
    cols = text_columns(df) if cols is None else list(cols)
    level_map = level_map or levels(df, cols, max_levels)
    new = []
    for c in cols:
        lv = level_map[c][1:] if drop_first else level_map[c]
        new += [F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for v in lv]
    keep = [F.col(c) for c in df.columns if not (drop and c in cols)]
    return df.select(*keep, *new)


def dummyfy_modal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P27 with ``force_bool``: one column per source, 1 where the value is the
    modal level (smallest level on ties); source kept."""
    from cohortlens.operators.describe import modal_levels
    cols = list(cols)
    modes = modal_levels(df, cols)
    return df.select("*", *[F.when(F.col(c).cast("string") == F.lit(modes[c]), 1).otherwise(0).alias(f"{c}_{modes[c]}")
                            for c in cols])


class LongitudinalPanel:
    """The dataset object of the original toolkit, on a DataFrame: column
    roles plus the operations that use them. Every method returns a new lazy
    DataFrame (and keeps it as ``self.data``), nothing is collected."""

    def __init__(self, data: DataFrame, group: str = "brcid", timestamp: str = "date", target: str = "score",
                 covariates: Sequence[str] | None = None, to_bucket: str | None = None, bucket_min: float = 50,
                 bucket_max: float = 90, interval: float = 0.5, min_obs: int = 3, tiebreak: Sequence[str] = ()):
        self.data = data
        self.panel = Panel(group=group, timestamp=timestamp, target=target,
                           covariates=tuple(covariates or ()), to_bucket=to_bucket, bucket_min=bucket_min,
                           bucket_max=bucket_max, interval=interval, min_obs=min_obs, tiebreak=tuple(tiebreak))

    def load_data(self) -> DataFrame:
        """S3: role columns only (all columns when there are no covariates or
        a name is missing)."""
        if self.panel.covariates:
            self.data = load_panel(self.data, self.panel)
        return self.data

    def normalize(self, cols: Sequence[str] | None = None) -> DataFrame:
        """P24 on the given columns, default the numeric covariates."""
        cols = list(cols) if cols is not None else numeric_columns(self.data, list(self.panel.covariates))
        self.data = normalize(self.data, cols)
        return self.data

    def dummyfy(self, cols: Sequence[str] | None = None, force_bool: bool = False, drop: bool = True) -> DataFrame:
        """Dummy columns (or one modal-level flag with ``force_bool``)."""
        if force_bool:
            self.data = dummyfy_modal(self.data, cols if cols is not None else text_columns(self.data))
        else:
            self.data = dummyfy(self.data, cols, drop=drop)
        return self.data

    def bucket_data(self) -> DataFrame:
        """A4 on the current data."""
        return bucket_data(self.data, self.panel)
