"""Column expressions (P6-P26, D4). Each takes and returns a ``Column``.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen and run unchanged on batch or streaming DataFrames.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference ------------------------------
# Missing-value spellings treated as "no" for yes/no text columns.
NO_VALUES = ("no", "null", "na", "#n/a", "n/a")
# Spellings the text flag (P14) maps to 0, besides null.
FLAG_ZERO_VALUES = ("no", "null", "#n/a", "0")
NA_CATEGORY = "not known"
# BMI: edges 18.5, 25, 30 -> underweight / normal / preobese / obese.
BMI_EDGES = (18.5, 25.0, 30.0)
BMI_LABELS = ("underweight", "normal", "preobese", "obese")
# Blood pressure ratio systolic/diastolic: edges 120/80 and 140/90.
BP_EDGES = (120.0 / 80.0, 140.0 / 90.0)
BP_LABELS = ("normal", "prehypertension", "hypertension")
# Fasting plasma glucose: edges 5.5 and 7.
GLUCOSE_EDGES = (5.5, 7.0)
GLUCOSE_LABELS = ("normal", "prediabetic", "diabetic")
# p-value stars.
SIG_LEVELS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
# ------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(c) -> Column:
    """pandas skips NaN like a missing value; Spark does not. Use at sources."""
    c = _c(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_number(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: text that is not a number becomes null,
    NaN becomes null."""
    return nan_to_null(_c(c).cast("string").try_cast("double"))


def round_nearest(x, intv: float = 0.5, direction: str = "down") -> Column:
    """Floor (``'down'``) or ceil (anything else) to a multiple of ``intv``."""
    q = _c(x) / F.lit(float(intv))
    r = F.floor(q) if direction == "down" else F.ceil(q)
    return r.cast("double") * F.lit(float(intv))


def round_down(num, divisor: float) -> Column:
    """``num - num % divisor`` with Python's modulo (sign of the divisor),
    which equals ``floor(num/divisor)*divisor``."""
    return F.floor(_c(num) / F.lit(float(divisor))).cast("double") * F.lit(float(divisor))


def num_to_bucket(nb, bucket_size: float = 0.5, as_text: bool = True) -> Column:
    """The half-open bucket ``(lo, hi]`` holding ``nb``, as ``"[lo, hi]"`` text
    (Python float formatting) or as an array of two doubles."""
    hi = F.ceil(_c(nb) / F.lit(float(bucket_size))).cast("double") * F.lit(float(bucket_size))
    lo = hi - F.lit(float(bucket_size))
    if not as_text:
        return F.array(lo, hi)
    return F.concat(F.lit("["), _py_float_str(lo), F.lit(", "), _py_float_str(hi), F.lit("]"))


def _py_float_str(c: Column) -> Column:
    """Python ``str(float)`` for values that print without an exponent."""
    s = c.cast("string")
    return F.when(s.contains(".") | s.contains("E") | s.contains("N") | s.contains("I"), s).otherwise(
        F.concat(s, F.lit(".0")))


def cut_with_na(x, edges: Sequence[float], labels: Sequence[str], na_category: str = NA_CATEGORY,
                coerce: bool = True) -> Column:
    """Right-closed bins ``(-inf, e1], (e1, e2], ..., (ek, +inf]``.

    The first edge is excluded, so ``-inf`` and anything not a number falls to
    ``na_category``; ``+inf`` lands in the last label.
    """
    v = to_number(x) if coerce else _c(x)
    bounds = [-math.inf, *edges, math.inf]
    expr = None
    for lo, hi, lab in zip(bounds[:-1], bounds[1:], labels):
        cond = (v > F.lit(lo)) & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(na_category))


def bmi_category(score, na_category: str = NA_CATEGORY) -> Column:
    """P10."""
    return cut_with_na(score, BMI_EDGES, BMI_LABELS, na_category)


def blood_pressure(systolic, diastolic, na_category: str = NA_CATEGORY) -> Column:
    """Ratio systolic/diastolic binned. ``x/0`` follows floating point: a
    positive systolic over 0 is ``+inf`` (hypertension), a negative one ``-inf``
    and ``0/0`` is NaN (both "not known")."""
    s, d = to_number(systolic), to_number(diastolic)
    ratio = (F.when(d == 0, F.when(s > 0, F.lit(math.inf)).when(s < 0, F.lit(-math.inf))
                    .otherwise(F.lit(None).cast("double")))
             .otherwise(s / d))
    return cut_with_na(ratio, BP_EDGES, BP_LABELS, na_category, coerce=False)


def diabetes(plasma_glucose, na_category: str = NA_CATEGORY) -> Column:
    """P12."""
    return cut_with_na(plasma_glucose, GLUCOSE_EDGES, GLUCOSE_LABELS, na_category)


def boolify_numeric(c) -> Column:
    """P13 numeric branch: ``x > 0`` gives 1, otherwise (null too) 0."""
    return F.when(to_number(c) > 0, 1).otherwise(0)


def boolify_text(c, no_values: Sequence[str] = NO_VALUES, legacy_polarity: bool = False) -> Column:
    """P13 text branch. Default: a value in the "no" list (or null) gives 0,
    anything else 1. ``legacy_polarity=True`` reproduces the inverted mapping of
    the original code (no -> 1)."""
    is_no = F.lower(_c(c)).isin(list(no_values)) | _c(c).isNull()
    yes, no = (0, 1) if legacy_polarity else (1, 0)
    return F.when(is_no, F.lit(no)).otherwise(F.lit(yes))


def text_flag(c) -> Column:
    """``'no'``, null, ``'null'``, ``'#n/a'``, ``0`` give 0, others 1."""
    v = F.lower(_c(c).cast("string"))
    return F.when(v.isNull() | v.isin(list(FLAG_ZERO_VALUES)), 0).otherwise(1)


def capped_flag(c) -> Column:
    """P15 first form: ``min(x, 1)``, null gives 0 (negatives pass through)."""
    x = _c(c).cast("double")
    return F.when(x.isNull(), F.lit(0.0)).otherwise(F.least(x, F.lit(1.0)))


def positive_flag(c) -> Column:
    """P15 second form: ``x > 0`` gives 1, otherwise (null too) 0."""
    return F.when(_c(c) > 0, 1).otherwise(0)


def absent_flag(c) -> Column:
    """``coalesce(x, 0) > 1`` gives 0, else 1."""
    return F.when(F.coalesce(_c(c).cast("double"), F.lit(0.0)) > 1, 0).otherwise(1)


def by_name(columns: Sequence[str], holds: str, without: Sequence[str], suffix: str, flag: Callable[[Column], Column]) -> dict[str, Column]:
    """For ``DataFrame.withColumns``, ``flag`` of every column whose name holds
    ``holds`` and none of ``without``, under that name and ``suffix``. Case counts, as in the names."""
    return {c + suffix: flag(F.col(f"`{c}`")) for c in columns if holds in c and not any(w in c for w in without)}


def complement(c) -> Column:
    """``1 - flag``."""
    return F.lit(1) - _c(c)


def threshold_flag(c, k: float, inclusive: bool = False) -> Column:
    """``c > k`` (or ``>=``) as 0/1; null gives 0."""
    cond = _c(c) >= k if inclusive else _c(c) > k
    return F.coalesce(cond.cast("int"), F.lit(0))


def capped_sum(cols: Sequence, cap: float = 1.0, fill_null: bool = True) -> Column:
    """``sum(min(cap, x))`` over columns. ``fill_null`` treats null as 0
    (the per-column ``fillna(0)`` form); otherwise a null propagates."""
    parts = []
    for c in cols:
        x = _c(c).cast("double")
        x = F.coalesce(x, F.lit(0.0)) if fill_null else x
        parts.append(F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(x, F.lit(cap))))
    return functools.reduce(lambda a, b: a + b, parts)


def cap(c, cap_value: float = 1.0) -> Column:
    """``min(cap, x)`` with null propagating (numpy semantics)."""
    x = _c(c).cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(x, F.lit(cap_value)))


def row_sum(cols: Sequence) -> Column:
    """P20: ``df[cols].sum(axis=1)``: nulls count as 0."""
    return functools.reduce(lambda a, b: a + b, [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols])


def age_at(score_year, birth, floor_age: int = 10, unknown_birth_year: int = 1900) -> Column:
    """P21 + D4: ``max(floor_age, score_year - year(birth))``; unknown birth year
    is 1900. A null score year stays null (numpy ``maximum`` propagates NaN)."""
    by = F.coalesce(F.year(_c(birth)), F.lit(unknown_birth_year))
    age = _c(score_year).cast("double") - by.cast("double")
    return F.when(age.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(age, F.lit(float(floor_age))))


def decade(age) -> Column:
    """``floor(age/10)*10``."""
    return round_nearest(age, 10, "down")


def centred_time(value, baseline) -> Column:
    """``1 + value - baseline``."""
    return F.lit(1) + _c(value) - _c(baseline)


def p_value_sig(p) -> Column:
    """P25: stars for a p-value; null or NaN gives the empty string."""
    p = nan_to_null(p)
    expr = None
    for level, stars in SIG_LEVELS:
        expr = F.when(p <= level, stars) if expr is None else expr.when(p <= level, stars)
    return expr.otherwise("")


def log_inverse(c) -> Column:
    """``exp(x)``."""
    return F.exp(_c(c))
