"""SQL for the oracles of fitted models and p-values: Newton steps as common table
expressions, Cholesky factors written out column by column, and tails of
distributions by Simpson's rule."""

from __future__ import annotations

_SIMPSON = "(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"


def _integral(density: str, low: str, high: str) -> str:
    """Of ``density`` (of ``x``) from ``low`` to ``high``, over 2,000 steps."""
    x = f"({low} + k * (({high}) - ({low})) / 2000)"
    return f"(list_sum(list_transform(range(0, 2001), lambda k: {_SIMPSON} * ({density.replace('@', x)}))) * (({high}) - ({low})) / 6000)"


def normal_tails(z: str) -> str:
    """Both tails beyond ``z`` of the normal distribution."""
    return f"(2 / sqrt(2 * pi()) * {_integral('exp(-0.5 * @ * @)', f'abs({z})', f'(abs({z}) + 13)')})"


def t_tails(t: str, dof: str) -> str:
    """Both tails beyond ``t`` of Student's distribution, over the angle whose tangent is t / sqrt(dof)."""
    low = f"atan(abs({t}) / sqrt({dof}))"
    high = f"least(pi() / 2, {low} + 16 / sqrt({dof}))"
    return (f"(2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi()) * "
            + _integral(f"pow(greatest(cos(@), 0), {dof} - 1)", low, high) + ")")


def chi2_tail(x: str, dof: str) -> str:
    """The tail beyond ``x`` of the chi-square distribution, over the square root."""
    low = f"sqrt({x})"
    return (f"(pow(2, 1 - {dof} / 2.0) / exp(lgamma({dof} / 2.0)) * "
            + _integral(f"pow(@, {dof} - 1) * exp(-0.5 * @ * @)", low, f"({low} + 13 + sqrt({dof}))") + ")")


def inverse(p: int, a: str = "a") -> str:
    """Columns ``inv<i>_<j>`` of the inverse of the symmetric matrix in columns ``<a><i>_<j>`` (i <= j)."""
    cols = []
    for j in range(p):
        minus = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        cols.append(f"sqrt({a}{j}_{j}{minus}) AS l{j}_{j}")
        for i in range(j + 1, p):
            minus = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            cols.append(f"({a}{j}_{i}{minus}) / l{j}_{j} AS l{i}_{j}")
    for j in range(p):
        cols.append(f"1 / l{j}_{j} AS m{j}_{j}")
        for i in range(j + 1, p):
            cols.append(f"-({' + '.join(f'l{i}_{k} * m{k}_{j}' for k in range(j, i))}) / l{i}_{i} AS m{i}_{j}")
    for i in range(p):
        for j in range(i, p):
            cols.append(f"{' + '.join(f'm{k}_{i} * m{k}_{j}' for k in range(j, p))} AS inv{i}_{j}")
    return ", ".join(cols)


def glm(src: str, y: str, xs: list[str], family: str, steps: int, prefix: str = "") -> str:
    """Common table expressions that end in ``<prefix>terms`` (segment, term, estimate, se, statistic, p,
    ci_low, ci_high, n) for each ``segment`` of ``src``: Newton's steps from a constant model."""
    p, q = len(xs) + 1, prefix
    eta = "greatest(least(b0" + "".join(f" + b{i + 1} * x{i + 1}" for i in range(len(xs))) + ", 500), -500)"
    data = ", ".join(f"CAST({x} AS DOUBLE) AS x{i + 1}" for i, x in enumerate(xs))
    start = "ln(avg(y) / (1 - avg(y)))" if family == "logit" else "ln(avg(y))"
    mu = f"1 / (1 + exp(-{eta}))" if family == "logit" else f"exp({eta})"
    weight, away = ("mu * (1 - mu)", "y - mu") if family == "logit" else ("1.0", "(y - mu) / mu")
    out = [f"{q}data AS MATERIALIZED (SELECT segment, CAST({y} AS DOUBLE) AS y, 1.0::DOUBLE AS x0, {data} FROM {src})",
           f"{q}b_0 AS (SELECT segment, {start} AS b0" + "".join(f", 0.0::DOUBLE AS b{i}" for i in range(1, p)) + f" FROM {q}data GROUP BY segment)"]
    for step in range(1, steps + 1):
        sums = [f"sum({weight} * x{i} * x{j}) AS a{i}_{j}" for i in range(p) for j in range(i, p)]
        sums += [f"sum(({away}) * x{i}) AS s{i}" for i in range(p)] + [f"any_value(b{i}) AS o{i}" for i in range(p)]
        entry = lambda i, j: f"inv{min(i, j)}_{max(i, j)}"
        new = ", ".join(f"o{i} + {' + '.join(f'{entry(i, j)} * s{j}' for j in range(p))} AS b{i}" for i in range(p))
        out.append(f"{q}b_{step} AS MATERIALIZED (SELECT *, {new} FROM (SELECT *, {inverse(p)} FROM (SELECT segment, count(*) AS n, "
                   f"sum(pow({away}, 2)) AS pearson, {', '.join(sums)} FROM (SELECT *, {mu} AS mu FROM {q}data JOIN {q}b_{step - 1}"
                   + (" USING (segment)" if step == 1 else f" _b USING (segment)") + ") GROUP BY segment)))")
    scale = "1.0" if family == "logit" else f"(pearson / (n - {p}))"
    rows = " UNION ALL ".join(f"SELECT segment, '{t}' AS term, b{i} AS estimate, sqrt(inv{i}_{i} * {scale}) AS se, n FROM {q}b_{steps}"
                              for i, t in enumerate(["const", *xs]))
    out.append(f"{q}terms AS (SELECT segment, term, estimate, se, estimate / se AS statistic, {normal_tails('(estimate / se)')} AS p, "
               f"estimate - 1.959963984540054 * se AS ci_low, estimate + 1.959963984540054 * se AS ci_high, n FROM ({rows}))")
    return ",\n".join(out)


def t_quantile(dof: str) -> str:
    """The 0.975 quantile of Student's distribution, by its expansion for many degrees of freedom."""
    z = 1.959963984540054
    terms = ((z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384)
    return f"({z!r} + " + " + ".join(f"{c!r} / pow({dof}, {i})" for i, c in enumerate(terms, 1)) + ")"


def ols(src: str, y: str, xs: list[str], prefix: str = "", intercept: bool = True) -> str:
    """Common table expressions that end in ``<prefix>terms`` (as :func:`glm`) and ``<prefix>stats`` (segment, n,
    r2, adj_r2, f_stat, loglik, aic, bic): least squares in each ``segment`` of ``src``."""
    q, names = prefix, (["const"] if intercept else []) + xs
    p, c = len(names), int(intercept)
    x = (["1.0::DOUBLE"] if intercept else []) + [f"CAST({v} AS DOUBLE)" for v in xs]
    sums = [f"sum({x[i]} * {x[j]}) AS a{i}_{j}" for i in range(p) for j in range(i, p)]
    sums += [f"sum({x[i]} * {y}) AS s{i}" for i in range(p)]
    entry = lambda i, j: f"inv{min(i, j)}_{max(i, j)}"
    beta = ", ".join(" + ".join(f"{entry(i, j)} * s{j}" for j in range(p)) + f" AS b{i}" for i in range(p))
    left = " - ".join([y, *[f"b{i} * {x[i]}" for i in range(p)]])
    tss = f"sum({y} * {y})" + (f" - pow(sum({y}), 2) / count(*)" if intercept else "")
    return f"""{q}beta AS MATERIALIZED (SELECT *, {beta} FROM (SELECT *, {inverse(p)} FROM (SELECT segment, {', '.join(sums)} FROM {src} GROUP BY segment))),
{q}residues AS MATERIALIZED (SELECT segment, count(*)::DOUBLE AS n, sum(pow({left}, 2)) AS rss, {tss} AS tss FROM {src} JOIN {q}beta USING (segment) GROUP BY segment),
{q}stats AS (SELECT *, -2 * loglik + 2 * {p} AS aic, -2 * loglik + {p} * ln(n) AS bic FROM (SELECT segment, n, 1 - rss / tss AS r2,
  1 - rss / tss * (n - {c}) / (n - {p}) AS adj_r2, (tss - rss) / {p - c} / (rss / (n - {p})) AS f_stat,
  -n / 2 * (ln(2 * pi()) + ln(rss / n) + 1) AS loglik FROM {q}residues)),
{q}terms AS (SELECT *, estimate / se AS statistic, {t_tails('(estimate / se)', f'(n - {p})')} AS p,
  estimate - {t_quantile(f'(n - {p})')} * se AS ci_low, estimate + {t_quantile(f'(n - {p})')} * se AS ci_high FROM (
  {' UNION ALL '.join(f"SELECT segment, '{t}' AS term, b{i} AS estimate, sqrt(inv{i}_{i} * rss / (n - {p})) AS se, n FROM {q}beta JOIN {q}residues USING (segment)"
                      for i, t in enumerate(names))}))"""
