"""SQL for the Lasso queries: coordinate descent as a recursive query over the moments of all training sets at once.

The queries fit by working sets on the driver; here every column is swept in turn, from zero, a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Sequence

from .views import with_views

SWEEPS = 60
N_ALPHAS, EPS = 100, 1e-3


def fold_of(keys: Sequence[str], seed: int = 42, k: int = 5) -> str:
    return f"cast(cast('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(keys)}), 1, 8) as bigint) % {k} as int)"


def _recursive(body: str) -> str:
    return with_views(body).replace("with ", "with recursive ", 1)


def _soft(p: int, j: int, alpha: str, free: Sequence[int]) -> str:
    """New value of coefficient j, from the new ones before it and the old ones behind it."""
    rest = " - ".join([f"c{j}"] + [f"s{min(i, j)}{max(i, j)} * {'n' if i < j else 'b'}{i}" for i in range(p) if i != j])
    if j in free:
        return f"({rest}) / s{j}{j}"
    return f"sign({rest}) * greatest(abs({rest}) - {alpha}, 0) / s{j}{j}"


def _sweeps(p: int, keys: str, free: Sequence[int]) -> str:
    """One more sweep of table cd; ``keys``: what names a fit."""
    inner, carried = "select * from cd join tr using (v, g) where it < %d" % SWEEPS, ""
    for j in range(p):
        inner = f"select *, {_soft(p, j, 'alpha', free)} as n{j} from ({inner}) q{j}"
    carried = ", ".join(f"n{j}" for j in range(p))
    return f"select {keys}, alpha, it + 1, {carried} from ({inner}) q"


def _moments(p: int) -> str:
    parts = ["count(*) * 1e0 as n", "avg(y) as my", "var_pop(y) as vy"]
    parts += [f"avg(z{j}) as m{j}" for j in range(p)]
    parts += [f"covar_pop(z{j}, y) / any_value(d{j}) as c{j}" for j in range(p)]
    parts += [f"covar_pop(z{i}, z{j}) / (any_value(d{i}) * any_value(d{j})) as s{i}{j}" for i in range(p) for j in range(i, p)]
    return ", ".join(parts)


def _fits(rows: str, p: int, free: Sequence[int]) -> str:
    """Tables up to ``final``: the fit of each variant v of the rows (v, f, y, z0..) at its best alpha."""
    scales = ", ".join(f"stddev_pop(z{j}) as d{j}" for j in range(p))
    each = ", ".join(f"z{j}" for j in range(p))
    if free:
        lead = [f"abs(c{j} - s{min(j, free[0])}{max(j, free[0])} * c{free[0]} / s{free[0]}{free[0]})" for j in range(p) if j not in free]
    else:
        lead = [f"abs(c{j})" for j in range(p)]
    cross = " + ".join(f"b{i} * b{j} * h.s{min(i, j)}{max(i, j)}" for i in range(p) for j in range(p))
    away = " - ".join(["h.my - t.my"] + [f"b{j} * (h.m{j} - t.m{j}) / d{j}" for j in range(p)])
    return f"""
  lr as ({rows}),
  sc as (select v, {scales} from lr group by v),
  lz as (select * from lr join sc using (v)),
  tr as (select v, g, {_moments(p)} from lz, (select cast(range as int) as g from range(6)) where f <> g group by v, g),
  he as (select v, f as g, {_moments(p)} from lz group by v, f),
  grid as (select v, range as k, greatest({", ".join(lead)}) * {EPS} ** (range / {N_ALPHAS - 1}e0) as alpha from tr, range({N_ALPHAS}) where g = 5),
  cd(v, g, k, alpha, it, {", ".join(f"b{j}" for j in range(p))}) as (
    select v, g, k, alpha, 0, {", ".join("0e0" for _ in range(p))} from grid, (select cast(range as int) as g from range(6))
    union all {_sweeps(p, "v, g, k", free)}),
  done as (select * from cd where it = {SWEEPS}),
  cv as (select v, k, avg(h.vy - 2 * ({" + ".join(f"b{j} * h.c{j}" for j in range(p))}) + {cross} + ({away}) ** 2) as mse
         from done b join he h using (v, g) join tr t using (v, g) join sc using (v) group by v, k),
  best as (select v, arg_min(k, mse) as k from cv group by v),
  final as (select done.*, {each.replace("z", "d")}, {", ".join(f"t.c{j}" for j in range(p))}, t.n, t.vy,
            {", ".join(f"t.s{i}{j}" for i in range(p) for j in range(i, p))}
            from done join best using (v, k) join sc using (v) join tr t using (v, g) where g = 5)"""


def lasso_sql(rows: str, names: Sequence[str], free: Sequence[int] = ()) -> str:
    """feature, coefficient of one table."""
    out = " union all ".join(f"select '{n}' as feature, round(b{j}, 6) as coefficient from final" for j, n in enumerate(names))
    return _recursive(f"with {_fits(rows, len(names), free)} {out}")


def path_counts_sql(rows: str, names: Sequence[str], alphas: Sequence[float], controls: Sequence[str]) -> str:
    p = len(names)
    scales = ", ".join(f"stddev_pop(z{j}) as d{j}" for j in range(p))

    def count(which: list[int]) -> str:
        return " + ".join(f"cast(b{j} <> 0 as bigint)" for j in which) or "0::bigint"

    return _recursive(f"""with lr as ({rows}), sc as (select v, {scales} from lr group by v), lz as (select * from lr join sc using (v)),
  tr as (select v, 5 as g, {_moments(p)} from lz group by v),
  cd(v, g, alpha, it, {", ".join(f"b{j}" for j in range(p))}) as (
    select v, g, alpha, 0, {", ".join("0e0" for _ in range(p))} from tr, (select unnest([{", ".join(f"{a}::double" for a in alphas)}]) as alpha)
    union all {_sweeps(p, "v, g", ())})
  select alpha, {count(list(range(p)))} as n_total, {count([j for j in range(p) if names[j] not in controls])} as n_concept,
         {count([j for j in range(p) if names[j] in controls])} as n_control from cd where it = {SWEEPS}""")


def selection_sql(rows: str, test_rows: str, p: int, concepts: Sequence[int], outcome: str) -> str:
    """Result of a split by year; the variants v are the split years, ``test_rows`` are those from the year on."""
    square = " + ".join(f"b{i} * b{j} * %ss{min(i, j)}{max(i, j)}" for i in range(p) for j in range(p))
    line = " + ".join(f"b{j} * %sc{j}" for j in range(p))

    def r2(t: str) -> str:
        return f"1 - ({t}vy - 2 * ({line.replace('%s', t)}) + {square.replace('%s', t)}) / {t}vy"

    scaled = f"select * from ({test_rows}) join sc using (v)"
    return _recursive(f"""with {_fits(rows, p, ())}, te as (select v, {_moments(p)} from ({scaled}) group by v)
  select '{outcome}' as outcome, v as split_year, cast(q.n as bigint) as n_train, cast(e.n as bigint) as n_test,
         {" + ".join(f"cast(abs(b{j}) > 1e-6 as bigint)" for j in concepts)} as n_features_selected,
         round({r2("q.")}, 7) as r2_train, round({r2("e.")}, 7) as r2_test, round(alpha, 7) as alpha
  from final q join te e using (v)""")


def knots_sql(rows: str, names: Sequence[str]) -> str:
    """The path of two columns in closed form: the stronger one alone, then both."""
    return with_views(f"""with lr as ({rows}),
  m as (select corr(z0, z1) as r, covar_pop(z0, y) / stddev_pop(z0) as c0, covar_pop(z1, y) / stddev_pop(z1) as c1 from lr),
  a as (select *, abs(c0) >= abs(c1) as lead0, case when abs(c0) >= abs(c1) then c0 else c1 end as ca, case when abs(c0) >= abs(c1) then c1 else c0 end as co from m),
  g as (select *, least((abs(ca) - co) / (1 - r * sign(ca)), (abs(ca) + co) / (1 + r * sign(ca))) as step from a),
  k as (select 0 as step_no, abs(ca) as alpha, lead0, 0e0 as ba, 0e0 as bo, r, c0, c1 from g
        union all select 1, abs(ca) - step, not lead0, sign(ca) * step, 0e0, r, c0, c1 from g
        union all select 2, 0e0, lead0, (ca - r * co) / (1 - r * r), (co - r * ca) / (1 - r * r), r, c0, c1 from g),
  l as (select lead0 as first0 from g)
  select step_no as step, round(alpha, 7) as alpha, case when step_no = 2 then null when lead0 then '{names[0]}' else '{names[1]}' end as feature,
         case when step_no < 2 then 'enters' end as change, round(case when first0 then ba else bo end, 7) as b_{names[0]},
         round(case when first0 then bo else ba end, 7) as b_{names[1]} from k, l""")
