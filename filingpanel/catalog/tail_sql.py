"""SQL for tail probabilities, by other expansions than the package's: fixed-depth fractions evaluated from behind."""

from __future__ import annotations

DEPTH = 300


def normal_two_sided(z: str) -> str:
    """erfc(|z| / sqrt 2): the power series near zero, the continued fraction beyond."""
    x = f"(abs({z}) / sqrt(2e0))"
    series = (f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: "
              f"(case when i % 2 = 0 then 1 else -1 end) * exp((2 * i + 1) * ln(greatest({x}, 1e-300)) - lgamma(i + 1)) / (2 * i + 1)))")
    fraction = f"list_reduce(list_prepend({x}, list_transform(range(0, 120), lambda i: (120 - i) / 2e0)), lambda acc, h: {x} + h / acc)"
    return f"(case when {x} < 1.5 then {series} else exp(-{x} * {x}) / sqrt(pi()) / {fraction} end)"


def _beta_side(a: str, b: str, x: str) -> str:
    """x^a (1-x)^b / (a B(a, b)) over the continued fraction, from its term number ``DEPTH`` forward."""
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    terms = (f"flatten(list_transform(range(0, {DEPTH}), lambda r: list_transform([{DEPTH} - r], lambda m: [{odd}, {even}])[1]))")
    first = f"-({a} + {b}) * {x} / ({a} + 1)"
    fraction = f"list_reduce(list_prepend(1e0, list_append({terms}, {first})), lambda acc, t: 1 + t / acc)"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
    return f"{front} / {a} / ({fraction})"


def incomplete_beta(a: str, b: str, x: str) -> str:
    a, b, x = f"({a})", f"({b})", f"({x})"
    return f"""(case when {x} <= 0 then 0e0 when {x} >= 1 then 1e0 when {x} < ({a} + 1) / ({a} + {b} + 2) then {_beta_side(a, b, x)}
      else 1 - {_beta_side(b, a, f"(1 - {x})")} end)"""


def t_two_sided(t: str, df: str) -> str:
    return incomplete_beta(f"{df} / 2e0", "0.5e0", f"{df} / ({df} + ({t}) * ({t}))")


def f_upper(f: str, d1: str, d2: str) -> str:
    return f"(case when {f} <= 0 then 1e0 else {incomplete_beta(f'{d2} / 2e0', f'{d1} / 2e0', f'{d2} / ({d2} + {d1} * ({f}))')} end)"
