"""Tail probabilities as DuckDB SQL, by Simpson's rule on densities or by series; arguments are column names."""

STEPS = 2000


def _area(density, x: str) -> str:
    """The integral of a density from 0 to x."""
    at = f"({x} * i / {STEPS}.0)"
    return f"({x} / {3 * STEPS}.0 * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density(at)})))"


def normal_tail(z: str) -> str:
    return f"(1 - 2 * {_area(lambda u: f'exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'abs({z})')})"


def t_tail(t: str, n: str) -> str:
    front = f"lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0) - ln({n} * pi()) / 2"
    return f"(1 - 2 * {_area(lambda u: f'exp({front} - ({n} + 1) / 2.0 * ln(1 + {u} * {u} / {n}))', f'abs({t})')})"


def f_tail(f: str, d1: str, d2: str) -> str:
    front = f"lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) + {d1} / 2.0 * ln({d1} / {d2}::DOUBLE)"
    return f"(1 - {_area(lambda u: f'exp({front} - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {u} / {d2})) * pow({u}, {d1} / 2.0 - 1)', f)})"


def chi2_tail(x: str, even: str) -> str:
    """For an even number of degrees."""
    return f"list_sum(list_transform(range(0, ({even} / 2)::BIGINT), lambda j: exp(j * ln({x} / 2) - lgamma(j + 1) - {x} / 2)))"


def ks_tail(d: str, n: str, m: str) -> str:
    x = f"({d} * sqrt({n} * {m} / ({n} + {m})::DOUBLE))"
    return f"(CASE WHEN {x} < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {x} * {x}))))) END)"
