"""Distribution tails on numpy: incomplete beta and gamma functions by continued fractions and series."""

from __future__ import annotations

from math import exp, lgamma, log, log1p


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    value = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value / a


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gammainc_upper(df / 2, x / 2)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Exact test of a 2 x 2 table: tables of the same margins that are no likelier."""
    a, b, c, d = int(a), int(b), int(c), int(d)  # a column with nulls comes as floats
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda p, q: lgamma(p + 1) - lgamma(q + 1) - lgamma(p - q + 1)
    chance = lambda k: exp(choose(row, k) + choose(n - row, col - k) - choose(n, col))
    seen = chance(a)
    return min(1.0, sum(p for k in range(max(0, row + col - n), min(row, col) + 1) if (p := chance(k)) <= seen * (1 + 1e-7)))


def normal_upper(z: float) -> float:
    return 0.5 * (gammainc_upper(0.5, z * z / 2) if z >= 0 else 2 - gammainc_upper(0.5, z * z / 2))


__all__ = ["betainc", "chi2_upper", "f_upper", "fisher_two_sided", "gammainc_upper", "normal_upper", "t_two_sided"]
