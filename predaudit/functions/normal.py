"""The normal distribution and tests of normality as column expressions, and Shapiro-Wilk on a bounded sample."""

from __future__ import annotations

from functools import reduce
from math import asin, exp, log, pi, sqrt
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a published rational form of the normal distribution function, highest power first.
CDF_ABOVE = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BELOW = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CDF_SWITCH, ROOT_2PI = 7.07106781186547, 2.506628274631

# Published p-value approximations of the Kolmogorov-Smirnov statistic with fitted mean and deviation:
# the small tail, and polynomials (constant term first) in the modified statistic up to each bound.
TAIL = (-7.01256, 2.78019, 2.99587, -0.122119, 0.974598, 1.67997)
BODY = (
    (0.302, (1.0,)),
    (0.5, (2.76773, -19.828315, 80.709644, -138.55152, 81.218052)),
    (0.9, (-4.901232, 40.662806, -97.490286, 94.029866, -32.355711)),
    (1.31, (6.198765, -19.558097, 23.186922, -12.234627, 2.423045)),
)

# Published polynomials (constant term first) for the weights and the p-value of the Shapiro-Wilk statistic.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)


def _horner(coefficients, x):
    """Value of a polynomial, highest power first, for numbers or columns."""
    return reduce(lambda total, c: total * x + c, coefficients[1:], coefficients[0])


def _polynomial(coefficients, x):
    return _horner(coefficients[::-1], x) if len(coefficients) > 1 else coefficients[0]


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 15 digits."""
    x = F.abs(z)
    density = F.exp(-x * x / 2.0)
    body = density * _horner((F.lit(CDF_ABOVE[0]), *CDF_ABOVE[1:]), x) / _horner((F.lit(CDF_BELOW[0]), *CDF_BELOW[1:]), x)
    fraction = reduce(lambda inner, k: x + k / inner, (4.0, 3.0, 2.0, 1.0), x + 0.65)
    upper = F.when(x < CDF_SWITCH, body).otherwise(density / fraction / ROOT_2PI)
    return F.when(z > 0, 1.0 - upper).otherwise(upper)


def fitted_ks_p_value(statistic: Column, n: Column) -> Column:
    """p-value of the largest distance from a normal whose mean and sample deviation were fitted to the ``n`` values; null below 5."""
    n = n.cast("double")
    size = F.least(n, F.lit(100.0))
    d = F.when(n > 100, statistic * F.pow(n / 100.0, F.lit(0.49))).otherwise(statistic)
    a, b, c, e, f, g = TAIL
    tail = F.exp(a * d * d * (size + b) + c * d * F.sqrt(size + b) + e + f / F.sqrt(size) + g / size)
    modified = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * statistic
    body = F.lit(0.0)
    for bound, coefficients in reversed(BODY):
        value = _horner((F.lit(coefficients[-1]), *coefficients[-2::-1]), modified)
        body = F.when(modified <= bound, value).otherwise(body)
    p = F.when(tail > 0.1, body).otherwise(tail)
    return F.when(n >= 5, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def shapiro_wilk(values: list[float]) -> tuple[float, float] | None:
    """Statistic and p-value for 3 to 5000 values; None for fewer, or for values that are all equal."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None
    normal = NormalDist()
    if n == 3:
        weights = [-sqrt(0.5), 0.0, sqrt(0.5)]
    else:
        scores = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        total = sum(s * s for s in scores)
        u = 1 / sqrt(n)
        last = _polynomial(WEIGHT_LAST, u) + scores[-1] / sqrt(total)
        if n > 5:
            following = _polynomial(WEIGHT_NEXT, u) + scores[-2] / sqrt(total)
            scale = sqrt((total - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * following**2))
            ends = [following, last]
        else:
            scale = sqrt((total - 2 * scores[-1] ** 2) / (1 - 2 * last**2))
            ends = [last]
        k = len(ends)
        weights = [-w for w in reversed(ends)] + [s / scale for s in scores[k : n - k]] + ends
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    w = min(1.0, sum(a * (v - mean) for a, v in zip(weights, x)) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    distance = log(1 - w)
    if n <= 11:
        gamma = _polynomial(SMALL_GAMMA, n)
        if distance >= gamma:
            return w, 0.0
        distance, mean_, spread_ = -log(gamma - distance), _polynomial(SMALL_MEAN, n), exp(_polynomial(SMALL_SPREAD, n))
    else:
        size = log(n)
        mean_, spread_ = _polynomial(LARGE_MEAN, size), exp(_polynomial(LARGE_SPREAD, size))
    return w, 1 - normal.cdf((distance - mean_) / spread_)
