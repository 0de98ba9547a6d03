"""Link functions, densities and distribution functions as native Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IMPOSSIBLE = float("-inf")

# Rational approximation of the normal quantile (algorithm AS 241, PPND16).
CENTRAL_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
               1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
               3.3430575583588128105e4, 2.5090809287301226727e3)
CENTRAL_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
               5.2264952788528545610e3)
MIDDLE_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
              3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
              2.27238449892691845833e-2, 7.74545014278341407640e-4)
MIDDLE_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0,
              6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2,
              5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1,
           1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5,
           1.42151175831644588870e-7, 2.04426310338993978564e-15)


def polynomial(coefficients, x: Column) -> Column:
    """Horner form of c0 + c1 x + c2 x^2 + ..."""
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""
    q = p - 0.5
    central = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    near, far = tail - 1.6, tail - 5.0
    outer = F.when(tail <= 5.0, polynomial(MIDDLE_NUM, near) / polynomial(MIDDLE_DEN, near)) \
        .otherwise(polynomial(FAR_NUM, far) / polynomial(FAR_DEN, far))
    return F.when(F.abs(q) <= 0.425,
                  q * polynomial(CENTRAL_NUM, central) / polynomial(CENTRAL_DEN, central)) \
        .otherwise(F.signum(q) * outer)


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _inside(x: Column, support: Column, density: Column) -> Column:
    """A log density: minus infinity outside the support, null for a null value only."""
    return F.when(support, density).when(x.isNotNull(), F.lit(IMPOSSIBLE))


def log_of(p: Column) -> Column:
    """ln p with minus infinity at 0, where Spark's logarithm is null."""
    return F.when(p > 0, F.ln(p)).when(p == 0, F.lit(IMPOSSIBLE))


def log_of_rest(p: Column) -> Column:
    """ln(1 - p) with minus infinity at 1."""
    return F.when(p < 1, F.log1p(-p)).when(p == 1, F.lit(IMPOSSIBLE))


def log_normal_precision(x: Column, mean: float | Column, precision: float | Column) -> Column:
    """Log density of a normal given its *precision*, as the model notation passes it."""
    mean, precision = _col(mean), _col(precision)
    return 0.5 * F.ln(precision / (2 * math.pi)) - 0.5 * precision * (x - mean) * (x - mean)


def log_truncated_normal(x: Column, mean: float, precision: float) -> Column:
    """Normal restricted to x > 0; the mass above 0 is a constant of the prior."""
    mass = 0.5 * math.erfc(-mean * math.sqrt(precision) / math.sqrt(2.0))
    return _inside(x, x > 0, log_normal_precision(x, mean, precision) - math.log(mass))


def log_half_cauchy(x: Column, scale: float) -> Column:
    """Student t with one degree of freedom restricted to x > 0."""
    return _inside(x, x > 0, math.log(2.0 / (math.pi * scale))
                   - F.log1p((x / scale) * (x / scale)))


def log_uniform(x: Column, low: float | Column, high: float | Column) -> Column:
    return _inside(x, (x > low) & (x < high), -F.ln(_col(high) - _col(low)))


def log_beta(x: Column, a: float, b: float) -> Column:
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return _inside(x, (x > 0) & (x < 1), norm + (a - 1) * F.ln(x) + (b - 1) * F.log1p(-x))


def log_bernoulli(y: Column, p: Column) -> Column:
    """An event of probability 0 scores minus infinity."""
    return F.when(y == 1, log_of(p)).otherwise(log_of_rest(p))


def log_factorial(k: Column) -> Column:
    """ln k! for an integer column by summing logarithms."""
    return F.when(k < 2, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(2), F.greatest(k, F.lit(2))), F.lit(0.0),
                    lambda total, i: total + F.ln(i.cast("double"))))


def log_gamma_density(x: Column, shape: Column, rate: Column) -> Column:
    """Log density of a gamma with *integer* shape."""
    return _inside(x, x > 0, shape * F.ln(rate) + (shape - 1) * F.ln(x) - rate * x
                   - log_factorial(shape - 1))


def gamma_density(x: Column, shape: Column, rate: Column) -> Column:
    """Density of a gamma with integer shape; at x = 0 it is the rate when shape = 1, else 0."""
    return F.when(x > 0, F.exp(log_gamma_density(x, shape, rate))) \
        .when(shape == 1, rate).otherwise(F.lit(0.0))


def erlang_cdf(x: Column, shape: Column, rate: Column) -> Column:
    """Distribution function of a gamma with integer shape: 1 - e^-lx sum_{j<k} (lx)^j / j!."""
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    parts = F.aggregate(
        F.sequence(F.lit(1), shape), zero,
        lambda acc, j: F.struct((acc["term"] * rate * x / j).alias("term"),
                                (acc["total"] + acc["term"]).alias("total")))
    return F.lit(1.0) - F.exp(-rate * x) * parts["total"]


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform on [0, 1) that depends only on the seed and the keys of the row, so a re-run, a
    lost task or another partitioning gives the same value. 52 bits of an MD5 digest, which any
    SQL engine can recompute."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(float(2 ** 52))


def _col(value):
    return value if isinstance(value, Column) else F.lit(float(value))
