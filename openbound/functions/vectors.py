"""Vector scalar functions (V1-V8) as Spark Column builders.

Spark has no vector built-ins and SQL UDFs cannot be called inside lambdas,
so every function returns a plain Column built from higher-order functions;
everything stays in the JVM.

Conventions
-----------
* vectors are ``ARRAY<DOUBLE>`` (cast float arrays once, up front);
* norms use the reference epsilon: ``||v|| = sqrt(sum v^2 + 1e-12)``, so a
  zero vector normalises to zero and its cosine with anything is 0.0;
* ``cos`` is the dot product of the two epsilon-normalised vectors;
* NULL and NaN stay NULL and NaN through every function, clamps included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: numeric constants of the reference formulas
NORM_EPS = 1e-12          # added to the squared norm before the square root
ACOS_EPS = 1e-7           # acos input is clamped to [-1 + eps, 1 - eps]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_vector(c) -> Column:
    return _col(c).cast("array<double>")


def dot(a, b) -> Column:
    """V4 raw inner product."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x * x)


def safe_norm(a) -> Column:
    """sqrt(sum v^2 + eps) -- the denominator the reference divides by."""
    return F.sqrt(sq_norm(a) + F.lit(NORM_EPS))


def l2_normalize(a) -> Column:
    """V1: v / sqrt(sum v^2 + 1e-12)."""
    n = safe_norm(a)
    return F.transform(_col(a), lambda x: x / n)


def cos_from_parts(dot_ab: Column, norm_a: Column, norm_b: Column,
                   clamp: bool = True) -> Column:
    """Cosine from a dot product and two epsilon norms (lets callers reuse norms)."""
    c = dot_ab / (norm_a * norm_b)
    return clamp_unit(c) if clamp else c


def _clamp(c: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL and NaN: Spark's ``least``/``greatest`` skip NULL and rank NaN
    highest, which would turn a missing vector into cosine 1.  The one-element array
    evaluates ``c`` once."""
    return F.transform(F.array(c), lambda v: F.when(v.isNull() | F.isnan(v), v).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), v))))[0]


def clamp_unit(c: Column) -> Column:
    return _clamp(c, -1.0, 1.0)


def is_usable(norm: Column) -> Column:
    """A vector can be scored if its norm is finite: not NULL, no NULL, NaN or infinite component."""
    return F.coalesce(~F.isnan(norm) & (norm < F.lit(float("inf"))), F.lit(False))


def cosine(a, b, clamp: bool = True) -> Column:
    """V2 (clamped to [-1, 1]) and, with ``clamp=False``, V3."""
    return cos_from_parts(dot(a, b), safe_norm(a), safe_norm(b), clamp)


def acos_clamped(c) -> Column:
    """V5: acos with its input clamped to +-(1 - 1e-7)."""
    return F.acos(_clamp(_col(c), -1.0 + ACOS_EPS, 1.0 - ACOS_EPS))


def angle(c) -> Column:
    """V6: acos without clamping (NaN when |c| > 1, as in the reference)."""
    return F.acos(_col(c))


def sin_from_cos(c) -> Column:
    """V7: sqrt(1 - c^2)."""
    c = _col(c)
    return F.sqrt(F.lit(1.0) - c * c)


def radius(margin_vec, proxy) -> Column:
    """V8: class acceptance radius = cos(margin_c, proxy_c), a same-row diagonal."""
    return cosine(margin_vec, proxy, clamp=True)
