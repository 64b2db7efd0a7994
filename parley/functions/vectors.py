"""Vector expressions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def dot(a, b):
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))


def unit(a):
    """At unit length; a zero vector is divided by 1."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a, b):
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def l1(a, b):
    """L1 distance; the shorter one is padded with zeros."""
    z = F.lit(0.0)
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(F.coalesce(x, z) - F.coalesce(y, z))), z, lambda s, x: s + x)


def euclid(a, b):
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def sound(a):
    """Neither null, empty, all zero, nor holding a NaN."""
    return F.coalesce(F.exists(_c(a), lambda x: x != 0) & ~F.exists(_c(a), lambda x: F.isnan(x)), F.lit(False))


def si_sdr(estimate, reference, floor: float = 1e-8):
    """Scale-invariant signal-to-distortion ratio in dB, after cutting to the shorter length and removing means.

    -inf where the reference has no energy, +inf where there is no noise.
    """
    n = F.least(F.size(estimate), F.size(reference))
    x, r = F.slice(estimate, 1, n), F.slice(reference, 1, n)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    # sums less means: a mean inside a lambda would be made anew for each element
    energy = dot(r, r) - add(r) * add(r) / n
    shared = dot(x, r) - add(x) * add(r) / n
    gain = shared / F.greatest(energy, F.lit(1e-300))
    target = energy * gain * gain
    rest = dot(x, x) - add(x) * add(x) / n - gain * shared
    ratio = F.lit(10.0) * F.log10(F.greatest(target, F.lit(1e-300)) / F.greatest(rest, F.lit(1e-300)))
    return F.when(energy < floor, F.lit(float("-inf"))).when(rest < floor, F.lit(float("inf"))).otherwise(ratio)


def energy_ratio(energies):
    """Least over greatest of at least two energies."""
    return F.when(F.size(energies) >= 2, F.array_min(energies) / F.when(F.array_max(energies) == 0, F.lit(1.0)).otherwise(F.array_max(energies)))
