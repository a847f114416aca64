"""Scalar functions of a numeric array column, as Spark expressions (no Python at run time).

Arrays are short (a tile's samples, a class distribution, an embedding). Variances are of the
population; quantiles interpolate linearly; ties of an argmax go to the first place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def moment(a: Column, k: int) -> Column:
    m = mean(a)
    return total(F.transform(a, lambda x: F.pow(x - m, F.lit(float(k))))) / F.size(a)


def variance(a: Column) -> Column:
    return moment(a, 2)


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def energy(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x)) / F.size(a)


def rms(a: Column) -> Column:
    return F.sqrt(energy(a))


def quantile(a: Column, q: float) -> Column:
    s = F.array_sort(a)
    h = (F.size(a) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")
    below = F.element_at(s, lo + 1)
    above = F.element_at(s, F.least(lo + 2, F.size(a)))
    return below + (above - below) * (h - lo)


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def skewness(a: Column, floor: float = 1e-12) -> Column:
    return moment(a, 3) / F.pow(F.greatest(variance(a), F.lit(floor)), F.lit(1.5))


def kurtosis(a: Column, floor: float = 1e-12, excess: bool = True) -> Column:
    v = F.greatest(variance(a), F.lit(floor))
    return moment(a, 4) / (v * v) - F.lit(3.0 if excess else 0.0)


def mean_abs_deviation(a: Column) -> Column:
    m = mean(a)
    return mean(F.transform(a, lambda x: F.abs(x - m)))


def median_abs_deviation(a: Column) -> Column:
    m = median(a)
    return median(F.transform(a, lambda x: F.abs(x - m)))


def shape_factor(a: Column, floor: float = 1e-8) -> Column:
    return rms(a) / F.greatest(F.abs(mean(a)), F.lit(floor))


def diff(a: Column, lag: int = 1) -> Column:
    n = F.size(a) - lag
    return F.zip_with(F.slice(a, lag + 1, n), F.slice(a, 1, n), lambda y, x: y - x)


def _changes(a: Column, differs) -> Column:
    n = F.size(a) - 1
    return total(F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n), lambda y, x: F.when(differs(x, y), 1.0).otherwise(0.0)))


def sign_changes(a: Column) -> Column:
    """Neighbours of different sign; zero is a sign of its own."""
    return _changes(a, lambda x, y: F.signum(x) != F.signum(y))


def strict_crossings(a: Column) -> Column:
    """Neighbours whose product is negative."""
    return _changes(a, lambda x, y: x * y < 0)


def filled_crossings(a: Column) -> Column:
    """Sign changes once zeros take the sign before them (leading zeros are dropped)."""
    return sign_changes(F.filter(a, lambda x: x != 0))


def centred(a: Column) -> Column:
    m = mean(a)
    return F.transform(a, lambda x: x - m)


def slope(a: Column) -> Column:
    """Least squares against the centred index."""
    n = F.size(a)
    c = (n - 1) / F.lit(2.0)
    return total(F.transform(a, lambda x, i: x * (i - c))) / (n * (n * n - 1) / F.lit(12.0))


def autocorrelation(a: Column, lag: int, floor: float = 1e-12) -> Column:
    c = centred(a)
    n = F.size(a) - lag
    return total(F.zip_with(F.slice(c, lag + 1, n), F.slice(c, 1, n), lambda x, y: x * y)) / F.greatest(total(F.transform(c, lambda x: x * x)), F.lit(floor))


def power(a: Column, n: int) -> Column:
    """Squared magnitudes of the real Fourier transform of n samples: n // 2 + 1 bins."""

    def bin_(k: int) -> Column:
        cos = F.array(*[F.lit(math.cos(2 * math.pi * k * t / n)) for t in range(n)])
        sin = F.array(*[F.lit(math.sin(2 * math.pi * k * t / n)) for t in range(n)])
        re, im = dot(a, cos), dot(a, sin)
        return re * re + im * im

    return F.array(*[bin_(k) for k in range(n // 2 + 1)])


def normalised(a: Column, floor: float = 1e-12) -> Column:
    s = F.greatest(total(a), F.lit(floor))
    return F.transform(a, lambda x: x / s)


def entropy(p: Column, floor: float = 1e-12) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(floor)))))


def centroid(p: Column) -> Column:
    return total(F.transform(p, lambda x, k: x * k))


def rolloff(p: Column, share: float = 0.95) -> Column:
    """The first place whose running sum reaches the share."""
    folded = F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["k"] + F.when(acc["s"] + x < share, 1).otherwise(0)).alias("k")))
    return F.least(folded["k"], F.size(p) - 1)


def moving_average(a: Column, width: int) -> Column:
    """Box filter of odd width, zeros beyond both ends."""
    half = width // 2
    n = F.size(a)
    return F.transform(a, lambda x, i: total(F.slice(a, F.greatest(i + 1 - half, F.lit(1)), F.least(i + 1 + half, n) - F.greatest(i + 1 - half, F.lit(1)) + 1)) / F.lit(float(width)))


def gradient(a: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(a)
    return F.transform(a, lambda x, i: F.when(i == 0, F.element_at(a, 2) - F.element_at(a, 1)).when(i == n - 1, F.element_at(a, -1) - F.element_at(a, -2)).otherwise((F.get(a, i + 1) - F.get(a, i - 1)) / 2))


def ema(a: Column, alpha: float) -> Column:
    """Exponential smoothing that starts at the first value."""
    none = F.array().cast("array<double>")
    return F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.element_at(acc, -1) * F.lit(1 - alpha) + x * F.lit(alpha)))))


def runs(a: Column, holds) -> Column:
    """Lengths of the maximal runs where the predicate holds."""
    none = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("open"))
    folded = F.aggregate(a, none, lambda acc, x: F.when(holds(x), F.struct(acc["done"].alias("done"), (acc["open"] + 1).alias("open"))).otherwise(F.struct(F.when(acc["open"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.lit(0).alias("open"))))
    return F.when(folded["open"] > 0, F.concat(folded["done"], F.array(folded["open"]))).otherwise(folded["done"])


def histogram_entropy(a: Column, bins: int = 10) -> Column:
    lo, hi = F.array_min(a), F.array_max(a)
    place = F.transform(a, lambda x: F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda p: p == b)) / F.size(a))
    return entropy(F.filter(counts, lambda c: c > 0))


def differential_entropy(a: Column, floor: float = 1e-12) -> Column:
    return F.lit(0.5) * F.ln(F.lit(2 * math.pi * math.e) * F.greatest(variance(a), F.lit(floor)))


def mobility(a: Column, floor: float = 1e-12) -> Column:
    return F.sqrt(variance(diff(a)) / F.greatest(variance(a), F.lit(floor)))


def complexity(a: Column, floor: float = 1e-12) -> Column:
    return mobility(diff(a)) / F.greatest(mobility(a), F.lit(floor))


def petrosian(a: Column) -> Column:
    n, changes = F.size(a), strict_crossings(diff(a))
    return F.log10(n) / (F.log10(n) + F.log10(n / (n + F.lit(0.4) * changes)))


def katz(a: Column, floor: float = 1e-12) -> Column:
    d = F.transform(diff(a), F.abs)
    length = F.greatest(total(d), F.lit(floor))
    first = F.element_at(a, 1)
    reach = F.greatest(F.array_max(F.transform(a, lambda x: F.abs(x - first))), F.lit(floor))
    n = F.log10(length / F.greatest(length / F.size(d), F.lit(floor)))
    return n / (n + F.log10(reach / length))


def peaks(a: Column) -> Column:
    """Places of values above the one before and not below the one after, ends excluded."""
    n = F.size(a)
    return F.filter(F.sequence(F.lit(1), n - 2), lambda i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) >= F.get(a, i + 1)))


def prominences(a: Column) -> Column:
    """Of each peak: its height over the higher of the two lowest points towards higher ground."""

    def low(side: Column, height: Column) -> Column:
        # walk away from the peak while not above it, keeping the least value
        start = F.struct(height.alias("m"), F.lit(True).alias("on"))
        return F.aggregate(side, start, lambda acc, x: F.struct(F.when(acc["on"] & (x <= height), F.least(acc["m"], x)).otherwise(acc["m"]).alias("m"), (acc["on"] & (x <= height)).alias("on")))["m"]

    return F.transform(peaks(a), lambda i: F.get(a, i) - F.greatest(low(F.reverse(F.slice(a, 1, i)), F.get(a, i)), low(F.slice(a, i + 2, F.size(a)), F.get(a, i))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def correlation(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Pearson; 0 where one side doesn't vary."""
    x, y = centred(a), centred(b)
    scale = norm(x) * norm(y)
    return F.when(scale > floor, dot(x, y) / scale).otherwise(F.lit(0.0))


def z_rows(a: Column, floor: float = 1e-12) -> Column:
    """Centred and scaled so that a dot product is Pearson's r."""
    return unit(centred(a), floor)


def argmax(a: Column) -> Column:
    """Place from 0 of the greatest value, the first on ties."""
    return F.array_position(a, F.array_max(a)) - 1


def margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def softmax(a: Column) -> Column:
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def logsumexp(a: Column) -> Column:
    m = F.array_max(a)
    return m + F.ln(total(F.transform(a, lambda x: F.exp(x - m))))


def logit(p: Column, floor: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def floored_log(p: Column, floor: float) -> Column:
    return F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(floor))))


def l1(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def bhattacharyya(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)))


def jensen_shannon(p: Column, q: Column, floor: float = 1e-12) -> Column:
    def part(x, m):
        return F.when(x > 0, x * F.ln(x / F.greatest(m, F.lit(floor)))).otherwise(0.0)

    return total(F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2))


def rank_of(p: Column, place: Column) -> Column:
    """How many values are greater than the one at ``place`` (from 0)."""
    v = F.get(p, place.cast("int"))
    return F.size(F.filter(p, lambda x: x > v))


def one_hot(c: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == c).cast("int"))


def parse_list(text: Column) -> Column:
    """'[1 2, 3]' to an array of doubles."""
    bare = F.trim(F.regexp_replace(text, r"[\[\],\s]+", " "))
    return F.when(bare == "", F.array().cast("array<double>")).otherwise(F.split(bare, " ").cast("array<double>"))
