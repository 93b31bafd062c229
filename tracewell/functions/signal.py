"""Column expressions on signals held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def median(x: Column) -> Column:
    n = F.size(x)
    return F.when(n > 0, let(F.array_sort(x), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2))


def std_pop(x: Column) -> Column:
    return F.sqrt(let(mean(x), lambda m: mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def span(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def rms(x: Column) -> Column:
    return F.sqrt(mean(F.transform(x, lambda v: v * v)))


def combined(x: Column, y: Column, a: float, b: float) -> Column:
    """a * x + b * y, element by element, over the shorter length."""
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda u, v: F.lit(a) * u + F.lit(b) * v)


def centered(x: Column, by=median) -> Column:
    return let(by(x), lambda m: F.transform(x, lambda v: v - m))


def linspace(lo, hi, n: int) -> Column:
    lo, hi = F.lit(lo), F.lit(hi)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * (hi - lo) / (n - 1))


def resampled(x: Column, n: int) -> Column:
    """n points of the line through x, evenly from its first to its last; null for an empty x."""

    def on(s: Column) -> Column:
        last = F.size(s) - 1
        at = lambda i: i * last / F.lit(float(max(n - 1, 1)))
        below = lambda i: F.least(F.floor(at(i)).cast("int"), F.greatest(last - 1, F.lit(0)))
        line = lambda i, k: F.get(s, k) + (F.coalesce(F.get(s, k + 1), F.get(s, k)) - F.get(s, k)) * (at(i) - k)
        return F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: line(i, below(i))))

    return let(x, on)


def decimated(x: Column, width: int) -> Column:
    """The samples nearest to ``width`` even steps over x, for display."""
    step = F.size(x) / F.lit(float(width))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(x, F.least(F.floor(i * step + 0.5).cast("int"), F.size(x) - 1)))


def padded(x: Column, n: int) -> Column:
    """x, or zeros where it is null or empty, as n samples."""
    zeros = F.array_repeat(F.lit(0.0), n)
    return F.when(F.coalesce(F.size(x), F.lit(0)) > 0, resampled(x, n)).otherwise(zeros)


def robust_scaled(x: Column, target: float = 0.35) -> Column:
    """Centered on the median and scaled so that 1.4826 * MAD is ``target``; as it is if the MAD is 0."""
    scaled = lambda d: let(F.lit(1.4826) * median(F.transform(d, F.abs)), lambda m: F.when(m > 0, F.transform(d, lambda v: v / m * F.lit(target))).otherwise(x))
    return let(centered(x), scaled)


def std_scaled(x: Column, target: float = 0.35) -> Column:
    return let(std_pop(x), lambda sd: F.when(sd > 0, F.transform(x, lambda v: v * F.lit(target) / sd)).otherwise(x))


def joined(x: Column, places: int = 4) -> Column:
    """The samples as one string of numbers with blanks between."""
    return F.array_join(F.transform(x, lambda v: F.format_string(f"%.{places}f", v)), " ")


def split_numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))


def bump(x: Column, center: float, width: float, height: float) -> Column:
    z = (x - F.lit(center)) / F.lit(width)
    return F.lit(height) * F.exp(F.lit(-0.5) * z * z)


#: fixed values: center, width and height of the five waves of a synthetic beat, by phase
BEAT = ((0.15, 0.025, 0.12), (0.26, 0.010, -0.10), (0.28, 0.011, 1.00), (0.30, 0.011, -0.22), (0.52, 0.045, 0.30))


def synthetic(samples: int, bpm: float, fs: float = 500.0, gain: float = 1.0) -> Column:
    """A synthetic recording: the beat's waves summed over the phase of each sample."""

    def at(i):
        phase = F.pmod(i / F.lit(fs) * F.lit(bpm / 60.0), F.lit(1.0))
        waves = [bump(phase, *w) for w in BEAT]
        return F.lit(gain) * sum(waves[1:], waves[0])

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at)


def segment(x: Column, column: int, width: int) -> Column:
    """The window of ``width`` samples that a montage's column shows."""
    return F.slice(x, column * width + 1, width)
