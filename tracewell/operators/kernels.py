"""Kernels with sequential state or transforms, run as grouped or batched pandas
functions: Spark deals and orders the series, numpy works within one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _butterworth_high(fs: float, hz: float) -> tuple[np.ndarray, np.ndarray]:
    """A second-order high-pass by the bilinear transform."""
    k = np.tan(np.pi * hz / fs)
    norm = 1 / (1 + np.sqrt(2) * k + k * k)
    return np.array([norm, -2 * norm, norm]), np.array([1.0, 2 * (k * k - 1) * norm, (1 - np.sqrt(2) * k + k * k) * norm])


def _pass(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    z0, z1 = z
    for i, v in enumerate(x):
        y = b[0] * v + z0
        z0 = b[1] * v - a[1] * y + z1
        z1 = b[2] * v - a[2] * y
        out[i] = y
    return out


def zero_phase_high(x: np.ndarray, fs: float, hz: float = 0.5) -> np.ndarray:
    """Filtered forward and back, over an odd extension of 9 samples, from the steady state; x itself if under 27 samples."""
    x = np.asarray(x, float)
    if len(x) < 27:
        return x
    b, a = _butterworth_high(fs, hz)
    # the state in which a constant input gives the filter's constant answer
    gain = b.sum() / a.sum()
    steady = np.array([gain - b[0], b[2] - a[2] * gain])
    ext = np.concatenate([2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]])
    y = _pass(b, a, ext, steady * ext[0])[::-1]
    return _pass(b, a, y, steady * y[0])[::-1][9:-9]


def fft_resampled(x: np.ndarray, n: int) -> np.ndarray:
    """n samples of the band-limited periodic signal through x."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(n)
    spectrum, m = np.fft.rfft(x), min(n, len(x))
    out = np.zeros(n // 2 + 1, complex)
    out[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0 and n != len(x):
        out[m // 2] *= 2 if n < len(x) else 0.5  # the Nyquist term of the shorter one
        if n < len(x):
            out[m // 2] = out[m // 2].real
    return np.fft.irfft(out, n) * (n / len(x))


def peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Strict local maxima (middle of a plateau), then height, then least distance with the highest first, then prominence.

    Every maximum is weighed, and only one of these three rules takes it out:
    of two under ``distance`` apart the lower goes (of equals the first), if
    the other one stands.
    """
    x = np.asarray(x, float)
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(x)]]) - 1
    a, b = starts[1:-1], ends[1:-1]
    top = (x[a - 1] < x[a]) & (x[b + 1] < x[a])
    at = (a[top] + b[top]) // 2
    if height is not None:
        at = at[x[at] >= height]
    lo, hi = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance)
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            keep[lo[k] : k] = keep[k + 1 : hi[k]] = False
    at = at[keep]
    if prominence is not None:
        at = np.array([p for p in at if _prominence(x, p) >= prominence], int)
    return at


#: bins as strong as the strongest, times samples, that strongest_bin() sums one by one
TIED = 1 << 20


def strongest_bin(x: np.ndarray, bins: int | None = None) -> int | None:
    """The number of turns over the length, from 1 to half of it (and ``bins`` at most), at which the mean-free samples have most
    power; None under two samples, and a null one counts as the mean.

    All bins come from one transform. Those that its rounding leaves open, as in
    a flat series, are summed sample by sample, as SQL would, and the first of
    the strongest counts; too many of them are taken to be equal at twelve digits.
    """
    n = len(x)
    most = n // 2 if bins is None else min(n // 2, bins)
    if most < 1:
        return None
    at = np.flatnonzero(~np.isnan(x))
    c = x[at] - (np.cumsum(x[at])[-1] / len(at) if len(at) else 0.0)
    whole = np.zeros(n)
    whole[at] = c
    size = np.abs(np.fft.rfft(whole)[1 : most + 1])
    near = np.flatnonzero(size >= size.max() - 4 * n * np.finfo(float).eps * np.abs(c).sum()) + 1
    if not c.any() or not len(near):  # flat, or not finite
        return 1
    if len(near) * n > TIED:
        near = near[size[near - 1] >= size.max() * (1 - 1e-12)][:1]

    def power(k: int) -> float:
        turns = (2 * math.pi * k * at / n).tolist()
        return sum(float(np.cumsum(c * np.array([f(t) for t in turns]))[-1]) ** 2 for f in (math.cos, math.sin))

    return int(near[0] if len(near) == 1 else min(near, key=lambda k: (-power(k), k)))


def _prominence(x: np.ndarray, p: int) -> float:
    left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
    lo = x[(left[-1] if len(left) else 0) : p + 1].min()
    hi = x[p : (p + 2 + right[0] if len(right) else len(x))].min()
    return float(x[p] - max(lo, hi))


def _cheapest_steps(cost: np.ndarray, prev: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of ``now``, the place in ``prev`` of least cost + squared step, and that cost.

    Both in ascending order, the best places ascend too: the middle of each gap
    is searched between the best places of the gap's ends, so memory is in
    proportion to the columns and time to their length times its logarithm.
    """
    up, across = np.argsort(prev, kind="stable"), np.argsort(now, kind="stable")
    cost, prev, now = cost[up], prev[up], now[across]
    n, m = len(prev), len(now)
    best = np.zeros(m + 2, np.int64)  # shifted by one: a place before the first and one after the last
    best[-1] = n - 1
    step = 1 << max(0, m.bit_length() - 1)
    while step:
        at = np.arange(step, m + 1, 2 * step)
        lo, hi = best[at - step], best[np.minimum(at + step, m + 1)]
        hi = np.maximum(lo, hi)
        sizes = hi - lo + 1
        begins = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(begins - lo, sizes)
        all_ = cost[place] + (np.repeat(now[at - 1], sizes) - prev[place]) ** 2
        least = np.minimum.reduceat(all_, begins)
        hits = np.flatnonzero(all_ == np.repeat(least, sizes))
        best[at] = place[hits[np.searchsorted(hits, begins)]]
        step //= 2
    found, total = np.empty(m, np.int64), np.empty(m)
    found[across] = up[best[1:-1]]
    total[across] = cost[best[1:-1]] + (now - prev[best[1:-1]]) ** 2
    return found, total


def cheapest_path(columns: list[np.ndarray], order: int = 1) -> np.ndarray:
    """A candidate of each column so that squared steps (order 1) or squared changes of step (order 2) cost least in all."""
    if order == 1:
        cost, back = np.zeros(len(columns[0])), []
        for prev, now in zip(columns, columns[1:], strict=False):
            places, cost = _cheapest_steps(cost, prev, now)
            back.append(places)
        k = int(cost.argmin())
        path = [k]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array([c[i] for c, i in zip(columns, reversed(path), strict=True)])
    if len(columns) < 3:
        return cheapest_path(columns, 1)
    cost, back = 1e-3 * (columns[1][None, :] - columns[0][:, None]) ** 2, []
    for a, b, c in zip(columns, columns[1:], columns[2:], strict=False):
        bend = (c[None, None, :] - 2 * b[None, :, None] + a[:, None, None]) ** 2
        all_ = cost[:, :, None] + bend
        back.append(all_.argmin(0))
        cost = all_.min(0)
    i, j = np.unravel_index(int(cost.argmin()), cost.shape)
    path = [int(j), int(i)]
    for b in reversed(back):
        path.append(int(b[path[-1], path[-2]]))
    return np.array([c[k] for c, k in zip(columns, reversed(path), strict=True)])


def normalise_bands(bands: list[tuple[float, float]], expected: int) -> list[tuple[float, float]]:
    """As many bands as expected: the smallest go, or the tallest are cut in half, one at a time."""
    out = sorted(bands)
    while out and len(out) != expected:
        if len(out) > expected:
            out.remove(min(out, key=lambda b: (b[1] - b[0], b)))
        else:
            lo, hi = max(out, key=lambda b: (b[1] - b[0], -b[0]))
            out.remove((lo, hi))
            out = sorted([*out, (lo, (lo + hi) / 2), ((lo + hi) / 2, hi)])
    return out


def offset_match(labels: np.ndarray, traces: np.ndarray, tolerance: float = 45.0) -> tuple[float, list[tuple[int, int]]]:
    """The offset, among those that some label and trace propose, that matches most labels to unused traces, then with least error."""
    best: tuple = (0, 0.0, 0.0, [])
    for offset in sorted({float(t - x) for x in labels for t in traces}):
        used, pairs, error = set(), [], 0.0
        for k, x in enumerate(labels):
            free = [(abs(x + offset - t), j) for j, t in enumerate(traces) if j not in used and abs(x + offset - t) <= tolerance]
            if free:
                d, j = min(free)
                used.add(j)
                pairs.append((k, j))
                error += d
        if (len(pairs), -error) > (best[0], best[1]):
            best = (len(pairs), -error, offset, pairs)
    return best[2], best[3]


#: hypotheses times labels or traces that best_offset() holds at once
MATCHED = 1 << 20


def best_offset(y: np.ndarray, traces: np.ndarray, tolerance: float, part: int = 0, parts: int = 1) -> tuple[int, float, int, int, np.ndarray] | None:
    """The best offset that one of ``parts`` shares of the labels proposes: minus its matches, its error, the label and trace that
    propose it first, and for each label the trace it takes (or -1); None if none matches anything.

    ``y`` and ``traces`` ascend, all traces differ. Under an offset the labels
    choose in order, each the nearest trace (ties: the lower) that is within
    ``tolerance`` and not taken. All offsets of a block go through the labels
    together. Of labels at one place the first proposes for all.
    """
    best, own = None, np.unique(y, return_index=True)[1][part::parts]
    step = max(1, MATCHED // (len(traces) * max(len(y), len(traces)) or 1))
    for a in range(0, len(own), step):
        block = own[a : a + step]
        offsets, first = np.unique(traces[None, :] - y[block, None], return_index=True)
        lines = np.arange(len(offsets))
        free, error, taken = np.ones((len(offsets), len(traces)), bool), np.zeros(len(offsets)), np.full((len(offsets), len(y)), -1, np.int32)
        for k, at in enumerate(y):
            aim = at + offsets
            # one more place to either side, as the difference may round to the tolerance
            lo = np.maximum(np.searchsorted(traces, aim - tolerance) - 1, 0)
            hi = np.minimum(np.searchsorted(traces, aim + tolerance, "right") + 1, len(traces))
            place = lo[:, None] + np.arange((hi - lo).max())
            inside = np.minimum(place, len(traces) - 1)
            d = np.abs(traces[inside] - aim[:, None])
            d = np.where((place < hi[:, None]) & (d <= tolerance) & free[lines[:, None], inside], d, np.inf)
            nearest = d.argmin(1)
            least = d[lines, nearest]
            hits = np.flatnonzero(least < np.inf)
            chosen = inside[hits, nearest[hits]]
            free[hits, chosen] = False
            error[hits] += least[hits]
            taken[hits, k] = chosen
            if not free.any():
                break
        matches = (taken >= 0).sum(1)
        k = np.lexsort((first, error, -matches))[0]
        found = (-int(matches[k]), float(error[k]), int(block[first[k] // len(traces)]), int(first[k] % len(traces)), taken[k])
        if matches[k] and (best is None or found[:4] < best[:4]):
            best = found
    return best


def _over_arrays(fn, returns: str):
    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(np.asarray(x, float)))

    return run


def best_offsets(y: Column, traces: Column, part: Column, parts: Column, tolerance: float) -> Column:
    """best_offset() of each row, its places counted from 0; null where nothing matches."""

    @F.pandas_udf("rank int, error double, label int, trace int, taken array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [best_offset(np.asarray(a, float), np.asarray(b, float), tolerance, *ks) for a, b, *ks in zip(*rows, strict=True)]
            yield pd.DataFrame([f or (None,) * 5 for f in found], columns=["rank", "error", "label", "trace", "taken"], dtype=object)

    return run(y, traces, part, parts)


def high_passed(x: Column, fs: float, hz: float = 0.5) -> Column:
    return _over_arrays(lambda v: zero_phase_high(v, fs, hz), "array<double>")(x)


def fft_resample(x: Column, n: int) -> Column:
    return _over_arrays(lambda v: fft_resampled(v, n), "array<double>")(x)


def find_peaks(x: Column, height: float | None = None, distance: int = 1, prominence: float | None = None) -> Column:
    return _over_arrays(lambda v: peaks(v, height, distance, prominence).tolist(), "array<long>")(x)


def find_peaks_by_share(x: Column, height: float, distance: int, prominence: float | None = None) -> Column:
    """find_peaks() with height and prominence as shares of the array's largest value; nulls are none, and no peaks."""

    def run(v: np.ndarray) -> list[int]:
        top = np.nanmax(v) if not np.isnan(v).all() else 0.0
        return peaks(v, height * top, distance, None if prominence is None else prominence * top).tolist()

    return _over_arrays(run, "array<long>")(x)


def strongest_bins(x: Column, bins: int | None = None) -> Column:
    return _over_arrays(lambda v: strongest_bin(v, bins), "double")(x)


def heart_rate(x: Column, fs: float, lo: float = 0.3, hi: float = 2.0) -> Column:
    """60 / median gap, in seconds, of the peaks above mean + std; null under two gaps in (lo, hi)."""

    def rate(v: np.ndarray) -> float | None:
        at = peaks(v, v.mean() + v.std(), int(0.25 * fs))
        rr = np.diff(at) / fs
        rr = rr[(rr > lo) & (rr < hi)]
        return float(60 / np.median(rr)) if len(rr) >= 2 else None

    return _over_arrays(rate, "double")(x)


def tracked(candidates: DataFrame, keys: list[str], column: str, value: str, order: int = 1) -> DataFrame:
    """The cheapest path through each series' candidates: one value for each column."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [(c, g[value].to_numpy(float)) for c, g in frame.sort_values([column, value]).groupby(column)]
        path = cheapest_path([v for _, v in groups], order)
        head = {k: frame[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, column: [c for c, _ in groups], "y": path})

    schema = ", ".join([f"{k} {candidates.schema[k].dataType.simpleString()}" for k in [*keys, column]] + ["y double"])
    return candidates.groupBy(*keys).applyInPandas(run, schema)
