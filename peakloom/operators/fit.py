"""Alternating refinement of block masses, and nearest compositions under masses that differ by sample.

A row of work is one (sample, trial) with the sample's peaks as an array, a spectrum's worth; Spark deals rows out, and each is
fitted by the numpy functions below. Per peak the misfit e^2 + lambda max(0, |e| - tolerance) grows with |e|, so
the best integer composition is the nearest lattice point, and no integer program is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from itertools import combinations, product
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MASS_UNIT


@dataclass(frozen=True)
class FitConfig:
    """Options of a phase. The penalty weights."""

    tolerance: float = 0.3
    final_tolerance: float = 0.5
    max_known: int = 10
    max_unknown: int = 4
    known_limits: tuple[int, ...] = ()
    lower: float = 35.0
    upper: float = 370.0
    iterations: int = 500
    bad_allowed: int = 0
    postgoal: int = 20
    common_fixed: bool = True
    anchors: tuple[float, ...] = ()
    block_weight: float = 10.0
    known_weight: float = 2e4
    multiple_weight: float = 1e4
    error_weight: float = 1e3
    most_error_weight: float = 1e6

    def limits(self, n_known: int, n: int) -> list[int]:
        known = [self.known_limits[r] if r < len(self.known_limits) else self.max_known for r in range(n_known)]
        return known + [self.max_unknown] * (n - n_known)


def _half(masses: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of some blocks and their masses, by mass."""
    points = np.array(list(product(*[range(m + 1) for m in limits])), dtype=np.int64).reshape(math.prod(m + 1 for m in limits), len(limits))
    sums = points @ masses if len(limits) else np.zeros(1)
    order = np.lexsort((points.sum(axis=1), sums))
    return points[order], sums[order]


#: Points of the largest lattice that is sorted whole.
WHOLE = 200_000


@lru_cache(maxsize=32)
def _grid(limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """All compositions in their order, and the rank of each by copies, then order."""
    points = np.ascontiguousarray(np.indices([m + 1 for m in limits]).reshape(len(limits), -1).T)
    rank = np.empty(len(points), dtype=np.int64)
    rank[np.argsort(points.sum(axis=1), kind="stable")] = np.arange(len(points))
    return points, rank


def nearest_compositions(y: np.ndarray, masses: np.ndarray, limits: list[int]) -> np.ndarray:
    """The composition nearest to each target; of equally near ones that of fewest copies, then the smallest. The sorted lattice is searched for each
    target, or, of more than WHOLE points, its halves."""
    k = len(masses)
    if k == 0 or not len(y):
        return np.zeros((len(y), k), dtype=np.int64)
    if math.prod(m + 1 for m in limits) > WHOLE:
        return _nearest_by_halves(y, masses, limits)
    points, rank = _grid(tuple(int(m) for m in limits))
    sums = points @ masses
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    at = np.searchsorted(sums, y)
    below, above = np.maximum(at - 1, 0), np.minimum(at, len(sums) - 1)
    nearest = np.where(np.abs(y - sums[below]) <= np.abs(y - sums[above]), below, above)
    reach = np.abs(y - sums[nearest]) + 1e-9
    first, last = np.minimum(np.searchsorted(sums, y - reach), nearest), np.maximum(np.searchsorted(sums, y + reach, side="right"), nearest + 1)
    picks = order[nearest]
    for i in np.flatnonzero(last - first > 1):
        ties = order[first[i] : last[i]]
        picks[i] = ties[rank[ties].argmin()]
    return points[picks]


def _nearest_by_halves(y: np.ndarray, masses: np.ndarray, limits: list[int]) -> np.ndarray:
    """Half of the blocks are enumerated against the sorted sums of the other half, so the whole lattice is never built."""
    cut = len(masses) // 2
    left, left_sums = _half(masses[:cut], limits[:cut])
    right, right_sums = _half(masses[cut:], limits[cut:])
    rest = y[:, None] - left_sums[None, :]
    at = np.searchsorted(right_sums, rest)
    picks = np.concatenate([np.maximum(at - 1, 0), np.minimum(at, len(right_sums) - 1)], axis=1)
    error = np.abs(np.concatenate([rest, rest], axis=1) - right_sums[picks])
    near = error <= error.min(axis=1, keepdims=True) + 1e-9
    first = near.argmax(axis=1)
    rows = np.arange(len(y))
    out = np.concatenate([left[first % len(left)], right[picks[rows, first]]], axis=1)
    for i in np.flatnonzero(near.sum(axis=1) > 1):
        ties = np.flatnonzero(near[i])
        found = np.concatenate([left[ties % len(left)], right[picks[i, ties]]], axis=1)
        out[i] = min(found.tolist(), key=lambda c: (sum(c), c))
    return out


def _costs(error: np.ndarray, tolerance: float, weight: float) -> np.ndarray:
    e = np.abs(error)
    return e**2 + weight * np.maximum(0, e - tolerance)


def _use_all_known(x: np.ndarray, y: np.ndarray, b: np.ndarray, limits: list[int], n_known: int, tolerance: float, weight: float) -> np.ndarray:
    """The cheapest change of x after which every known block occurs: a dynamic program over peaks and the sets of known blocks seen so far."""
    known = [r for r in range(n_known) if limits[r] > 0]
    if not len(y) or x[:, known].any(axis=0).all():
        return x
    full = (1 << len(known)) - 1
    options = []
    for s in range(full + 1):
        must = np.zeros(len(b), dtype=np.int64)
        must[[r for q, r in enumerate(known) if s >> q & 1]] = 1
        z = nearest_compositions(y - must @ b, b, [m - int(d) for m, d in zip(limits, must)]) + must
        options.append((z, _costs(z @ b - y, tolerance, weight), (z[:, known] > 0) @ (1 << np.arange(len(known)))))
    best, came = {0: 0.0}, []
    for i in range(len(y)):
        new: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        for seen, cost in best.items():
            for s, (_, costs, has) in enumerate(options):
                to, value = seen | int(has[i]), cost + costs[i]
                if to not in new or value < new[to]:
                    new[to], back[to] = value, (seen, s)
        best = new
        came.append(back)
    if full not in best:
        return x
    out, seen = np.empty_like(x), full
    for i in range(len(y) - 1, -1, -1):
        seen, s = came[i][seen]
        out[i] = options[s][0][i]
    return out


def best_compositions(y: np.ndarray, b: np.ndarray, n_known: int, config: FitConfig, weight: float) -> np.ndarray:
    """M2: the least total cost over sets of active unknown blocks, each costing block_weight; every known block occurs."""
    k, limits = len(b), config.limits(n_known, len(b))
    best, least = np.zeros((len(y), k), dtype=np.int64), math.inf
    for size in range(k - n_known + 1):
        for active in combinations(range(n_known, k), size):
            use = [m if r < n_known or r in active else 0 for r, m in enumerate(limits)]
            x = _use_all_known(nearest_compositions(y, b, use), y, b, use, n_known, config.tolerance, weight)
            cost = float(_costs(x @ b - y, config.tolerance, weight).sum()) + config.block_weight * size
            if cost < least - 1e-9:
                best, least = x, cost
    return best


def refit_masses(x: np.ndarray, y: np.ndarray, b: np.ndarray, n_known: int, anchor: np.ndarray, config: FitConfig) -> np.ndarray:
    """M3: weighted least squares in a box, with known masses held to their anchors and unknown ones to multiples of the mass unit. Strictly convex, so
    coordinate descent ends at the one minimum."""
    weight = np.minimum(1.0, config.final_tolerance / (np.abs(x @ b - y) + 1e-9))
    copies = max(min(int(math.ceil(y.max() / b[:n_known].min())) if n_known and len(y) and b[:n_known].min() > 0 else 1, config.max_known), 1)
    window = max(config.final_tolerance / copies, 0.01)
    goal, pull = np.concatenate([anchor, np.rint(b[n_known:] / MASS_UNIT) * MASS_UNIT]), np.where(np.arange(len(b)) < n_known, config.known_weight, config.multiple_weight)
    low = np.concatenate([np.maximum(anchor - window, 0), np.full(len(b) - n_known, config.lower)])
    high = np.concatenate([anchor + window, np.full(len(b) - n_known, config.upper)])
    a = (x * weight[:, None]).T @ x + np.diag(pull)
    rhs = (x * weight[:, None]).T @ y + pull * goal
    out = np.clip(np.linalg.solve(a, rhs), low, high)  # the minimum itself, where it is in the box
    for _ in range(10_000):
        was = out.copy()
        for r in range(len(b)):
            out[r] = min(max((rhs[r] - a[r] @ out + a[r, r] * out[r]) / a[r, r], low[r]), high[r])
        if np.abs(out - was).max() < 1e-12:
            break
    return out


def bic(n: int, rss: float, k: int) -> float:
    return n * math.log(max(rss, 1e-10) / n) + k * math.log(n)


def connectivity(x: np.ndarray, good: np.ndarray) -> float:
    """M10 for one sample: squared frequencies of steps of one or two changes among good peaks. Equal compositions are counted, not compared pair by pair."""
    rows, counts = np.unique(x[good], axis=0, return_counts=True)
    n_of, k, score = dict(zip(map(tuple, rows.tolist()), counts.tolist())), x.shape[1], 0.0
    one = [tuple(int(i == r) for i in range(k)) for r in range(k)]
    steps = one + [tuple(u + sign * v for u, v in zip(one[a], one[b])) for a in range(k) for b in range(a, k) for sign in ((1,) if a == b else (1, -1))]
    for step in steps:
        n = sum(many * n_of.get(tuple(map(add, c, step)), 0) for c, many in n_of.items())
        score += float(n) * n
    return score


def run_phase(observed: np.ndarray, masses: np.ndarray, n_known: int, common: float, config: FitConfig) -> dict:
    """M5, M6: compositions, masses and common mass in turn, until the goal has held for postgoal rounds, nothing improves for 3 (while most peaks are bad 6)
    rounds, or the iterations end. The best state has the fewest bad peaks; of equal ones the newest."""
    n, b = len(observed), masses.astype(float).copy()
    best, first = None, common
    if len(b):
        anchor = np.array(config.anchors[:n_known]) if config.anchors else b[:n_known].copy()
        weight, y, reached, after, stale, fewest = config.error_weight, observed - common, False, 0, 0, n
        for _ in range(config.iterations):
            x = best_compositions(y, b, n_known, config, weight)
            b = refit_masses(x, y, b, n_known, anchor, config)
            level = float(np.median(observed - x @ b))
            if config.common_fixed:
                common = (level + config.known_weight * first) / (1 + config.known_weight)
            else:
                common = max(0.0, common + float(np.clip(level - common, -10, 10)))
            y = observed - common
            bad = int((np.abs(y - x @ b) >= config.final_tolerance).sum())
            stale = 0 if bad < fewest else stale + 1
            if bad <= fewest:
                best, fewest = (x, b.copy(), common), bad
            reached = reached or bad <= config.bad_allowed
            after += reached
            # Rounds without gain before a stop, and the growth of the error weight below.
            if (reached and after >= config.postgoal) or stale >= (3 if fewest < 0.8 * n else 6):
                break
            if bad > config.bad_allowed and weight < config.most_error_weight:
                weight *= 1.5
        if best is None:
            return {"bic": math.inf, "rss": math.inf, "n_good": 0, "n_bad": n, "median_error": math.inf, "masses": masses.tolist(), "common": first, "compositions": [[0] * len(b)] * n, "errors": [math.inf] * n, "used": [False] * len(b), "connectivity": 0.0}
    x, b, common = best or (np.zeros((n, 0), dtype=np.int64), b, common)
    error = np.abs(observed - common - (x @ b if len(b) else 0))
    rss, used = float((error**2).sum()), x.any(axis=0)
    good = error < config.final_tolerance
    value = bic(n, rss, n_known + int(used[n_known:].sum())) if n and (len(b) or rss > 0) else math.inf
    return {
        "bic": value, "rss": rss, "n_good": int(good.sum()), "n_bad": int(n - good.sum()), "median_error": float(np.median(error)) if n else math.inf, "masses": b.tolist(), "common": float(common),
        "compositions": x.tolist(), "errors": error.tolist(), "used": used.tolist(), "connectivity": connectivity(x, good),
    }


RESULT = "bic double, rss double, n_good int, n_bad int, median_error double, masses array<double>, common double, compositions array<array<int>>, errors array<double>, used array<boolean>, connectivity double"


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """A row is much work and few bytes. Without a number of partitions Spark joins the small ones, and all rows are one task."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def run_trials(trials: DataFrame, config: FitConfig, **changes) -> DataFrame:
    """trials: (sample_id, trial, observed array, start array of masses, n_known, start_common) with a run_phase result each, and its start."""
    config = FitConfig(**(asdict(config) | changes))
    columns = ["sample_id", "trial", "n_known", "start"]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [run_phase(np.array(r.observed, dtype=float), np.array(r.start, dtype=float), int(r.n_known), float(r.start_common), config) for r in f.itertuples()]
            yield pd.concat([f[columns].reset_index(drop=True), pd.DataFrame(done, columns=[c.split()[0] for c in RESULT.split(", ")])], axis=1)

    schema = ", ".join(f"{c} {trials.schema[c].dataType.simpleString()}" for c in columns) + ", " + RESULT
    return _dealt(trials.select(*columns, "observed", "start_common"), "sample_id", "trial").mapInPandas(fit, schema)


def fit_models(samples: DataFrame, limits_of) -> DataFrame:
    """M1 with masses of each sample's own. samples: (sample_id, mask, observed array, masses array, common); limits_of(n_blocks) gives limits.
    One row (sample_id, mask, peak_id, observed, composition, error) for each peak."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for f in frames for r in f.itertuples()):
            b, y = np.array(r.masses, dtype=float), np.array(r.observed, dtype=float)
            limits = [m if r.mask >> i & 1 else 0 for i, m in enumerate(limits_of(len(b)))]
            x = nearest_compositions(y - r.common, b, limits)
            rows = [(r.sample_id, r.mask, p + 1, o, c, e) for p, (o, c, e) in enumerate(zip(y.tolist(), x.tolist(), np.abs(y - r.common - x @ b).tolist()))]
            yield pd.DataFrame(rows, columns=["sample_id", "mask", "peak_id", "observed", "composition", "error"])

    kind = samples.schema["sample_id"].dataType.simpleString()
    return _dealt(samples, "sample_id", "mask").mapInPandas(fit, f"sample_id {kind}, mask int, peak_id int, observed double, composition array<int>, error double")


def spectra(peaks: DataFrame) -> DataFrame:
    """(sample_id, observed array) in peak order: one spectrum a row."""
    return peaks.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("peak_id", "observed"))), lambda p: p["observed"]).alias("observed"))


def within_tolerance(target: float, masses: np.ndarray, limits: list[int], tolerance: float, most: int = 500) -> list[tuple[list[int], float]]:
    """G1 for one peak: the first `most` compositions below the tolerance in composition order, by error."""
    reach = np.append(np.cumsum((masses * np.array(limits))[::-1])[::-1], 0.0)
    found: list[tuple[list[int], float]] = []

    def extend(prefix: list[int], left: float) -> None:
        r = len(prefix)
        if len(found) >= most or left < -tolerance or left - reach[r] > tolerance:
            return
        if r == len(masses):
            if abs(left) < tolerance:
                found.append((prefix, abs(left)))
            return
        for n in range(limits[r] + 1):
            extend([*prefix, n], left - n * masses[r])

    extend([], target)
    return sorted(found, key=lambda f: f[1])


def sample_alternatives(samples: DataFrame, limits_of, tolerance: float) -> DataFrame:
    """G1 with masses of each sample's own: (sample_id, peak_id, observed, alternative, composition, error); zeros and an infinite error without any."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                b = np.array(r.masses, dtype=float)
                for p, o in enumerate(r.observed):
                    found = within_tolerance(o - r.common, b, limits_of(len(b)), tolerance) or [([0] * len(b), math.inf)]
                    rows += [(r.sample_id, p + 1, o, k + 1, c, e) for k, (c, e) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["sample_id", "peak_id", "observed", "alternative", "composition", "error"])

    kind = samples.schema["sample_id"].dataType.simpleString()
    return _dealt(samples, "sample_id").mapInPandas(fit, f"sample_id {kind}, peak_id int, observed double, alternative int, composition array<int>, error double")
