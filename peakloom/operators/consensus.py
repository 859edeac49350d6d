"""Consensus compositions: one per peak, from several models.

candidates and alternatives: (sample_id, peak_id, observed, composition, error, ...).
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import block_bits, total

ERROR_WEIGHT = 0.1
DEPENDENCY_WEIGHT = 0.3


def simplest_consensus(peak_stats: DataFrame, n_blocks: int) -> DataFrame:
    """Each peak's best model's composition, zeros where none explains it."""
    zeros = F.array_repeat(F.lit(0), F.lit(n_blocks))
    return peak_stats.select("sample_id", "peak_id", "observed", F.coalesce("best_composition", zeros).alias("composition"))


def explaining_compositions(fits: DataFrame, tolerance: float) -> DataFrame:
    """U4: the distinct compositions of each peak below the tolerance, with the first model (least mask) that has each."""
    good = fits.where(F.col("error") < tolerance)
    return good.groupBy("sample_id", "peak_id", "composition").agg(F.first("observed").alias("observed"), F.min_by("error", "mask").alias("error"), F.min("mask").alias("mask"))


def connected(candidates: DataFrame) -> DataFrame:
    """Candidates with connectivity, the other peaks of the sample that have a candidate one step away.

    Each candidate's 2k neighbours are generated and looked up by an equi-join.
    """
    steps = F.array(F.lit(1), F.lit(-1))
    near = candidates.select("sample_id", "peak_id", F.col("composition").alias("own"), F.explode(F.sequence(F.lit(0), F.size("composition") - 1)).alias("k")).withColumn("s", F.explode(steps))
    near = near.withColumn("composition", F.transform("own", lambda n, i: F.when(i == F.col("k"), n + F.col("s")).otherwise(n)))
    theirs = candidates.select("sample_id", F.col("peak_id").alias("other"), "composition")
    met = near.join(theirs, ["sample_id", "composition"]).where(F.col("other") != F.col("peak_id"))
    counts = met.groupBy("sample_id", "peak_id", F.col("own").alias("composition")).agg(F.count_distinct("other").alias("connectivity"))
    return candidates.join(counts, ["sample_id", "peak_id", "composition"], "left").fillna(0, ["connectivity"])


def network_consensus(peaks: DataFrame, candidates: DataFrame, n_blocks: int) -> DataFrame:
    """Per peak the candidate with most connectivity, fewest copies and least error (then the earliest model); zeros without one."""
    copies = total(F.transform("composition", lambda n: F.greatest(n, F.lit(0))))
    key = F.struct("connectivity", (-copies).alias("copies"), (-F.col("error")).alias("error"), (-F.col("mask")).alias("mask"))
    best = connected(candidates).groupBy("sample_id", "peak_id").agg(F.max_by("composition", key).alias("composition"))
    rows = peaks.join(best, ["sample_id", "peak_id"], "left")
    return rows.select("sample_id", "peak_id", "observed", F.coalesce("composition", F.array_repeat(F.lit(0), F.lit(n_blocks))).alias("composition"))


def trusted_prerequisites(usage: DataFrame, confidence: float = 0.5) -> DataFrame:
    """C4: (sample_id, trusted array<int>): the prerequisite mask of each block that enough of its models use, 0 for the others."""
    ok = (F.col("n_used") > 0) & (F.col("n_used") / F.col("n_with") >= confidence)
    masks = F.transform(F.array_sort(F.collect_list(F.struct("block", F.when(ok, F.col("prerequisites")).otherwise(0).alias("need")))), lambda x: x["need"])
    return usage.groupBy("sample_id").agg(masks.alias("trusted"))


def dependency_score(composition, trusted):
    """Satisfied less violated trusted prerequisites of the blocks present."""
    bits = block_bits(composition)
    each = F.zip_with(composition, trusted, lambda n, need: F.when(n > 0, 2 * F.bit_count(need.bitwiseAND(bits)) - F.bit_count(need)).otherwise(0))
    return total(each)


def with_dependencies(alternatives: DataFrame, usage: DataFrame, hard_prune: bool = False, confidence: float = 0.5) -> DataFrame:
    """alternatives with dep_score; F8: hard_prune drops those that lack a trusted prerequisite (a peak that loses all keeps one of zeros)."""
    rows = alternatives.join(trusted_prerequisites(usage, confidence), "sample_id", "left")
    zeros = F.transform("composition", lambda n: F.lit(0))
    rows = rows.withColumn("trusted", F.coalesce("trusted", zeros)).withColumn("dep_score", dependency_score(F.col("composition"), F.col("trusted")))
    if not hard_prune:
        return rows.drop("trusted")
    bits = block_bits(F.col("composition"))
    broken = F.exists(F.zip_with("composition", "trusted", lambda n, need: (n > 0) & (need.bitwiseAND(bits) != need)), lambda x: x)
    kept = rows.where(~broken)
    lost = rows.groupBy("sample_id", "peak_id").agg(F.first("observed").alias("observed"), F.first(zeros).alias("composition")).join(kept.select("sample_id", "peak_id").distinct(), ["sample_id", "peak_id"], "left_anti")
    lost = lost.select("sample_id", "peak_id", "observed", F.lit(1).alias("alternative"), "composition", F.lit(float("inf")).alias("error"), F.lit(0).alias("dep_score"))
    return kept.select(*lost.columns).unionByName(lost)


def near_steps(n_blocks: int) -> dict[tuple[int, ...], tuple[int, ...]]:
    """Each step of one or two changes, with its canonical form."""
    unit = lambda i: tuple(int(i == j) for j in range(n_blocks))
    ones = [u for i in range(n_blocks) for u in (unit(i), tuple(-x for x in unit(i)))]
    both = {tuple(x + y for x, y in zip(a, b)) for a in ones for b in ones}
    steps = {*ones, *both} - {(0,) * n_blocks}
    return {v: max(v, tuple(-x for x in v)) for v in steps}


class Annealer:
    """One sample's choice of an alternative for each peak.

    Score: squared frequencies of the steps between the chosen compositions + ERROR_WEIGHT x quality + weight x dependency score. Steps join neighbouring
    alternatives, which are linked once; what a peak's choice adds to the score then takes its neighbours alone.
    """

    def __init__(self, compositions: list[np.ndarray], errors: list[np.ndarray], extra: list[np.ndarray], tolerance: float):
        self.first = np.cumsum([0] + [len(c) for c in compositions]).tolist()
        self.own = np.concatenate([np.where(e < tolerance, ERROR_WEIGHT * (1 - e / tolerance), -ERROR_WEIGHT) + x for e, x in zip(errors, extra)]).tolist()
        every = [tuple(c) for group in compositions for c in group.tolist()]
        peak = [p for p, group in enumerate(compositions) for _ in group]
        at: dict[tuple[int, ...], list[int]] = {}
        for k, c in enumerate(every):
            at.setdefault(c, []).append(k)
        steps = near_steps(len(every[0])) if every else {}
        # Of each alternative: the alternatives of other peaks one step away, and the step.
        self.links = [[(other, step) for v, step in steps.items() for other in at.get(tuple(x + y for x, y in zip(c, v)), ()) if peak[other] != peak[k]] for k, c in enumerate(every)]

    def _adds(self, k: int, chosen: list[bool], frequency: Counter) -> float:
        """What alternative k adds to the score of the other peaks' choices."""
        met = Counter(step for other, step in self.links[k] if chosen[other])
        return self.own[k] + sum(n * (2 * frequency[step] + n) for step, n in met.items())

    def _sweep(self, state: list[int], chosen: list[bool], frequency: Counter, heat: float, draw: random.Random) -> bool:
        """Each peak with a choice, in random order, is chosen anew given all others: by its alternatives' additions, with Gumbel noise of the heat, which
        draws them by their Boltzmann weights. Whether any choice changed."""
        peaks = [p for p in range(len(state)) if self.first[p + 1] - self.first[p] > 1]
        draw.shuffle(peaks)
        moved = False
        for p in peaks:
            was = state[p]
            chosen[was] = False
            frequency.subtract(step for other, step in self.links[was] if chosen[other])
            noise = lambda: -heat * math.log(-math.log(draw.random() or 1e-300)) if heat else 0.0
            now = max(range(self.first[p], self.first[p + 1]), key=lambda k: (self._adds(k, chosen, frequency) + noise(), k == was, -k))
            frequency.update(step for other, step in self.links[now] if chosen[other])
            state[p], chosen[now] = now, True
            moved |= now != was
        return moved

    def run(self, seed: int = 42, starts: int = 4, sweeps: int = 30) -> np.ndarray:
        """The best state of some descents, the first from each peak's first alternative, the others cooled from ever hotter ones: an index into each peak's alternatives."""
        draw, best, most = random.Random(seed), None, -math.inf
        for turn in range(starts):
            state = self.first[:-1]
            chosen = [False] * len(self.own)
            for k in state:
                chosen[k] = True
            frequency = Counter(step for k in state for other, step in self.links[k] if chosen[other] and other > k)
            for t in range(sweeps if turn else 0):
                self._sweep(state, chosen, frequency, 4.0**turn * (1 - t / sweeps) ** 2, draw)
            while self._sweep(state, chosen, frequency, 0.0, draw):
                pass
            score = sum(f * f for f in frequency.values()) + sum(self.own[k] for k in state)
            if score > most + 1e-9:
                best, most = list(state), score
        return np.array(best, dtype=int) - np.array(self.first[:-1], dtype=int)


def annealed_consensus(alternatives: DataFrame, tolerance: float, dependency_weight: float = 0.0) -> DataFrame:
    """C3, and C4 with a weight for dep_score: samples are annealed in parallel, one group of alternatives (at most 500 a peak) each."""
    schema = "sample_id {}, peak_id {}, observed double, composition array<int>".format(*(alternatives.schema[c].dataType.simpleString() for c in ("sample_id", "peak_id")))

    def anneal(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [g for _, g in frame.sort_values(["peak_id", "alternative"]).groupby("peak_id", sort=True)]
        compositions = [np.array(g["composition"].tolist(), dtype=int) for g in groups]
        extra = [dependency_weight * g["dep_score"].to_numpy(dtype=float) if dependency_weight else np.zeros(len(g)) for g in groups]
        chosen = Annealer(compositions, [g["error"].to_numpy() for g in groups], extra, tolerance).run()
        return pd.DataFrame([(g["sample_id"].iloc[0], g["peak_id"].iloc[0], g["observed"].iloc[0], c[k].tolist()) for g, c, k in zip(groups, compositions, chosen)], columns=["sample_id", "peak_id", "observed", "composition"])

    return alternatives.groupBy("sample_id").applyInPandas(anneal, schema)


def overridden_best(peak_stats: DataFrame, consensus: DataFrame, tolerance: float, name: str = "BioConsensus3") -> DataFrame:
    """Peaks that the consensus explains name it as their best model. consensus has error."""
    c = consensus.select("sample_id", "peak_id", "composition", "error")
    return overridden(peak_stats.join(c, ["sample_id", "peak_id"], "left"), tolerance, name)


def overridden(rows: DataFrame, tolerance: float, name: str = "BioConsensus3") -> DataFrame:
    """overridden_best() where the consensus is in the peak's row, as composition and error; these are dropped."""
    good = F.col("error") < tolerance
    return rows.withColumns({"best_model": F.when(good, name).otherwise(F.col("best_model")), "best_composition": F.when(good, F.col("composition")).otherwise(F.col("best_composition"))}).drop("composition", "error")


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Peaks on which two consensus models differ."""
    a = first.select("sample_id", "peak_id", F.col("composition").alias("first"))
    return a.join(second.select("sample_id", "peak_id", F.col("composition").alias("second")), ["sample_id", "peak_id"]).where(F.col("first") != F.col("second"))


MODELS: Sequence[str] = ("Consensus", "BioConsensus", "BioConsensus2", "BioConsensus3")
