"""The whole analysis of many samples: candidates, progressive selection, refinement, model comparison, consensus and analytics.

Every step is one job over all samples; the driver only loops over steps, at most one for each block that may be added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_COMMON
from ..functions.exprs import adjusted_bic, bic, bit, common_mass, composition_name, dot, strings
from ..operators import candidates, compare, consensus, dependencies, fit, lattice, network
from ..operators.lattice import MASK_BITS
from ..operators.storage import settled
from ..sources import dictionary as dictionaries

LEAST_GAIN = 2.0


@dataclass(frozen=True)
class SolveConfig:
    """Options; the defaults are those of the command line."""

    mode: str | None = None
    matrix: str | None = None
    common: float | None = None
    composition: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_COMMON))
    names: tuple[str, ...] = ("Hex",)
    masses: tuple[float, ...] = ()
    known_limits: tuple[int, ...] = ()
    exclude: tuple[str, ...] = ()
    protect: tuple[str, ...] = ()
    max_added: int = 3
    min_diff: float = 40.0
    exhaustive: int = 1
    sanity_check: bool = False
    glycan_type: str = "native"
    dictionary: str | None = None
    label: str = "2-AA"
    fit: fit.FitConfig = field(default_factory=fit.FitConfig)


def resolved(spark: SparkSession, config: SolveConfig) -> tuple[DataFrame, SolveConfig]:
    """The dictionary, and the configuration with names, masses and common mass filled in. A name that the dictionary lacks keeps no mass, and the
    names that follow keep theirs."""
    book = settled(dictionaries.blocks(spark, config.dictionary, config.glycan_type))
    by_name = {r["name"]: r.mass for r in book.orderBy("ord").collect()}  # a dictionary's rows
    low = {n.lower(): (n, m) for n, m in by_name.items()}
    known = [low[n.lower()] for n in config.names if n.lower() in low]
    known += [(next((n for n, x in by_name.items() if abs(x - m) < candidates.NAME_WINDOW), f"{m:g}"), m) for m in config.masses]
    common = config.common
    if common is None:
        labels = {r["name"]: r.mass for r in dictionaries.labels(spark).collect()}
        polarity, reduction = config.mode, (config.matrix or "").rpartition("_")[2] or None
        common = common_mass(config.composition, by_name, labels.get(config.label, 0.0) if (config.matrix or "").startswith("2aa") else 0.0, polarity, reduction)
    if len(known) + config.max_added > MASK_BITS:
        raise ValueError(f"{len(known)} known blocks and up to {config.max_added} more; a model's mask holds {MASK_BITS}")
    fitting = replace(config.fit, known_limits=config.known_limits)
    return book, replace(config, names=tuple(n for n, _ in known), masses=tuple(m for _, m in known), common=common, fit=fitting)


def _masses_of(tokens: tuple[str, ...], book: DataFrame) -> list[float]:
    if not tokens:
        return []
    rows = book.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    return [r.mass for r in candidates.resolved_masses(rows, book).collect() if r.mass is not None]


def _order(new_masses: Column) -> Column:
    n = F.size("errors")
    return F.struct((-F.col("n_good")).alias("good"), (-F.col("connectivity")).alias("connected"), adjusted_bic(F.col("bic"), n, new_masses).alias("adjusted"), F.col("trial"))


def select_blocks(spectra: DataFrame, ranked: DataFrame, config: SolveConfig) -> DataFrame:
    """(sample_id, selected masses, common, bic, n_good). Each step tries the five best free candidates of every sample; where none
    helps at the first step, pairs of these."""
    known = F.array(*[F.lit(float(m)) for m in config.masses]) if config.masses else F.array().cast("array<double>")
    n_known = len(config.masses)
    first = spectra.select("sample_id", F.lit(0).alias("trial"), "observed", known.alias("start"), F.lit(n_known).alias("n_known"), F.lit(config.common).alias("start_common"))
    base = fit.run_trials(first, config.fit, iterations=40, bad_allowed=10**9)
    state = settled(base.select("sample_id", "bic", "n_good", "common", F.array().cast("array<double>").alias("selected"), F.array().cast("array<int>").alias("taken"), F.lit(True).alias("open")))
    near = lambda masses, m: F.exists(masses, lambda s: F.abs(m - s) < candidates.NAME_WINDOW)
    for step in range(config.max_added):
        live = state.where(F.col("open") & (F.size("selected") < config.max_added))
        free = ranked.select("sample_id", "rank", "median").join(live, "sample_id").where(~F.array_contains("taken", F.col("rank")) & ~near(F.col("selected"), F.col("median")) & ~near(known, F.col("median")))
        top = settled(candidates.available(free, (), 5).join(spectra, "sample_id"))
        if top.isEmpty():
            break
        trial = lambda rows, new: rows.select("sample_id", "trial", "observed", F.concat(known, "selected", new).alias("start"), F.lit(n_known).alias("n_known"), F.col("common").alias("start_common"))
        singles = top.withColumn("trial", F.col("rank"))
        state = settled(_accepted(state, fit.run_trials(trial(singles, F.array("median")), config.fit, iterations=15, postgoal=5), singles.select("sample_id", "trial", F.array("median").alias("new"), F.array("rank").alias("ranks")), n_known, 1))
        if config.sanity_check:
            state = settled(_rechecked(state, spectra, ranked, known, n_known, config))
        if step == 0 and config.max_added >= 2:
            lost = state.where(~F.col("open")).select("sample_id")
            a, b = top.join(lost, "sample_id").alias("a"), top.alias("b")
            pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.turn") < F.col("b.turn"))).select("a.sample_id", "a.observed", "a.selected", "a.common", (F.col("a.rank").cast("long") * 2**31 + F.col("b.rank")).alias("trial"), F.array("a.median", "b.median").alias("new"), F.array("a.rank", "b.rank").alias("ranks"))
            pairs = settled(pairs)
            if not pairs.isEmpty():
                state = settled(_accepted(state, fit.run_trials(trial(pairs, F.col("new")), config.fit, iterations=30, postgoal=5), pairs.select("sample_id", "trial", "new", "ranks"), n_known, 2))
    return state


def _rechecked(state: DataFrame, spectra: DataFrame, ranked: DataFrame, known: Column, n_known: int, config: SolveConfig) -> DataFrame:
    """M8: state after probing again, for samples that have just gained a block, the one selected before it: the best of five candidates takes
    its place if it differs and lowers the adjusted BIC."""
    near = lambda masses, m: F.exists(masses, lambda s: F.abs(m - s) < candidates.NAME_WINDOW)
    live = state.where(F.col("open") & (F.size("selected") >= 2)).withColumn("pos", F.size("selected") - 2)
    others = F.filter("selected", lambda m, i: i != F.col("pos"))
    free = ranked.select("sample_id", "rank", "median").join(live, "sample_id").where(~near(others, F.col("median")) & ~near(known, F.col("median")))
    top = settled(candidates.available(free, (), 5).join(spectra, "sample_id"))
    if top.isEmpty():
        return state
    put = F.transform("selected", lambda m, i: F.when(i == F.col("pos"), F.col("median")).otherwise(m))
    trials = top.select("sample_id", F.col("rank").alias("trial"), "observed", F.concat(known, put).alias("start"), F.lit(n_known).alias("n_known"), F.col("common").alias("start_common"))
    results = fit.run_trials(trials, config.fit, iterations=15, postgoal=5).join(top.select("sample_id", F.col("rank").alias("trial"), "median"), ["sample_id", "trial"])
    best = results.groupBy("sample_id").agg(F.min_by(F.struct("trial", "bic", "n_good", "common", "masses", "median", "errors"), _order(F.array("median"))).alias("t"))
    rows = state.join(best, "sample_id", "left").withColumn("pos", F.size("selected") - 2)
    refined, old, n = F.get("t.masses", F.col("pos") + n_known), F.get("selected", F.col("pos")), F.size("t.errors")
    better = (adjusted_bic(F.col("t.bic"), n, F.array(refined)) < adjusted_bic(F.col("bic"), n, F.array(old))) & (F.abs(F.col("t.median") - old) > candidates.NAME_WINDOW)
    ok = F.coalesce(better, F.lit(False))
    swap = lambda c, v: F.when(ok, F.transform(c, lambda m, i: F.when(i == F.col("pos"), v).otherwise(m))).otherwise(F.col(c)).alias(c)
    pick = lambda c: F.when(ok, F.col(f"t.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("sample_id", pick("bic"), pick("n_good"), pick("common"), swap("selected", refined), swap("taken", F.col("t.trial")), "open")


def _accepted(state: DataFrame, results: DataFrame, tried: DataFrame, n_known: int, n_new: int) -> DataFrame:
    """state after the best trial of each sample. One new block must be used and gain a peak and 2 of adjusted BIC, or two peaks; a pair must
    both be used and gain 2."""
    best = results.join(tried, ["sample_id", "trial"])
    best = best.groupBy("sample_id").agg(F.min_by(F.struct("bic", "n_good", "common", "masses", "used", "new", "ranks", "errors"), _order(F.col("new"))).alias("t"))
    refined = F.slice("t.masses", F.size("t.masses") - n_new + 1, n_new)
    used = F.forall(F.slice("t.used", F.size("t.used") - n_new + 1, n_new), lambda u: u)
    gain = F.col("bic") - adjusted_bic(F.col("t.bic"), F.size("t.errors"), refined)
    more = F.col("t.n_good") - F.col("n_good")
    ok = used & ((gain > LEAST_GAIN) if n_new == 2 else ((gain > LEAST_GAIN) & (more >= 1)) | (more >= 2))
    ok = F.coalesce(ok, F.lit(False))
    rows = state.join(best, "sample_id", "left")
    tried_now = F.col("t").isNotNull()
    chosen = F.when(ok, F.col("t.bic")).otherwise(F.col("bic"))
    return rows.select(
        "sample_id", chosen.alias("bic"), F.when(ok, F.col("t.n_good")).otherwise(F.col("n_good")).alias("n_good"), F.when(ok, F.col("t.common")).otherwise(F.col("common")).alias("common"),
        F.when(ok, F.concat("selected", refined)).otherwise(F.col("selected")).alias("selected"), F.when(ok, F.concat("taken", "t.ranks")).otherwise(F.col("taken")).alias("taken"),
        F.when(tried_now, ok).otherwise(F.col("open") if n_new == 2 else F.lit(False)).alias("open"),
    )


def refined_models(spectra: DataFrame, state: DataFrame, config: SolveConfig) -> DataFrame:
    """M9: (sample_id, observed, masses, common): all iterations over all peaks, kept if no worse, then over the good peaks where there are enough."""
    n_known = len(config.masses)
    known = F.array(*[F.lit(float(m)) for m in config.masses]) if config.masses else F.array().cast("array<double>")
    rows = spectra.join(state, "sample_id").select("sample_id", F.lit(0).alias("trial"), "observed", F.concat(known, "selected").alias("start"), F.lit(n_known).alias("n_known"), F.col("common").alias("start_common"), F.col("bic").alias("was"))
    full = fit.run_trials(rows, config.fit, anchors=config.masses)
    kept = settled(rows.select("sample_id", "observed", "start", "start_common", "was", "n_known").join(full.select("sample_id", "bic", "masses", "common", "errors", "n_good"), "sample_id"))
    better = F.col("bic") <= F.col("was")
    kept = kept.withColumns({"masses": F.when(better, F.col("masses")).otherwise(F.col("start")), "common": F.when(better, F.col("common")).otherwise(F.col("start_common"))})
    good = F.filter(F.zip_with("observed", "errors", lambda o, e: F.when(e < config.fit.final_tolerance, o)), lambda o: o.isNotNull())
    enough = F.col("n_good") >= F.greatest(F.size("masses"), F.lit(3))
    again = kept.where(enough).select("sample_id", F.lit(1).alias("trial"), good.alias("observed"), F.col("masses").alias("start"), "n_known", F.col("common").alias("start_common"))
    last = fit.run_trials(again, config.fit, anchors=config.masses).select("sample_id", F.col("masses").alias("m2"), F.col("common").alias("c2"))
    return kept.join(last, "sample_id", "left").select("sample_id", "observed", F.coalesce("m2", "masses").alias("masses"), F.coalesce("c2", "common").alias("common"))


def final_names(model: DataFrame, book: DataFrame, config: SolveConfig) -> DataFrame:
    """Model with names: the known names, then dictionary names, else letters, and from the 27th new block on Unk and its number."""
    known, n_known = strings(config.names), len(config.names)
    each = model.select("sample_id", F.posexplode("masses").alias("ord", "mass"))
    named = candidates.named_by_mass(each, book)
    turn = F.col("ord") - n_known
    letters = F.when(turn < 26, F.char(F.lit(65) + turn)).otherwise(F.concat(F.lit("Unk"), (turn + 1).cast("string")))
    name = F.when(F.col("ord") < n_known, F.get(known, F.col("ord"))).otherwise(F.coalesce("name", letters))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", name.alias("n")))), lambda x: x["n"])
    return model.join(named.groupBy("sample_id").agg(names.alias("names")), "sample_id")


class Analysis(Mapping[str, DataFrame]):
    """The tables of the analysis by name, each worked out when it is first asked for: candidates, rejected, models, best, facts (every model's and consensus's compositions), peak_stats,
    shares, usage, dependencies, network, prefixes, margins and blocks."""

    TABLES = ("candidates", "rejected", "models", "best", "facts", "peak_stats", "shares", "usage", "dependencies", "network", "prefixes", "margins", "blocks")

    def __init__(self, peaks: DataFrame, config: SolveConfig) -> None:
        self.peaks = peaks
        self.book, self.config = resolved(peaks.sparkSession, config)
        self.tolerance, self.n_known = self.config.fit.final_tolerance, len(self.config.masses)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)

    @property
    def _limits(self) -> Callable[[int], list[int]]:
        fitting, n_known = self.config.fit, self.n_known  # what tasks get must not hold the session
        return lambda k: fitting.limits(n_known, k)

    @cached_property
    def _discovered(self) -> tuple[DataFrame, DataFrame]:
        c = self.config
        ranked, rejected = candidates.discover(self.peaks, self.book, c.common, c.masses, c.min_diff, c.fit.lower, c.fit.upper, 1)
        return settled(candidates.without_excluded(ranked, _masses_of(c.exclude, self.book), c.masses, _masses_of(c.protect, self.book))), rejected

    @property
    def candidates(self) -> DataFrame:
        return self._discovered[0]

    @property
    def rejected(self) -> DataFrame:
        return self._discovered[1]

    @cached_property
    def _model(self) -> DataFrame:
        """The final model of each sample: observed, masses, common, names."""
        spectra = settled(fit.spectra(self.peaks))
        state = select_blocks(spectra, self.candidates, self.config)
        return settled(final_names(refined_models(spectra, state, self.config), self.book, self.config))

    @cached_property
    def _tried(self) -> tuple[DataFrame, DataFrame]:
        """Fits and models of the mode: all subsets, those with Hex, or nested prefixes."""
        model, k, exhaustive = self._model, F.size("masses"), self.config.exhaustive
        at = F.array_position(F.transform("names", F.lower), "hex")
        masks = F.sequence(F.lit(1), bit(k) - 1)
        if exhaustive == 0:
            masks = F.transform(F.sequence(F.lit(max(1, self.n_known)), k), lambda m: bit(m) - 1)
        each = model.where(k > 0).select("*", F.explode(masks).alias("mask"))
        if exhaustive == 1:
            each = each.where((at == 0) | (F.getbit("mask", F.greatest(at - 1, F.lit(0)).cast("int")) == 1))
        fits = settled(fit.fit_models(each.select("sample_id", "mask", "observed", "masses", "common"), self._limits))
        blocks = F.filter(F.transform("names", lambda b, i: F.when(F.getbit(F.col("mask"), i) == 1, b)), lambda b: b.isNotNull())
        e = F.col("error")
        summary = fits.groupBy("sample_id", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(e < self.tolerance).alias("n_good"), F.count_if(e >= self.tolerance).alias("n_bad"), F.sum(e * e).alias("rss"), F.median("error").alias("median_error"))
        models = summary.join(each.select("sample_id", "mask", blocks.alias("blocks")), ["sample_id", "mask"]).withColumn("n_blocks", F.size("blocks"))
        models = models.withColumns({"bic": bic(F.col("n"), F.col("rss"), F.col("n_blocks")), "model": F.array_join("blocks", "+")})
        models = settled(compare.without_supersets(models) if exhaustive else models)
        return fits.join(models.select("sample_id", "mask", "model"), ["sample_id", "mask"]), models

    @property
    def models(self) -> DataFrame:
        return compare.model_order(self._tried[1])

    @property
    def best(self) -> DataFrame:
        return compare.best_models(self._tried[1])

    @cached_property
    def _stats(self) -> DataFrame:
        fits, models = self._tried
        return settled(compare.peak_statistics(fits.drop("model"), models, (), self.tolerance, own=self._model.select("sample_id", "masses")))

    @cached_property
    def usage(self) -> DataFrame:
        return settled(dependencies.block_usage_across_models(self._tried[0], MASK_BITS, self.tolerance))

    @property
    def dependencies(self) -> DataFrame:
        return dependencies.direct_dependencies(self.usage)

    @property
    def shares(self) -> DataFrame:
        return compare.model_shares(self._stats)

    @property
    def _shape(self) -> DataFrame:
        return self._model.select("sample_id", F.array_repeat(F.lit(0), F.size("masses")).alias("zeros"), "masses", "common")

    def _judged(self, rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("sample_id", "peak_id", "observed", "composition").join(self._shape, "sample_id")
        rows = rows.withColumn("composition", F.when(F.size("composition") == F.size("zeros"), F.col("composition")).otherwise(F.col("zeros")))
        error = F.abs(F.col("observed") - F.col("common") - dot(F.col("composition"), F.col("masses")))
        return rows.select("sample_id", F.lit(name).alias("model"), "peak_id", "observed", "composition", error.alias("error"))

    @cached_property
    def _alternatives(self) -> DataFrame:
        return settled(fit.sample_alternatives(self._model.where(F.size("masses") > 0).select("sample_id", "observed", "masses", "common"), self._limits, self.tolerance))

    @cached_property
    def _consensus(self) -> list[DataFrame]:
        """The four consensus models, in the order of their names."""
        fits, names, own = self._tried[0], consensus.MODELS, ("peak_id", "observed", "composition", "error")
        first = settled(self._judged(consensus.simplest_consensus(self._stats, 0), names[0]))
        explained = consensus.explaining_compositions(fits.select("sample_id", "mask", *own).unionByName(first.select("sample_id", F.lit(2**30).alias("mask"), *own)), self.tolerance)
        second = self._judged(consensus.network_consensus(self._stats.select("sample_id", "peak_id", "observed"), explained, 0), names[1])
        third = self._judged(consensus.annealed_consensus(self._alternatives, self.tolerance), names[2])
        fourth = self._judged(consensus.annealed_consensus(consensus.with_dependencies(self._alternatives, self.usage), self.tolerance, consensus.DEPENDENCY_WEIGHT), names[3])
        return [first, second, third, settled(fourth)]

    @cached_property
    def facts(self) -> DataFrame:
        facts = self._tried[0].select("sample_id", "model", "peak_id", "observed", "composition", "error")
        for rows in self._consensus:
            facts = facts.unionByName(rows)
        facts = facts.join(self._shape.drop("zeros"), "sample_id")
        facts = facts.withColumn("reconstructed", F.col("common") + dot(F.col("composition"), F.col("masses"))).withColumn("status", F.when(F.col("error") < self.tolerance, "GOOD").otherwise("BAD"))
        named = self._tried[1].select("sample_id", "model", F.col("bic").alias("model_bic"), "n_blocks")
        return settled(facts.join(named, ["sample_id", "model"], "left").join(self._model.select("sample_id", "names"), "sample_id"))

    @property
    def peak_stats(self) -> DataFrame:
        return consensus.overridden_best(self._stats, self._consensus[3], self.tolerance)

    @cached_property
    def network(self) -> DataFrame:
        nodes = settled(self.facts.where(F.col("status") == "GOOD").select("sample_id", "model", "peak_id", "observed", "composition"))
        statistics = network.network_statistics(nodes, None, network.clean_components(nodes))
        return network.rank_models(statistics, network.tree_statistics(network.spanning_trees(network.tree_candidates(nodes))))

    @property
    def prefixes(self) -> DataFrame:
        """In nested mode, the fewest blocks of a prefix that explain each peak, null if none does; else no rows."""
        fits, models = self._tried
        return compare.simplest_prefix(fits.where(F.lit(self.config.exhaustive == 0)), models.select("mask", "n_blocks").distinct(), self.tolerance)

    @property
    def margins(self) -> DataFrame:
        """The number of compositions of each explained peak within the tolerance, the least error, and how far the second is from it."""
        return lattice.ambiguity(self._alternatives)

    @property
    def blocks(self) -> DataFrame:
        return self._model.withColumn("common_name", composition_name(strings(list(self.config.composition)), F.array(*map(F.lit, self.config.composition.values()))))


def solve(peaks: DataFrame, config: SolveConfig | None = None) -> Analysis:
    return Analysis(peaks, config or SolveConfig())
