"""Discovery of unknown blocks from pairwise differences of peaks.

peaks: (sample_id, peak_id, observed). Dictionaries: (ord, name, mass, category, ...), as sources.dictionary gives them.
All steps run for every sample at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import nearest_multiple
from .bands import with_first
from .medians import with_medians
from .storage import settled

GAP = 0.25
NAME_WINDOW = 0.5


def pair_differences(peaks: DataFrame, common: float, min_diff: float, max_diff: float | None = None) -> DataFrame:
    """sample_id, i, j, diff of the pairs i < j of a sample whose masses, less the common mass, differ by more than min_diff, and by max_diff at most if it is given.

    With max_diff, masses are cut into stretches of that length, and a peak meets the heavier ones of its own and the next stretch only.
    """
    y = peaks.select("sample_id", "peak_id", (F.col("observed") - common).alias("y"))
    diff = F.abs(F.col("a.y") - F.col("b.y")).alias("diff")
    if max_diff is None or min_diff < 0:
        a, b = y.alias("a"), y.alias("b")
        pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.peak_id") < F.col("b.peak_id")))
        out = pairs.select(F.col("a.sample_id"), F.col("a.peak_id").alias("i"), F.col("b.peak_id").alias("j"), diff).where(F.col("diff") > min_diff)
        return out if max_diff is None else out.where(F.col("diff") <= max_diff)
    y = y.withColumn("stretch", F.floor(F.col("y") / (max_diff * (1 + 1e-9) + 1e-6)))
    a, b = y.withColumn("stretch", F.explode(F.array(F.col("stretch"), F.col("stretch") + 1))).alias("a"), y.alias("b")
    pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.stretch") == F.col("b.stretch")) & (F.col("a.y") < F.col("b.y")))
    out = pairs.select(F.col("a.sample_id"), F.least("a.peak_id", "b.peak_id").alias("i"), F.greatest("a.peak_id", "b.peak_id").alias("j"), diff)
    return out.where((F.col("diff") > min_diff) & (F.col("diff") <= max_diff))


def reference_masses(dictionary: DataFrame, known: Sequence[float]) -> DataFrame:
    """pos, mass, label: known masses first, then dictionary masses that differ from all before at six decimals."""
    spark = dictionary.sparkSession
    named = dictionary.select("mass", F.concat("name", F.lit("("), F.format_string("%.3f", "mass"), F.lit(")")).alias("label"), (F.col("ord") + len(known)).alias("pos"))
    own = spark.createDataFrame([(float(m), f"{m:.3f}", k) for k, m in enumerate(known)], "mass double, label string, pos int")
    key = F.round("mass", 6)
    w = Window.partitionBy(key).orderBy("pos")
    last_name = Window.partitionBy(key).orderBy(F.col("pos").desc())
    both = own.unionByName(named).withColumns({"n": F.row_number().over(w), "label": F.first("label").over(last_name)})
    return both.where("n = 1").select("pos", "mass", "label")


def exclusions(dictionary: DataFrame, known: Sequence[float]) -> DataFrame:
    """Masses that differences are rejected for: ord struct<rule, a, b, c, d>, mass, reason; the order is that of the rules.

    Rule 1: a known mass and its 2 to 9 fold; 2: sums of 0 to 3 copies of each of two reference masses, two copies at least; 3: positive
    differences of reference masses. Both sides of the joins are dictionary-sized.
    """
    refs = reference_masses(dictionary, known)
    spark = dictionary.sparkSession
    order = lambda rule, a, b, c, d: F.struct(*[F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in zip(("rule", "a", "b", "c", "d"), (rule, a, b, c, d))]).alias("ord")
    own = spark.createDataFrame([(k, float(m)) for k, m in enumerate(known)], "pos int, mass double").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9))))
    text = F.format_string("%.3f", "mass")
    # The wording of the reasons, here and in filter_differences(), is part of the files.
    multiples = own.select(order(1, F.col("pos"), F.col("n"), 0, 0), (F.col("mass") * F.col("n")).alias("mass"), F.when(F.col("n") == 1, F.concat(F.lit("Too close to known block "), text)).otherwise(F.concat(F.lit("Multiple of "), text, F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))).alias("reason"))
    a, b = refs.alias("a"), refs.alias("b")
    counts = spark.createDataFrame([(c, d) for c in range(4) for d in range(4) if c + d >= 2], "c int, d int")
    pairs = a.join(b, F.col("a.pos") <= F.col("b.pos"))
    several = refs.count() >= 2
    combos = pairs.join(counts, F.lit(several)).select(
        order(2, F.col("a.pos"), F.col("b.pos"), F.col("c"), F.col("d")), (F.col("c") * F.col("a.mass") + F.col("d") * F.col("b.mass")).alias("mass"),
        F.concat(F.lit("Combination of "), F.col("c").cast("string"), F.lit("x"), F.col("a.label"), F.lit(" + "), F.col("d").cast("string"), F.lit("x"), F.col("b.label")).alias("reason"),
    )
    minus = a.join(b, F.col("a.mass") > F.col("b.mass")).select(
        order(3, F.col("a.pos"), F.col("b.pos"), 0, 0), (F.col("a.mass") - F.col("b.mass")).alias("mass"),
        F.concat(F.lit("Difference between "), F.col("a.label"), F.lit(" and "), F.col("b.label")).alias("reason"),
    )
    return multiples.unionByName(combos).unionByName(minus)


def filter_differences(diffs: DataFrame, dictionary: DataFrame, known: Sequence[float], lower: float | None = None, upper: float | None = None, gap: float = GAP) -> DataFrame:
    """diffs with reason; null where the difference stays a candidate.

    The first rule that fits names the reason. A difference near a dictionary mass is rescued from rules 2 and 3. The bounds come last.
    """
    hit = with_first(diffs, F.col("diff"), exclusions(dictionary, known), gap, "reason", into="rule_hit")
    hit = with_first(hit, F.col("diff"), dictionary.select("ord", "mass"), gap, into="rescue")
    rescued = (F.col("rule_hit.ord.rule") > 1) & F.col("rescue").isNotNull()
    reason = F.when(~rescued, F.col("rule_hit.reason"))
    for bound, below in ((lower, True), (upper, False)):
        if bound is not None:
            out = F.col("diff") < bound if below else F.col("diff") > bound
            reason = F.coalesce(reason, F.when(out, F.lit(f"{'Below lower' if below else 'Above upper'} bound {bound:.3f}")))
    return hit.withColumn("reason", reason).drop("rule_hit", "rescue")


def gap_clusters(diffs: DataFrame, gap: float = GAP) -> DataFrame:
    """(sample_id, diff) with cluster: a new one begins where the sorted differences leave more than the gap."""
    w = Window.partitionBy("sample_id").orderBy("diff")
    opens = F.when(F.col("diff") - F.lag("diff").over(w) <= gap, 0).otherwise(1)
    return diffs.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def cluster_scores(clustered: DataFrame, dictionary: DataFrame, gap: float = GAP) -> DataFrame:
    """Statistics and score of each cluster.

    Score: size x tightness x closeness to a multiple of the mass unit (not asked of modifications) x 10 for a dictionary match.
    """
    clustered = settled(clustered.withColumn("n", F.row_number().over(Window.partitionBy("sample_id", "cluster").orderBy("diff"))))
    stats = clustered.groupBy("sample_id", "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.var_pop("diff").alias("variance"), F.min("diff").alias("low"), F.max("diff").alias("high"),
        F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.col("diff")))).alias("values"),
    )
    stats = with_medians(stats, clustered, ["sample_id", "cluster"], {"median": F.col("diff")})
    stats = with_first(stats, F.col("median"), dictionary.select("ord", "mass", "name"), gap, "name", into="entry")
    stats = with_first(stats, F.col("median"), dictionary.where(F.col("category") == "mod").select("ord", "mass"), gap, into="mod")
    tightness = F.when(F.col("size") == 1, 1.0).when(F.col("variance") < 1e-10, 1000.0).otherwise(1 / (F.col("variance") + 0.001))
    closeness = F.when(F.col("mod").isNotNull(), 1.0).otherwise(F.exp(-4 * F.abs(F.col("median") - nearest_multiple(F.col("median")))))
    boost = F.when(F.col("entry").isNotNull(), 10.0).otherwise(1.0)
    return stats.withColumns({"score": F.col("size") * tightness * closeness * boost, "name": F.col("entry.name")}).drop("entry", "mod")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Rank by score, the lighter first among equals."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "median")))


def discover(peaks: DataFrame, dictionary: DataFrame, common: float, known: Sequence[float], min_diff: float = 40.0, lower: float | None = 35.0, upper: float | None = 370.0, k_unknown: int = 1, gap: float = GAP) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates and rejected differences. A sample with fewer kept differences than k_unknown has no candidates.

    No difference above the upper bound can be kept, so candidates come from pairs within it; all pairs are made only if the rejected ones are asked for.
    """
    judged = lambda most: filter_differences(pair_differences(peaks, common, min_diff, most), dictionary, known, lower, upper, gap)
    filtered = judged(None)
    kept = judged(upper).where(F.col("reason").isNull()).withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy("sample_id"))).where(F.col("kept") >= k_unknown).drop("kept", "reason")
    return rank_candidates(cluster_scores(gap_clusters(kept, gap), dictionary, gap)), filtered.where(F.col("reason").isNotNull())


def candidate_report(ranked: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both kinds in one table; a rejected difference has score 0 and size 1."""
    values = F.array_join(F.transform(F.slice("values", 1, 5), lambda v: F.format_string("%.5f", v)), ",")
    more = F.when(F.col("size") > 5, F.concat(F.lit("...("), (F.col("size") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    active = ranked.select("sample_id", "median", "score", "size", "low", "high", F.lit("ACTIVE").alias("status"), F.lit("").alias("filter_reason"), F.concat(values, more).alias("sample_values"))
    out = rejected.select("sample_id", F.col("diff").alias("median"), F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("size"), F.col("diff").alias("low"), F.col("diff").alias("high"), F.lit("FILTERED").alias("status"), F.col("reason").alias("filter_reason"), F.format_string("%.5f", "diff").alias("sample_values"))
    return active.unionByName(out)


def named_by_mass(rows: DataFrame, dictionary: DataFrame, window: float = NAME_WINDOW, mass: str = "mass") -> DataFrame:
    """Name and category of the first dictionary entry (in file order) within the window; null and unknown without one."""
    hit = with_first(rows, F.col(mass), dictionary.select("ord", "mass", "name", "category"), window, "name", "category", into="entry")
    return hit.withColumns({"name": F.col("entry.name"), "category": F.coalesce("entry.category", F.lit("unknown"))}).drop("entry")


def _listed(spark: SparkSession, masses: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(k, float(m)) for k, m in enumerate(masses)], "ord int, mass double")


def without_excluded(candidates: DataFrame, excluded: Sequence[float], known: Sequence[float] = (), protected: Sequence[float] = (), window: float = NAME_WINDOW, mass: str = "median") -> DataFrame:
    """Candidates less those near an excluded mass, its 2 to 5 fold or a sum of up to 3 known and 3 excluded ones; protected ones stay.

    With an exclusion given, plain multiples of known masses go as well: a sum may have no excluded part.
    """
    if not excluded:
        return candidates
    spark = candidates.sparkSession
    gone = [e * k for e in excluded for k in range(1, 6)] + [a * m + b * e for e in excluded for m in known for a in range(4) for b in range(4) if a + b]
    hit = with_first(candidates, F.col(mass), _listed(spark, gone), window, into="gone")
    hit = with_first(hit, F.col(mass), _listed(spark, protected), window, into="kept")
    return hit.where(F.col("gone").isNull() | F.col("kept").isNotNull()).drop("gone", "kept")


def available(candidates: DataFrame, taken: Sequence[float], top: int = 5, window: float = NAME_WINDOW, mass: str = "median") -> DataFrame:
    """Of each sample the best-ranked candidates that are no taken (known or selected) mass."""
    hit = with_first(candidates, F.col(mass), _listed(candidates.sparkSession, taken), window, into="gone")
    left = hit.where(F.col("gone").isNull()).drop("gone")
    return left.withColumn("turn", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank"))).where(F.col("turn") <= top)


def resolved_masses(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token) to mass: a dictionary name in any case (its first row), else a number; null where neither fits."""
    names = dictionary.groupBy(F.lower("name").alias("key")).agg(F.min_by("mass", "ord").alias("named"))
    hit = tokens.withColumn("key", F.lower(F.trim("token"))).join(names, "key", "left")
    return hit.withColumn("mass", F.coalesce("named", F.trim("token").try_cast("double"))).drop("key", "named")
