import random
import re

import pytest
from pyspark.sql import functions as F

from peakloom.operators import compare, consensus, dependencies, lattice
from peakloom.plans import catalog, more
from tests.spectrum import COMMON, MASSES, NAMES

LIMITS, SMALL = (10, 8, 3, 4), "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def peaks(spark):
    draw = random.Random(7)
    rows = []
    for s in range(60):  # small samples, so that models are perfect in some
        for p in range(draw.randint(1, 4)):
            base = sum(m * draw.randint(0, 2) for m in MASSES[: draw.randint(1, 4)])
            rows.append((s, p, COMMON + base + draw.uniform(-3, 3)))
    rows += [(60, 0, 1e9), (60, 1, -1e9), (61, 0, COMMON + sum(m * n for m, n in zip(MASSES, LIMITS)) + 1.9), (62, 0, COMMON - 1.9), (63, 0, None)]
    return spark.createDataFrame(rows, "sample_id int, peak_id int, observed double").repartition("sample_id").cache()


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_fits_in_a_peaks_row_give_the_same_statistics_and_dependencies(spark, peaks):
    masks = lattice.subset_masks(spark, NAMES)
    fits = lattice.closest(peaks, MASSES, LIMITS, COMMON, masks).cache()
    models = compare.without_supersets(compare.model_summary(fits, masks, 2.0)).cache()
    assert 0 < models.groupBy("sample_id").count().where("count < 15").count() < 60
    explained = compare.explained_peaks(peaks, NAMES, MASSES, LIMITS, COMMON, 2.0)
    kept = compare.kept_fits(explained, 4)
    assert _rows(compare.kept_statistics(kept)) == _rows(compare.peak_statistics(fits, models, MASSES, 2.0))
    own = compare.of_models(fits, models).where("error < 2.0")
    columns = ("sample_id", "peak_id", "mask", "composition", "error")
    assert _rows(kept.select("sample_id", "peak_id", F.inline("good")).select(*columns)) == _rows(own.select(*columns))
    assert _rows(dependencies.block_usage_of_peaks(explained, 4)) == _rows(dependencies.block_usage_across_models(compare.of_models(fits, models), 4, 2.0))


def test_fits_within_with_blocks_in_front(spark, peaks):
    masks = lattice.subset_masks(spark, NAMES)
    flat = lambda rows: _rows(rows.select("sample_id", "peak_id", F.inline("good")).select("sample_id", "peak_id", "mask", "composition", F.round("error", 9)))
    assert flat(lattice.fits_within(peaks, MASSES, LIMITS, COMMON, masks, 2.0)) == flat(lattice.fits_within(peaks, MASSES, LIMITS, COMMON, masks, 2.0, half=200))


def test_override_in_the_row(spark, peaks):
    stats = compare.kept_statistics(compare.kept_fits(compare.explained_peaks(peaks, NAMES, MASSES, LIMITS, COMMON, 2.0), 4))
    chosen = lattice.closest(peaks, MASSES, LIMITS, COMMON)
    assert _rows(consensus.overridden(lattice.closest(stats, MASSES, LIMITS, COMMON).drop("lattice_mass"), 0.5)) == _rows(consensus.overridden_best(stats, chosen, 0.5))


@pytest.mark.parametrize("query", [catalog.best_model_per_peak, catalog.model_share, catalog.block_dependencies, more.overridden_best])
def test_peaks_are_read_and_dealt_out_once(spark, query):
    """No join of fits with models or of peaks with peaks; orders are read once and shuffled once."""
    plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "SortMergeJoin" not in plan and len(re.findall(r"Exchange hashpartitioning\((?:o_custkey|sample_id)", plan)) == 1


@pytest.mark.parametrize("query", [catalog.best_model_per_peak, more.overridden_best])
def test_peaks_are_sorted_once_before_they_hold_fits(spark, query):
    """The one sort of a sample's peaks is of their three columns; rows that hold fits of all models are not sorted again."""
    plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Sort \[((?:o_custkey|sample_id)[^\]]*)\]", re.sub(r"#\d+L?", "", plan)) == ["sample_id ASC NULLS FIRST, o_orderkey ASC NULLS FIRST"]


def _moved(spark, query, data):
    """Bytes that a query's stages shuffle, spill and write, less its result."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        rows = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {x.stageId(): x for x in map(rows.apply, range(rows.size()))}

    seen = stages()
    query(spark, data).write.format("noop").mode("overwrite").save()
    own = [x for k, x in stages().items() if k not in seen]
    return sum(x.shuffleWriteBytes() + x.memoryBytesSpilled() + x.diskBytesSpilled() + x.outputBytes() for x in own)


def test_what_is_moved_grows_with_three_numbers_a_peak(spark, tmp_path):
    """F16: nothing but a peak's sample, order and price is shuffled, and nothing is stored; fits, 15 a peak, would be hundreds of bytes."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    for n in (1, 4):
        copies = orders.crossJoin(spark.range(n)).select((F.col("o_custkey") + F.col("id") * 1_000_000).alias("o_custkey"), (F.col("o_orderkey") + F.col("id") * 1_000_000).alias("o_orderkey"), "o_totalprice")
        copies.write.parquet(f"{tmp_path}/{n}/orders.parquet")
    few, many = (_moved(spark, more.overridden_best, f"{tmp_path}/{n}") for n in (1, 4))
    assert 0 < (many - few) / (3 * orders.count()) < 32
