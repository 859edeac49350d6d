import pytest

from peakloom.plans import solve as plan
from peakloom.plans.solve import Analysis, SolveConfig, final_names, resolved, solve
from peakloom.sources import dictionary
from tests.spectrum import peaks


def test_nothing_is_worked_out_before_it_is_asked_for(spark, monkeypatch):
    asked = []
    for name in ("select_blocks", "refined_models"):
        monkeypatch.setattr(plan, name, lambda *a, name=name: asked.append(name))
    found = solve(peaks(spark, "a"), SolveConfig(mode="neg_h", matrix="2aa_nr", names=("Hex",)))
    assert set(found) == set(Analysis.TABLES) and len(found) == len(Analysis.TABLES)
    assert found["candidates"].count() > 0 and asked == []
    with pytest.raises(KeyError):
        found["nothing"]


def test_nested_report(spark):
    found = solve(peaks(spark, "a"), SolveConfig(mode="neg_h", matrix="2aa_nr", names=("Hex", "HexNAc"), max_added=1, exhaustive=0))
    models = {r.n_blocks: r.n_good for r in found["models"].collect()}
    assert sorted(models) in ([2], [2, 3])
    simplest = [r.simplest for r in found["prefixes"].collect()]
    assert len(simplest) == 32
    assert sum(s == 2 for s in simplest) == models[2] and sum(s is None for s in simplest) <= 32 - max(models.values())
    margins = found["margins"].collect()
    assert margins and all(r.n_alternatives >= 1 and (r.margin is None) == (r.n_alternatives == 1) and 0 <= r.best_error < 1 for r in margins)


def test_names_after_the_letters(spark):
    book, config = resolved(spark, SolveConfig(mode="neg_h", matrix="2aa_nr", names=("Hex",)))
    masses = [162.052824, *(1000.0 + 10 * k for k in range(28))]
    names = final_names(spark.createDataFrame([("s", masses)], "sample_id string, masses array<double>"), book, config).first().names
    assert names[:2] == ["Hex", "A"] and names[26:] == ["Z", "Unk27", "Unk28"]
    assert dictionary.blocks(spark).count() == 16


def test_more_blocks_than_a_mask_holds(spark):
    with pytest.raises(ValueError, match="31"):
        resolved(spark, SolveConfig(mode="neg_h", matrix="2aa_nr", names=(), masses=tuple(500.0 + 10 * k for k in range(29)), max_added=3))
