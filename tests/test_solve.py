import json

import pytest
from pyspark.sql import functions as F

from peakloom import cli
from peakloom.functions import exprs
from peakloom.operators import diagnostics, fit, network
from peakloom.plans import solve as plan
from peakloom.plans.solve import SolveConfig, resolved, solve
from peakloom.sinks import reports, tables
from peakloom.sources import results
from tests.spectrum import COMMON, MASSES, NAMES, PEAKS, peaks


@pytest.fixture(scope="module")
def solved(spark):
    return solve(peaks(spark, "a", "b"), SolveConfig(mode="neg_h", matrix="2aa_nr", names=("Hex",), max_added=3))


def test_configuration(spark):
    _, config = resolved(spark, SolveConfig(mode="neg_h", matrix="2aa_nr", names=("Hex", "Fuc", "hexnac"), masses=(291.1,)))
    assert config.common == pytest.approx(COMMON) and config.names == ("Hex", "HexNAc", "NeuAc") and config.masses == (MASSES[0], MASSES[1], 291.1)


def test_progressive_solve(solved):
    blocks = {r.sample_id: r for r in solved["blocks"].collect()}
    assert set(blocks) == {"a", "b"} and blocks["a"].names[0] == "Hex" and set(blocks["a"].names) == set(NAMES)
    best = solved["best"].where("sample_id = 'a'").first()
    assert best.n_good == 32 and set(best.model.split("+")) == set(NAMES)
    facts = solved["facts"].where("sample_id = 'b'")
    models = {r.model: r.n for r in facts.groupBy("model").agg(F.count_if(F.col("status") == "GOOD").alias("n")).collect()}
    assert models["BioConsensus3"] == models["Consensus"] == 32 and set(models) >= {"BioConsensus", "BioConsensus2"}
    assert solved["peak_stats"].where("best_model = 'BioConsensus3'").count() == 64
    ranked = solved["network"].where("sample_id = 'a'").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and all(x.score <= y.score for x, y in zip(ranked, ranked[1:]))
    assert solved["dependencies"].where("sample_id = 'a'").count() == 4


def test_sanity_check_replaces_a_wrong_block(spark):
    _, config = resolved(spark, SolveConfig(mode="neg_h", matrix="2aa_nr", names=("Hex",), sanity_check=True))
    state = spark.createDataFrame([("a", 200.0, 3, COMMON, [187.3, MASSES[2]], [9, 2], True), ("b", -100.0, 22, COMMON, [MASSES[1], MASSES[2]], [1, 2], True)], "sample_id string, bic double, n_good int, common double, selected array<double>, taken array<int>, open boolean")
    ranked = spark.createDataFrame([(s, r, m) for s in "ab" for r, m in ((1, MASSES[1]), (3, MASSES[3]), (9, 187.3))], "sample_id string, rank int, median double")
    got = {r.sample_id: r for r in plan._rechecked(state, fit.spectra(peaks(spark, "a", "b")), ranked, exprs.doubles(MASSES[:1]), 1, config).collect()}
    assert got["a"].taken == [1, 2] and got["a"].selected[0] == pytest.approx(MASSES[1], abs=0.02) and got["a"].n_good == 22
    assert got["b"].taken == [1, 2] and got["b"].bic == -100.0


def test_sinks_round_trip(spark, solved, tmp_path):
    names = solved["blocks"].where("sample_id = 'a'").first().names
    facts = solved["facts"].where("sample_id = 'a'")
    layout = tables.exhaustive_models(facts, solved["peak_stats"].where("sample_id = 'a'"), names, "Common", {"Hex": 3, "HexNAc": 2}, MASSES, COMMON)
    assert layout.columns[1:16] == ["Peak_ID", "Observed", "Model", "Model_Blocks", "Model_BIC", "Reconstructed", "Reconstructed_Theoretical", "Error", "Status", "Formula", "Structure", *names]
    path = str(tmp_path / "results.tsv")
    tables.write_tsv(layout.drop("sample_id"), path, True)
    back, read_names = results.results(spark, path)
    assert read_names == list(names) and back.count() == facts.count()
    assert back.where("status = 'GOOD'").count() == facts.where("status = 'GOOD'").count()
    single = tables.single_model(facts.where("model = 'BioConsensus3'"), names, "Common", {"Hex": 3, "HexNAc": 2}, MASSES, COMMON).orderBy("Peak_ID").first()
    assert (single.Observed, single.Status, single.Formula, single.Structure) == ("1352.55500", "GOOD", "Common + 2Hex", "5Hex + 2HexNAc")
    kinds = [r.Type for r in tables.blocks_file(solved["blocks"].where("sample_id = 'a'"), 1, dict(zip(NAMES, MASSES)), "Common", COMMON).collect()]
    assert kinds == ["fixed", "known", "discovered", "discovered", "discovered"]
    assert tables.network_file(solved["network"], facts.select("sample_id", "model", "model_bic").distinct()).columns[1:5] == ["Rank", "Model", "BIC", "N_Good"]


def test_reports(solved):
    facts = solved["facts"].where("sample_id = 'a' and model like '%Consensus3'")
    nodes = diagnostics.good(facts).select("sample_id", "model", "peak_id", "observed", "composition")
    edges = network.network(nodes)
    trees = network.spanning_trees(edges)
    ranked = network.rank_models(network.network_statistics(nodes, edges, network.clean_components(nodes)), network.tree_statistics(trees))
    payload = json.loads(reports.network_payload(ranked, trees, edges).first().payload)
    assert len(payload["mst_edges"]) == 31 and payload["statistics"]["n_good"] == 32 and all(e["kind"] == "clean" for e in payload["clean_edges"])
    lines = reports.network_report(ranked, edges, 5).orderBy("line_no").collect()
    assert lines[0].line.startswith("Model BioConsensus3") and sum("clean edge" in r.line for r in lines) == 5
    by = ["sample_id", "model"]
    residuals, pairs = diagnostics.residual_statistics(diagnostics.good(facts), by), diagnostics.cooccurrence(nodes, by, NAMES)
    text = json.loads(reports.diagnostics_payload(residuals, diagnostics.usage_by_block(nodes, by, NAMES), diagnostics.blocks_per_peak(nodes, by), pairs).first().payload)
    counts = [p["n_peaks"] for p in text["cooccurrence"]]
    assert counts == sorted(counts, reverse=True) and len(text["usage"]) == 4
    assert reports.diagnostics_report(residuals, pairs).count() > 10
    chain = network.tree_chain(nodes, NAMES)
    tree = tables.tree_file(chain).collect()
    assert len(tree) == 33 and (tree[0].Formula, tree[0].Peak_ID) == ("Common", 0)


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 1 and "usage" in capsys.readouterr().out
    args = cli.parser().parse_args(["-p", "x/LN_a_2aa.msd", "-n", "Hex:3,dHex", "-m", "291.1:2", "-e", "KDN, 5", "-u", "2"])
    config = cli.config_of(args)
    assert (config.mode, config.matrix, config.names, config.masses, config.known_limits, config.exclude, config.max_added) == ("neg_h", "2aa_nr", ("Hex", "dHex"), (291.1,), (3, 10, 2), ("KDN", "5"), 2)
    assert cli.composition("Hex:3,HexNAc") == {"Hex": 3, "HexNAc": 1} and cli.sniffed("RP_1.txt") == (None, None) and cli.sniffed("RP_1.msd") == ("pos_na", None)
    assert cli.merged_selection(["Hex", "KDN"], ["kdn"], ["5"]) == (["Hex", "5"], ["kdn"])
    assert cli.form_config({"block_Hex": "use", "block_KDN": "exclude"}, ["Hex", "KDN", "dHex"]) == {"names": ("Hex",), "exclude": ("KDN",)}
    path = tmp_path / "p.txt"
    path.write_text("\n".join(map(str, PEAKS)))
    assert cli.main(["-p", str(path), "-o", str(tmp_path / "out"), "-D", "neg_h", "-X", "2aa_nr", "-C"]) == 0
    written = results.raw_table(spark, str(tmp_path / "out/candidates.tsv"))
    assert written.where("Status = 'ACTIVE'").count() == 36


def test_command_line_writes_all_files(spark, tmp_path, capsys):
    folder = tmp_path / "p.txt"
    folder.write_text("\n".join(map(str, PEAKS)))
    out = tmp_path / "out"
    assert cli.main(["-p", str(folder), "-o", str(out), "-D", "neg_h", "-X", "2aa_nr", "-n", "Hex,HexNAc", "-u", "1", "-T", "3", "-v"]) == 0
    said = capsys.readouterr()
    assert "-T" in said.err and "results.tsv" in said.out
    table = lambda name: results.raw_table(spark, str(out / name)).collect()
    rows = table("results.tsv")
    names = [c for c in rows[0].asDict() if c not in (*results.FIXED, "sample_id")]
    assert names[:2] == ["Hex", "HexNAc"] and {int(r.Peak_ID) for r in rows} == set(range(1, 33))
    first = next(r for r in rows if r.Peak_ID == "1" and r.Model == "Consensus")
    assert (first.Hex, first.Status) == ("2", "GOOD") and abs(float(first.Reconstructed) - PEAKS[0]) < 0.5 and abs(float(first.Reconstructed_Theoretical) - PEAKS[0]) < 0.5
    assert [r.Type for r in table("blocks.tsv")][:3] == ["fixed", "known", "known"]
    assert {r.Block for r in table("block_dependencies.tsv")} >= {"Hex", "HexNAc"}
    assert len(table("biosynthetic_summary.tsv")) >= 4 and len(table("biosynthetic_tree.tsv")) > 32
    for name in ("block_dependencies.txt", "biosynthetic_report.txt", "diagnostics_report.txt", "biosynthetic.json", "diagnostics.json"):
        assert spark.read.text(str(out / name)).count() >= 1
    assert "statistics" in json.loads(spark.read.text(str(out / "biosynthetic.json")).first().value)
