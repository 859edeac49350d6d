from collections import Counter

import corpus_pipeline
from peakloom.llm import line_dedup, mixing, packing, quality, simhash
from tests.llm import test_line_dedup, test_packing, test_simhash
from tests.llm.data import frame, odd_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark):
    rows = [r[:5] for r in odd_documents()]
    rows += [(100 + k, " ".join(f"w{k}x{j % (20 + k)}" for j in range(60)) if k % 2 else " ".join(f"u{j}" for j in range(80)) + f" e{k}", "en", f"s{k % 3}", 0) for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        out = stage(spark, docs, "")
        rows = out.collect()
        if k < 4:
            assert tuple(out.columns) == COLUMNS
        texts = Counter((r[0], r[1]) for r in before)
        if name == "quality rules":
            want = [r for r in before if not (d := quality.Document(r[1])).base_failed and quality.first_rejection(d, list(quality.RULES)) is None]
            assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
        elif name == "line dedup":
            assert sorted(h for *_, h in test_line_dedup.brute(before)) == sorted(r.kept_sha256 for r in line_dedup.dedup_lines(docs).collect())
            assert len(rows) == len(before)
        elif name == "near dedup":
            components = {c for _, _, c in test_simhash.brute(before)}
            assert sorted(r.doc_id for r in rows) == sorted(components)
            assert all(texts[r.doc_id, r.text] for r in rows)
        elif name == "mixing":
            assert sum(len((r.text or "").split()) for r in rows) == sum(r.taken for r in mixing.mix_sources(docs).collect())
        else:
            assert len({(r.doc_id) for r in rows}) == len({i for i, *_ in before})
            assert test_packing.check_layout(rows, 4096) == test_packing.best_fit([r.length for r in rows], 4096)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert packing and simhash


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], documents(spark).schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
