"""The pipeline: its stages in order, on planted cases and odd rows."""

import corpus_pipeline
from metaloom.llm import pfair
from tests.llm.helpers import DOCS, awkward, empty
from tests.llm.test_langid import texts


def saved(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_planted_cases(spark, tmp_path):
    rows = [(i, t + f" unique{i} marker{i * 7} end{i * 13}", lang, f"s{i % 3}", 1) for i, t, lang in texts(120, 8)]
    shared = " ".join(f"passage{i}" for i in range(70))
    rows += [(200, "the of and " + shared + " is that for it", "en", "s0", 1), (201, " ".join(f"in{i} the" for i in range(90)) + " " + shared, "en", "s1", 1)]
    rows += [(300 + i, "the same words in a copy of it are here for that and this " * 3 + "x" * (i % 2), "en", "s2", 1) for i in range(20)]
    rows += [(400, "漢字仮名交じり文は日本語の文章である", None, "s0", 1)]
    sf = saved(spark.createDataFrame(rows, DOCS), tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert 300 in got and not any(300 + i in got for i in range(1, 20)) and 400 not in got
    assert set(range(120)) <= set(got) and all(r.exact for r in got.values())
    from metaloom.llm import bpe

    text = {r.doc_id: r.text for r in bpe.decode_documents(spark.createDataFrame([(k, r.ids) for k, r in got.items()], "doc_id bigint, ids array<int>")).collect()}
    assert shared in text[200] and "passage5 " not in text[201]
    assert text[7] == rows[7][1]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    df = awkward(spark, "1 AS __row, 2 AS k, 3 AS __gone, 4 AS __spans, 5 AS key, 6 AS row, 7 AS position")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == df.columns
    assert {1, 5} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, saved(empty(spark), tmp_path)).collect() == []


def test_the_mixed_order_survives_part_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"t{i} " + " ".join(f"{i * j}" for j in range(i % 7 * 40)), "en", "s" + str(i % 3), 1) for i in range(900)]
    sf = saved(spark.createDataFrame(rows, DOCS), tmp_path / "in")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = corpus_pipeline.run(spark, sf)
        assert len(got.inputFiles()) > 2
        place = {r.doc_id: r.position for r in pfair.schedule(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
        assert [r.doc_id for r in got.sort("position").select("doc_id").collect()] == sorted(place, key=place.get)
        assert sorted(r.position for r in got.select("position").collect()) == list(range(900))
    finally:
        spark.conf.unset(key)
