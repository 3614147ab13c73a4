import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelweave.plans import source_queries
from panelweave.sources import io


def test_csv_subset_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n1,"Café, ""old""",2\n', encoding="latin-1")
    row = io.read_csv(spark, str(tmp_path), "id int, name string, x int", ["name", "id"], "ISO-8859-1").first()
    assert row.asDict() == {"name": 'Café, "old"', "id": 1}


def test_pairs_with_and_without_label(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"indicator1": ["a", "b"], "indicator2": ["c", "d"]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"indicator1": ["e"], "indicator2": ["f"], "related": ["Yes"]}, indent=1))
    got = sorted(tuple(r) for r in io.read_pairs(spark, str(tmp_path), "i2i").fillna("-").collect())
    assert got == [("a", "c", "-"), ("b", "d", "-"), ("e", "f", "Yes")]


def test_corpus_takes_only_numbered_files(spark, tmp_path):
    (tmp_path / "00").mkdir()
    (tmp_path / "00" / "001.txt").write_text("line one\n\nline two")
    (tmp_path / "00" / "search_term.txt").write_text("roads")
    assert [r.text for r in io.read_corpus(spark, str(tmp_path)).collect()] == ["line one\n\nline two"]


def test_docs_pair_by_term_and_number(spark, tmp_path):
    for term in ("00", "01"):
        (tmp_path / term).mkdir()
        (tmp_path / term / "index.csv").write_text(f'0,"T{term}, first",A\n1,T{term} second,B\n')
        for n in (0, 1):
            (tmp_path / term / f"{n:03}.pdf").write_bytes(f"%PDF {term} {n}".encode())
    got = {(r.term_idx, r.pos): (r.title, bytes(r.content)) for r in io.read_docs(spark, str(tmp_path)).collect()}
    assert got[1, 0] == ("T01, first", b"%PDF 01 0") and got[0, 1] == ("T00 second", b"%PDF 00 1") and len(got) == 4


def test_experiments_carry_their_folder(spark, tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / f"exp_id={name}"
        folder.mkdir()
        (folder / "results.csv").write_text("item,score\nx,1.5\n")
    config = spark.createDataFrame([("a", "m1"), ("b", "m2")], "exp_id string, llm_name string")
    out = io.read_experiments(spark, f"{tmp_path}/exp_id=*/*.csv", "item string, score double", config)
    assert sorted((r.exp_id, r.llm_name, r.score) for r in out.collect()) == [("a", "m1", 1.5), ("b", "m2", 1.5)]


def test_best_metric_counts_missing_as_zero(spark):
    df = spark.createDataFrame([("run_f1=0.31",), ("run",), ("run_f1=0.4",)], "name string")
    assert io.best_by_regex(df, "name", r"f1=([0-9.]+)").first().asDict() == {"name": "run_f1=0.4", "metric": 0.4}


def test_prediction_columns_follow_the_label(spark):
    df = spark.range(1).select(
        F.lit("a").alias("indicator1"), F.lit("b").alias("indicator2"), F.create_map(F.lit("Yes"), F.lit(0.5)).alias("pred_aggregated"),
        F.array(F.lit("p")).alias("prompts"), F.array(F.lit("q")).alias("predictions"), F.lit(None).cast("array<string>").alias("discourse"))
    assert io.encode_predictions(df, "i2i").columns == ["indicator1", "indicator2", "pred_aggregated", "prompts", "predictions", "discourse"]
    labelled = io.encode_predictions(df.withColumn("related", F.lit("Yes")), "i2i")
    assert labelled.columns == ["indicator1", "indicator2", "related", "pred_aggregated", "predictions", "prompts", "discourse"]
    assert labelled.first().pred_aggregated == '{"Yes":0.5}'


def test_checkpoint_folder_of_the_session_is_kept(spark):
    from panelweave.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    first = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == first
    assert io.scratch_folder(spark).startswith(first)


@pytest.mark.parametrize("limits", [{}, {"file_rows": 3}, {"file_rows": 50, "file_bytes": 40}])
def test_stored_texts_come_back_whatever_they_hold(spark, tmp_path, limits):
    odd = ["a\fb", "\f", "\f7\nx", "\\", "\\0", "\\1", "\\2", "\\\\f", "", "\n", "a\n\n", "\r\n x", "7\n", None, "é \u2028 中"]
    rows = [(i - 5, odd[i % len(odd)]) for i in range(90)] + [(None, "no id")]
    path = f"{tmp_path}/t"
    out = source_queries.stored_texts(spark.createDataFrame(rows, "item_id long, text string").repartition(2), path, **limits)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows))
    assert len(list(Path(path).rglob("*.txt"))) >= {None: 1, 3: 30, 50: 8}[limits.get("file_rows")]  # grows with the rows


@pytest.mark.parametrize("limits", [{}, {"file_rows": 3}, {"file_rows": 5, "file_bytes": 12}])
def test_stored_docs_in_many_files_keep_their_digests(spark, tmp_path, limits):
    rows = [(i, None if i % 13 == 5 or i % 7 == 6 else f"text {i}" * (i % 4) + "\n" * (i % 2)) for i in range(210)]
    want = set()
    for term in range(7):
        texts = [t for i, t in rows if i % 7 == term and t is not None]
        digest = hashlib.md5(("\n".join(texts) + "\n").encode()).hexdigest() if texts else None
        want.add((term, term + 100, f"title {term}", digest))
    path = f"{tmp_path}/t"
    df = spark.createDataFrame(rows[::-1], "item_id long, text string").repartition(4)
    out = source_queries.stored_docs(df, path, **limits).select("term_idx", "pos", "title", "digest").collect()
    assert len(out) == 7 and {tuple(r) for r in out} == want
    assert len(list(Path(path).rglob("*.txt"))) >= {None: 6, 3: 60, 5: 60}[limits.get("file_rows")]
