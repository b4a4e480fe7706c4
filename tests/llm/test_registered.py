"""The registered queries against their SQL, and the pipeline against brute force."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stallbook.config import keep
from stallbook.llm import queries
from tests_llm_plain import line_dedup_brute, near_dedup_brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_operator_has_one_query():
    names = [*queries.queries()]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    from check import connect, differences

    assert differences(queries.queries()[name](spark, FOLDER), connect(FOLDER),
                       queries.oracle_sql()[name]) == []


def test_whole_tables_come_back(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op4_toxicity", "op7_language_id", "op9_line_dedup"):
        assert queries.queries()[name](spark, FOLDER).count() == n
    packed = queries.queries()["op3_packing"](spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == n


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs, docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (before, keep(stage(spark, before, FOLDER), name))
        before = made[name][1]
        assert name == "packing" or before.columns == columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    given, kept = made["toxicity"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    gone = given.join(kept, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.agg(F.avg("toxic")).first()[0] in (None, 1.0) or gone.where("toxic = 0").count() <= 3
    given, kept = made["line_dedup"]
    assert texts(kept) == line_dedup_brute(texts(given), 40)
    assert kept.where("n_chars <> length(text)").count() == 0
    given, kept = made["near_dedup"]
    assert set(texts(kept)) == near_dedup_brute(texts(given))
    given, kept = made["mixing"]
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(kept) - words(given)) <= 20
    assert made["packing"][1].agg(F.sum("n_words")).first()[0] == words(kept)


#: Names that operators use for columns of their own, and one that differs in case alone.
CLASHING = ("score", "predicted", "target", "part", "whole", "source_size", "removed_lines", "first_ids",
            "__copy", "__of", "__id", "__hash", "lone", "node", "Size", "__made", "__rest", "a b")


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "packing"], ids=lambda s: s[0])
def test_stages_keep_the_callers_columns(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    own = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    own = keep(own.unionByName(own.limit(1).withColumn("text", F.lit(None).cast("string"))), "own")
    plain, got = (stage[1](spark, d, FOLDER) for d in (own.select(*docs.columns), own))
    assert got.columns == own.columns and got.schema == own.schema
    rows = got.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted(
        (r.doc_id, r.text or "") for r in plain.collect()) and rows
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHING)
    assert stage[1](spark, own.limit(0), FOLDER).collect() == []


def test_the_library_works_without_this_part(tmp_path):
    for name in ("__spark_entry__.py", "stallbook"):
        from_, to = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(from_):
            shutil.copytree(from_, to, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(from_, to)
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert len(q) > 100 and set(o) <= set(q) and 'pipeline' not in q")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    # but a fault inside the part itself is not hidden
    (tmp_path / "stallbook" / "llm").mkdir()
    (tmp_path / "stallbook" / "llm" / "__init__.py").write_text("")
    (tmp_path / "stallbook" / "llm" / "queries.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                          capture_output=True).returncode
