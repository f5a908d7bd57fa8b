import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import rows_of

SF = "/root/testdata/sf0.001"
SMALL = ["col_score_stats", "segment_cut", "conservation_symbol", "global_rank_norm", "consistency_relax", "row_split",
         "gap_expand", "count_cutoff", "annotation_text", "fasta_parse"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no table set")


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 70


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["family", "n", "len", "un_sp", "sd", "peak", "a", "b"] and df.count() > 0


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_entry_without_the_corpus_folders(tmp_path):
    """The queries of the library are there when the corpus operators are taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()), len(e.oracle_sql()) > 80)"],
        cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert said.returncode == 0, said.stderr
    n, ops, many = said.stdout.split()
    assert int(n) > 90 and ops == "0" and many == "True"


def test_planned_regions_with_joins_cut_at_run_time(spark):
    """Joins by shuffle whose partitions are merged at run time, as over large tables."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = entry.queries()["planned_regions"](spark, SF)
        got = rows_of(df.columns, df.collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cur = db.execute(entry.oracle_sql()["planned_regions"])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
