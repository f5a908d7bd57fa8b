"""Sequences without letters and families of one sequence keep their rows, in the queries and in their SQL forms."""

import duckdb
import pytest

from check_oracles import rows_of
from seqloom.operators import trees as T
from seqloom.plans.oracles import ORACLES
from seqloom.plans.registry import QUERIES

TURNS = [(1, 0, "alpha beta gamma"), (1, 1, "12 34 --"), (1, 2, "beta beta"), (1, 3, ""), (2, 0, "only one"), (3, 0, "!!"), (4, 0, "x y"), (4, 1, "x z")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(c, t, "user" if t % 2 else "bot", x) for c, t, x in TURNS], "conv_id long, turn int, role string, text string")
    df.toPandas().to_parquet(folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["upgma_tree", "single_linkage_tree", "chained_tree", "tree_weights", "leaf_places", "parsed_tree_weights",
                                  "newick_round_trip", "distance_hist", "subtree_distances", "alignment_intervals"])
def test_equals_sql(spark, tables, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tables}/conversations.parquet')")
    df = QUERIES[name](spark, tables)
    cur = db.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    got, want = rows_of(df.columns, df.collect()), rows_of(cols, cur.fetchall())
    assert got == want
    if name in ("upgma_tree", "chained_tree"):
        leaves = {(r["family"], r["node"]) for r in df.where("level = 0").collect()}
        assert leaves == {(str(c), t) for c, t, _ in TURNS}


def test_empty_tables_give_empty_trees(spark):
    none = spark.createDataFrame([], "family string, a int, b int, d double")
    nodes, members = T.build_trees(none)
    assert nodes.count() == members.count() == 0
    one = spark.createDataFrame([("f", 7)], "family string, idx int")
    nodes, members = T.build_trees(none, seqs=one)
    assert [(r["node"], r["parent"], r["leaves"]) for r in nodes.collect()] == [(7, None, 1)] and members.count() == 0
