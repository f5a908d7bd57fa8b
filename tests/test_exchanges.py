"""Trees, their tours and their texts send no table to the driver."""

import pytest

from seqloom.operators import trees as T
from seqloom.operators import tours as TO
from seqloom.operators import windows as W
from seqloom.plans import registry as Q
from seqloom.sources import newick as NW


@pytest.mark.parametrize("name", ["parsed_tree_weights", "subtree_distances"])
def test_no_join_is_broadcast(spark, tmp_path, monkeypatch, name):
    turns = [(c, t, "user", f"ab{t} cd{c % 3} ef{t % 2}") for c in range(20) for t in range(1 + c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    plans, keep = [], Q.materialize

    def written(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, tag)

    for module in (T, TO, NW, W, Q):
        monkeypatch.setattr(module, "materialize", written)
    out = Q.QUERIES[name](spark, str(tmp_path))
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 5 and sum("SortMergeJoin" in p for _, p in plans) > 5
    assert [tag for tag, p in plans if "BroadcastExchange" in p] == []


def test_rounds_of_trees_keep_their_tasks(spark, monkeypatch):
    """The rounds of small families stay in as many tasks as asked for, also where Spark's own exchanges have that number."""
    monkeypatch.setattr(T, "cpu_partitions", lambda df: 4)
    pairs = spark.createDataFrame([(f"f{k}", 0, 1, 0.5) for k in range(200)], "family string, a int, b int, d double")
    tasks, keep = [], T.materialize

    def written(df, tag):
        if tag == "tree-merges":
            tasks.append(df.rdd.getNumPartitions())
        return keep(df, tag)

    monkeypatch.setattr(T, "materialize", written)
    nodes, _ = T.build_trees(pairs)
    assert nodes.count() == 600
    assert tasks == [4]
