"""Near-duplicate vectors: spherical k-means cells, blocked cosines, components.

Only vectors of one label are compared. Equal vectors are one vector with a
weight. The vectors of a label fall into the cells of a spherical k-means; all
vectors of a cell are compared with each other in blocks, and a vector visits
another cell if a partner can lie there. That test loses no link: two unit
vectors with cosine c are sqrt(2 - 2c) apart, so a vector whose partner is
nearer to another centre is at most that far from the plane between the two
centres. Centres only decide how much work is saved, so they are fitted on a
bounded sample; the result doesn't depend on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch
from seqloom.llm.components import components


@dataclass(frozen=True)
class VectorConfig:
    """``cell_rows``: vectors of a cell aimed at; ``cells``: most cells of a label;
    ``block_rows``: vectors of a block; ``sample_per_cell``: vectors the centres
    of a label are fitted on, times the cells; ``rounds`` of k-means."""

    threshold: float = 0.93
    cell_rows: int = 2048
    cells: int = 256
    block_rows: int = 1024
    sample_per_cell: int = 64
    rounds: int = 10


def matrix(column) -> np.ndarray:
    """Rows of equally long byte strings of doubles."""
    return np.array([np.frombuffer(x.as_buffer(), np.float64) for x in column]).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; divided by their largest component first, so that no square leaves the range of doubles."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means of unit vectors, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        n = np.linalg.norm(s, axis=1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, list[list[int]]]:
    """Own cell of each unit vector and the higher cells where partners may be."""
    cos = x @ c.T
    own = cos.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    far = math.sqrt(2 - 2 * threshold) + 1e-9
    near = (cos[np.arange(len(x)), own][:, None] - cos) <= far * apart[own]
    near &= np.arange(len(c))[None, :] > own[:, None]
    return own, [np.flatnonzero(r).tolist() for r in near]


def compare(ids_a, a, weight_a, ids_b, b, weight_b, threshold):
    """Of each vector of two blocks: weight of its links and the smallest id of its local component."""
    link = unit(a) @ unit(b).T >= threshold
    same = ids_a is ids_b
    if same:
        np.fill_diagonal(link, False)
    n_a, n_b = link @ weight_a if same else link @ weight_b, link.T @ weight_a
    top = np.iinfo(np.int64).max
    low_a, low_b = ids_a.copy(), ids_b.copy()
    rows_a, rows_b = np.flatnonzero(n_a), np.flatnonzero(n_b)
    sub = link[np.ix_(rows_a, rows_b)]
    while sub.size:
        before = low_a[rows_a].sum(), low_b[rows_b].sum()
        low_a[rows_a] = np.minimum(low_a[rows_a], np.where(sub, low_b[rows_b][None, :], top).min(1))
        low_b[rows_b] = np.minimum(low_b[rows_b], np.where(sub, low_a[rows_a][:, None], top).min(0))
        if same:
            low_a = low_b = np.minimum(low_a, low_b)
        if before == (low_a[rows_a].sum(), low_b[rows_b].sum()):
            break
    return (n_a, low_a), (n_b, low_b)


def links(vectors: DataFrame, cfg: VectorConfig = VectorConfig()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    A vector that is null or zero, holds a null or non-finite component, or has
    a null label links with nothing, nor do vectors of different lengths.
    Equal vectors of one label are linked. Rows that repeat a vec_id count as
    vectors of their own; a row with a null vec_id has a null component and is
    linked with nothing. Further columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    keyed = vectors.select(
        "vec_id", F.col("label").cast("long").alias("label"), "embedding", F.coalesce(usable, F.lit(False)).alias("ok"),
        F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2"),
    )
    one = keyed.where("ok").groupBy("label", F.size("embedding").alias("dim"), "k1", "k2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    one, _ = scratch.write(one, "distinct")
    sizes = one.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "k", F.least(F.lit(cfg.cells), F.ceil(F.col("n") / cfg.cell_rows)).cast("int"))
    sizes, _ = scratch.write(sizes, "sizes")  # a row for each label and length
    key = ["label", "dim"]
    sample = one.join(sizes, key).where(
        (F.col("k") > 1) & (F.pmod(F.xxhash64("id"), F.col("n")) < F.col("k") * cfg.sample_per_cell))
    rounds, threshold, block = cfg.rounds, cfg.threshold, cfg.block_rows

    def fit(table):
        k = table.column("k")[0].as_py()
        x = unit(np.array([r for r in table.column("embedding").to_pylist()], float))
        c = centres(x[np.argsort(table.column("id").to_numpy())], min(k, len(x)), rounds)
        return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1],
                         "centres": pa.array([c.tobytes()], pa.binary())})

    fitted = sample.groupBy(*key).applyInArrow(fit, "label long, dim int, centres binary")
    # the vectors of a label are dealt out in parts; each part gets the centres once
    part = F.ceil(F.col("n") / 8192).cast("long")
    dealt = one.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, key).withColumn(
        "part", F.pmod(F.xxhash64("id"), part)).select(*key, "part", "id", "weight", "embedding")
    told = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part - 1))).join(fitted, key, "left").select(
        *key, "part", "centres")

    def assign(left, right):
        x = np.array(left.column("embedding").to_pylist(), float).reshape(left.num_rows, -1)
        c = right.column("centres")[0].as_py() if right.num_rows else None
        if c is None:
            own, visits = np.zeros(len(x), int), [[]] * len(x)
        else:
            own, visits = cells_of(unit(x), np.frombuffer(c).reshape(-1, x.shape[1]), threshold)
        return pa.table({
            "label": left.column("label"), "dim": left.column("dim"), "id": left.column("id"),
            "weight": left.column("weight"), "vector": pa.array([r.tobytes() for r in x], pa.binary()),
            "cell": pa.array(own, pa.int32()), "visits": pa.array(visits, pa.list_(pa.int32())),
        })

    placed = dealt.groupBy(*key, "part").cogroup(told.groupBy(*key, "part")).applyInArrow(
        assign, "label long, dim int, id long, weight long, vector binary, cell int, visits array<int>")
    placed, _ = scratch.write(placed, "cells")
    cell = [*key, "cell"]
    slots = placed.select(*key, "id", "weight", "vector", F.explode(F.concat(
        F.array(F.struct("cell", F.lit(True).alias("home"))),
        F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))).alias("s")
    ).select(*key, "id", "weight", "vector", "s.cell", "s.home")
    tally = placed.select(*key, F.explode(F.concat(F.array(F.struct("cell", F.lit(1).alias("h"), F.lit(0).alias("v"))),
        F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(0).alias("h"), F.lit(1).alias("v"))))).alias("s"))
    tally = tally.groupBy(*key, "s.cell").agg(
        F.ceil(F.sum("s.h") / block).alias("homes"), F.ceil(F.sum("s.v") / block).alias("guests"))
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("id"), "homes")).otherwise(F.pmod(F.xxhash64("id"), "guests"))
    zero = F.lit(0).cast("long")
    among = lambda n: F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    at_home = F.concat(
        F.transform(among("homes"), lambda j: F.struct(
            F.lit(0).alias("kind"), F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"), (F.col("mine") > j).alias("second"))),
        F.transform(among("guests"), lambda i: F.struct(
            F.lit(1).alias("kind"), i.alias("i"), F.col("mine").alias("j"), F.lit(True).alias("second"))))
    away = F.transform(among("homes"), lambda j: F.struct(
        F.lit(1).alias("kind"), F.col("mine").alias("i"), j.alias("j"), F.lit(False).alias("second")))
    units = slots.join(tally, cell).withColumn("mine", mine).select(
        *cell, "id", "weight", "vector", F.explode(F.when(F.col("home"), at_home).otherwise(away)).alias("u")
    ).select(*cell, "u.*", "id", "weight", "vector")

    def meet(table):
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        x = matrix(table.column("vector"))
        second = table.column("second").to_numpy().astype(bool)
        if table.column("kind")[0].as_py() == 0 and not second.any():
            (n, low), _ = compare(ids, x, weight, ids, x, weight, threshold)
        else:
            n, low = np.zeros(len(ids), np.int64), ids.copy()
            a, b = np.flatnonzero(~second), np.flatnonzero(second)
            if len(a) and len(b):
                (n[a], low[a]), (n[b], low[b]) = compare(ids[a], x[a], weight[a], ids[b], x[b], weight[b], threshold)
        hit = np.flatnonzero(n)
        return pa.table({"id": ids[hit], "n": n[hit], "low": low[hit]})

    met, _ = scratch.write(
        units.groupBy(*cell, "kind", "i", "j").applyInArrow(meet, "id long, n long, low long"), "links")
    found = components(met.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")), scratch)
    counted = met.groupBy("id").agg(F.sum("n").alias("n"))
    classes = one.join(counted, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "k1", "k2", F.coalesce("n", F.lit(0)).alias("n"), "weight", F.coalesce("component", "id").alias("component"))
    plain = keyed.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), "k1", "k2")
    out = plain.join(classes, ["label", "k1", "k2"], "left")
    return out.select(
        "vec_id", F.coalesce(F.col("n") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
