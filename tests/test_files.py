"""One file per family: partitions per folder, pushed filters, and writes in two phases."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from seqloom.sources import files as FS
from seqloom.sources import sinks as K


def table(spark, data):
    return spark.createDataFrame(data, "bench string, family string, idx int, header string, seq string")


ROWS = [("b1", f, k, f"{f} {k}", "ACDEFGHIKL" * (k % 9) + "MN") for f in ("_under", "plain:1", "two") for k in range(40)] + [("b2", "two", 0, "x", "")]


@pytest.mark.parametrize("uri", [False, True])
def test_round_trip(spark, tmp_path, uri):
    root = tmp_path.as_uri() if uri else str(tmp_path)
    FS.write_families(FS.fasta_pieces(table(spark, ROWS).repartition(5)), root, ["idx"])
    assert sorted(os.listdir(tmp_path)) == ["b1", "b2"] and sorted(os.listdir(tmp_path / "b1")) == ["_under", "plain:1", "two"]
    want = K.fasta(table(spark, ROWS).where("bench = 'b1' and family = 'two'").drop("bench")).first().text
    assert (tmp_path / "b1" / "two").read_text() == want
    back = FS.read_families(spark, root)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    (tmp_path / "b1" / ".dot").write_text(">h\nAC\n")
    assert FS.read_families(spark, root).count() == len(ROWS)


def test_filters_prune_partitions_and_files(spark, tmp_path):
    FS.write_families(FS.fasta_pieces(table(spark, ROWS), 0), str(tmp_path), ["idx"])
    # a file that can't be read shows whether it is opened
    (tmp_path / "b1" / "broken").write_bytes(b">h\nA\xff")
    (tmp_path / "b3").mkdir()
    all_ = FS.read_families(spark, str(tmp_path), parts=3)
    assert all_.rdd.getNumPartitions() == 9
    one = all_.where("bench = 'b1' and family in ('two', 'none')")
    assert one.count() == 40 and one.rdd.getNumPartitions() <= 2
    assert all_.where("bench = 'b2' and idx = 0").count() == 1
    assert all_.where("family = 'two' and bench = 'b9'").count() == 0
    with pytest.raises(Exception, match="decode"):
        all_.collect()


def test_records_and_strictness(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "odd").write_bytes("junk\n>one two \r\nAC\r\n\r\nG T\r\n>x>y\nA-.c\n>é\n>last".encode())
    (tmp_path / "b" / "empty").write_text("no record\n")
    got = FS.read_families(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.family, r.idx, r.header, r.seq) for r in got] == [("odd", 0, "one two", "ACGT"), ("odd", 1, "x>y", "A-.c"), ("odd", 2, "é", ""), ("odd", 3, "last", "")]
    with pytest.raises(Exception, match="no sequence in b/empty"):
        FS.read_families(spark, str(tmp_path), strict="true").collect()
    assert FS.read_families(spark, str(tmp_path), sub="in").count() == 0


def test_append_never_replaces_and_overwrite_does(spark, tmp_path):
    root, one = str(tmp_path), table(spark, ROWS[:1])
    FS.write_families(FS.fasta_pieces(one), root, ["idx"])
    before = (tmp_path / "b1" / "_under").read_text()
    with pytest.raises(Exception, match="there already"):
        FS.write_families(FS.fasta_pieces(one.withColumn("header", F.lit("new"))), root, ["idx"])
    assert (tmp_path / "b1" / "_under").read_text() == before and os.listdir(tmp_path) == ["b1"]
    FS.write_families(FS.fasta_pieces(table(spark, [("b1", "other", 0, "h", "AC")])), root, ["idx"], mode="overwrite")
    assert os.listdir(tmp_path / "b1") == ["other"]
    with pytest.raises(Exception, match="no name of a file"):
        FS.write_families(FS.fasta_pieces(table(spark, [("b1", "a/b", 0, "h", "AC")])), root, ["idx"])
    with pytest.raises(Exception, match="columns needed"):
        one.write.format(FS.NAME).mode("append").save(root)


class Context:
    """What a task knows of itself, for attempts of one task beside each other."""

    def __init__(self, attempt):
        self.attempt = attempt

    def partitionId(self):
        return 0

    def taskAttemptId(self):
        return self.attempt


def test_retried_tasks_leave_one_file(tmp_path, monkeypatch):
    """An attempt that died, one that came too late, and the one that counts."""
    from pyspark.sql.types import StructType

    writer = FS.FamilyWriter({"path": str(tmp_path), "job": "j"}, StructType.fromDDL("bench string, family string, piece string"), False)
    rows = [{"bench": "b", "family": f, "piece": p} for f in ("f", "g") for p in (f">{f}\n", "AC\n")]

    def attempt(k, mine, dies=False):
        monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Context(k)))

        def given():
            yield from mine
            if dies:
                raise OSError("lost")

        return writer.write(given())

    with pytest.raises(OSError, match="lost"):
        attempt(1, rows[:3], dies=True)
    late, counts = attempt(2, rows), attempt(3, rows)
    assert late.folder != counts.folder and not (tmp_path / "b").exists()
    writer.commit([counts, None])
    assert {p.name: p.read_text() for p in (tmp_path / "b").iterdir()} == {"f": ">f\nAC\n", "g": ">g\nAC\n"}
    assert os.listdir(tmp_path) == ["b"]
    with pytest.raises(ValueError, match="follow each other"):
        attempt(4, [rows[0], rows[2], rows[1]])
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([attempt(5, rows), attempt(6, rows)])
    writer.abort([])
    assert os.listdir(tmp_path) == ["b"]
