import os

import pytest

from seqloom.sources import fasta as FA
from seqloom.sources import newick as NW
from seqloom.sources import sinks as K
from seqloom.sources import tables as TB


def texts(spark, **kw):
    return spark.createDataFrame(list(kw.items()), "family string, text string")


def test_fasta_edge_cases(spark):
    t = texts(spark, a="junk\n>one two \r\nAC\r\n\r\nGT\r\n>x>y\nA-.c\n>empty\n", b="no record here", c="")
    got = [(r.family, r.idx, r.header, r.seq) for r in FA.parse_fasta(t).orderBy("family", "idx").collect()]
    assert got == [("a", 0, "one two", "ACGT"), ("a", 1, "x>y", "A-.c"), ("a", 2, "empty", "")]


def test_strict_reader(spark):
    ok = texts(spark, a=">h\nac.g\n")
    assert FA.parse_strict(ok).first().seq == "AC-G"
    bad = texts(spark, a=">h\nAC-G\n")
    assert FA.parse_strict(bad, strip_gaps=True).first().seq == "ACG"
    with pytest.raises(Exception, match="illegal character"):
        FA.parse_strict(bad).collect()


def test_hidden_names_are_read(spark, tmp_path):
    d = tmp_path / "bench"
    d.mkdir()
    for name in ("_under", ".dot", "plain:1"):
        (d / name).write_text(f">h\nAC\n")
    for root in (str(tmp_path), tmp_path.as_uri()):
        files = FA.list_families(spark, root)
        assert sorted(f["family"] for f in files.collect()) == ["_under", "plain:1"]
        rec = FA.parse_fasta(FA.read_texts(files, root, 2))
        assert {(r.bench, r.family, r.seq) for r in rec.collect()} == {("bench", "_under", "AC"), ("bench", "plain:1", "AC")}
    (d / "broken").write_bytes(b">h\nA\xff")
    with pytest.raises(Exception, match="decode"):
        FA.read_texts(FA.list_families(spark, str(tmp_path)), str(tmp_path), 2).collect()


MSF = """ some title   MSF: 8  Type: P  Check: 1 ..

 Name: alpha  Len: 8
 Name: beta   Len: 8

//

alpha  ACgt
beta   A.GT

alpha  AAAA
beta   CC C*
"""
CLUSTAL = "CLUSTAL W\n\nalpha   ACGT\nbeta    A-GT\n        * **\n\nalpha   AA\nbeta    CC\n"
BARE = "header\n//\none ACG\ntwo A.T\n"


def test_block_formats(spark):
    t = texts(spark, msf=MSF, clustal=CLUSTAL, bare=BARE, fasta=">q\nAC\n")
    got = {(r.family, r.idx): (r.header, r.seq) for r in FA.parse_any(t).collect()}
    assert got == {
        ("msf", 0): ("alpha", "ACGTAAAA"), ("msf", 1): ("beta", "A-GTCCC*"),
        ("clustal", 0): ("alpha", "ACGTAA"), ("clustal", 1): ("beta", "A-GTCC"),
        ("bare", 0): ("one", "ACG"), ("bare", 1): ("two", "A-T"), ("fasta", 0): ("q", "AC"),
    }


def rows(spark, data):
    return spark.createDataFrame(data, "family string, idx int, header string, seq string")


def test_renderings(spark):
    long = "ACDEFGHIKL" * 12 + "MN"
    r = rows(spark, [("f", 0, "b", long), ("f", 1, "a", long[:60] + "-" * 62)])
    text = K.fasta(r).first().text
    assert text == f">b\n{long[:60]}\n{long[60:120]}\nMN\n>a\n{long[:60]}\n{'-' * 60}\n--\n"
    assert K.one_line_fasta(r).first().text.startswith(">a\n" + long[:60] + "-")
    back = FA.parse_fasta(K.fasta(r)).orderBy("idx").collect()
    assert [(x.header, x.seq) for x in back] == [("b", long), ("a", long[:60] + "-" * 62)]
    p = K.phylip(rows(spark, [("f", 0, "name", "ACDEFGHIKLMN"), ("f", 1, "longer name here", "------------")])).first().text
    assert p == "2\n12\nname       ACDEFGHIKL MN\nlonger nam ---------- --\n\n"


def test_one_row_segments_table(spark, tmp_path):
    f = spark.createDataFrame([("f", 0, 1, "reliable", "h", "AC"), ("f", 2, 3, "unreliable", "h", "GT")],
                              "family string, s long, e long, kind string, header string, frag string")
    K.write_segments(f, str(tmp_path / "seg"))
    got = K.read_segments(spark, str(tmp_path / "seg"), "unreliable")
    assert [r.frag for r in got.collect()] == ["GT"]
    assert "PartitionFilters: [isnotnull(kind" in got._jdf.queryExecution().toString()


def test_text_sinks(spark, tmp_path):
    r = rows(spark, [("f", 0, "b", "AC")])
    K.write_texts(K.fasta(r), str(tmp_path / "t"))
    assert os.path.isdir(tmp_path / "t" / "family=f")
    stats = spark.createDataFrame([("pairs", 3.0), ("cells", 9.0)], "key string, value double")
    K.write_statistics(stats, str(tmp_path / "s"))
    assert "".join(sorted(x.value for x in spark.read.text(str(tmp_path / "s")).collect())) == "[stats]cells=9.0pairs=3.0"


def test_small_text_sources(spark, tmp_path):
    s = tmp_path / "para.txt"
    s.write_text("2\n1\n10\n-10\n")
    got = [(r.feature, r["max"], r["min"]) for r in TB.read_scaler(spark, str(s), "m", ["x", "y"]).orderBy("pos").collect()]
    assert got == [("x", 2.0, 1.0), ("y", 10.0, -10.0)]
    t = texts(spark, f="head\n1 0.5 z\n2  -1.5\ntail\n")
    assert [(r.label, r.score) for r in TB.parse_score_text(t).orderBy("pos").collect()] == [("1", 0.5), ("2", -1.5)]
    d = spark.createDataFrame([("1\t2\t3\t4\t5\t6\t7",), ("1\t2",)], "line string").select(TB.feature_line().alias("f"))
    assert [tuple(r.f) for r in d.collect()] == [(1.0, 5.0, 3.0, 4.0, 2.0, 6.0, 7.0), (0.0,) * 7]


def test_newick(spark):
    t = texts(spark, f="((a:0.1,b:0.2):0.3,c:0.4,d:0.5);")
    n = {r.node: r for r in NW.parse(t).collect()}
    assert [n[k].name for k in range(4)] == list("abcd")
    assert (n[4].left, n[4].right, n[4].dist) == (0, 1, 0.3)
    assert (n[5].left, n[5].right) == (4, 2) and (n[6].left, n[6].right) == (5, 3)
    assert n[6].parent is None and n[0].parent == 4
