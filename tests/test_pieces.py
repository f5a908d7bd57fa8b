"""Files parsed from their pieces give the rows of their whole texts, and no text of a family is put together for it."""

import pytest

from seqloom.plans import registry as Q
from seqloom.sources import fasta as FA

FILES = {
    "f": [">a b\nAC\n", ">c\n\n", ">d\r\nA-\nC\n"],
    "blank first": ["\n", " \n", ">x\nA.\n"],
    "clustal": ["CLUSTAL x\n", "\n", "one  AC-\n", "two  A.G\n", "     *  \n", "\n", "one  TT\n", "two  T-\n"],
    "msf": ["Name: one\nName: two\n", "//\n", "  one AC\n  two A-\n", "  two GG\n", "  six XX\n"],
    "no title": ["one  AC\n"],
    "none": [" \n", "\n"],
}


@pytest.mark.parametrize("strip", [False, True])
def test_pieces_equal_whole_texts(spark, strip):
    pieces = spark.createDataFrame([(f, i, p) for f, ps in FILES.items() for i, p in enumerate(ps)], "family string, at int, piece string")
    texts = spark.createDataFrame([(f, "".join(ps)) for f, ps in FILES.items()], "family string, text string")
    cols = ("family", "idx", "header", "seq")
    got = sorted(tuple(r) for r in FA.parse_pieces(pieces, ["at"], strip).select(*cols).collect())
    want = sorted(tuple(r) for r in FA.parse_any(texts, strip_gaps=strip).select(*cols).collect())
    assert got == want and len(got) == 9


@pytest.mark.parametrize("name", ["sniffed_parse", "block_parse"])
def test_families_are_parsed_in_pieces_that_follow_the_letters(spark, tmp_path, monkeypatch, name):
    turns = [(c, t, "user", "ab cd" * 4) for c in range(40) for t in range(1 + c % 4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")

    def whole(*args, **kwargs):
        raise AssertionError("the text of a family is put together")

    seen = []
    keep = Q.materialize

    def written(df, tag):
        seen.append((tag, df.rdd.getNumPartitions() if tag == "lines" else 0))
        return keep(df, tag)

    monkeypatch.setattr(Q.K, "_join", whole)
    monkeypatch.setattr(Q.K, "_whole", whole)
    monkeypatch.setattr(Q, "materialize", written)
    monkeypatch.setattr(Q, "LETTERS_PER_TASK", 20)
    rows = Q.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == len(turns)
    # 100 turns of 20 letters in tasks of about 20
    assert dict(seen)["lines"] >= 100
