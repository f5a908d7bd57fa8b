import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id long, n long, score double, _kept string, _c_text string, length long, label string, component string")
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    syllables = ["the", "and", "er", "ing", "on", "ti", "al", "re", "un", "ma", "lo", "ste"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    lines = [" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, n, 12)]
    return "\n".join(lines)


def edited(text: str, seed: int, edits: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


TEXTS = [
    None, "", " \n\t ", "a", "Two words", "no letters: 12 34 --", "12 34", "ÄÖÜ ß é 日本語 😀", "<|endoftext|> in <s> text <unk>", LONG,
    "x" * 30_000, " " * 5_000, "same line\nsame line\nsame line", prose(1), prose(1), prose(1).upper(),
    edited(prose(2, 400), 1, 1), edited(prose(2, 400), 2, 1), prose(2, 400), "### $$$ *** " * 30, "a\u2003b\u00a0c\x0bd\x00e",
    "tab\tand\x0cfeed", "word " * 200,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, odd texts, repeated rows, ties and columns that clash."""
    rows = [(k, t, ["en", "de", None][k % 3], None if k % 4 else "s", None, 1, 2, 0.5, "k", "c", 3, "l", "x") for k, t in enumerate(TEXTS)]
    rows += [rows[13], rows[13], (None, "text of a row without id", None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
