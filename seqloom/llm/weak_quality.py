"""Quality classifier learnt from overlapping heuristic labellers.

Every labeller votes good, bad or nothing on a document. Expectation
maximisation over the counts of vote patterns of all documents estimates how
often each labeller gives each vote on good and on bad documents, without any
labels. The posterior of its pattern is a document's soft label; a hashed
linear scorer of byte trigrams learns these labels on a bounded sample and
judges every document.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_slices, only, text_fields, unused

GOOD, BAD, NOTHING = 0, 1, 2


@dataclass(frozen=True)
class QualityConfig:
    """``sample_rows``: most rows the scorer is fitted on, the only bound; ``hash_bits``:
    size of the feature table; ``spare``: share of confidently good sample documents
    that the cutoff may reject; ``cutoff``: scores below it are rejected; ``false_alarms``:
    largest share of good documents that a labeller is believed to call bad;
    ``least_found``: least share of bad documents it is believed to call bad."""

    sample_rows: int = 8000
    hash_bits: int = 12
    em_steps: int = 200
    false_alarms: float = 0.001
    least_found: float = 0.2
    fit_steps: int = 300
    spare: float = 0.002
    cutoff: float = 0.3


#: Labellers: feature, the range that speaks for a good document, the range that speaks for a bad one.
LABELLERS = (
    ("symbols", (0.0, 0.01), (0.06, np.inf)),
    ("capitals", (0.0, 0.15), (0.4, np.inf)),
    ("marks", (0.0, 0.01), (0.2, np.inf)),
    ("ends", (0.03, 0.6), (-1.0, 0.01)),
    ("short", (0.1, 0.8), (-1.0, 0.04)),
    ("lines", (0.0, 0.1), (0.4, np.inf)),
    ("words", (20.0, np.inf), (-1.0, 2.0)),
    ("bars", (0.0, 0.01), (0.2, np.inf)),
    ("again", (0.0, 0.05), (0.4, np.inf)),
)
PATTERNS = 3 ** len(LABELLERS)
_SPACES = " \t\n\x0b\x0c\r"


def features(text: str) -> tuple[float, ...]:
    """Symbols and capitals per byte, words with ``!!``, sentence marks at word
    ends, words of at most three bytes, repeated lines, number of words, words that are
    a bar, and words equal to the one before."""
    raw = text.encode()
    words = raw.split()
    n = max(1, len(words))
    letters = np.frombuffer(raw, np.uint8)
    size = max(1, len(raw))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    ends = sum(raw.count(a + b) for a in (b".", b",", b"?", b"!") for b in (b" ", b"\n")) + raw.endswith((b".", b"?", b"!"))
    short = sum(len(w) < 4 for w in words)
    return (
        symbols / size, np.count_nonzero((letters >= 65) & (letters <= 90)) / size, raw.count(b"!!") / n, ends / n,
        short / n, 1 - len(set(lines)) / max(1, len(lines)), float(len(words)),
        words.count(b"|") / n, sum(map(operator.eq, words, words[1:])) / n,
    )


def patterns(texts: list[str]) -> np.ndarray:
    """Votes of all labellers on every text, as one number below ``PATTERNS``."""
    x = np.array([features(t) for t in texts]).reshape(-1, len(LABELLERS))
    out = np.zeros(len(texts), np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        v = x[:, k]
        vote = np.where((v >= good[0]) & (v <= good[1]), GOOD, np.where((v >= bad[0]) & (v < bad[1]), BAD, NOTHING))
        out = out * 3 + vote
    return out


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


def posteriors(counts: np.ndarray, steps: int, false_alarms: float = 0.001, least_found: float = 0.2) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good | pattern) of every pattern, vote shares ``(labeller, class, vote)`` and P(good).

    ``counts`` has the number of documents of each of the ``PATTERNS``.
    """
    seen = np.flatnonzero(counts)
    counts, votes = counts[seen], votes_of(seen)
    shows = votes[:, :, None] == np.arange(3)
    # the start: one defect is enough to doubt a document
    good = np.where((votes == BAD).any(1), 0.05, 0.95)
    share, prior = np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5
    for _ in range(steps):
        weight = np.stack([counts * good, counts * (1 - good)], 1)
        total = weight.sum(0)
        share = (np.einsum("pc,plv->lcv", weight, shows) + 1) / (total[None, :, None] + 3)
        # what makes the classes good and bad: good documents are hardly ever
        # accused, and every labeller finds some share of the bad ones
        share[:, 0, BAD] = np.minimum(share[:, 0, BAD], false_alarms)
        share[:, 1, BAD] = np.maximum(share[:, 1, BAD], least_found)
        prior = (total[0] + 1) / (total.sum() + 2)
        log = np.einsum("plv,lcv->pc", shows, np.log(share)) + np.log([prior, 1 - prior])
        good = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
    everywhere = np.full(PATTERNS, prior)
    everywhere[seen] = good
    return everywhere, share, prior


def hashed(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams and the roots of their shares, drawn to zero
    where few trigrams say little."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - bits)
    n = np.bincount(h, minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, np.sqrt(n[at] / n.sum()) * (len(h) / (len(h) + 50))


@dataclass
class Scorer:
    weights: np.ndarray
    cutoff: float
    bits: int

    def score(self, text: str) -> float:
        at, x = hashed(text, self.bits)
        if not len(at):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at], -500, 500))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cfg: QualityConfig) -> Scorer:
    """Logistic regression of the soft labels by full gradient steps with momentum.

    It has no constant term, so that a text that says nothing has score 0.5."""
    size = 1 << cfg.hash_bits
    doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, np.int64)
    x = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    w, speed = np.zeros(size), np.zeros(size)
    n = max(1, len(rows))
    # both classes carry the same weight
    good, bad = max(labels.sum(), 1e-9), max((1 - labels).sum(), 1e-9)
    weight = labels * n / (2 * good) + (1 - labels) * n / (2 * bad)
    for _ in range(cfg.fit_steps):
        z = np.bincount(doc, x * w[at], len(rows))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / n
        speed = 0.9 * speed - 4.0 * (np.bincount(at, x * slope[doc], size) + 1e-5 * w)
        w = w + speed
    z = np.bincount(doc, x * w[at], len(rows))
    score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    sure = np.sort(score[labels > 0.95])
    cutoff = min(cfg.cutoff, sure[int(len(sure) * cfg.spare)]) if len(sure) else 0.0
    return Scorer(w, cutoff, cfg.hash_bits)


def train(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> tuple[np.ndarray, Scorer]:
    """Pattern posteriors from all documents, and the scorer from a bounded sample of them."""

    seen = text_fields(docs.select("text"), "text", "_votes", "pattern long", lambda texts: [pa.array(patterns(texts), pa.int64())])
    seen = seen.groupBy(F.col("_votes.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    found = {r["pattern"]: r["n"] for r in seen.collect()}
    counts = np.zeros(PATTERNS)
    counts[list(found)] = list(found.values())
    good, _, _ = posteriors(counts, cfg.em_steps, cfg.false_alarms, cfg.least_found)
    total = max(1, int(counts.sum()))
    # a hash of the text decides who is in the sample, so that it is the same in every run
    share = min(1.0, cfg.sample_rows * 0.9 / total)
    bits = cfg.hash_bits

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = b.column(0).to_pylist()
            rows = [hashed(t, bits) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns(texts), pa.int64()),
                 pa.array([a.astype("<u2").tobytes() for a, _ in rows], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                ["pattern", "at", "x"],
            )

    chosen = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = (
        docs.where(F.length("text") > 2).where(chosen).select("text")
        .mapInArrow(vectors, "pattern long, at binary, x binary").limit(cfg.sample_rows).collect()
    )
    rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in sample]
    labels = good[np.array([r["pattern"] for r in sample], np.int64)]
    return good, fit(rows, labels, cfg)


def judged(docs: DataFrame, into: str, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """``docs`` with a struct ``into`` of posterior, score and kept.

    A null, empty or very short text (under three bytes) has score 0 and is not
    kept. Repeated rows and null ids are judged each. Further columns, of any name and type, pass
    through in the JVM; an empty table gives an empty result.
    """
    good, scorer = train(docs, cfg)
    model = docs.sparkSession.sparkContext.broadcast((good, scorer))

    def run(texts: list[str]) -> list[pa.Array]:
        posterior, s = model.value
        score = np.array([s.score(t) for t in texts])
        size = np.array([len(t.encode()) for t in texts])
        return [
            pa.array(posterior[patterns(texts)], pa.float64()), pa.array(score, pa.float64()),
            pa.array((score >= s.cutoff) & (size > 2), pa.bool_()),
        ]

    return text_fields(docs, "text", into, "posterior double, score double, kept boolean", run)


def kept(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    into = unused(docs, "_judged")
    return only(judged(docs, into, cfg).where(F.col(f"{into}.kept")), docs.columns)


def report(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """``(doc_id, posterior, score, kept)`` of every row."""
    return judged(docs.select("doc_id", "text"), "_judged", cfg).select("doc_id", "_judged.*")
