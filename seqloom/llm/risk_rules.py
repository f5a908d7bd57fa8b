"""Quality rules whose cutoffs are chosen by exact binomial bounds on labelled documents.

Every rule rejects documents with a share above a cutoff. Labelled bad documents
and a fifth of the good ones set an order in which the cutoffs of all rules are
lowered, one step at a time. The other good documents are the holdout: in every
stratum (language) the steps are tested in that order, each for all rules
together, and the first step at which the exact binomial test does not refute
that more than the allowed share of good documents is rejected ends the
sequence. The order doesn't depend on the holdout, so no level is divided by
the number of rules or cutoffs. A stratum with too few good documents to pass
any test takes the steps certified for all strata pooled, as far as its own
good documents don't speak against them.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, blocks, fold, only, text_fields, unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
WINDOW = 5


@dataclass(frozen=True)
class RiskConfig:
    """``risk``: share of good documents that all rules together may reject, of a stratum
    or, for strata too small to be tested, of all strata pooled; ``delta``: probability
    that this fails anywhere; ``grid``: cutoffs tried, in rising order."""

    risk: float = 0.02
    delta: float = 0.05
    grid: tuple[float, ...] = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)


#: Rule to the share it looks at: numerator and denominator of the counts.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
}

_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words inside windows of five that occur twice or more in their document.

    ``ids`` are the words of all documents, ``doc`` the document of each."""
    n = len(ids) - WINDOW + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    h = np.zeros(n, np.uint64)
    for k, m in enumerate(_MIX):
        x = (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(m)
        h = (h ^ (x ^ (x >> np.uint64(31)))) * np.uint64(0x9FB21C651E98DF25)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    d = doc[at]
    h = h[at] ^ (d.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin = np.zeros(len(ids) + 1, np.int64)
    np.add.at(begin, at[twice], 1)
    np.add.at(begin, at[twice] + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(begin)[:-1] > 0, minlength=n_docs).astype(np.int64)


def measure(texts: list[str]) -> list[np.ndarray]:
    """The counts of ``FIELDS`` of every text."""
    out = np.zeros((len(FIELDS), len(texts)), np.int64)
    for a, b in blocks(texts):
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids, sizes = [], []
        for k in range(a, b):
            t = texts[k]
            raw = t.encode()
            words = raw.split()  # of bytes: at the six ASCII spaces
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
            lines = [line for line in t.split("\n") if line.strip(SPACES)]
            letters = np.frombuffer(raw, np.uint8)
            out[:, k] = (
                len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)),
                len(lines) - len(set(lines)), 0, len(lines),
                np.count_nonzero((letters >= 65) & (letters <= 90)), t.count("!!"),
            )
        doc = np.repeat(np.arange(b - a), sizes)
        out[4, a:b] = repeated_words(np.concatenate(ids), doc, b - a)
    return list(out)


COUNTS = ", ".join(f"{f} long" for f in FIELDS)


def counted_into(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` and the counts of the text as a struct; a null text has no words."""
    return text_fields(docs, "text", into, COUNTS, lambda texts: [pa.array(x, pa.int64()) for x in measure(texts)])


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs``, which has no such columns, and the counts as columns ``_c_*``."""
    out = counted_into(docs, "_counts")
    return out.select(*docs.columns, *[F.col(f"_counts.{f}").alias(f"_c_{f}") for f in FIELDS])


def share(rule: str, at: str = "_c_") -> Column:
    num, den = RULES[rule]
    return F.col(f"{at}{num}") / F.greatest(F.col(f"{at}{den}"), F.lit(1))


def base_failed(at: str = "_c_") -> Column:
    return (F.col(f"{at}n_words") < 10) | (100 * F.col(f"{at}n_repeat_words") > 20 * F.col(f"{at}n_words"))


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p), summed exactly."""
    terms = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def certified(n: int, rejected: int, risk: float, level: float) -> bool:
    """Whether ``rejected`` of ``n`` good documents refutes a false rejection above ``risk``."""
    if rejected >= n * risk:  # no evidence, and a long sum
        return False
    return log_binomial_tail(rejected, n, risk) <= math.log(level)


def lowering(levels: np.ndarray, bad: np.ndarray, good: np.ndarray, cuts: int) -> list[tuple[int, int]]:
    """``(rule, cutoff)`` in the order in which cutoffs are lowered, from no rejection to the lowest of all rules.

    ``levels`` has for kinds of documents and rules how many cutoffs a share is
    above; ``bad`` and ``good`` count the documents of each kind. The next rule is the one that
    rejects most further bad documents for the good ones it costs."""
    at, out = [cuts] * levels.shape[1], []
    alive = np.ones(len(levels), bool)
    while any(at):
        best = (-1.0, 0, 0)
        for r, now in enumerate(at):
            over = [np.cumsum(np.bincount(levels[alive, r], w[alive], cuts + 1)[::-1])[::-1] for w in (bad, good)]
            for j in range(now - 1, -1, -1):
                gain = (over[0][j + 1] + 0.5) / (over[1][j + 1] + 1)
                if gain > best[0]:
                    best = (gain, r, j)
        _, r, j = best
        out += [(r, k) for k in range(at[r] - 1, j - 1, -1)]
        at[r] = j
        alive &= levels[:, r] <= j
    return out


def certified_steps(n: int, rejected: list[int], risk: float, level: float) -> int:
    """How many steps pass before the first that fails; ``rejected`` good documents of ``n`` up to each step."""
    return next((t for t, k in enumerate(rejected) if not certified(n, k, risk, level)), len(rejected))


def refuted(n: int, rejected: int, risk: float, level: float) -> bool:
    """Whether ``rejected`` of ``n`` good documents shows a false rejection above ``risk``."""
    return rejected > n * risk and -math.expm1(min(0.0, log_binomial_tail(rejected - 1, n, risk))) < level


def tested(sizes: list[tuple[int, int]], cfg: RiskConfig) -> tuple[float, float]:
    """Least good documents of a stratum that is tested by itself, and the level of every test.

    ``sizes`` has ``(good documents, strata)``. Sizes alone decide, so the level is shared only by
    strata that can pass and the pooled test."""
    least, strata = math.inf, 0
    for n, count in sorted(sizes, reverse=True):
        if not certified(n, 0, cfg.risk, cfg.delta / (strata + count + 1)):
            break
        least, strata = n, strata + count
    return least, cfg.delta / (strata + 1)


def cutoffs(counted: DataFrame, labels: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """``(_stratum, _cut_<rule>)``: the cutoffs each stratum may use; the row without
    stratum is for strata without labelled good documents.

    A document with several labels is good if all its labels are; null labels say
    nothing. The driver gets counts by kinds of documents (how many cutoffs the
    shares are above), which the grid bounds.
    """
    grid, names = sorted(cfg.grid), list(RULES)
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    level = [functools.reduce(operator.add, [(share(r) > c).cast("int") for c in grid]) for r in RULES]
    kinds = (
        counted.where(~base_failed()).join(label, "doc_id")
        .select("_stratum", F.array(*level).alias("levels"), (F.col("q") == 1).alias("good"), fold("doc_id", 5, 0).alias("tune"))
        .groupBy("_stratum", "levels", "good", "tune").agg(F.count(F.lit(1)).alias("n"))
    )
    kinds, _ = Scratch(counted.sparkSession, "rules").write(kinds, "kinds")
    tune = kinds.where("tune or not good").groupBy("levels", "good").agg(F.sum("n").alias("n")).collect()
    is_good, n = np.array([x["good"] for x in tune], bool), np.array([x["n"] for x in tune], float)
    levels = np.array([x["levels"] for x in tune], np.int64).reshape(-1, len(names))
    steps = lowering(levels, n * ~is_good, n * is_good, len(grid))
    place = {s: t for t, s in enumerate(steps)}

    def first(r: int) -> Column:
        at = [len(steps), *(place[r, j] for j in range(len(grid)))]
        return F.element_at(F.array(*map(F.lit, at)), F.col("levels")[r] + 1)

    held = kinds.where("good and not tune").select("_stratum", F.least(*map(first, range(len(names)))).alias("step"), "n")
    per_step = held.groupBy("_stratum", "step").agg(F.sum("n").alias("n"))
    strata = per_step.groupBy("_stratum").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("at"))
    enough = math.ceil(math.log(cfg.delta * 1e-12) / math.log1p(-cfg.risk))  # for any number of strata
    sizes = strata.groupBy(F.least("n", F.lit(enough)).alias("n")).count().collect()
    least, alpha = tested([tuple(x) for x in sizes], cfg)

    def sums(at: dict[int, int]) -> list[int]:
        return list(itertools.accumulate(at.get(t, 0) for t in range(len(steps))))

    everyone = {x["step"]: x["n"] for x in held.groupBy("step").agg(F.sum("n").alias("n")).collect()}
    pooled = certified_steps(sum(everyone.values()), sums(everyone), cfg.risk, alpha)

    def depth(n: int, at: dict[int, int]) -> int:
        rejected = sums(at)
        if n >= least:
            return certified_steps(n, rejected, cfg.risk, alpha)
        return next((t for t in range(pooled, 0, -1) if not refuted(n, rejected[t - 1], cfg.risk, cfg.delta)), 0)

    def lowest(t: int) -> list[float | None]:
        done = dict(steps[:t])  # the last step of a rule is its lowest
        return [grid[done[r]] if r in done else None for r in range(len(names))]

    schema = "_stratum string, " + ", ".join(f"_cut_{r} double" for r in RULES)

    def run(batches):
        for b in batches:
            rows = [(x["_stratum"], *lowest(depth(x["n"], dict(x["at"])))) for x in b.to_pylist()]
            cols = list(zip(*rows)) or [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), *(pa.array(c, pa.float64()) for c in cols[1:])],
                ["_stratum", *(f"_cut_{r}" for r in RULES)],
            )

    rest = counted.sparkSession.createDataFrame([(None, *lowest(pooled))], schema)
    return strata.mapInArrow(run, schema).unionByName(rest)


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def verdicts(counted: DataFrame, cuts: DataFrame, at: str, language: Column, into: str) -> DataFrame:
    """``counted`` with whether each row is kept; ``at`` is what the names of its counts begin with."""
    rest = cuts.where("_stratum is null").first()
    key, cut = unused(counted, "_cut_key"), unused(counted, "_cuts")
    cuts = cuts.where("_stratum is not null").select(F.col("_stratum").alias(key), F.struct(*[f"_cut_{r}" for r in RULES]).alias(cut))
    rejected = base_failed(at)
    for r in RULES:
        own = F.when(F.col(key).isNotNull(), F.col(f"{cut}._cut_{r}")).otherwise(F.lit(rest[f"_cut_{r}"]).cast("double"))
        rejected = rejected | F.coalesce(share(r, at) > own, F.lit(False))
    out = counted.join(cuts, F.coalesce(language, F.lit("")) == F.col(key), "left")
    return out.withColumn(into, ~rejected).drop(key, cut)


def kept(docs: DataFrame, labels: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``.

    Null or empty text has no words and fails the base rules. A null language
    is a stratum of its own. Repeated rows are judged alike; a null id has no
    label. With an empty label table only the base rules reject. Further columns
    may have any name and type; they stay in the JVM. Texts are counted twice, for the cutoffs and for the
    verdicts: a join of texts with labels, or a copy of them, would cost more than that.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    slim = docs.select("doc_id", "text", stratum().alias("_stratum"))
    slim, _ = scratch.write(with_counts(slim).drop("text"), "counts")
    cuts, _ = scratch.write(cutoffs(slim, labels, cfg), "cutoffs")
    counts, verdict = unused(docs, "_counts"), unused(docs, "_kept")
    out = verdicts(counted_into(docs, counts), cuts, f"{counts}.", docs["lang"], verdict)
    return only(out.where(F.col(verdict)), docs.columns)


def report(docs: DataFrame, labels: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """A row per document with counts and verdicts; documents are read once. Odd rows: as for ``kept``."""
    scratch = Scratch(docs.sparkSession, "rules")
    slim = with_counts(docs.select("doc_id", "text", stratum().alias("_stratum"))).drop("text")
    slim, _ = scratch.write(slim, "counts")
    cuts, _ = scratch.write(cutoffs(slim, labels, cfg), "cutoffs")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return verdicts(slim, cuts, "_c_", F.col("_stratum"), "_kept").select(
        "doc_id", *[F.col(f"_c_{c}").alias(c) for c in names], base_failed().alias("base_failed"), F.col("_kept").alias("kept"))
