import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from seqloom.llm import kneser_ney, language, link_trust, risk_rules, weak_quality
from seqloom.llm.common import fold

from .conftest import prose, rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


def brute_counts(text):
    t = text or ""
    w = words_of(t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(c not in SPACES for c in t), sum(c in "#*$%&|<>" for c in t), dup, len(hit))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, None) for k in range(20)] + [(3, None, 1), (None, 1, 0), (5, 0, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rule_counts(odd, labels, no_documents):
    got = risk_rules.report(odd, labels).collect()
    want = Counter()
    for i, t in rows_of(odd):
        c = brute_counts(t)
        want[i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert risk_rules.report(no_documents, labels).count() == 0
    assert risk_rules.report(odd, labels.limit(0)).where("kept = base_failed").count() == 0
    assert risk_rules.kept(odd, labels).columns == odd.columns


def test_binomial_bound_is_exact():
    for n, k, p in ((10, 0, 0.1), (50, 7, 0.2), (200, 3, 0.01)):
        plain = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(risk_rules.log_binomial_tail(k, n, p)), plain, rel_tol=1e-9)
    assert not risk_rules.certified(100, 0, 0.01, 1e-3) and risk_rules.certified(1000, 0, 0.01, 1e-3)


def test_cutoffs_are_the_lowest_certified_ones(spark):
    r = random.Random(5)
    cfg = risk_rules.RiskConfig(risk=0.25, grid=(0.05, 0.1, 0.2, 0.4))
    rows, good = [], []
    for k in range(3000):
        marks = 0 if r.random() > 0.03 else 4
        rows.append((k, prose(k % 50, 24) + " x## y" * marks + f" tail{k}", "en" if k % 3 else "de"))
        good.append((k, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(good, "doc_id long, quality int, toxic int")
    slim = risk_rules.with_counts(docs.withColumn("_stratum", risk_rules.stratum()))
    got = {x["_stratum"]: x for x in risk_rules.cutoffs(slim, labels, cfg).collect()}
    # the fixed sequence, step by step: tuning documents give the order, held-out ones of a language the end
    counts = dict(zip(risk_rules.FIELDS, risk_rules.measure([t for _, t, _ in rows])))
    names = list(risk_rules.RULES)
    shares = [[counts[num][k] / max(1, counts[den][k]) for num, den in risk_rules.RULES.values()] for k in range(len(rows))]
    sound = [k for k in range(len(rows)) if counts["n_words"][k] >= 10 and 100 * counts["n_repeat_words"][k] <= 20 * counts["n_words"][k]]
    tune = [k for k in sound if zlib.crc32(str(k).encode()) % 5 == 0]
    above = np.array([[sum(x > c for c in cfg.grid) for x in shares[k]] for k in tune])
    steps = risk_rules.lowering(above, np.zeros(len(tune)), np.ones(len(tune)), len(cfg.grid))
    level = cfg.delta / 3  # two languages and the pool
    for lang in ("en", "de"):
        held = [k for k in sound if k not in set(tune) and rows[k][2] == lang]
        cut, want = {}, {}
        for r, j in steps:
            cut[r] = cfg.grid[j]
            rejected = sum(any(shares[k][x] > c for x, c in cut.items()) for k in held)
            n = len(held)
            if sum(math.comb(n, i) * cfg.risk**i * (1 - cfg.risk) ** (n - i) for i in range(rejected + 1)) > level:
                break
            want = dict(cut)
        assert {n: got[lang][f"_cut_{n}"] for n in names} == {n: want.get(x) for x, n in enumerate(names)} and want


def test_production_parameters_reject_junk_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    quality = {}
    for x in labels.collect():
        quality[x["doc_id"]] = min(x["quality"], quality.get(x["doc_id"], 1))
    good, bad = Counter(), Counter()
    for r in risk_rules.report(docs, labels).where("not base_failed").collect():
        if r["doc_id"] in quality:
            by = good if quality[r["doc_id"]] else bad
            by[lang[r["doc_id"]], r["kept"]] += 1
            if 20 * r["n_symbols"] > r["word_chars"] and not quality[r["doc_id"]]:
                assert not r["kept"]
    for la in ("en", "de", "fr", "es"):
        assert good[la, False] <= 0.02 * (good[la, True] + good[la, False])
        assert bad[la, False] >= 0.9 * (bad[la, True] + bad[la, False])


def test_small_strata_take_the_pooled_cutoffs_unless_their_documents_refute_them(spark):
    rows, label, junk = [], [], "".join(f" x##{j}" for j in range(5))
    for k in range(700):
        la = "en" if k < 600 else "is" if k < 650 else "fo"
        rows.append((k, prose(k % 50, 24) + (junk if la == "fo" else "") + f" tail{k}", la))
        label.append((k, 1, 0))
    rows += [(1000 + k, prose(k, 24) + junk + f" tail{k}", ("en", "is", "fo", "xx", None)[k % 5]) for k in range(50)]
    label += [(1000 + k, 0, 0) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(label, "doc_id long, quality int, toxic int").where("doc_id < 600 or doc_id >= 630")
    kept = {r["doc_id"] for r in risk_rules.report(docs, labels, risk_rules.RiskConfig(risk=0.12)).where("kept").collect()}
    assert set(range(700)) <= kept
    assert {i for i in kept if i >= 1000} == {1000 + k for k in range(50) if k % 5 == 2}


def test_levels_are_shared_by_strata_that_can_pass():
    cfg = risk_rules.RiskConfig()
    assert risk_rules.tested([(500, 1), (250, 3), (10, 1000)], cfg) == (250, 0.05 / 5)
    assert risk_rules.tested([(10, 1000)], cfg) == (math.inf, 0.05)


def test_quality_classifier(spark, odd, no_documents):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in weak_quality.report(docs).collect()}
    assert len(got) == 1000
    by = defaultdict(list)
    for x in labels.collect():
        by[x["quality"]].append(got[x["doc_id"]]["kept"])
    assert sum(by[1]) >= 0.99 * len(by[1])
    assert sum(by[0]) <= 0.6 * len(by[0])
    out = weak_quality.report(odd).collect()
    assert len(out) == odd.count()
    assert all(not r["kept"] and r["score"] == 0 for r in out if r["doc_id"] in (0, 1))
    assert weak_quality.report(no_documents).count() == 0
    assert weak_quality.kept(odd).columns == odd.columns


def test_labelled_patterns_give_the_accuracies_of_the_labellers():
    import numpy as np

    r, votes = np.random.default_rng(0), len(weak_quality.LABELLERS)
    good = r.random(40_000) < 0.8
    said = np.where(r.random((len(good), votes)) < 0.4, 2, np.where(good[:, None], 0, 1))
    flip = r.random(said.shape) < np.where(good[:, None], 0.0005, 0.15)
    said = np.where((said < 2) & flip, 1 - said, said)
    pattern = (said * 3 ** np.arange(votes - 1, -1, -1)).sum(1)
    p, share, prior = weak_quality.posteriors(np.bincount(pattern, minlength=weak_quality.PATTERNS), 100)
    assert abs(prior - 0.8) < 0.02
    assert ((p[pattern] > 0.5) == good).mean() > 0.99
    assert abs(share[:, 1, 0] / share[:, 1, :2].sum(1) - 0.15).max() < 0.03


def test_language_on_held_out_documents(spark, odd, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs, fold("doc_id", 4, 2), PIECES).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    out = language.identify(odd, fold("doc_id", 4, 2), PIECES).collect()
    assert len(out) == odd.count()
    letters = {i: any(c.isalpha() for c in t or "") for i, t in rows_of(odd)}
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]])
    assert language.identify(no_documents, fold("doc_id", 4, 2), PIECES).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", odd["source"].cast("string").substr(9, 1)).where(
        "lang is null"), fold("doc_id", 4, 2), PIECES).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    vocab = language.vocabulary(PIECES)
    r = np.random.default_rng(1)
    log_p = np.log(r.dirichlet(np.ones(len(vocab[0]) + 1), 2).T)
    words = ["the", "ing", "zqñ日x", "nation", "a"]
    lattice = language.Lattice(words, vocab)
    got = lattice.totals(lattice.forward(log_p[lattice.piece]))

    def total(s, c):
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            p = vocab[0].get(s[:k], len(vocab[0]) if k == 1 else None)
            if p is not None:
                out += math.exp(log_p[p, c]) * total(s[k:], c)
        return out

    for k, w in enumerate(words):
        for c in range(2):
            assert math.isclose(math.exp(got[k, c]), total("▁" + w, c), rel_tol=1e-9)
    # every character lies in one used piece
    used = lattice.expected(log_p[lattice.piece][:, :1])
    for k, w in enumerate(words):
        mine = lattice.word == k
        assert math.isclose((used * (lattice.end - lattice.start))[mine].sum(), len(w) + 1, rel_tol=1e-9)


def brute_model(rows, held):
    texts = [[*(t or "").encode().lower().split(), "END"] for i, t in rows if not held(i)]
    uni = Counter(w for t in texts for w in t)
    two = Counter(p for t in texts for p in zip(["BEGIN", *t], t))
    cont = Counter(w for _, w in two)

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 3 * y]
        return [0, *(min(max(x, 0), k) for k, x in enumerate(d, 1))]

    high, low = discounts(two), discounts(cont)
    rest = sum(low[min(c, 3)] for c in cont.values()) / max(1, len(two))
    total, spare = Counter(), Counter()
    for (u, _), c in two.items():
        total[u] += c
        spare[u] += high[min(c, 3)]
    one = lambda w: ((cont[w] - low[min(cont[w], 3)]) / len(two) if two else 0) + (rest if two else 1) / (len(uni) + 1)
    pair = lambda u, w: (two[u, w] - high[min(two[u, w], 3)] + spare[u] * one(w)) / total[u] if total[u] else one(w)
    return uni, pair


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_kneser_ney_against_brute_force(spark, odd, which):
    import zlib

    docs = odd if which == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = rows_of(docs)
    uni, pair = brute_model(rows, held)
    n, v = sum(uni.values()), len(uni)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "END"]
        base = sum(math.log10((uni[x] + 1) / ((n + 1) * (v + 1))) for x in w)
        score = sum(math.log10(pair(u, x)) for u, x in zip(["BEGIN", *w], w))
        want[i, held(i), len(w), sum(uni[x] > 0 for x in w), n, round(base, 4), round(score, 4)] += 1
    got = kneser_ney.score(docs, fold("doc_id", 7, 2)).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == want
    assert math.isclose(sum(pair("the", w) for w in uni) + pair("the", "never seen"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_op5_base_adds_one_to_every_count(spark, odd, which, tmp_path):
    """The base of a token is ``(c+1) / (N+1*(V+1))``: one for each of the V words and one for all unknown ones."""
    import zlib

    import __spark_entry__ as entry

    docs = odd if which == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = rows_of(docs)
    uni, pair = brute_model(rows, held)
    n, v = sum(uni.values()), len(uni)
    assert math.isclose(sum((uni[x] + 1) / (n + v + 1) for x in [*uni, "never seen"]), 1)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "END"]
        base = sum(math.log10((uni[x] + 1) / (n + 1 * (v + 1))) for x in w)
        score = sum(math.log10(pair(u, x)) for u, x in zip(["BEGIN", *w], w))
        want[i, held(i), len(w), sum(uni[x] > 0 for x in w), n, round(base, 4), round(score, 4)] += 1
    got = entry.queries()["op5_kneser_ney"](spark, str(tmp_path)).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == want


def test_kneser_ney_of_an_empty_table(no_documents):
    assert kneser_ney.score(no_documents, fold("doc_id", 7, 2)).count() == 0


def test_hot_words_are_split_and_added_up(spark):
    rows = [(k, "the " + " the ".join(f"w{(k * j) % 40}" for j in range(30))) for k in range(60)]
    uni, pair = brute_model(rows, lambda i: False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    spec = kneser_ney.train(docs, F.lit(False))
    assert len(spec["hot"]) > 1
    got = {r["doc_id"]: r["score"] for r in kneser_ney.score(docs, F.lit(False), spec).collect()}
    for i, t in rows:
        w = [*t.encode().split(), "END"]
        assert math.isclose(got[i], sum(math.log10(pair(u, x)) for u, x in zip(["BEGIN", *w], w)), rel_tol=1e-6)


def test_url_parts(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://b.net", "b.net", "", None, "allow"), (3, "https://b.net/", "b.net", "/", "net/", "block"),
        (4, "no scheme", "", "", None, "allow"), (5, None, "", "", None, "allow"),
        (6, "x://u.example.com/de/a#b", "u.example.com", "/de/a", "example.com/de/", "block"),
        (7, "x://example.org/fr/", "example.org", "/fr/", "org/fr/", "allow"), (8, "x://ENT://y/z", "ent:", "//y/z", None, "allow"),
        (9, "http://xexample.com/de/", "xexample.com", "/de/", None, "allow"), (9, "http://xexample.com/de/", "xexample.com", "/de/", None, "allow"),
        (None, "http://ÄB.org?x", "Äb.org", "", None, "allow"), (10, "p://h.net\n/q", "h.net\n", "/q", None, "allow"),
    ]
    pages = spark.createDataFrame([(u[0], u[1], None, "c", 1) for u in urls], "page_id long, url string, html string, host string, rule long")
    got = Counter(tuple(r)[:5] for r in link_trust.judge(pages).collect())
    assert got == Counter((u[0], *u[2:]) for u in urls)
    assert link_trust.judge(pages.limit(0)).count() == 0


def brute_trust(pages, cfg):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = lambda u: (re.match(r"(?s).*?://([^/?#]*)", u) or ["", ""])[1].translate(low)
    links, share = Counter(), defaultdict(list)
    for _, url, html, verdict in pages:
        share[host(url)].append(verdict)
        for t in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", html or ""):
            to = host(t) if "://" in t else re.match("//([^/?#]*)", t)[1].translate(low) if t.startswith("//") else host(url)
            if to != host(url):
                links[host(url), to] += 1
    hosts = {h for h in share} | {d for _, d in links}
    out = {}
    back = Counter({(b, a): n for (a, b), n in links.items()})
    for name, kind, edges in (("t", "allow", links), ("d", "block", back), ("mt", None, links), ("md", None, back)):
        seed = {h: sum(v == kind for v in share[h]) * link_trust.UNIT // len(share[h]) if share.get(h) else 0 for h in hosts}
        if kind is None:
            seed = dict.fromkeys(hosts, link_trust.UNIT)
        total, score = Counter(), dict(seed)
        for (a, _), n in edges.items():
            total[a] += n
        for _ in range(cfg.iterations):
            got = Counter()
            for (a, b), n in edges.items():
                got[b] += score[a] * n // total[a]
            score = {h: ((100 - cfg.damping) * seed[h] + cfg.damping * got[h]) // 100 for h in hosts}
        out[name], out["linked", name] = score, {h: cfg.damping * got[h] // 100 for h in hosts}
    for h in hosts:
        most = out["linked", "md"][h]
        share_ = out["linked", "d"][h] / most if most else 0
        linked = most and 100 * share_ >= cfg.linked_share and share_ > out["t"][h] / out["mt"][h]
        guess = (out["d"][h] > out["t"][h] and out["d"][h] >= cfg.threshold) or linked
        out["verdict", h] = "block" if guess else "allow"
    return out


def by_trust_sql(pages, where=""):
    """Verdicts of hosts by the SQL form."""
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    db.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    return {r[0]: r[1:] for r in db.execute(f"SELECT host, verdict, trust, distrust FROM ({link_trust.oracle_sql()}) {where}").fetchall()}


def test_distrust_runs_against_links_and_trust_along(spark):
    link = lambda *t: "".join(f'<a HREF = "{x}">' for x in t)
    rows = [
        (1, "http://bad.net/x", link("/self"), "block"), (2, "http://farm.com/x", link("http://bad.net/1", "http://BAD.net/2"), None),
        (3, "http://friend.com/", link("//farm.com/a", "http://farm.com/b", "http://farm.com/c"), None),
        (4, "http://good.org/fr/", link("https://liked.com/a", "mailto:x@y", "#top"), "allow"), (5, "http://liked.com/", link("x/y"), None),
        (6, "http://alone.com/", None, None),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["host"]: r for r in link_trust.judge(pages).collect()}
    want = brute_trust(rows, link_trust.TrustConfig())
    for h, r in got.items():
        assert (r["trust"], r["distrust"]) == (want["t"][h], want["d"][h])
    assert {h: r["verdict"] for h, r in got.items()} == {
        "bad.net": "block", "farm.com": "block", "friend.com": "block", "good.org": "allow", "liked.com": "allow", "alone.com": "allow"}
    assert all(want["verdict", h] == r["verdict"] for h, r in got.items() if h not in ("bad.net", "good.org"))
    assert {h: (r["verdict"], r["trust"], r["distrust"]) for h, r in got.items()} == by_trust_sql([r[:3] for r in rows])


def test_hubs_do_not_overflow(spark):
    """Scores times links leave the range of a long; the scores don't."""
    from seqloom.llm.common import Scratch

    seeds = spark.createDataFrame([("good", "hub", link_trust.UNIT), ("good", "far", 0)], "kind string, host string, seed long")
    links = spark.createDataFrame([("good", "hub", "far", 3 * 10**17, 4 * 10**17)], "kind string, src string, dst string, n long, out long")
    got = {r["host"]: r["score"] for r in link_trust.spread(seeds, links, Scratch(spark, "test"), link_trust.TrustConfig()).collect()}
    assert got["far"] == 85 * (15 * link_trust.UNIT // 100 * 3 // 4) // 100


def test_random_graphs_like_the_sql(spark):
    r = random.Random(8)
    hosts = [f"{x}{k}.{tld}" for k in range(12) for x, tld in (("b", "net"), ("c", "com"), ("g", "org"))]
    rows = []
    for k in range(300):
        h = r.choice(hosts)
        rows.append((k, f"http://{h}/{r.choice(['fr/', 'de/', ''])}p", "".join(f"<a href='http://{r.choice(hosts)}/'>" for _ in range(r.randrange(5)))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["host"]: (x["verdict"], x["trust"], x["distrust"]) for x in link_trust.judge(pages).where("rule is null").collect()}
    assert len(set(got.values())) > 10 and {v for v, _, _ in got.values()} == {"allow", "block"}
    assert got == by_trust_sql(rows, "WHERE rule IS NULL")


def test_farms_of_any_size_are_blocked(spark):
    link = lambda *t: "".join(f'<a href="http://{x}/">' for x in t)
    rows, want = [], {}
    for m in (2, 10, 1000):
        bad = [f"bad{m}x{j}.net" for j in range(2)]
        rows += [(f"http://{b}/", None) for b in bad]
        rows += [(f"http://f{k}.farm{m}.com/", link(*bad)) for k in range(m)]
        want |= {f"f{k}.farm{m}.com": "block" for k in range(m)}
    # a directory that links to one blocked host among many, and a trusted host that links to a farm's target
    rows += [("http://directory.com/", link("bad2x0.net", *(f"site{k}.com" for k in range(9)))), ("http://site1.com/", None)]
    rows += [("http://seed.org/fr/", link("liked.com")), ("http://liked.com/", link("bad1000x0.net", *(f"site{k}.com" for k in range(9))))]
    want |= {"directory.com": "allow", "site1.com": "allow", "liked.com": "allow"}
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in link_trust.judge(pages).collect()}
    assert {h: got[h] for h in want} == want
