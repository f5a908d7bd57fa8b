"""The queries of the registry in SQL, over the same parquet tables."""

from __future__ import annotations

from seqloom import constants as K
from seqloom.functions.draws import twister_stream
from seqloom.operators.sparse import global_bounds, local_bounds

DOC = """docs AS (
  SELECT lang AS family, doc_id AS idx, 'doc' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS header,
         upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS seq
  FROM documents)"""
CONV = """conv AS (
  SELECT CAST(conv_id AS VARCHAR) AS family, turn AS idx, role || '_' || lpad(CAST(turn AS VARCHAR), 6, '0') AS header,
         upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS seq
  FROM conversations)"""

_S = K.square(K.BLOSUM62_LOWER)
BLOSUM = "blosum(a, b, s) AS (VALUES " + ", ".join(
    f"('{x}', '{y}', {int(_S[i][j])})" for i, x in enumerate(K.AMINO) for j, y in enumerate(K.AMINO)
) + ")"
PROPS = "props(r, bits) AS (VALUES " + ", ".join(
    f"('{chr(65 + i)}', {K.property_mask(chr(65 + i))})" for i in range(26)
) + ")"


def counted(src: str) -> str:
    """Cells, shapes, letter counts and the full column grid of a row source."""
    return f"""cells AS (
  SELECT family, idx, unnest(range(length(seq))) AS col, unnest(string_split(seq, '')) AS r FROM {src}),
shape AS (SELECT family, CAST(count(*) AS BIGINT) AS n, max(length(seq)) AS len FROM {src} GROUP BY family),
cnt AS (SELECT family, col, r, CAST(count(*) AS BIGINT) AS c FROM cells WHERE r <> '-' GROUP BY family, col, r),
grid AS (SELECT family, n, unnest(range(len)) AS col FROM shape)"""


SCORED = BLOSUM + """,
pairsum AS (
  SELECT x.family, x.col, CAST(sum(s * x.c * (y.c - CASE WHEN x.r = y.r THEN 1 ELSE 0 END)) AS BIGINT) // 2 AS v
  FROM cnt x JOIN cnt y ON x.family = y.family AND x.col = y.col JOIN blosum ON x.r = a AND y.r = b
  GROUP BY x.family, x.col),
scores AS (
  SELECT g.family, g.col, g.n, coalesce(v, 0) AS pair_sum,
         CASE WHEN g.n > 1 THEN coalesce(v, 0) / (g.n * (g.n - 1) / 2) END AS score
  FROM grid g LEFT JOIN pairsum p ON g.family = p.family AND g.col = p.col)"""


def scored(src: str) -> str:
    return counted(src) + ",\n" + SCORED


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def regions(hit: str, gain: str) -> str:
    """Islands by row-number difference and the border rule."""
    return f"""hits AS (
  SELECT family, col, col - row_number() OVER (PARTITION BY family ORDER BY col) AS g FROM scores WHERE {hit}),
runs AS (SELECT family, min(col) AS f, max(col) AS l FROM hits GROUP BY family, g),
bounds AS (
  SELECT runs.family, f + 1 AS a, CASE WHEN l = len - 1 THEN l ELSE l + 1 END AS b
  FROM runs JOIN shape ON runs.family = shape.family WHERE l - f + 1 >= 3),
regions AS (SELECT family, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM bounds WHERE b - a > {gain})"""


LOW = "score BETWEEN 0.0 AND 1.2"
SEGMENTS = """nb AS (
  SELECT family, a, b, lag(b) OVER (PARTITION BY family ORDER BY a) AS pb, lead(a) OVER (PARTITION BY family ORDER BY a) AS na
  FROM regions),
segs AS (
  SELECT * FROM (
    SELECT family, a - 1 AS s, b - 1 AS e, 'unreliable' AS kind FROM nb
    UNION ALL SELECT family, coalesce(pb, 0), a - 2, 'reliable' FROM nb
    UNION ALL SELECT nb.family, b, len - 1, 'reliable' FROM nb JOIN shape ON nb.family = shape.family WHERE na IS NULL
    UNION ALL SELECT family, 0, len - 1, 'reliable' FROM shape WHERE family NOT IN (SELECT family FROM regions))
  WHERE s <= e)"""
FRAGS = """frags AS (
  SELECT segs.family, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, kind, header, idx,
         substr(rpad(seq, CAST(len AS INTEGER), '-'), CAST(s + 1 AS INTEGER), CAST(e - s + 1 AS INTEGER)) AS frag
  FROM segs JOIN conv ON segs.family = conv.family JOIN shape ON segs.family = shape.family)"""
CONV_SEG = (CONV, scored("conv"), regions(LOW, "10"), SEGMENTS)

WORDS = """words AS (
  SELECT CAST(conv_id AS VARCHAR) AS family, CAST(turn AS BIGINT) AS x,
         regexp_extract_all(lower(text), '\\p{L}+') AS ws
  FROM conversations),
tok AS (SELECT family, x, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM words),
m AS (
  SELECT l.family, l.x AS a, r.x AS b, l.p AS i, r.p AS j, 1.0::DOUBLE / (1 + abs(l.p - r.p)) AS p
  FROM tok l JOIN tok r ON l.family = r.family AND l.w = r.w AND l.x < r.x),
lens AS (SELECT family, x, len(ws) AS n FROM words),
dist AS (
  SELECT u.family, u.x AS a, v.x AS b, 1.0::DOUBLE - coalesce(k, 0)::DOUBLE / greatest(u.n * v.n, 1) AS d
  FROM lens u JOIN lens v ON u.family = v.family AND u.x < v.x
  LEFT JOIN (SELECT family, a, b, count(*) AS k FROM m GROUP BY family, a, b) h
    ON h.family = u.family AND h.a = u.x AND h.b = v.x)"""


def symbol_case() -> str:
    groups = [(":", g) for g in K.STRONG_GROUPS] + [(".", g) for g in K.WEAK_GROUPS]
    inside = lambda g: "coalesce(sum(c) FILTER (r IN (" + ", ".join(f"'{ch}'" for ch in g) + ")), 0) = coalesce(sum(c), 0)"
    cases = " ".join(f"WHEN {inside(g)} THEN '{mark}'" for mark, g in groups)
    return f"CASE WHEN sum(c) = 1 THEN ' ' WHEN coalesce(max(c), 0) = coalesce(sum(c), 0) THEN '*' {cases} ELSE ' ' END"


def symbols(src: str) -> str:
    return counted(src) + f""",
symbols AS (
  SELECT g.family, g.col, {symbol_case()} AS symbol
  FROM grid g LEFT JOIN cnt ON g.family = cnt.family AND g.col = cnt.col GROUP BY g.family, g.col)"""


PROPERTY = PROPS + """,
prop AS (
  SELECT g.family, g.col, max(g.n) AS n, coalesce(bit_and(bits), 1023) AS common, coalesce(bit_or(bits), 0) AS present,
         coalesce(sum(c), 0) AS total
  FROM grid g LEFT JOIN cnt ON g.family = cnt.family AND g.col = cnt.col LEFT JOIN props ON props.r = cnt.r
  GROUP BY g.family, g.col),
pscore AS (SELECT *, (bit_count(common) + 10 - bit_count(present)) / 10.0::DOUBLE AS property_score FROM prop)"""
_TERM = "(({c}) / (total + 10)) * log2(({c}) / (total + 10))"
_AMINO_LIST = ", ".join(f"'{ch}'" for ch in K.AMINO)
# letters that a column lacks all add the same term, so only those it has are listed
ENTROPY = PROPERTY + f""",
ent AS (
  SELECT p.family, p.col,
         -(coalesce(sum({_TERM.format(c="c + 0.5::DOUBLE")}), 0) + (20 - count(c)) * {_TERM.format(c="0.5::DOUBLE")}) / log2(20.0::DOUBLE) AS entropy
  FROM pscore p LEFT JOIN (SELECT * FROM cnt WHERE r IN ({_AMINO_LIST})) k ON k.family = p.family AND k.col = p.col
  GROUP BY p.family, p.col, total),
full_entropy AS (
  SELECT p.family, p.col, entropy, (n - total) / n::DOUBLE AS gap_score,
         (1.0::DOUBLE - entropy) * property_score * (1.0::DOUBLE - (n - total) / n::DOUBLE) AS score
  FROM pscore p JOIN ent ON ent.family = p.family AND ent.col = p.col)"""

PADDED = """plen AS (SELECT family, max(length(seq)) AS len, count(*) AS n FROM conv GROUP BY family),
pad AS (SELECT conv.family, idx, header, rpad(seq, CAST(len AS INTEGER), '-') AS seq, len, n FROM conv JOIN plen ON conv.family = plen.family)"""

FASTA = """pieces AS (
  SELECT family, idx, '>' || header || chr(10) || regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g')
         || CASE WHEN length(seq) % 60 = 0 THEN '' ELSE chr(10) END AS t
  FROM conv),
fasta AS (SELECT family, string_agg(t, '' ORDER BY idx) AS text FROM pieces GROUP BY family)"""

VEC = """vec AS (
  SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS dims,
         unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""


def first_bucket(bounds: list[float]) -> str:
    arms = " ".join(f"WHEN p > {b!r}::DOUBLE THEN {k}" for k, b in enumerate(bounds))
    return f"CASE {arms} ELSE {len(bounds)} END"


def bound_of(bounds: list[float]) -> str:
    arms = " ".join(f"WHEN {k} THEN {b!r}::DOUBLE" for k, b in enumerate(bounds))
    return f"CASE hit {arms} ELSE 0.0::DOUBLE END"


def retained(keys: str, bounds: list[float]) -> str:
    return f"""bk AS (SELECT {keys}, {first_bucket(bounds)} AS k, count(*) AS n FROM m GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY k) AS run, floor(sum(n) OVER (PARTITION BY {keys}) * 0.3::DOUBLE) AS keep FROM bk),
cutoffs AS (SELECT {keys}, min(k) FILTER (run > keep) AS hit, CAST(max(keep) AS BIGINT) AS retain FROM cum GROUP BY ALL)"""


def longest_rows(most: int, fraction: float, dense: bool) -> str:
    """Cutoffs with the rule of the longest row, step by step from the bound of the fraction up."""
    bounds = local_bounds(0.01)
    of = "max(u.n * v.n)" if dense else "count(*)"
    values = ", ".join(f"({k}, {b!r}::DOUBLE)" for k, b in enumerate(bounds))
    return f"""bounds(k, c) AS (VALUES {values}),
sizes AS (
  SELECT m.family, a, b, count(*) AS cells, CAST(floor({of} * {fraction!r}::DOUBLE) AS BIGINT) AS retain
  FROM m JOIN lens u ON m.family = u.family AND m.a = u.x JOIN lens v ON m.family = v.family AND m.b = v.x GROUP BY m.family, a, b),
per_bound AS (
  SELECT s.family, s.a, s.b, k, c, any_value(cells) AS cells, any_value(retain) AS retain, count(*) FILTER (m.p > c) AS above
  FROM sizes s JOIN m USING (family, a, b), bounds GROUP BY s.family, s.a, s.b, k, c),
per_row AS (
  SELECT family, a, b, k, max(n) AS longest FROM (
    SELECT m.family, a, b, i, k, count(*) FILTER (p >= c) AS n FROM m, bounds GROUP BY m.family, a, b, i, k) GROUP BY family, a, b, k),
whole_row AS (SELECT family, a, b, max(n) AS longest FROM (SELECT family, a, b, i, count(*) AS n FROM m GROUP BY family, a, b, i) GROUP BY family, a, b),
starts AS (
  SELECT family, a, b, any_value(retain) AS retain, any_value(cells) < any_value(retain) AS few,
         CASE WHEN any_value(cells) < any_value(retain) THEN {len(bounds) - 2}
              ELSE coalesce(min(k) FILTER (above > retain), CASE WHEN any_value(cells) > any_value(retain) THEN {len(bounds)} ELSE 0 END) END AS k0
  FROM per_bound GROUP BY family, a, b),
fitting AS (
  SELECT s.family, s.a, s.b, any_value(retain) AS retain, bool_or(few) AS few, any_value(w.longest) AS longest, any_value(k0) AS k0,
         max(r.k) FILTER (r.k <= k0 AND r.longest <= {most}) AS k, max(w.longest) <= {most} AS all_fit
  FROM starts s JOIN whole_row w USING (family, a, b) JOIN per_row r USING (family, a, b) GROUP BY s.family, s.a, s.b),
cutoffs AS (
  SELECT f.family, f.a, f.b, retain, CASE WHEN few AND longest < {most} THEN NULL WHEN k0 = {len(bounds)} AND all_fit THEN 0.0::DOUBLE ELSE c END AS cutoff
  FROM fitting f JOIN bounds ON bounds.k = coalesce(f.k, 0))"""


def bucket_count(fraction: float) -> str:
    return f"""keeps AS (
  SELECT m.family, a, b, count(*) AS cells, CAST(floor((max(u.n * v.n) - min(least(u.n, v.n))) * {fraction!r}::DOUBLE) + min(least(u.n, v.n)) AS BIGINT) AS keep
  FROM m JOIN lens u ON m.family = u.family AND m.a = u.x JOIN lens v ON m.family = v.family AND m.b = v.x GROUP BY m.family, a, b),
borders AS (SELECT k, pow(2.0::DOUBLE, -k) AS c FROM unnest(range(64)) t(k)),
counted AS (
  SELECT n.family, n.a, n.b, c, count(*) FILTER (p >= c) AS above, any_value(keep) AS keep, any_value(cells) AS cells
  FROM keeps n JOIN m USING (family, a, b), borders GROUP BY n.family, n.a, n.b, c),
-- of borders with the same cells above them the highest stands behind a bucket that has cells
cutoffs AS (
  SELECT family, a, b, CASE WHEN any_value(cells) <= any_value(keep) THEN 0.0::DOUBLE
    ELSE coalesce(min(c) FILTER (above > 0 AND above <= keep), 0.0::DOUBLE) END AS cutoff FROM counted GROUP BY family, a, b)"""


STRATEGY = """stats AS (
  SELECT family, max(n) AS n, count(*) AS len, sum(pair_sum)::DOUBLE / count(*) / (max(n) * (max(n) - 1) / 2) AS un_sp
  FROM scores GROUP BY family),
classes AS (
  SELECT family, CASE WHEN un_sp >= 2.0 THEN 0 ELSE 1 END AS strategy,
         CASE WHEN len < 100 THEN 0 WHEN len < 300 THEN 1 WHEN len < 1000 THEN 2 ELSE 3 END AS length_class
  FROM stats)"""

LINKAGE = {
    "upgma": "sum(na * nb * d) / sum(na * nb)",
    "wpgma": "avg(d)",
    "single": "min(d)",
}


def tree(linkage: str, dist: str = "dist") -> str:
    """The tree of every family, one merge after another.

    Each step finds the nearest pair of a family by ``(distance, larger label,
    smaller label)``; the cluster keeps the larger label.
    """
    left, right = ("lo", "hi") if linkage == "single" else ("hi", "lo")
    return f"""steps AS (
  WITH RECURSIVE st(family, a, b, d, na, nb, ha, hb, la, lb, rnd) AS (
    SELECT family, a, b, d::DOUBLE, 1::BIGINT, 1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0, 1 FROM {dist}
    UNION ALL
    SELECT family, least(x, y), greatest(x, y), round({LINKAGE[linkage]}, 12),
           any_value(CASE WHEN x < y THEN nx ELSE ny END), any_value(CASE WHEN x < y THEN ny ELSE nx END),
           any_value(CASE WHEN x < y THEN hx ELSE hy END), any_value(CASE WHEN x < y THEN hy ELSE hx END),
           any_value(CASE WHEN x < y THEN lx ELSE ly END), any_value(CASE WHEN x < y THEN ly ELSE lx END), max(rnd) + 1
    FROM (
      SELECT *, CASE WHEN a IN (m.a, m.b) THEN m.b ELSE a END AS x, CASE WHEN b IN (m.a, m.b) THEN m.b ELSE b END AS y,
             CASE WHEN a IN (m.a, m.b) THEN m.na + m.nb ELSE na END AS nx, CASE WHEN b IN (m.a, m.b) THEN m.na + m.nb ELSE nb END AS ny,
             CASE WHEN a IN (m.a, m.b) THEN greatest(m.d, m.ha, m.hb) ELSE ha END AS hx,
             CASE WHEN b IN (m.a, m.b) THEN greatest(m.d, m.ha, m.hb) ELSE hb END AS hy,
             CASE WHEN a IN (m.a, m.b) THEN greatest(m.la, m.lb) + 1 ELSE la END AS lx,
             CASE WHEN b IN (m.a, m.b) THEN greatest(m.la, m.lb) + 1 ELSE lb END AS ly
      FROM (SELECT *, first(struct_pack(a := a, b := b, d := d, na := na, nb := nb, ha := ha, hb := hb, la := la, lb := lb))
                      OVER (PARTITION BY family ORDER BY d, b, a) AS m FROM st))
    WHERE x <> y GROUP BY family, least(x, y), greatest(x, y))
  SELECT * FROM st),
merges AS (
  SELECT family, b AS hi, a AS lo, nb AS n_hi, na AS n_lo, na + nb AS leaves, greatest(d, ha, hb) AS height, greatest(la, lb) + 1 AS level
  FROM steps QUALIFY row_number() OVER (PARTITION BY family, rnd ORDER BY d, b, a) = 1),
firsts AS (SELECT family, max(b) + 1 AS f FROM {dist} GROUP BY family),
inner_nodes AS (
  SELECT m.*, f + row_number() OVER (PARTITION BY m.family ORDER BY height, level, hi, lo) - 1 AS node FROM merges m JOIN firsts USING (family)),
linked AS (
  SELECT m.family, m.node, m.leaves, m.height, m.level, coalesce(h.node, m.hi) AS hi_node, coalesce(l.node, m.lo) AS lo_node
  FROM inner_nodes m LEFT JOIN inner_nodes h ON h.family = m.family AND h.hi = m.hi AND h.leaves = m.n_hi
  LEFT JOIN inner_nodes l ON l.family = m.family AND l.hi = m.lo AND l.leaves = m.n_lo),
every_node AS (
  SELECT family, node, {left}_node AS "left", {right}_node AS "right", leaves, height, level FROM linked
  UNION ALL SELECT family, x, NULL, NULL, 1, 0.0::DOUBLE, 0 FROM lens),
nodes AS (
  SELECT n.family, n.node, n."left", n."right", p.node AS parent, coalesce(p.height * 0.5::DOUBLE, 0) AS dist, n.leaves, n.height, n.level
  FROM every_node n LEFT JOIN every_node p ON p.family = n.family AND n.node IN (p."left", p."right"))"""


NODES = """SELECT family, node, "left", "right", parent, round(dist, 9) AS dist, leaves, round(height, 9) AS height, level FROM nodes"""
MEMBERS = """members AS (
  WITH RECURSIVE up(family, leaf, below, node, ups) AS (
    SELECT family, node, node, parent, 1 FROM nodes WHERE level = 0 AND parent IS NOT NULL
    UNION ALL SELECT up.family, up.leaf, up.node, n.parent, ups + 1 FROM up JOIN nodes n ON n.family = up.family AND n.node = up.node
    WHERE n.parent IS NOT NULL)
  SELECT up.family, up.leaf, up.node, ups, n.leaves, n.level, CASE WHEN below = n."left" THEN 'L' ELSE 'R' END AS side
  FROM up JOIN nodes n ON n.family = up.family AND n.node = up.node)"""
TREE_WEIGHTS = """raw_weights AS (
  SELECT family, leaf, sum(w) AS w FROM (
    SELECT family, node AS leaf, CASE WHEN parent IS NULL THEN 0 ELSE dist / leaves END AS w FROM nodes WHERE level = 0
    UNION ALL SELECT m.family, m.leaf, CASE WHEN n.parent IS NULL THEN 0 ELSE n.dist / n.leaves END
    FROM members m JOIN nodes n ON n.family = m.family AND n.node = m.node) GROUP BY family, leaf),
weights AS (
  SELECT family, leaf, w, CASE WHEN sum(w) OVER f = 0 THEN 1.0::DOUBLE / count(*) OVER f ELSE w / sum(w) OVER f END AS weight
  FROM raw_weights WINDOW f AS (PARTITION BY family))"""
LEAF_PAIRS = """met AS (
  SELECT x.family, least(x.leaf, y.leaf) AS a, greatest(x.leaf, y.leaf) AS b, x.node, x.leaves AS subtree, x.level, x.ups + y.ups AS branches
  FROM members x JOIN members y ON x.family = y.family AND x.node = y.node AND x.side = 'L' AND y.side = 'R')"""
# a leaf comes behind all leaves left of it: those of the left children of the nodes that have it on the right
PLACES = """places AS (
  SELECT m.family, m.leaf, CAST(sum(CASE WHEN m.side = 'R' THEN l.leaves ELSE 0 END) AS BIGINT) AS place, count(*) AS depth
  FROM members m JOIN nodes n ON n.family = m.family AND n.node = m.node JOIN nodes l ON l.family = n.family AND l.node = n."left"
  GROUP BY m.family, m.leaf UNION ALL SELECT family, node, 0, 0 FROM nodes WHERE level = 0 AND parent IS NULL)"""
CHAIN = """turns AS (
  SELECT family, x, n, row_number() OVER (PARTITION BY family ORDER BY substr(md5(CAST(x AS VARCHAR)), 1, 13), x) - 1 AS q,
         count(*) OVER (PARTITION BY family) AS k FROM lens),
chain AS (
  SELECT u.family, least(u.x, v.x) AS a, greatest(u.x, v.x) AS b,
         1.0::DOUBLE / (u.k * u.k // 2) * (v.q * (v.q - 1) / 2 + u.q + 1) AS d
  FROM turns u JOIN turns v ON u.family = v.family AND u.q < v.q)"""

THIRD = """sel AS (SELECT family, a, b, subtree AS d FROM met UNION ALL SELECT family, b, a, subtree FROM met),
ok AS (
  SELECT m.family, m.a, m.b, x.b AS z FROM met m JOIN sel x ON x.family = m.family AND x.a = m.a
  JOIN sel y ON y.family = m.family AND y.a = m.b AND y.b = x.b WHERE greatest(x.d, y.d) <= 200),
own AS (
  SELECT m.family, m.a, m.b, (1 + 2.0::DOUBLE * (SELECT count(*) FROM ok WHERE ok.family = m.family AND ok.a = m.a AND ok.b = m.b) / 200.0::DOUBLE)
         * (u.weight + v.weight) AS w
  FROM met m JOIN weights u ON u.family = m.family AND u.leaf = m.a JOIN weights v ON v.family = m.family AND v.leaf = m.b),
third AS (
  SELECT o.family, o.a, o.b, w.leaf AS z, CASE WHEN k.z IS NULL THEN 0 ELSE w.weight / o.w END AS zw,
         1 + sum(CASE WHEN k.z IS NULL THEN 0 ELSE w.weight / o.w END) OVER (PARTITION BY o.family, o.a, o.b) AS sum_w
  FROM own o JOIN weights w ON w.family = o.family LEFT JOIN ok k ON k.family = o.family AND k.a = o.a AND k.b = o.b AND k.z = w.leaf)"""


def third_by_chance(name: str, s: float = 0.4) -> str:
    """Third sequences accepted by random numbers, for families of at most 64 sequences."""
    level = {
        "lowpass": f"{(2 * s) ** 0.5!r}::DOUBLE - x", "highpass": f"x + {(2 * s) ** 0.5 - 1!r}::DOUBLE",
        "midpass": f"least({4 * s!r}::DOUBLE * x, {4 * s!r}::DOUBLE - {4 * s!r}::DOUBLE * x)", "homograph": f"(1 - x) / ({s!r}::DOUBLE * x + 1)",
    }[name]
    scale = {"lowpass": -1.0, "highpass": 1.0, "midpass": 4 * s, "homograph": 1.0}[name]
    seeds = [g % K.LCG_MODULUS for g in twister_stream(64 * 64) if g // K.LCG_MODULUS < (2**32 - 1) // K.LCG_MODULUS]
    powers = [pow(K.LCG_MULTIPLIER, k, K.LCG_MODULUS) for k in range(1, 65)]
    listed = lambda xs: "[" + ", ".join(map(str, xs)) + "]"
    return f"""drawn AS (SELECT {listed(seeds)} AS seeds, {listed(powers)} AS powers),
near AS (SELECT family, a, b, d FROM dist UNION ALL SELECT family, b, a, d FROM dist),
tries AS (
  SELECT m.family, m.a, m.b, x.b AS z, greatest(x.d, y.d) AS x, row_number() OVER (PARTITION BY m.family, m.a, m.b ORDER BY x.b) AS k, sz.n
  FROM dist m JOIN near x ON x.family = m.family AND x.a = m.a AND x.b <> m.b JOIN near y ON y.family = m.family AND y.a = m.b AND y.b = x.b
  JOIN (SELECT family, count(*) AS n FROM weights GROUP BY family) sz ON sz.family = m.family),
ok AS (SELECT family, a, b, z FROM tries, drawn WHERE CAST(seeds[a * n + b + 1] AS BIGINT) * powers[k] % {K.LCG_MODULUS} * {K.LCG_INVERSE!r}::DOUBLE < {level}),
own AS (
  SELECT m.family, m.a, m.b, (1 + 2.0::DOUBLE * (SELECT count(*) FROM ok WHERE ok.family = m.family AND ok.a = m.a AND ok.b = m.b) / {scale!r}::DOUBLE)
         * (u.weight + v.weight) AS w
  FROM dist m JOIN weights u ON u.family = m.family AND u.leaf = m.a JOIN weights v ON v.family = m.family AND v.leaf = m.b),
third AS (
  SELECT o.family, o.a, o.b, w.leaf AS z, CASE WHEN k.z IS NULL THEN 0 ELSE w.weight / o.w END AS zw,
         1 + sum(CASE WHEN k.z IS NULL THEN 0 ELSE w.weight / o.w END) OVER (PARTITION BY o.family, o.a, o.b) AS sum_w
  FROM own o JOIN weights w ON w.family = o.family LEFT JOIN ok k ON k.family = o.family AND k.a = o.a AND k.b = o.b AND k.z = w.leaf)"""


def relaxed(source: str, out: str, cutoff: float) -> str:
    """One consistency pass over single-precision cells."""
    return f"""both_{out} AS (SELECT family, a, b, i, j, p FROM {source} UNION ALL SELECT family, b, a, j, i, p FROM {source}),
through_{out} AS (
  SELECT x.family, x.a, y.b, x.i, y.j, sum(t.zw * x.p::DOUBLE * y.p::DOUBLE) AS v
  FROM both_{out} x JOIN both_{out} y ON x.family = y.family AND x.b = y.a AND x.j = y.i
  JOIN third t ON t.family = x.family AND t.a = x.a AND t.b = y.b AND t.z = x.b WHERE x.a < y.b GROUP BY ALL),
{out} AS (
  SELECT * FROM (
    SELECT m.family, m.a, m.b, m.i, m.j, CAST((m.p::DOUBLE + coalesce(v, 0)) / s.sum_w AS FLOAT) AS p
    FROM {source} m JOIN (SELECT DISTINCT family, a, b, sum_w FROM third) s ON s.family = m.family AND s.a = m.a AND s.b = m.b
    LEFT JOIN through_{out} r ON m.family = r.family AND m.a = r.a AND m.b = r.b AND m.i = r.i AND m.j = r.j)
  WHERE p >= {cutoff!r}::DOUBLE)"""


LINE_KEY = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey"

ORACLES = {
    "col_sum_of_pairs": with_(DOC, scored("docs"), body="SELECT family, col, n, pair_sum, round(score, 9) AS score FROM scores"),
    "col_score_stats": with_(DOC, scored("docs"), body="""
SELECT family, max(n) AS n, count(*) AS len, round(avg(score), 6) AS un_sp, round(stddev_pop(score), 6) AS sd,
       round(avg(CASE WHEN score >= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS peak
FROM scores GROUP BY family"""),
    "avg_col_score": with_(CONV, scored("conv"), body="""
SELECT family, max(n) AS n, count(*) AS len,
       round(CASE WHEN max(n) > 1 THEN sum(pair_sum)::DOUBLE / count(*) / (max(n) * (max(n) - 1) / 2) ELSE -1.0 END, 9) AS avg_score
FROM scores GROUP BY family"""),
    "unreliable_family": with_(CONV, scored("conv"), body="""
SELECT family, round(avg(CASE WHEN score <= 0.0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS low_share,
       avg(CASE WHEN score <= 0.0 THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.8 AS unreliable
FROM scores GROUP BY family"""),
    "col_gap_count": with_(DOC, counted("docs"), body="""
SELECT g.family, g.col, g.n, CAST(g.n - coalesce(sum(c), 0) AS BIGINT) AS gaps
FROM grid g LEFT JOIN cnt ON g.family = cnt.family AND g.col = cnt.col GROUP BY g.family, g.col, g.n"""),
    "inner_gap_count": with_(CONV, counted("conv"), """
span AS (SELECT family, idx, min(col) AS f, max(col) AS l FROM cells WHERE r <> '-' GROUP BY family, idx),
inner_gaps AS (
  SELECT c.family, c.col, count(*) AS gaps FROM cells c JOIN span s ON c.family = s.family AND c.idx = s.idx
  WHERE c.r = '-' AND c.col BETWEEN s.f AND s.l GROUP BY c.family, c.col)""", body="""
SELECT g.family, g.col, g.n, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps
FROM grid g LEFT JOIN inner_gaps i ON g.family = i.family AND g.col = i.col"""),
    "conservation_symbol": with_(DOC, symbols("docs"), body="SELECT family, col, symbol FROM symbols"),
    "property_consensus": with_(DOC, counted("docs"), PROPERTY, body="""
SELECT family, col, CAST(common AS BIGINT) AS common, CAST(present AS BIGINT) AS present, property_score FROM pscore"""),
    "col_entropy": with_(DOC, counted("docs"), ENTROPY, body="""
SELECT family, col, round(entropy, 6) AS entropy, round(gap_score, 6) AS gap_score, round(score, 6) AS score FROM full_entropy"""),
    "alignment_entropy": with_(CONV, counted("conv"), ENTROPY, body="""
SELECT family, round(sum(score), 5) AS entropy_score FROM full_entropy GROUP BY family"""),
    "column_rank_by_gaps": with_(DOC, counted("docs"), """
gaps AS (
  SELECT g.family, g.col, g.n, CAST(g.n - coalesce(sum(c), 0) AS BIGINT) AS gaps
  FROM grid g LEFT JOIN cnt ON g.family = cnt.family AND g.col = cnt.col GROUP BY g.family, g.col, g.n)""", body="""
SELECT family, col, gaps, row_number() OVER (PARTITION BY family ORDER BY abs(n / 2 - gaps) DESC, col) - 1 AS rank
FROM gaps WHERE gaps > 0"""),
    "column_rank_by_score": with_(DOC, scored("docs"), body="""
SELECT family, col, row_number() OVER (PARTITION BY family ORDER BY score, col) - 1 AS rank FROM scores"""),
    "residue_column_map": with_(CONV, counted("conv"), body="""
SELECT family, idx, row_number() OVER (PARTITION BY family, idx ORDER BY col) AS pos, col + 1 AS col FROM cells WHERE r <> '-'"""),
    "drop_allgap_columns": with_(CONV, """
kept AS (SELECT * FROM conv WHERE header LIKE 'assistant%')""", counted("kept"), body="""
SELECT k.family, k.idx, string_agg(coalesce(nullif(substr(k.seq, CAST(u.col + 1 AS INTEGER), 1), ''), '-'), '' ORDER BY u.col) AS seq
FROM kept k JOIN (SELECT DISTINCT family, col FROM cnt) u ON k.family = u.family GROUP BY k.family, k.idx"""),
    "header_dedup": """
SELECT CAST(conv_id AS VARCHAR) AS family, role AS header, max(turn) AS idx,
       upper(regexp_replace(arg_max(text, turn), '[^A-Za-z]', '-', 'g')) AS seq
FROM conversations GROUP BY conv_id, role""",
    "highlight": with_(CONV, scored("conv"), body="""
SELECT c.family, c.idx, string_agg(CASE WHEN score >= 0.5 THEN upper(r) ELSE lower(r) END, '' ORDER BY c.col) AS seq
FROM cells c JOIN scores s ON c.family = s.family AND c.col = s.col GROUP BY c.family, c.idx"""),
    "unreliable_regions": with_(DOC, scored("docs"), regions(LOW, "1"), body="SELECT * FROM regions"),
    "unreliable_regions_long": with_(CONV, scored("conv"), regions(LOW, "10"), body="SELECT * FROM regions"),
    "reliable_regions": with_(CONV, scored("conv"), regions("score > 2.0", "2"), body="SELECT * FROM regions"),
    "reliable_regions_loose": with_(CONV, scored("conv"), regions("score > 0.5", "2"), body="SELECT * FROM regions"),
    "segment_partition": with_(*CONV_SEG, body="SELECT family, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, kind FROM segs"),
    "segment_cut": with_(*CONV_SEG, FRAGS, body="SELECT family, s, e, kind, header, frag FROM frags"),
    "segment_recombine": with_(CONV, PADDED, body="SELECT family, header, seq FROM pad"),
    "segment_replace": with_(*CONV_SEG, FRAGS, body="""
SELECT family, header, string_agg(CASE WHEN kind = 'unreliable' THEN reverse(frag) ELSE frag END, '' ORDER BY s) AS seq
FROM frags GROUP BY family, header, idx"""),
    "empty_row_restore": with_(*CONV_SEG, FRAGS, body="""
SELECT family, s, e, header, frag FROM frags f
WHERE EXISTS (SELECT 1 FROM frags g WHERE g.family = f.family AND g.s = f.s AND g.e = f.e AND regexp_matches(g.frag, '[A-Z]'))"""),
    "segment_choice": """
SELECT o.family, coalesce(o.v > n.v, true) AS use_original
FROM (SELECT l_orderkey AS family, avg(l_quantity) AS v FROM lineitem GROUP BY 1) o
LEFT JOIN (SELECT l_orderkey AS family, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) n ON o.family = n.family""",
    "count_fallback": """
SELECT l_orderkey AS family, concat_ws('-', l_linenumber, l_suppkey, l_partkey) AS header,
       CASE WHEN bool_and(l_returnflag <> 'R') OVER (PARTITION BY l_orderkey) THEN lower(l_linestatus) ELSE l_linestatus END AS frag
FROM lineitem""",
    "degap": with_(DOC, body="SELECT idx, length(replace(seq, '-', '')) AS len, md5(replace(seq, '-', '')) AS digest FROM docs"),
    "normalise": """
SELECT doc_id, regexp_full_match(text, '[A-Za-z.]*') AS valid,
       md5(translate(text, '.abcdefghijklmnopqrstuvwxyz', '-ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest
FROM documents""",
    "slice_and_reverse": with_(DOC, body="SELECT idx, substr(seq, 3, 10) AS part, md5(reverse(seq)) AS digest FROM docs"),
    "encode_residues": with_(DOC, counted("docs"), body=f"""
SELECT family, r AS residue, CAST(ascii(r) - 65 AS BIGINT) AS code, CAST(instr('{K.AMINO}', r) - 1 AS BIGINT) AS pos, CAST(sum(c) AS BIGINT) AS n
FROM cnt GROUP BY family, r"""),
    "header_names": "SELECT doc_id, regexp_extract(text, '^\\s*(\\S*)', 1) AS name FROM documents",
    "length_stats": with_(DOC, body="""
SELECT family, count(*) AS n, min(length(replace(seq, '-', ''))) AS min_len, max(length(replace(seq, '-', ''))) AS max_len,
       round(avg(length(replace(seq, '-', ''))), 6) AS mean_len
FROM docs GROUP BY family"""),
    "length_order": with_(DOC, body="""
SELECT family, idx, length(replace(seq, '-', '')) AS len,
       row_number() OVER (PARTITION BY family ORDER BY length(replace(seq, '-', '')), idx) - 1 AS rank
FROM docs"""),
    "pair_self_join": with_(CONV, """
seqs AS (SELECT family, idx, length(replace(seq, '-', '')) AS len FROM conv WHERE length(replace(seq, '-', '')) > 0)""", body="""
SELECT x.family, x.idx AS a, y.idx AS b, x.len AS len_a, y.len AS len_b
FROM seqs x JOIN seqs y ON x.family = y.family AND x.idx < y.idx"""),
    "fasta_render": with_(CONV, FASTA, body="SELECT family, text FROM fasta"),
    "fasta_one_line": with_(CONV, body="""
SELECT family, string_agg('>' || header || chr(10) || seq || chr(10), '' ORDER BY header) AS text FROM conv GROUP BY family"""),
    "fasta_hash": with_(CONV, FASTA, body="SELECT family, md5(text) AS digest FROM fasta"),
    "fasta_parse": with_(CONV, body="SELECT family, idx, header, seq FROM conv"),
    "fasta_strict": with_(CONV, body="SELECT family, idx, header, replace(seq, '-', '') AS seq FROM conv"),
    "fasta_unwrap": with_(CONV, body="""
SELECT family, string_agg('>' || header || chr(10) || seq || chr(10), '' ORDER BY idx) AS text FROM conv GROUP BY family"""),
    "phylip_render": with_(CONV, PADDED, """
blk AS (SELECT family, idx, header, seq, n, len, unnest(range((len + 49) // 50)) AS b FROM pad),
lin AS (
  SELECT family, n, len, b, idx, CASE WHEN b = 0 THEN rpad(substr(header, 1, 10), 10, ' ') ELSE '          ' END
         || regexp_replace(substr(seq, CAST(b * 50 + 1 AS INTEGER), 50), '(.{1,10})', ' \\1', 'g') || chr(10) AS t
  FROM blk),
per AS (SELECT family, n, len, b, string_agg(t, '' ORDER BY idx) || chr(10) AS t FROM lin GROUP BY family, n, len, b)""", body="""
SELECT family, CAST(n AS VARCHAR) || chr(10) || CAST(len AS VARCHAR) || chr(10) || string_agg(t, '' ORDER BY b) AS text
FROM per GROUP BY family, n, len"""),
    "clustal_render": with_(CONV, PADDED, symbols("pad"), """
wid AS (SELECT family, max(length(header)) + 4 AS w FROM conv GROUP BY family),
blk AS (SELECT family, idx, header, seq, unnest(range((len + 59) // 60)) AS b FROM pad),
lin AS (
  SELECT blk.family, b, string_agg(rpad(header, CAST(w AS INTEGER), ' ') || substr(seq, CAST(b * 60 + 1 AS INTEGER), 60) || chr(10), '' ORDER BY idx) AS t
  FROM blk JOIN wid ON blk.family = wid.family GROUP BY blk.family, b),
mk AS (SELECT family, col // 60 AS b, string_agg(symbol, '' ORDER BY col) AS t FROM symbols GROUP BY family, b)""", body="""
SELECT lin.family, 'CLUSTAL multiple sequence alignment' || chr(10)
       || string_agg(chr(10) || lin.t || repeat(' ', w) || mk.t || chr(10), '' ORDER BY lin.b) AS text
FROM lin JOIN mk ON lin.family = mk.family AND lin.b = mk.b JOIN wid ON wid.family = lin.family GROUP BY lin.family"""),
    "block_parse": with_(CONV, PADDED, body="SELECT family, idx, header, seq FROM pad"),
    "family_files": """
SELECT role AS bench, CAST(conv_id AS VARCHAR) AS family, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) - 1 AS idx,
       role || '_' || lpad(CAST(turn AS VARCHAR), 6, '0') AS header, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS seq FROM conversations""",
    "family_files_of_a_bench": """
SELECT CAST(conv_id AS VARCHAR) AS family, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS letters
FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "clustal_files": with_(CONV, PADDED, body="SELECT family, idx, header, seq FROM pad"),
    "sniffed_parse": with_(CONV, PADDED, body="SELECT family, idx, header, replace(seq, '-', '') AS seq FROM pad"),
    "feature_line": """
SELECT c_custkey, CASE WHEN ok THEN c_acctbal ELSE 0 END AS avg_pid, CASE WHEN ok THEN c_nationkey::DOUBLE ELSE 0 END AS sd_pid,
       CASE WHEN ok THEN c_custkey::DOUBLE ELSE 0 END AS f2, CASE WHEN ok THEN c_acctbal ELSE 0 END AS f3,
       CASE WHEN ok THEN c_nationkey::DOUBLE ELSE 0 END AS avg_sp, CASE WHEN ok THEN c_custkey::DOUBLE ELSE 0 END AS peak,
       CASE WHEN ok THEN c_acctbal ELSE 0 END AS factor
FROM (SELECT *, c_mktsegment <> 'BUILDING' AS ok FROM customer)""",
    "score_text": "SELECT l_orderkey AS family, count(*) AS lines, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey",
    "sparse_cutoff": with_(WORDS, body="SELECT family, a, b, i, j, round(p, 9) AS p FROM m WHERE p >= 0.1::DOUBLE"),
    "sparse_transpose": with_(WORDS, body="SELECT family, b AS a, a AS b, j AS i, i AS j, round(p, 9) AS p FROM m"),
    "sparse_totals": with_(WORDS, body="SELECT family, count(*) AS cells, round(sum(p), 6) AS total FROM m GROUP BY family"),
    "sparse_row_offsets": with_(WORDS, """
sizes AS (SELECT family, a, b, i, count(*) AS size FROM m GROUP BY family, a, b, i)""", body="""
SELECT family, a, b, i, size, CAST(sum(size) OVER (PARTITION BY family, a, b ORDER BY i) - size AS BIGINT) AS "offset" FROM sizes"""),
    "sparse_row_histogram": with_(WORDS, """
sizes AS (SELECT family, a, b, i, count(*) AS size FROM m GROUP BY family, a, b, i)""", body="""
SELECT family, CAST(CASE WHEN size <= 1 THEN 1 WHEN size <= 2 THEN 2 WHEN size <= 4 THEN 4 WHEN size <= 8 THEN 8 WHEN size <= 16 THEN 16 ELSE 666 END AS BIGINT) AS bound,
       count(*) AS "rows"
FROM sizes GROUP BY 1, 2"""),
    "local_cutoff": with_(WORDS, retained("family, a, b", local_bounds(0.01)), body=f"""
SELECT family, a, b, retain, round({bound_of(local_bounds(0.01))}, 6) AS cutoff FROM cutoffs"""),
    "global_cutoff": with_(WORDS, retained("family", global_bounds()), body=f"""
SELECT family, retain, round({bound_of(global_bounds())}, 6) AS cutoff FROM cutoffs"""),
    "consistency_relax": with_(WORDS, """
s AS (SELECT family, a, b, i, j, p FROM m UNION ALL SELECT family, b, a, j, i, p FROM m),
relaxed AS (
  SELECT x.family, x.a, y.b, x.i, y.j, sum(x.p * y.p) AS v
  FROM s x JOIN s y ON x.family = y.family AND x.b = y.a AND x.j = y.i WHERE x.a < y.b GROUP BY ALL)""", body="""
SELECT m.family, m.a, m.b, m.i, m.j, round(coalesce(v, 0), 6) AS relaxed
FROM m LEFT JOIN relaxed r ON m.family = r.family AND m.a = r.a AND m.b = r.b AND m.i = r.i AND m.j = r.j"""),
    "profile_posterior": with_(WORDS, body="""
SELECT family, CASE WHEN a % 2 = 0 THEN i ELSE j END - 1 AS x, CASE WHEN a % 2 = 0 THEN j ELSE i END - 1 AS y,
       round(sum(p * (1.0::DOUBLE / (a + 1)) * (1.0::DOUBLE / (b + 1))), 6) AS v
FROM m WHERE a % 2 <> b % 2 GROUP BY 1, 2, 3"""),
    "column_reliability": with_(WORDS, """
cols AS (SELECT family, p AS col, count(*) AS n FROM tok GROUP BY family, p),
agree AS (SELECT family, i AS col, sum(p) AS v FROM m WHERE i = j GROUP BY family, i)""", body="""
SELECT c.family, c.col, c.n AS m, CAST(CASE WHEN n > 1 THEN floor(200.0::DOUBLE * coalesce(v, 0) / (n * (n - 1))) ELSE 0 END AS BIGINT) AS reliability
FROM cols c LEFT JOIN agree a ON c.family = a.family AND c.col = a.col"""),
    "annotation_text": with_(WORDS, """
cols AS (SELECT family, p AS col, count(*) AS n FROM tok GROUP BY family, p),
agree AS (SELECT family, i AS col, sum(p) AS v FROM m WHERE i = j GROUP BY family, i)""", body="""
SELECT c.family, string_agg(lpad(CAST(CAST(CASE WHEN n > 1 THEN floor(200.0::DOUBLE * coalesce(v, 0) / (n * (n - 1))) ELSE 0 END AS BIGINT) AS VARCHAR), 4, ' ')
       || chr(10), '' ORDER BY c.col) AS text
FROM cols c LEFT JOIN agree a ON c.family = a.family AND c.col = a.col GROUP BY c.family"""),
    "count_cutoff": with_(WORDS, """
ranked AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.family, a, b ORDER BY p DESC, i, j) AS k,
         floor((u.n * v.n - least(u.n, v.n)) * 0.0001::DOUBLE) + least(u.n, v.n) AS keep
  FROM m JOIN lens u ON m.family = u.family AND m.a = u.x JOIN lens v ON m.family = v.family AND m.b = v.x)""", body="""
SELECT family, a, b, i, j, round(p, 9) AS p FROM ranked WHERE k <= keep"""),
    "bucket_count_filter": with_(WORDS, bucket_count(0.0001), body="""
SELECT family, a, b, i, j, round(p, 9) AS p FROM m JOIN cutoffs USING (family, a, b) WHERE p >= cutoff"""),
    "longest_row_cutoff": with_(WORDS, longest_rows(2, 0.3, False), body="SELECT family, a, b, retain, round(cutoff, 6) AS cutoff FROM cutoffs"),
    "dense_share_filter": with_(WORDS, longest_rows(3, 0.02, True), body="""
SELECT family, a, b, i, j, round(p, 9) AS p FROM m JOIN cutoffs USING (family, a, b) WHERE cutoff IS NULL OR p >= cutoff"""),
    "gap_expand": with_(CONV, PADDED, body="SELECT family, header, seq FROM pad"),
    "row_split": with_(CONV, counted("conv"), f"""
gaps AS (
  SELECT g.family, g.col, g.n, CAST(g.n - coalesce(sum(c), 0) AS BIGINT) AS gaps
  FROM grid g LEFT JOIN cnt ON g.family = cnt.family AND g.col = cnt.col GROUP BY g.family, g.col, g.n),
ranked AS (
  SELECT family, col, row_number() OVER (PARTITION BY family ORDER BY abs(n / 2 - gaps) DESC, col) - 1 AS r,
         count(*) OVER (PARTITION BY family) AS m
  FROM gaps WHERE gaps > 0),
chosen AS (SELECT family, col FROM ranked WHERE r = {twister_stream(1)[0]} % m)""", body="""
SELECT conv.family, idx AS leaf, CASE WHEN substr(seq, CAST(col + 1 AS INTEGER), 1) BETWEEN 'A' AND 'Z' THEN 'R' ELSE 'L' END AS side
FROM conv JOIN chosen ON conv.family = chosen.family"""),
    "distance_hist": with_(WORDS, body="""
SELECT family, CAST(CASE """ + " ".join(f"WHEN d <= {(k + 1) / 10!r}::DOUBLE THEN {k}" for k in range(10)) + """ ELSE 10 END AS BIGINT) AS bin, count(*) AS pairs
FROM dist GROUP BY 1, 2"""),
    "posterior_weight_total": with_(WORDS, body="""
SELECT dist.family, round(sum((1.0::DOUBLE / u.n) * (1.0::DOUBLE / v.n)), 9) AS weight_total
FROM dist JOIN lens u ON dist.family = u.family AND dist.a = u.x JOIN lens v ON dist.family = v.family AND dist.b = v.x
WHERE d <= 0.99::DOUBLE GROUP BY dist.family"""),
    "max_norm": f"""
SELECT {LINE_KEY}, l_quantity, l_extendedprice,
       round(CASE WHEN max(l_quantity) OVER w > 1 THEN l_quantity / max(l_quantity) OVER w ELSE l_quantity END, 9) AS norm
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
    "row_rank_norm": with_(VEC, body="""
SELECT vec_id, pos, round((row_number() OVER (PARTITION BY vec_id ORDER BY x, pos) - 1) / dims, 9) AS norm FROM vec"""),
    "global_rank_norm": with_(VEC, body="""
SELECT label, vec_id, pos,
       round((row_number() OVER (PARTITION BY label ORDER BY x, vec_id * dims + pos) - 1) / (dims * (dims - 1)), 9) AS norm
FROM vec"""),
    "value_rank": """
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders""",
    "running_total": """
SELECT lang AS family, doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS running FROM documents""",
    "weight_norm": """
SELECT CAST(c_nationkey AS BIGINT) AS family, c_custkey AS leaf,
       round(greatest(CASE WHEN sum(w) OVER p = 0 THEN 1.0::DOUBLE / count(*) OVER p ELSE w / sum(w) OVER p END, 1e-6), 9) AS weight
FROM (SELECT *, greatest(c_acctbal, 0.0) AS w FROM customer) WINDOW p AS (PARTITION BY c_nationkey)""",
    "integer_weight_norm": """
SELECT CAST(c_nationkey AS BIGINT) AS family, c_custkey AS leaf,
       greatest(CAST(floor((CASE WHEN sum(i) OVER p = 0 THEN 1 ELSE i END) * 1000
         / (CASE WHEN sum(i) OVER p = 0 THEN count(*) OVER p ELSE sum(i) OVER p END)) AS BIGINT), 1) AS int_weight
FROM (SELECT *, CAST(trunc(100 * greatest(c_acctbal, 0.0)) AS BIGINT) AS i FROM customer) WINDOW p AS (PARTITION BY c_nationkey)""",
    "minmax_scale": """
SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()), 9) AS scaled_size,
       round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS scaled_price
FROM part""",
    "log_space": f"""
SELECT {LINE_KEY}, round(ln(l_quantity + l_extendedprice + l_discount), 6) AS total, round(ln(1 + exp(l_discount)), 6) AS lookup
FROM lineitem""",
    "scalar_functions": f"""
SELECT {LINE_KEY},
       CASE WHEN l_quantity >= l_discount * 100 AND l_quantity >= l_tax * 100 THEN 'D' WHEN l_discount * 100 >= l_tax * 100 THEN 'L' ELSE 'U' END AS best,
       (l_orderkey + 6) // 7 AS ceil_div, (l_orderkey + 6) // 7 * 7 AS ceil_round, (75 * l_orderkey) % 65537 AS random,
       round(sqrt(l_discount * l_discount * 0.5 + l_tax * l_tax * 0.5), 9) AS rms,
       round(sqrt(l_discount * l_discount * 0.3 + l_tax * l_tax * 0.7), 9) AS weighted_rms,
       round(l_discount + l_tax, 9) AS sel_sum, round(least(l_discount, l_tax), 9) AS sel_min,
       round(greatest(l_discount, l_tax), 9) AS sel_max, round(l_discount + l_tax / 2, 9) AS sel_avg,
       round(least(2.0 * l_discount, 2.0 - 2.0 * l_discount), 9) AS midpass
FROM lineitem""",
    "strategy_classes": with_(CONV, scored("conv"), STRATEGY, body="""
SELECT family, CAST(strategy AS BIGINT) AS strategy, CAST(length_class AS BIGINT) AS length_class FROM classes"""),
    "planned_regions": with_(CONV, scored("conv"), STRATEGY, """
hits AS (
  SELECT s.family, s.col, s.col - row_number() OVER (PARTITION BY s.family ORDER BY s.col) AS g
  FROM scores s JOIN classes c ON s.family = c.family
  WHERE CASE strategy WHEN 1 THEN score BETWEEN 0.0 AND 1.2 ELSE score > 2.0 END),
runs AS (SELECT family, min(col) AS f, max(col) AS l FROM hits GROUP BY family, g),
bounds AS (
  SELECT runs.family, f + 1 AS a, CASE WHEN l = len - 1 THEN l ELSE l + 1 END AS b
  FROM runs JOIN shape ON runs.family = shape.family WHERE l - f + 1 >= 3)""", body="""
SELECT bounds.family, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM bounds JOIN classes c ON bounds.family = c.family
WHERE b - a > CASE WHEN strategy = 0 THEN 2 ELSE CASE length_class WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 30 END END"""),
    "bench_timing": """
SELECT event_type AS bench, round(avg(value), 6) AS mean_seconds, count(*) AS families FROM events GROUP BY event_type""",
    "stats_merge": "SELECT event_type AS key, round(sum(value), 4) AS value FROM events GROUP BY event_type",
    "upgma_tree": with_(WORDS, tree("upgma"), body=NODES),
    "wpgma_tree": with_(WORDS, tree("wpgma"), body=NODES),
    "single_linkage_tree": with_(WORDS, tree("single"), body=NODES),
    "chained_tree": with_(WORDS, CHAIN, tree("upgma", "chain"), body=NODES),
    "tree_weights": with_(WORDS, tree("upgma"), MEMBERS, TREE_WEIGHTS, body="""
SELECT family, leaf, round(w, 9) AS w, round(weight, 9) AS weight FROM weights"""),
    "subtree_distances": with_(WORDS, tree("upgma"), MEMBERS, LEAF_PAIRS, body="SELECT family, a, b, node, subtree, level FROM met"),
    "branch_distances": with_(WORDS, tree("upgma"), MEMBERS, LEAF_PAIRS, body="SELECT family, a, b, branches FROM met"),
    "alignment_orders": with_(WORDS, tree("upgma"), MEMBERS, body="""
SELECT n.family, row_number() OVER (PARTITION BY n.family ORDER BY n.node) AS step, n.node, any_value(n."left") AS "left", any_value(n."right") AS "right",
       string_agg(CAST(leaf AS VARCHAR), ',' ORDER BY leaf) FILTER (side = 'L') AS left_leaves,
       string_agg(CAST(leaf AS VARCHAR), ',' ORDER BY leaf) FILTER (side = 'R') AS right_leaves
FROM nodes n JOIN members m ON m.family = n.family AND m.node = n.node GROUP BY n.family, n.node"""),
    "alignment_intervals": with_(WORDS, tree("upgma"), MEMBERS, PLACES, body="""
SELECT n.family, row_number() OVER (PARTITION BY n.family ORDER BY n.node) AS step, n.node, any_value(n."left") AS "left", any_value(n."right") AS "right",
       min(place) AS left_from, min(place) FILTER (side = 'R') AS left_to, min(place) FILTER (side = 'R') AS right_from, max(place) + 1 AS right_to
FROM nodes n JOIN members m ON m.family = n.family AND m.node = n.node JOIN places p ON p.family = m.family AND p.leaf = m.leaf
GROUP BY n.family, n.node"""),
    "leaf_places": with_(WORDS, tree("upgma"), MEMBERS, PLACES, body="SELECT family, leaf, place, depth FROM places"),
    "parsed_tree_weights": with_(WORDS, tree("upgma"), MEMBERS, TREE_WEIGHTS, body="""
SELECT family, 't' || leaf AS name, round(w, 9) AS w, round(weight, 9) AS weight FROM weights"""),
    "newick_round_trip": with_(WORDS, tree("upgma"), body="""
SELECT family, count(*) AS nodes, count(*) FILTER (level = 0) AS leaves, round(sum(dist), 6) AS length FROM nodes GROUP BY family"""),
    "third_weights": with_(WORDS, tree("upgma"), MEMBERS, TREE_WEIGHTS, LEAF_PAIRS, THIRD, body="""
SELECT family, a, b, z, round(zw, 6) AS zw, round(sum_w, 6) AS sum_w FROM third"""),
    **{f"third_weights_{name}": with_(WORDS, tree("upgma"), MEMBERS, TREE_WEIGHTS, third_by_chance(name), body="""
SELECT family, a, b, z, round(zw, 6) AS zw, round(sum_w, 6) AS sum_w FROM third""") for name in ("lowpass", "highpass", "midpass", "homograph")},
    "consistency_blocks": with_(WORDS, tree("upgma"), MEMBERS, TREE_WEIGHTS.replace(
        "ELSE w / sum(w) OVER f END AS weight", "ELSE greatest(w / sum(w) OVER f, 1e-6) END AS weight"), LEAF_PAIRS, THIRD,
        "start AS (SELECT family, a, b, i, j, CAST(p AS FLOAT) AS p FROM m)", relaxed("start", "once", 0.01), relaxed("once", "twice", 1e-5), body="""
SELECT family, a, b, i, j, round(p::DOUBLE, 6) AS p FROM twice"""),
    "random_row_split": with_(CONV, """
fam AS (SELECT family, count(*) AS n FROM conv GROUP BY family),
seq_r AS (
  WITH RECURSIVE g(family, n, k, r) AS (
    SELECT family, n, 0, (5 * 3 + 3) % (19 * n) FROM fam
    UNION ALL SELECT family, n, k + 1, (5 * r + 3) % (19 * n) FROM g WHERE k + 1 < 7 * (n + 1))
  SELECT family, k // 7 - 1 AS i, r % 2 AS bit FROM g WHERE k % 7 = 6 AND k > 6),
rows_r AS (SELECT family, idx, row_number() OVER (PARTITION BY family ORDER BY idx) - 1 AS i FROM conv)""", body="""
SELECT r.family, idx AS leaf, CASE WHEN bit = 1 THEN 'L' ELSE 'R' END AS side FROM rows_r r JOIN seq_r s ON r.family = s.family AND r.i = s.i"""),
    "tree_row_split": with_(WORDS, tree("upgma"), MEMBERS, f"""
roots AS (SELECT family, node AS root, 3499211612 % node AS drawn FROM nodes WHERE parent IS NULL)""", body="""
SELECT n.family, n.node AS leaf, CASE WHEN n.node = drawn OR m.leaf IS NOT NULL THEN 'L' ELSE 'R' END AS side
FROM nodes n JOIN roots r ON r.family = n.family LEFT JOIN members m ON m.family = n.family AND m.leaf = n.node AND m.node = drawn
WHERE n.level = 0"""),
    "refinement_accept": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS family FROM conversations WHERE conv_id % 2 = 0",
    "column_rank_by_entropy": with_(CONV, counted("conv"), ENTROPY, body="""
SELECT family, col, row_number() OVER (PARTITION BY family ORDER BY round(score, 9), col) - 1 AS rank FROM full_entropy"""),
    "classifier_features": with_(CONV, scored("conv"), WORDS, body="""
SELECT d.family, CAST(CASE WHEN d.avg_pid < 0.01 THEN 1 ELSE 0 END AS BIGINT) AS base_class, round(d.avg_pid, 6) AS avg_pid, round(d.sd_pid, 6) AS sd_pid,
       round(coalesce(s.avg_sp, 0), 6) AS avg_sp, round(coalesce(s.peak, 0), 6) AS peak, 0.0::DOUBLE AS f2, 0.0::DOUBLE AS f3, 1.0::DOUBLE AS factor
FROM (SELECT family, avg(1 - d) AS avg_pid, stddev_pop(1 - d) AS sd_pid FROM dist GROUP BY family) d
LEFT JOIN (SELECT family, avg(score) AS avg_sp, avg(CASE WHEN score >= 1.0 THEN 1.0::DOUBLE ELSE 0.0 END) AS peak FROM scores GROUP BY family) s
ON s.family = d.family"""),
}
