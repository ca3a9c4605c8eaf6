"""What queries must return, written from the operators' definitions: no step of ``steps`` occurs in this SQL.

Rasters of vectors are read as lists of lists; neighbours are looked up pixel by pixel, ranks are counted, thresholds and pairs are tried one by one.
"""

from __future__ import annotations

import math

EMBEDDINGS = """img AS (SELECT CAST(label AS VARCHAR) AS image_id, list(embedding ORDER BY vec_id) AS m FROM embeddings WHERE label IS NOT NULL GROUP BY label),
sz AS (SELECT image_id, len(m) AS h, list_max([len(x) FOR x IN m]) AS w FROM img),
px AS MATERIALIZED (SELECT i.image_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(coalesce(m[r + 1][c + 1] > 0, false) AS INT) AS v FROM img i JOIN sz USING (image_id), unnest(range(h)) AS a(r), unnest(range(w)) AS b(c))"""

LINEITEM = """seen AS (SELECT DISTINCT l_returnflag || l_linestatus AS image_id, CAST(l_partkey AS INT) AS r, CAST(date_diff('month', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS c FROM lineitem),
sz AS (SELECT image_id, h, w FROM (SELECT DISTINCT image_id FROM seen), (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM seen)),
px AS MATERIALIZED (SELECT g.image_id, g.r, g.c, CAST(s.r IS NOT NULL AS INT) AS v FROM (SELECT image_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM sz, unnest(range(h)) AS a(r), unnest(range(w)) AS b(c)) g LEFT JOIN seen s USING (image_id, r, c))"""

#: 3x3 blocks by all of their pixels, and how often each pattern occurs.
BLOCKS = """blk AS (SELECT image_id, r // 3 AS br, c // 3 AS bc, CAST(sum(v * power(2, 8 - 3 * (r % 3) - c % 3)) AS INT) AS pat FROM px JOIN sz USING (image_id) WHERE r < 3 * (h // 3) AND c < 3 * (w // 3) GROUP BY image_id, r // 3, c // 3),
freq AS (SELECT image_id, pat, count(*) AS n FROM blk GROUP BY image_id, pat)"""

#: A pixel's cost of being inverted: weights of the neighbours (by 1 / distance, all 24 adding up to 1) that would differ from it.
COSTS = """near AS (SELECT a AS dr, b AS dc, 1 / sqrt(a * a + b * b) / sum(1 / sqrt(a * a + b * b)) OVER () AS wt FROM unnest(range(-2, 3)) AS x(a), unnest(range(-2, 3)) AS y(b) WHERE a <> 0 OR b <> 0),
cost AS MATERIALIZED (SELECT p.image_id, p.r, p.c, p.v, coalesce(sum(wt) FILTER (WHERE q.v = p.v), 0) AS cost FROM px p CROSS JOIN near LEFT JOIN px q ON q.image_id = p.image_id AND q.r = p.r + dr AND q.c = p.c + dc GROUP BY p.image_id, p.r, p.c, p.v)"""

#: Interior pixels by the number of differing edge and corner neighbours; classes by falling distance, the smaller counts first among equals.
LEVELS = """cls AS (SELECT nn, fn, CAST(row_number() OVER (ORDER BY -(3.4142 - nn - fn / sqrt(2)), nn, fn) AS INT) AS lvl FROM unnest(range(5)) AS a(nn), unnest(range(5)) AS b(fn)),
apart AS (SELECT p.image_id, p.r, p.c, count(*) FILTER (WHERE q.v <> p.v AND abs(q.r - p.r) + abs(q.c - p.c) = 1) AS nn, count(*) FILTER (WHERE q.v <> p.v AND abs(q.r - p.r) + abs(q.c - p.c) = 2) AS fn, count(*) AS k
  FROM px p, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j), px q WHERE q.image_id = p.image_id AND q.r = p.r + i AND q.c = p.c + j GROUP BY p.image_id, p.r, p.c),
lv AS MATERIALIZED (SELECT image_id, r, c, lvl FROM apart JOIN cls USING (nn, fn) WHERE k = 9)"""

SCORES = """mean AS (SELECT lvl, avg(cost) AS m FROM lv JOIN cost USING (image_id, r, c) GROUP BY lvl),
pr AS (SELECT image_id, f.f AS first_level, count(lv.lvl) AS capacity, avg(m) / 2 AS each, count(lv.lvl) FILTER (WHERE m IS NULL) AS unknown FROM sz CROSS JOIN unnest(range(1, 14)) AS f(f) LEFT JOIN lv USING (image_id) LEFT JOIN mean USING (lvl) WHERE lv.lvl = f OR lv.lvl = 26 - f GROUP BY image_id, f.f)"""


def _r(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 9) + 0.0 AS {name}"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


#: Pairs of runs of one image and payload, one method against m1, for both measures.
_RUNS = """f AS (SELECT 'i' || (l_suppkey % 40) AS image, 'm' || (l_linenumber % 4) AS method, CAST(64 * power(2, l_partkey % 4) AS INT) AS payload_bits, count(*) AS k, sum(floor(l_quantity)::BIGINT) % 997 - 300 AS net, sum(round(100 * l_discount)::BIGINT) / count(*)::DOUBLE / 10 AS drd FROM lineitem GROUP BY ALL),
g AS (SELECT a.payload_bits, b.method AS competitor, a.image, unnest([{'m': 'net', 'd': (a.net - b.net)::DOUBLE}, {'m': 'drd', 'd': round(a.drd - b.drd, 12)}]) AS x FROM f a JOIN f b USING (payload_bits, image) WHERE a.method = 'm1' AND b.method <> 'm1' AND a.k >= 3 AND b.k >= 3),
e AS (SELECT payload_bits, competitor, x.m AS metric, image, x.d AS d FROM g),
rk AS (SELECT p.payload_bits, p.competitor, p.metric, p.image, p.d, count(*) FILTER (WHERE abs(q.d) < abs(p.d)) + (count(*) FILTER (WHERE abs(q.d) = abs(p.d)) + 1) / 2 AS k, count(*) FILTER (WHERE abs(q.d) = abs(p.d)) AS ties
  FROM e p JOIN e q USING (payload_bits, competitor, metric) WHERE p.d <> 0 AND q.d <> 0 GROUP BY p.payload_bits, p.competitor, p.metric, p.image, p.d),
ws AS (SELECT payload_bits, competitor, metric, count(*) AS n, coalesce(sum(k) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(k) FILTER (WHERE d < 0), 0) AS w_minus, sum(ties::DOUBLE * ties - 1) AS tie_term FROM rk GROUP BY ALL)"""

#: Exact two-sided p: all signs of the ranks, by their sums, one pair after the other; beyond 50 pairs the tail of the normal distribution (fixed values of a published approximation).
_EXACT = """ix AS (SELECT payload_bits, competitor, metric, row_number() OVER (PARTITION BY payload_bits, competitor, metric ORDER BY image) AS o, (2 * k)::INT AS twice FROM rk),
dp AS (SELECT payload_bits, competitor, metric, 0::BIGINT AS o, 0 AS s, 1::DOUBLE AS ways FROM ws WHERE n <= 50 UNION ALL
  SELECT payload_bits, competitor, metric, o, s, sum(ways) AS ways FROM (SELECT d.payload_bits, d.competitor, d.metric, i.o, unnest([d.s, d.s + i.twice]) AS s, d.ways FROM dp d JOIN ix i ON i.payload_bits = d.payload_bits AND i.competitor = d.competitor AND i.metric = d.metric AND i.o = d.o + 1) GROUP BY ALL),
zs AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48) AS z FROM ws WHERE n > 50),
pv AS (SELECT payload_bits, competitor, metric, least(1, 2 * sum(ways) FILTER (WHERE s <= 2 * least(w_plus, w_minus)) / power(2, any_value(n))) AS p FROM dp JOIN ws USING (payload_bits, competitor, metric) WHERE dp.o = ws.n GROUP BY ALL
  UNION ALL SELECT payload_bits, competitor, metric, least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM zs)
  UNION ALL SELECT DISTINCT payload_bits, competitor, metric, 1 FROM e ANTI JOIN ws USING (payload_bits, competitor, metric))"""

_GRAY = """h AS (SELECT image_id, g, count(*) AS n FROM (SELECT lang AS image_id, least(unicode(unnest(regexp_extract_all(text, '(?s).'))), 255) AS g FROM documents) GROUP BY ALL),
v AS (SELECT t.image_id, t.g AS t, (SELECT sum(n) FROM h a WHERE a.image_id IS NOT DISTINCT FROM t.image_id AND a.g <= t.g)::DOUBLE AS w0, (SELECT sum(n * g) FROM h a WHERE a.image_id IS NOT DISTINCT FROM t.image_id AND a.g <= t.g)::DOUBLE AS s0,
  (SELECT sum(n) FROM h a WHERE a.image_id IS NOT DISTINCT FROM t.image_id AND a.g > t.g)::DOUBLE AS w1, (SELECT sum(n * g) FROM h a WHERE a.image_id IS NOT DISTINCT FROM t.image_id AND a.g > t.g)::DOUBLE AS s1 FROM h t),
o AS (SELECT image_id, arg_max(t, struct_pack(a := w0 * w1 * (s0 / w0 - s1 / w1) * (s0 / w0 - s1 / w1), b := -t)) AS threshold FROM v WHERE w1 > 0 GROUP BY image_id)"""

#: A pixel and those right of, below and diagonally below it, up to two steps.
_CODES = """nb AS (SELECT p.image_id, p.r, p.c, a.i, b.j, q.v FROM px p, unnest(range(3)) AS a(i), unnest(range(3)) AS b(j), px q WHERE q.image_id = p.image_id AND q.r = p.r + i AND q.c = p.c + j),
c2 AS (SELECT image_id, CAST(sum(v * power(2, 2 * i + j)) AS INT) AS code FROM nb WHERE i < 2 AND j < 2 GROUP BY image_id, r, c HAVING count(*) = 4),
c3 AS (SELECT image_id, CAST(sum(v * power(2, 3 * i + j)) AS INT) AS code FROM nb GROUP BY image_id, r, c HAVING count(*) = 9)"""

#: The 81 pixels around a block's centre, those outside the image taken from its edge.
_AROUND = "CAST(i AS INT) AS i, CAST(m[least(greatest(3 * br + 1 + i // 9 - 4, 0), h - 1) + 1][least(greatest(3 * bc + 1 + i % 9 - 4, 0), w - 1) + 1] > 0 AS INT) AS v"
_CONTEXT = f"cx AS (SELECT image_id, CAST(br AS INT) AS br, CAST(bc AS INT) AS bc, pat, {_AROUND} FROM blk JOIN img USING (image_id) JOIN sz USING (image_id), unnest(range(81)) AS u(i))"

DEFINITIONS: dict[str, str] = {
    "context_patches": _with(EMBEDDINGS, BLOCKS, _CONTEXT) + "SELECT image_id, br, bc, i, v FROM cx WHERE pat IN (0, 511)",
    "context_features": _with(EMBEDDINGS, BLOCKS, _CONTEXT, "li AS (SELECT image_id, br, bc, pat, list(v ORDER BY i) AS x FROM cx WHERE pat IN (0, 511) GROUP BY ALL)") + f"SELECT image_id, br, bc, pat, {_r('list_avg(x)', 'density')}, {_r('len([k FOR k IN range(1, 82) IF k % 9 > 0 AND x[k] <> x[k + 1]]) / 72', 'horizontal')}, {_r('len([k FOR k IN range(1, 73) IF x[k] <> x[k + 9]]) / 72', 'vertical')} FROM li",
    "average_peak_context": _with(EMBEDDINGS, BLOCKS, _CONTEXT) + f"SELECT image_id, pat AS peak, i, {_r('avg(v)', 'mean')} FROM cx JOIN freq USING (image_id, pat) WHERE n >= 2 AND pat NOT IN (0, 511) GROUP BY image_id, pat, i",
    "pattern_hist": _with(LINEITEM, BLOCKS) + "SELECT image_id, pat, n FROM freq",
    "pattern_hist_dense": _with(EMBEDDINGS, BLOCKS) + "SELECT image_id, pat, n FROM freq",
    "zero_set": _with(LINEITEM, BLOCKS) + "SELECT image_id, CAST(p AS INT) AS pat FROM sz, unnest(range(512)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM freq WHERE freq.image_id = sz.image_id AND freq.pat = p)",
    "hn_capacity": _with(LINEITEM, BLOCKS, "pk AS (SELECT image_id, arg_max(pat, n * 1000 - pat) AS peak, max(n) AS n FROM freq WHERE pat NOT IN (0, 511) GROUP BY image_id)") + """SELECT image_id, peak, n, count(*) AS near, CAST(floor(log2(count(*) + 1)) AS INT) AS bits, CAST(n * floor(log2(count(*) + 1)) AS BIGINT) AS capacity_bits
        FROM pk, unnest(range(512)) AS u(z) WHERE bit_count(xor(peak, z::INT)) <= 5 AND NOT EXISTS (SELECT 1 FROM freq f WHERE f.image_id = pk.image_id AND f.pat = z) GROUP BY image_id, peak, n""",
    "flip_cost_map": _with(EMBEDDINGS, COSTS) + f"SELECT image_id, r, c, v, {_r('cost', 'cost')} FROM cost",
    "level_map": _with(EMBEDDINGS, LEVELS) + "SELECT image_id, r, c, lvl FROM lv",
    "level_profile": _with(EMBEDDINGS, COSTS, LEVELS) + f"SELECT CAST(k AS INT) AS lvl, count(cost) AS n, {_r('avg(cost)', 'cost')} FROM unnest(range(1, 26)) AS u(k) LEFT JOIN (lv JOIN cost USING (image_id, r, c)) ON lvl = k GROUP BY k",
    "pair_select": _with(EMBEDDINGS, COSTS, LEVELS, SCORES) + f"SELECT image_id, CAST(arg_max(first_level, struct_pack(s := round(1 / greatest(each, 2.220446049250313e-16), 9), l := -first_level)) AS INT) AS first_level, arg_max(capacity, struct_pack(s := round(1 / greatest(each, 2.220446049250313e-16), 9), l := -first_level)) AS capacity, {_r('max(1 / greatest(each, 2.220446049250313e-16))', 'score')} FROM pr WHERE unknown = 0 GROUP BY image_id",
    "bit_costs": _with(EMBEDDINGS, BLOCKS, COSTS) + f"SELECT b.image_id, b.pat AS peak, CAST(8 - 3 * (k.r % 3) - k.c % 3 AS INT) AS bit, {_r('avg(k.cost)', 'cost')} FROM blk b JOIN freq f ON f.image_id = b.image_id AND f.pat = b.pat AND f.n >= 2 AND f.pat NOT IN (0, 511) JOIN cost k ON k.image_id = b.image_id AND k.r // 3 = b.br AND k.c // 3 = b.bc GROUP BY b.image_id, b.pat, 8 - 3 * (k.r % 3) - k.c % 3",
    "best_uniform_flip": _with(EMBEDDINGS, BLOCKS, COSTS) + f"SELECT b.image_id, CAST(br AS INT) AS br, CAST(bc AS INT) AS bc, pat, CAST(arg_min(3 * (r % 3) + c % 3, 10 * round(cost, 9) * 1000000000 + 3 * (r % 3) + c % 3) AS INT) AS position, {_r('min(cost)', 'cost')} FROM blk b JOIN cost k ON k.image_id = b.image_id AND k.r // 3 = br AND k.c // 3 = bc WHERE pat IN (0, 511) GROUP BY b.image_id, br, bc, pat",
    "diff_matrix": _with(EMBEDDINGS) + "SELECT p.image_id, p.r, p.c, CASE WHEN p.r = 0 AND p.c = 0 THEN p.v ELSE CAST(p.v <> q.v AS INT) END AS d FROM px p LEFT JOIN px q ON q.image_id = p.image_id AND CASE WHEN p.c > 0 THEN q.r = p.r AND q.c = p.c - 1 ELSE q.c = 0 AND q.r = p.r - 1 END",
    "inverse_diff": _with(EMBEDDINGS) + "SELECT image_id, count(*) AS pixels, count(*) AS equal FROM px GROUP BY image_id",
    "pattern_hist_2x2": _with(EMBEDDINGS, _CODES) + "SELECT image_id, code AS code2, count(*) AS n FROM c2 GROUP BY ALL",
    "pattern_hist_3x3": _with(EMBEDDINGS, _CODES) + "SELECT image_id, code AS code3, count(*) AS n FROM c3 GROUP BY ALL",
    "otsu_threshold": _with(_GRAY) + "SELECT image_id, threshold::BIGINT AS threshold FROM o",
    "wilcoxon_stats": _with(_RUNS) + f"SELECT payload_bits, competitor, metric, n, {_r('w_plus', 'w_plus')}, {_r('w_minus', 'w_minus')}, {_r('tie_term', 'tie_term')} FROM ws",
    "wilcoxon_z": _with(_RUNS) + f"SELECT payload_bits, competitor, metric, {_r('(least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(greatest(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48, 1e-12))', 'z')} FROM ws",
    "wilcoxon_p": _with(_RUNS, _EXACT).replace("WITH", "WITH RECURSIVE", 1) + f"SELECT payload_bits, competitor, metric, {_r('p', 'p')} FROM pv",
    "holm_adjust": _with(_RUNS, _EXACT).replace("WITH", "WITH RECURSIVE", 1) + f"""SELECT a.payload_bits, a.competitor, a.metric, {_r('a.p', 'p')}, {_r('max(least(1, (b.m - b.o + 1) * b.p))', 'adjusted')} FROM pv a JOIN (SELECT *, count(*) OVER (PARTITION BY payload_bits) AS m, row_number() OVER (PARTITION BY payload_bits ORDER BY round(p, 12), competitor, metric) AS o FROM pv) b
        ON b.payload_bits = a.payload_bits AND (round(b.p, 12), b.competitor, b.metric) <= (round(a.p, 12), a.competitor, a.metric) GROUP BY a.payload_bits, a.competitor, a.metric, a.p""",
    # The sixteen nearest absent patterns within distance two of peaks that have two at least; planes pixel by pixel.
    "candidate_tensors": _with(EMBEDDINGS, BLOCKS, _CONTEXT, """cn AS (SELECT f.image_id, f.pat AS peak, z::INT AS candidate, bit_count(xor(f.pat, z::INT))::INT AS dist FROM freq f, unnest(range(512)) AS u(z) WHERE f.n >= 2 AND f.pat NOT IN (0, 511) AND bit_count(xor(f.pat, z::INT)) <= 2 AND NOT EXISTS (SELECT 1 FROM freq g WHERE g.image_id = f.image_id AND g.pat = z)),
tops AS (SELECT a.image_id, a.peak, a.candidate, a.dist FROM cn a JOIN cn b ON b.image_id = a.image_id AND b.peak = a.peak GROUP BY ALL HAVING count(*) FILTER (WHERE (b.dist, b.candidate) < (a.dist, a.candidate)) < 16 AND count(*) >= 2),
ct AS (SELECT image_id, pat, i, sum(v)::INT AS k FROM cx GROUP BY ALL),
cl AS (SELECT image_id, pat, string_agg(k, ',' ORDER BY i) AS context_counts FROM ct GROUP BY ALL)""") + """SELECT t.image_id, peak, candidate, dist,
        (SELECT string_agg(CASE WHEN i // 9 BETWEEN 3 AND 5 AND i % 9 BETWEEN 3 AND 5 THEN (peak // power(2, 8 - 3 * (i // 9 - 3) - (i % 9 - 3))::INT) % 2 ELSE 0 END, '' ORDER BY i) FROM unnest(range(81)) AS u(i)) AS peak_plane,
        (SELECT string_agg(CASE WHEN i // 9 BETWEEN 3 AND 5 AND i % 9 BETWEEN 3 AND 5 THEN (candidate // power(2, 8 - 3 * (i // 9 - 3) - (i % 9 - 3))::INT) % 2 ELSE 0 END, '' ORDER BY i) FROM unnest(range(81)) AS u(i)) AS candidate_plane, context_counts
        FROM tops t JOIN cl ON cl.image_id = t.image_id AND cl.pat = t.peak""",
    # Peaks one after the other, each with the cheapest absent pattern at distance one that is left.
    "cost_order": _with(EMBEDDINGS, BLOCKS, COSTS, """pk AS (SELECT image_id, pat, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, pat) AS INT) AS rk FROM freq WHERE n >= 2 AND pat NOT IN (0, 511)),
bc AS (SELECT b.image_id, b.pat, CAST(power(2, 8 - 3 * (k.r % 3) - k.c % 3) AS INT) AS mask, round(avg(k.cost), 9) AS cost FROM blk b JOIN cost k ON k.image_id = b.image_id AND k.r // 3 = b.br AND k.c // 3 = b.bc GROUP BY ALL),
ed AS (SELECT p.image_id, p.rk, p.pat, p.n, xor(p.pat, mask) AS z, cost FROM pk p JOIN bc ON bc.image_id = p.image_id AND bc.pat = p.pat WHERE NOT EXISTS (SELECT 1 FROM freq f WHERE f.image_id = p.image_id AND f.pat = xor(p.pat, mask))),
ops AS (SELECT image_id, rk, list(z ORDER BY cost, z) AS zs FROM ed GROUP BY ALL),
go AS (SELECT image_id, 0 AS rk, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS took FROM sz UNION ALL
  SELECT g.image_id, g.rk + 1, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, x FROM (SELECT g.*, list_filter(coalesce(o.zs, []), lambda z: NOT list_contains(g.used, z))[1] AS x FROM go g LEFT JOIN ops o ON o.image_id = g.image_id AND o.rk = g.rk + 1 WHERE EXISTS (SELECT 1 FROM pk WHERE pk.image_id = g.image_id AND pk.rk = g.rk + 1)) g)""").replace("WITH", "WITH RECURSIVE", 1) + "SELECT p.image_id, p.rk, p.pat AS peak, took AS pattern, p.n FROM go JOIN pk p ON p.image_id = go.image_id AND p.rk = go.rk WHERE took IS NOT NULL",
    "auc_rank": f"WITH s AS (SELECT CAST(label IN (1, 3, 5) AS INT) AS y, round(embedding[1] * 100)::INT AS s FROM embeddings WHERE label IS NOT NULL) SELECT (SELECT sum(y) FROM s)::BIGINT AS positives, {_r('avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END)', 'auc')} FROM s a JOIN s b ON a.y = 1 AND b.y = 0",
    "seeded_sample": "SELECT p.p_partkey FROM part p WHERE (SELECT count(*) FROM part q WHERE ((q.p_partkey * 1103515245 + 12345) % 1000003, q.p_partkey) < ((p.p_partkey * 1103515245 + 12345) % 1000003, p.p_partkey)) < 50",
    "drd_kernel": f"SELECT a::INT AS dr, b::INT AS dc, {_r('1 / sqrt(a * a + b * b) / ' + repr(sum(1 / math.hypot(i, j) for i in range(-2, 3) for j in range(-2, 3) if i or j)), 'wt')} FROM unnest(range(-2, 3)) AS x(a), unnest(range(-2, 3)) AS y(b) WHERE a <> 0 OR b <> 0",
    "level_table": "SELECT nn::INT AS nn, fn::INT AS fn, CAST(1 + count(*) FILTER (WHERE (-(3.4142 - n2 - f2 / sqrt(2)), n2, f2) < (-(3.4142 - nn - fn / sqrt(2)), nn, fn)) AS INT) AS lvl FROM unnest(range(5)) AS a(nn), unnest(range(5)) AS b(fn), unnest(range(5)) AS c(n2), unnest(range(5)) AS d(f2) GROUP BY nn, fn",
}
