"""Named relational steps over rasters, as SQL that Catalyst plans.

A step is one SELECT; it names the steps and tables it reads in FROM. ``sql(final)`` puts the steps a query needs
in a WITH clause. A raster is two relations: ``ones`` (image_id, r, c), the distinct 1-pixels, and ``dim``
(image_id, h, w); all other steps follow from these. Few things differ between Spark and the SQL that
results are held against, and they're written as ``XOR(a, b)``, ``RANGE(n)`` (a relation with column x), ``AT(array, i)``,
``EACH(n, i)`` (the relation before it, once for each i below n) and ``CHARS(text, ch)`` (once for each character).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

from rasterlake.stages import kept

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Rasters derived from tables: the step ``ones`` and the step ``dim`` of each.
FIXTURES: dict[str, dict[str, str]] = {
    "lineitem": {
        "ones": "SELECT DISTINCT concat(l_returnflag, l_linestatus) AS image_id, CAST(l_partkey AS INT) AS r, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INT) AS c FROM lineitem",
        "dim": "SELECT i.image_id, s.h, s.w FROM (SELECT DISTINCT image_id FROM ones) i CROSS JOIN (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM ones) s",
    },
    "embeddings": {
        "vec": "SELECT CAST(label AS STRING) AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS r, embedding FROM embeddings WHERE label IS NOT NULL",
        "ones": "SELECT v.image_id, v.r, CAST(x AS INT) AS c FROM vec v EACH(LEN(v.embedding), x) WHERE AT(v.embedding, x) > 0",
        "dim": "SELECT image_id, max(r) + 1 AS h, CAST(max(LEN(embedding)) AS INT) AS w FROM vec GROUP BY image_id",
    },
    # Shapes: the sign of each vector's components summed over 7x7 around a place, in thousandths, so that sums are exact.
    "smooth": {
        "vec": "SELECT CAST(label AS STRING) AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS r, embedding FROM embeddings WHERE label IS NOT NULL",
        "cells": "SELECT v.image_id, v.r, CAST(x AS INT) AS c, CAST(round(CAST(AT(v.embedding, x) AS DOUBLE) * 1000) AS BIGINT) AS q FROM vec v EACH(LEN(v.embedding), x)",
        "across": "SELECT s.image_id, s.r, s.c + k.x - 3 AS c, CAST(sum(s.q) AS BIGINT) AS q FROM cells s CROSS JOIN RANGE(7) k GROUP BY s.image_id, s.r, s.c + k.x - 3",
        "shade": "SELECT q.image_id, q.r, q.c, q.q FROM (SELECT s.image_id, s.r + k.x - 3 AS r, s.c, CAST(sum(s.q) AS BIGINT) AS q FROM across s CROSS JOIN RANGE(7) k GROUP BY s.image_id, s.r + k.x - 3, s.c) q JOIN dim d ON d.image_id = q.image_id WHERE q.r BETWEEN 0 AND d.h - 1 AND q.c BETWEEN 0 AND d.w - 1",
        "ones": "SELECT image_id, r, c FROM shade WHERE q > 0",
        "dim": "SELECT image_id, max(r) + 1 AS h, CAST(max(LEN(embedding)) AS INT) AS w FROM vec GROUP BY image_id",
    },
    "events": {
        "ones": "SELECT DISTINCT event_type AS image_id, CAST(user_id AS INT) AS r, CAST((DAYS(ts) * 24 + hour(ts)) % 240 AS INT) AS c FROM events",
        "dim": "SELECT i.image_id, s.h, 240 AS w FROM (SELECT DISTINCT image_id FROM ones) i CROSS JOIN (SELECT max(r) + 1 AS h FROM ones) s",
    },
}


def wire_bits(t: int) -> int:
    """Side information of t distance-one tables: a 12-byte head and the rank of one of C(512, t) * 9^t states."""
    return 8 * (12 + -(-max(math.comb(512, t) * 9**t - 1, 0).bit_length() // 8))


def level_order() -> list[tuple[int, int, int]]:
    """(differing edge neighbours, differing corner neighbours, level 1..25), by falling distance."""
    classes = sorted(((nn, fn) for nn in range(5) for fn in range(5)), key=lambda x: (-(3.4142 - x[0] - x[1] / math.sqrt(2)), *x))
    return [(nn, fn, k + 1) for k, (nn, fn) in enumerate(classes)]


def kernel() -> list[tuple[int, int, float]]:
    """The 24 reciprocal-distance weights of a 5x5 neighbourhood, summing to 1."""
    raw = {(i, j): 1 / math.sqrt(i * i + j * j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)}
    return [(i, j, w / sum(raw.values())) for (i, j), w in raw.items()]


def substitutes() -> list[tuple[int, int]]:
    """(pattern, substitute) of 4-bit patterns: xor with 0011, 0110 and 1100, but 1001 has 1000 in place of 0101 (a fixed value)."""
    return [(p, 0b1000 if (p, q) == (0b1001, 0b0101) else q) for p in range(1, 16) for q in sorted(p ^ m for m in (0b0011, 0b0110, 0b1100))]


def values(rows: list[tuple], *names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(repr, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


#: Portable message bits: bit i of every image.
BIT = "CAST(floor((CAST({i} AS BIGINT) * 1103515245 + 12345) / 65536) AS BIGINT) % 2"

#: Weight of a pixel's neighbours that are inside the image.
ROOM = " + ".join(f"CASE WHEN p.r + {i} BETWEEN 0 AND d.h - 1 AND p.c + {j} BETWEEN 0 AND d.w - 1 THEN {w!r} ELSE 0.0 END" for i, j, w in kernel())

STEPS: dict[str, str] = {
    "bits9": values([(b,) for b in range(9)], "b"),
    "kernel": values([(i, j, w) for i, j, w in kernel()], "dr", "dc", "wt"),
    "levels": values(level_order(), "nn", "fn", "lvl"),
    "wire": values([(t, wire_bits(t)) for t in range(257)], "t", "bits"),
    "subst": values(substitutes(), "p", "q"),
    # Tiles
    "blocks": """SELECT o.image_id, CAST(floor(o.r / 3) AS INT) AS br, CAST(floor(o.c / 3) AS INT) AS bc, CAST(sum(1 << (8 - (o.r % 3) * 3 - o.c % 3)) AS INT) AS pat
        FROM ones o JOIN dim d ON o.image_id = d.image_id WHERE o.r < d.h - d.h % 3 AND o.c < d.w - d.w % 3 GROUP BY o.image_id, CAST(floor(o.r / 3) AS INT), CAST(floor(o.c / 3) AS INT)""",
    "tiles": "SELECT image_id, CAST(floor(h / 3) * floor(w / 3) AS BIGINT) AS n FROM dim",
    "nonzero_hist": "SELECT image_id, pat, count(*) AS n FROM blocks GROUP BY image_id, pat",
    "hist": """SELECT image_id, pat, n FROM nonzero_hist UNION ALL
        SELECT t.image_id, 0 AS pat, t.n - coalesce(k.n, 0) AS n FROM tiles t LEFT JOIN (SELECT image_id, CAST(sum(n) AS BIGINT) AS n FROM nonzero_hist GROUP BY image_id) k ON t.image_id = k.image_id WHERE t.n > coalesce(k.n, 0)""",
    "zeros": "SELECT d.image_id, k.x AS pat FROM dim d CROSS JOIN RANGE(512) k LEFT JOIN hist s ON s.image_id = d.image_id AND s.pat = k.x WHERE s.pat IS NULL",
    "peaks": "SELECT image_id, pat, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, pat) AS INT) AS rk FROM hist WHERE n >= 2 AND pat NOT IN (0, 511)",
    "edges": "SELECT p.image_id, p.rk, p.pat AS peak, p.n, b.b, z.pat AS zero FROM peaks p CROSS JOIN bits9 b JOIN zeros z ON z.image_id = p.image_id AND z.pat = XOR(p.pat, (1 << b.b))",
    # h1map (image_id, rk, peak, zero, n) is the greedy assignment, below.
    "ranked_h1": """SELECT m.*, CAST(row_number() OVER (PARTITION BY m.image_id ORDER BY m.rk) AS INT) AS t, CAST(sum(m.n) OVER (PARTITION BY m.image_id ORDER BY m.rk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gross FROM h1map m""",
    "net": "SELECT r.*, r.gross - k.bits AS net, k.bits AS wire_bits FROM ranked_h1 r JOIN wire k ON k.t = r.t",
    "best": "SELECT image_id, t AS best_t, gross, wire_bits, net FROM (SELECT n.*, row_number() OVER (PARTITION BY image_id ORDER BY net DESC, t) AS o FROM net n WHERE net > 0) q WHERE o = 1",
    "capacity": "SELECT d.image_id, coalesce(m.tables, 0) AS tables, coalesce(m.gross_all, 0) AS gross_all, coalesce(b.best_t, 0) AS best_tables, coalesce(b.gross, 0) AS gross_bits, coalesce(b.wire_bits, 96) AS wire_bits, coalesce(b.net, 0) AS net_bits FROM dim d LEFT JOIN (SELECT image_id, count(*) AS tables, CAST(sum(n) AS BIGINT) AS gross_all FROM h1map GROUP BY image_id) m ON m.image_id = d.image_id LEFT JOIN best b ON b.image_id = d.image_id",
    # Embedding: bits go to the blocks of chosen peaks in raster order. Places are a prefix sum over bands of block rows, then over a band's blocks, so that no task holds a whole image.
    "chosen": "SELECT n.image_id, n.peak, n.zero FROM net n JOIN best b ON b.image_id = n.image_id WHERE n.t <= b.best_t",
    "carriers": "SELECT b.image_id, b.br, b.bc, c.peak, c.zero, CAST(floor(b.br / 64) AS INT) AS band FROM blocks b JOIN chosen c ON c.image_id = b.image_id AND c.peak = b.pat",
    "bands": "SELECT image_id, band, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY band ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS before_n FROM (SELECT image_id, band, count(*) AS n FROM carriers GROUP BY image_id, band) q",
    "placed": "SELECT c.image_id, c.br, c.bc, c.peak, c.zero, d.before_n + row_number() OVER (PARTITION BY c.image_id, c.band ORDER BY c.br, c.bc) - 1 AS i FROM carriers c JOIN bands d ON d.image_id = c.image_id AND d.band = c.band",
    "embedded": "SELECT p.*, CAST(" + BIT.format(i="p.i") + " AS INT) AS bit FROM placed p",
    "flips": """SELECT image_id, br * 3 + CAST(floor(k / 3) AS INT) AS r, bc * 3 + k % 3 AS c, was FROM (
        SELECT image_id, br, bc, 8 - b.b AS k, CASE WHEN zero < peak THEN 1 ELSE 0 END AS was FROM embedded e JOIN bits9 b ON (1 << b.b) = XOR(e.peak, e.zero) WHERE e.bit = 1) q""",
    "stego": "SELECT o.image_id, o.r, o.c FROM ones o LEFT JOIN (SELECT * FROM flips WHERE was = 1) f ON f.image_id = o.image_id AND f.r = o.r AND f.c = o.c WHERE f.r IS NULL UNION ALL SELECT image_id, r, c FROM flips WHERE was = 0",
    # Extraction sees only the marked raster, the tables and the number of bits.
    "stego_blocks": """SELECT o.image_id, CAST(floor(o.r / 3) AS INT) AS br, CAST(floor(o.c / 3) AS INT) AS bc, CAST(sum(1 << (8 - (o.r % 3) * 3 - o.c % 3)) AS INT) AS pat
        FROM stego o JOIN dim d ON o.image_id = d.image_id WHERE o.r < d.h - d.h % 3 AND o.c < d.w - d.w % 3 GROUP BY o.image_id, CAST(floor(o.r / 3) AS INT), CAST(floor(o.c / 3) AS INT)""",
    "inverse": "SELECT image_id, peak AS pattern, peak, 0 AS bit FROM chosen UNION ALL SELECT image_id, zero, peak, 1 FROM chosen",
    "read_blocks": """SELECT b.image_id, b.br, b.bc, v.peak, v.bit, CAST(floor(b.br / 64) AS INT) AS band FROM stego_blocks b JOIN inverse v ON v.image_id = b.image_id AND v.pattern = b.pat
        UNION ALL SELECT g.image_id, g.br, g.bc, g.peak, g.bit, CAST(floor(g.br / 64) AS INT) FROM (SELECT q.image_id, q.br, q.peak, q.bit, CAST(bc AS INT) AS bc FROM (SELECT d.image_id, d.w, v.peak, v.bit, CAST(br AS INT) AS br
        FROM dim d JOIN inverse v ON v.image_id = d.image_id AND v.pattern = 0 EACH(CAST(floor(d.h / 3) AS INT), br)) q EACH(CAST(floor(q.w / 3) AS INT), bc)) g
        LEFT JOIN stego_blocks s ON s.image_id = g.image_id AND s.br = g.br AND s.bc = g.bc WHERE s.pat IS NULL""",
    "read_bands": "SELECT image_id, band, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY band ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS before_n FROM (SELECT image_id, band, count(*) AS n FROM read_blocks GROUP BY image_id, band) q",
    "extracted": "SELECT c.image_id, c.br, c.bc, c.peak, c.bit, d.before_n + row_number() OVER (PARTITION BY c.image_id, c.band ORDER BY c.br, c.bc) - 1 AS i FROM read_blocks c JOIN read_bands d ON d.image_id = c.image_id AND d.band = c.band",
    # Distortion
    "flip_costs": """SELECT q.image_id, q.r, q.c, sum(k.wt * abs(CASE WHEN o.r IS NULL THEN 0 ELSE 1 END - (1 - q.was))) AS cost
        FROM flips q JOIN dim d ON d.image_id = q.image_id CROSS JOIN kernel k LEFT JOIN ones o ON o.image_id = q.image_id AND o.r = q.r + k.dr AND o.c = q.c + k.dc
        WHERE q.r + k.dr BETWEEN 0 AND d.h - 1 AND q.c + k.dc BETWEEN 0 AND d.w - 1 GROUP BY q.image_id, q.r, q.c""",
    "mixed8": """SELECT image_id, count(*) AS n FROM (SELECT o.image_id, count(*) AS k FROM ones o JOIN dim d ON d.image_id = o.image_id WHERE o.r < d.h - d.h % 8 AND o.c < d.w - d.w % 8
        GROUP BY o.image_id, CAST(floor(o.r / 8) AS INT), CAST(floor(o.c / 8) AS INT)) q WHERE k < 64 GROUP BY image_id""",
    # Dense pixels, for operators that look at every pixel
    "px": "SELECT g.image_id, g.r, g.c, CASE WHEN o.r IS NULL THEN 0 ELSE 1 END AS v FROM (SELECT q.image_id, q.r, CAST(c AS INT) AS c FROM (SELECT d.image_id, d.w, CAST(r AS INT) AS r FROM dim d EACH(d.h, r)) q EACH(q.w, c)) g LEFT JOIN ones o ON o.image_id = g.image_id AND o.r = g.r AND o.c = g.c",
    # What the 1-pixels around a place weigh: each is scattered to its 24 neighbours and summed there (the kernel is symmetric).
    "ink": "SELECT o.image_id, o.r + k.dr AS r, o.c + k.dc AS c, sum(k.wt) AS ink FROM ones o CROSS JOIN kernel k GROUP BY o.image_id, o.r + k.dr, o.c + k.dc",
    "flip_cost_map": f"SELECT q.image_id, q.r, q.c, q.v, CASE WHEN q.v = 1 THEN coalesce(i.ink, 0.0) ELSE q.room - coalesce(i.ink, 0.0) END AS cost FROM (SELECT p.image_id, p.r, p.c, p.v, {ROOM} AS room FROM px p JOIN dim d ON d.image_id = p.image_id) q LEFT JOIN ink i ON i.image_id = q.image_id AND i.r = q.r AND i.c = q.c",
    # Neighbourhood levels
    "around": """SELECT image_id, r, c, v, h, w, lag(v) OVER (PARTITION BY image_id, r ORDER BY c) AS l, lead(v) OVER (PARTITION BY image_id, r ORDER BY c) AS e FROM (SELECT p.*, d.h, d.w FROM px p JOIN dim d ON d.image_id = p.image_id) q""",
    "level_px": """SELECT q.image_id, q.r, q.c, q.v, k.lvl FROM (SELECT image_id, r, c, v,
            CASE WHEN l <> v THEN 1 ELSE 0 END + CASE WHEN e <> v THEN 1 ELSE 0 END + CASE WHEN u <> v THEN 1 ELSE 0 END + CASE WHEN s <> v THEN 1 ELSE 0 END AS nn,
            CASE WHEN ul <> v THEN 1 ELSE 0 END + CASE WHEN ue <> v THEN 1 ELSE 0 END + CASE WHEN sl <> v THEN 1 ELSE 0 END + CASE WHEN se <> v THEN 1 ELSE 0 END AS fn, h, w
        FROM (SELECT a.*, lag(v) OVER col AS u, lead(v) OVER col AS s, lag(l) OVER col AS ul, lag(e) OVER col AS ue, lead(l) OVER col AS sl, lead(e) OVER col AS se FROM around a WINDOW col AS (PARTITION BY image_id, c ORDER BY r)) z
        WHERE r BETWEEN 1 AND h - 2 AND c BETWEEN 1 AND w - 2) q JOIN levels k ON k.nn = q.nn AND k.fn = q.fn""",
    "profile": "SELECT k.lvl, count(m.cost) AS n, avg(m.cost) AS cost FROM levels k LEFT JOIN (SELECT p.lvl, f.cost FROM level_px p JOIN flip_cost_map f ON f.image_id = p.image_id AND f.r = p.r AND f.c = p.c) m ON m.lvl = k.lvl GROUP BY k.lvl",
    "level_counts": "SELECT image_id, lvl, count(*) AS n FROM level_px GROUP BY image_id, lvl",
    "pairs": "SELECT d.image_id, k.x + 1 AS first_level, coalesce(a.n, 0) AS n1, CASE WHEN k.x = 12 THEN 0 ELSE coalesce(b.n, 0) END AS n2 FROM dim d CROSS JOIN RANGE(13) k LEFT JOIN level_counts a ON a.image_id = d.image_id AND a.lvl = k.x + 1 LEFT JOIN level_counts b ON b.image_id = d.image_id AND b.lvl = 25 - k.x",
    "scores": """SELECT p.image_id, p.first_level, p.n1 + p.n2 AS capacity, CASE WHEN p.n1 + p.n2 = 0 THEN NULL WHEN (p.n1 > 0 AND a.cost IS NULL) OR (p.n2 > 0 AND b.cost IS NULL) THEN NULL
        ELSE (p.n1 + p.n2) / greatest((p.n1 * coalesce(a.cost, 0.0) + p.n2 * coalesce(b.cost, 0.0)) / 2.0, 2.220446049250313e-16) END AS score
        FROM pairs p JOIN profile a ON a.lvl = p.first_level JOIN profile b ON b.lvl = 26 - p.first_level""",
    "selected": "SELECT image_id, first_level, capacity, score FROM (SELECT s.*, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, first_level) AS o FROM scores s WHERE score IS NOT NULL) q WHERE o = 1",
    "pair_px": "SELECT p.image_id, p.r, p.c, p.v, row_number() OVER (PARTITION BY p.image_id ORDER BY p.r, p.c) - 1 AS i FROM level_px p JOIN selected s ON s.image_id = p.image_id AND (p.lvl = s.first_level OR p.lvl = 26 - s.first_level)",
    # Differences
    "diff": "SELECT image_id, r, c, CASE WHEN c > 0 THEN XOR(v, l) WHEN r > 0 THEN XOR(v, u) ELSE v END AS d FROM (SELECT image_id, r, c, v, lag(v) OVER (PARTITION BY image_id, r ORDER BY c) AS l, lag(v) OVER (PARTITION BY image_id, c ORDER BY r) AS u FROM px) q",
    "first_column": "SELECT image_id, r, CAST(sum(d) OVER (PARTITION BY image_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS INT) % 2 AS v FROM diff WHERE c = 0",
    "undone": "SELECT d.image_id, d.r, d.c, CAST((sum(CASE WHEN d.c = 0 THEN f.v ELSE d.d END) OVER (PARTITION BY d.image_id, d.r ORDER BY d.c ROWS UNBOUNDED PRECEDING)) AS INT) % 2 AS v FROM diff d JOIN first_column f ON f.image_id = d.image_id AND f.r = d.r",
    "heads": "SELECT image_id, c * h + r AS head, p FROM (SELECT d.image_id, d.r, d.c, s.h, s.w, d.d * 8 + lead(d.d, 1) OVER line * 4 + lead(d.d, 2) OVER line * 2 + lead(d.d, 3) OVER line AS p FROM diff d JOIN dim s ON s.image_id = d.image_id WINDOW line AS (PARTITION BY d.image_id, d.r ORDER BY d.c)) q WHERE c < w - 3",
    # Single-peak mapping within distance five
    "hn_peak": "SELECT image_id, pat AS peak, n FROM (SELECT s.*, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, pat) AS o FROM hist s WHERE pat NOT IN (0, 511)) q WHERE o = 1",
    "hn_near": "SELECT p.image_id, p.peak, p.n, z.pat AS zero, bit_count(XOR(p.peak, z.pat)) AS dist FROM hn_peak p JOIN zeros z ON z.image_id = p.image_id WHERE bit_count(XOR(p.peak, z.pat)) <= 5",
    "hn_bits": "SELECT image_id, peak, n, count(*) AS near, CAST(floor(log2(count(*) + 1)) AS INT) AS bits FROM hn_near GROUP BY image_id, peak, n",
    "hn_map": "SELECT q.image_id, q.peak, q.symbol, q.zero AS pattern, b.bits FROM (SELECT e.*, CAST(row_number() OVER (PARTITION BY image_id ORDER BY dist, zero) AS INT) AS symbol FROM hn_near e) q JOIN hn_bits b ON b.image_id = q.image_id WHERE q.symbol < (1 << b.bits)",
    # Result facts of a study: image, method, payload and measures, from line items
    "runs": """SELECT concat('i', CAST(l_suppkey % 40 AS STRING)) AS image, concat('m', CAST(l_linenumber % 4 AS STRING)) AS method, CAST(64 * (1 << CAST(l_partkey % 4 AS INT)) AS INT) AS payload_bits,
        count(*) >= 3 AS available, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) % 997 AS BIGINT) - 300 AS net, sum(CAST(round(l_discount * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 10.0 AS drd, CAST(max(CAST(floor(l_extendedprice) AS BIGINT)) % 500 AS BIGINT) AS changed
        FROM lineitem GROUP BY concat('i', CAST(l_suppkey % 40 AS STRING)), concat('m', CAST(l_linenumber % 4 AS STRING)), CAST(64 * (1 << CAST(l_partkey % 4 AS INT)) AS INT)""",
    "matched": "SELECT payload_bits, image FROM runs WHERE available GROUP BY payload_bits, image HAVING count(DISTINCT method) = 4",
    "deltas": """SELECT payload_bits, competitor, image, k.metric, CASE WHEN k.metric = 'net' THEN net ELSE drd END AS d FROM (SELECT a.payload_bits, b.method AS competitor, a.image, CAST(a.net - b.net AS DOUBLE) AS net, round(a.drd - b.drd, 12) AS drd
        FROM runs a JOIN runs b ON b.payload_bits = a.payload_bits AND b.image = a.image AND b.method <> 'm1' AND a.method = 'm1' AND a.available AND b.available) q CROSS JOIN metrics k""",
    "metrics": values([("net",), ("drd",)], "metric"),
    "delta_ranks": "SELECT q.*, CASE WHEN d = 0 THEN 0.0 ELSE k + (ties - 1) / 2.0 END AS mean_rank FROM (SELECT d.*, rank() OVER (PARTITION BY payload_bits, competitor, metric ORDER BY abs(d)) AS k, count(*) OVER (PARTITION BY payload_bits, competitor, metric, abs(d)) AS ties FROM deltas d WHERE d <> 0) q",
    "wilcoxon": """SELECT payload_bits, competitor, metric, count(*) AS n, sum(CASE WHEN d > 0 THEN mean_rank ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN mean_rank ELSE 0.0 END) AS w_minus, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie_term FROM delta_ranks GROUP BY payload_bits, competitor, metric""",
    "z_scores": "SELECT payload_bits, competitor, metric, n, w_plus, w_minus, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(greatest(n * (n + 1.0) * (2 * n + 1) / 24.0 - tie_term / 48.0, 1e-12)) AS z FROM wilcoxon",
    # The exact null of rank sums for up to 50 pairs: how many of the 2^n signs give each sum of doubled ranks (doubled, as ties share half ranks), one rank after the other.
    "few_pairs": """SELECT d.payload_bits, d.competitor, d.metric, w.n, CAST(round(2 * least(w.w_plus, w.w_minus)) AS INT) AS low, collect_list(CAST(round(2 * d.mean_rank) AS INT)) AS ranks
        FROM delta_ranks d JOIN wilcoxon w ON w.payload_bits = d.payload_bits AND w.competitor = d.competitor AND w.metric = d.metric WHERE w.n <= 50 GROUP BY d.payload_bits, d.competitor, d.metric, w.n, w.w_plus, w.w_minus""",
    "exact_tails": """SELECT payload_bits, competitor, metric, least(CAST(1 AS DOUBLE), 2 * aggregate(slice(ways, 1, low + 1), CAST(0 AS DOUBLE), (a, x) -> a + x) / power(2, n)) AS p FROM (SELECT f.*,
        aggregate(ranks, transform(sequence(0, CAST(n * (n + 1) AS INT)), s -> CAST(s = 0 AS DOUBLE)), (c, k) -> transform(c, (x, s) -> x + CASE WHEN s < k THEN CAST(0 AS DOUBLE) ELSE element_at(c, s - k + 1) END)) AS ways FROM few_pairs f) q""",
    # Beyond: two-sided tail of the normal distribution by a polynomial (fixed values of a published approximation, good to 1e-7); a pair of methods without differences has 1.
    "p_values": """SELECT c.payload_bits, c.competitor, c.metric, CASE WHEN e.p IS NOT NULL THEN e.p WHEN z IS NULL THEN 1.0 ELSE least(1.0, 2 * exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) END AS p
        FROM (SELECT DISTINCT payload_bits, competitor, metric FROM deltas) c LEFT JOIN (SELECT z.*, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z_scores z) s ON s.payload_bits = c.payload_bits AND s.competitor = c.competitor AND s.metric = c.metric
        LEFT JOIN exact_tails e ON e.payload_bits = c.payload_bits AND e.competitor = c.competitor AND e.metric = c.metric""",
    "gray": "SELECT d.lang AS image_id, least(ascii(ch), 255) AS g FROM documents d CHARS(d.text, ch) WHERE ch <> ''",
    "gray_hist": "SELECT image_id, g, count(*) AS n FROM gray GROUP BY image_id, g",
    "gray_prefix": "SELECT image_id, g, n, sum(n) OVER p AS w0, sum(n) OVER (PARTITION BY image_id) - sum(n) OVER p AS w1, sum(n * g) OVER p AS s0, sum(n * g) OVER (PARTITION BY image_id) - sum(n * g) OVER p AS s1 FROM gray_hist WINDOW p AS (PARTITION BY image_id ORDER BY g ROWS UNBOUNDED PRECEDING)",
    "otsu": "SELECT image_id, g AS threshold FROM (SELECT image_id, g, row_number() OVER (PARTITION BY image_id ORDER BY CAST(w0 AS DOUBLE) * w1 * (s0 / CAST(w0 AS DOUBLE) - s1 / CAST(w1 AS DOUBLE)) * (s0 / CAST(w0 AS DOUBLE) - s1 / CAST(w1 AS DOUBLE)) DESC, g) AS o FROM gray_prefix WHERE w1 > 0) q WHERE o = 1",
    # Detector scores
    "scored": "SELECT vec_id, CASE WHEN label IN (1, 3, 5) THEN 1 ELSE 0 END AS y, CAST(round(AT(embedding, 0) * 100) AS INT) AS s FROM embeddings WHERE label IS NOT NULL",
    "score_ranks": "SELECT s, n, pos, sum(n) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0 AS k FROM score_levels",
    "score_levels": "SELECT s, count(*) AS n, sum(y) AS pos FROM scored GROUP BY s",
    "codes": "SELECT image_id, r, c, v + 2 * e + 4 * s + 8 * se AS code2 FROM (SELECT a.*, lead(v) OVER col AS s, lead(e) OVER col AS se FROM around a WINDOW col AS (PARTITION BY image_id, c ORDER BY r)) q WHERE r < h - 1 AND c < w - 1",
    "codes3": """SELECT image_id, v + 2 * e + 4 * e2 + 8 * s + 16 * se + 32 * se2 + 64 * t + 128 * te + 256 * te2 AS code3 FROM (SELECT a.*, lead(v) OVER col AS s, lead(e) OVER col AS se, lead(e2) OVER col AS se2, lead(v, 2) OVER col AS t, lead(e, 2) OVER col AS te, lead(e2, 2) OVER col AS te2
        FROM (SELECT a.*, lead(v, 2) OVER (PARTITION BY image_id, r ORDER BY c) AS e2 FROM around a) a WINDOW col AS (PARTITION BY image_id, c ORDER BY r)) q WHERE r < h - 2 AND c < w - 2""",
    "transitions": "SELECT image_id, avg(v) AS foreground, avg(CASE WHEN c < w - 1 THEN CAST(v <> e AS DOUBLE) END) AS horizontal, avg(CASE WHEN r < h - 1 THEN CAST(v <> s AS DOUBLE) END) AS vertical FROM (SELECT a.*, lead(v) OVER (PARTITION BY image_id, c ORDER BY r) AS s FROM around a) q GROUP BY image_id",
    # Context of uniform tiles
    "uniform": "SELECT g.image_id, g.br, g.bc, coalesce(b.pat, 0) AS pat FROM (SELECT q.image_id, q.br, CAST(bc AS INT) AS bc FROM (SELECT d.image_id, d.w, CAST(br AS INT) AS br FROM dim d EACH(CAST(floor(d.h / 3) AS INT), br)) q EACH(CAST(floor(q.w / 3) AS INT), bc)) g LEFT JOIN blocks b ON b.image_id = g.image_id AND b.br = g.br AND b.bc = g.bc WHERE coalesce(b.pat, 0) IN (0, 511)",
    "context": """SELECT u.image_id, u.br, u.bc, u.pat, k.x AS i, CASE WHEN o.r IS NULL THEN 0 ELSE 1 END AS v FROM uniform u JOIN dim d ON d.image_id = u.image_id CROSS JOIN RANGE(81) k
        LEFT JOIN ones o ON o.image_id = u.image_id AND o.r = least(greatest(u.br * 3 + 1 + CAST(floor(k.x / 9) AS INT) - 4, 0), d.h - 1) AND o.c = least(greatest(u.bc * 3 + 1 + k.x % 9 - 4, 0), d.w - 1)""",
    "peak_context": """SELECT b.image_id, b.pat AS peak, k.x AS i, avg(CASE WHEN o.r IS NULL THEN 0.0 ELSE 1.0 END) AS mean FROM blocks b JOIN peaks p ON p.image_id = b.image_id AND p.pat = b.pat JOIN dim d ON d.image_id = b.image_id CROSS JOIN RANGE(81) k
        LEFT JOIN ones o ON o.image_id = b.image_id AND o.r = least(greatest(b.br * 3 + 1 + CAST(floor(k.x / 9) AS INT) - 4, 0), d.h - 1) AND o.c = least(greatest(b.bc * 3 + 1 + k.x % 9 - 4, 0), d.w - 1) GROUP BY b.image_id, b.pat, k.x""",
    "context_summary": """SELECT image_id, br, bc, pat, avg(v) AS density, sum(CASE WHEN i % 9 < 8 AND v <> e THEN 1 ELSE 0 END) / 72.0 AS horizontal, sum(CASE WHEN i < 72 AND v <> s THEN 1 ELSE 0 END) / 72.0 AS vertical
        FROM (SELECT x.*, lead(v) OVER (PARTITION BY image_id, br, bc ORDER BY i) AS e, lead(v, 9) OVER (PARTITION BY image_id, br, bc ORDER BY i) AS s FROM context x) q GROUP BY image_id, br, bc, pat""",
    "tile_costs": "SELECT u.image_id, u.br, u.bc, u.pat, k.b AS i, f.cost FROM uniform u CROSS JOIN bits9 k JOIN flip_cost_map f ON f.image_id = u.image_id AND f.r = u.br * 3 + CAST(floor(k.b / 3) AS INT) AND f.c = u.bc * 3 + k.b % 3",
    "best_flip": "SELECT image_id, br, bc, pat, i AS position, cost FROM (SELECT t.*, row_number() OVER (PARTITION BY image_id, br, bc ORDER BY round(cost, 9), i) AS o FROM tile_costs t) q WHERE o = 1",
    # Replacement cost of each bit of a peak: mean flip cost of that pixel over its occurrences
    "bit_costs": "SELECT b.image_id, b.pat AS peak, 8 - k.b AS bit, avg(f.cost) AS cost FROM blocks b JOIN peaks p ON p.image_id = b.image_id AND p.pat = b.pat CROSS JOIN bits9 k JOIN flip_cost_map f ON f.image_id = b.image_id AND f.r = b.br * 3 + CAST(floor(k.b / 3) AS INT) AND f.c = b.bc * 3 + k.b % 3 GROUP BY b.image_id, b.pat, 8 - k.b",
    "candidates": "SELECT image_id, peak, n, zero, dist FROM (SELECT q.*, row_number() OVER (PARTITION BY image_id, peak ORDER BY dist, zero) AS o, count(*) OVER (PARTITION BY image_id, peak) AS k FROM (SELECT p.image_id, p.pat AS peak, p.n, z.pat AS zero, bit_count(XOR(p.pat, z.pat)) AS dist FROM peaks p JOIN zeros z ON z.image_id = p.image_id WHERE bit_count(XOR(p.pat, z.pat)) <= 2) q) w WHERE o <= 16 AND k >= 2",
    "ranker_rows": "SELECT c.image_id, c.peak, c.zero AS candidate, c.dist, sum(b.cost) AS target FROM candidates c JOIN bit_costs b ON b.image_id = c.image_id AND b.peak = c.peak AND (XOR(c.peak, c.zero) & (1 << b.bit)) <> 0 GROUP BY c.image_id, c.peak, c.zero, c.dist",
}

#: The greedy assignment: peaks in rank order each take the smallest absent neighbour that no earlier peak has.
#: A fold over each image's peaks (510 at most) on Spark, a recursion over ranks in the SQL it's held against.
H1_SPARK = """SELECT image_id, inline(aggregate(sort_array(collect_list(struct(rk, peak, n, zs))), named_struct('used', cast(array() AS array<int>), 'made', cast(array() AS array<struct<rk:int,peak:int,zero:int,n:bigint>>)),
    (s, p) -> CASE WHEN size(array_except(p.zs, s.used)) = 0 THEN s ELSE named_struct('used', concat(s.used, array(array_min(array_except(p.zs, s.used)))), 'made', concat(s.made, array(named_struct('rk', p.rk, 'peak', p.peak, 'zero', array_min(array_except(p.zs, s.used)), 'n', p.n)))) END, s -> s.made))
    FROM (SELECT image_id, rk, peak, n, collect_list(zero) AS zs FROM edges GROUP BY image_id, rk, peak, n) q GROUP BY image_id"""
H1_OTHER = """SELECT image_id, rk, peak, zero, n FROM (SELECT image_id, rk, peak, n, used[len(used)] AS zero, took FROM greedy) q WHERE took"""
GREEDY_OTHER = """greedy AS (SELECT image_id, 0 AS rk, CAST(0 AS INT) AS peak, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS used, false AS took FROM dim UNION ALL
    SELECT image_id, rk, peak, n, CASE WHEN z IS NULL THEN used ELSE list_append(used, z) END, z IS NOT NULL FROM (
    SELECT g.image_id, p.rk, p.pat AS peak, p.n, g.used, (SELECT min(e.zero) FROM edges e WHERE e.image_id = g.image_id AND e.rk = p.rk AND NOT list_contains(g.used, e.zero)) AS z FROM greedy g JOIN peaks p ON p.image_id = g.image_id AND p.rk = g.rk + 1) q)"""

#: Steps that Spark runs in another form. A cross join with the nine places of a tile lets Catalyst join tiles and pixels by image alone, which grows with the square of an image; here pixels
#: name their tile. Rows of pixels are dealt out before they're made, as ``dim`` is a few rows in one task.
SPARK_STEPS: dict[str, str] = {
    "px": "SELECT g.image_id, g.r, g.c, CASE WHEN o.r IS NULL THEN 0 ELSE 1 END AS v FROM (SELECT q.image_id, q.r, CAST(c AS INT) AS c FROM (SELECT /*+ REPARTITION(SLICES, image_id, r) */ d.image_id, d.w, CAST(r AS INT) AS r FROM dim d EACH(d.h, r)) q EACH(q.w, c)) g LEFT JOIN ones o ON o.image_id = g.image_id AND o.r = g.r AND o.c = g.c",
    "tile_costs": "SELECT u.image_id, u.br, u.bc, u.pat, f.r % 3 * 3 + f.c % 3 AS i, f.cost FROM flip_cost_map f JOIN uniform u ON u.image_id = f.image_id AND u.br = CAST(floor(f.r / 3) AS INT) AND u.bc = CAST(floor(f.c / 3) AS INT)",
    "bit_costs": """SELECT b.image_id, b.pat AS peak, 8 - f.r % 3 * 3 - f.c % 3 AS bit, avg(f.cost) AS cost FROM flip_cost_map f JOIN blocks b ON b.image_id = f.image_id AND b.br = CAST(floor(f.r / 3) AS INT) AND b.bc = CAST(floor(f.c / 3) AS INT)
        JOIN peaks p ON p.image_id = b.image_id AND p.pat = b.pat GROUP BY b.image_id, b.pat, 8 - f.r % 3 * 3 - f.c % 3""",
}


def _steps(fixture: str, dialect: str = "spark") -> dict[str, str]:
    return {**STEPS, **FIXTURES[fixture], **(SPARK_STEPS | {"h1map": H1_SPARK} if dialect == "spark" else {"h1map": H1_OTHER})}


def sql(final: str, fixture: str = "lineitem", dialect: str = "spark", given: tuple[str, ...] = ()) -> str:
    """``final`` with the steps it needs in front. ``given``: steps that are relations of the caller's (Spark: in braces)."""
    steps = _steps(fixture, dialect)
    if dialect != "spark":
        steps["greedy"] = "edges peaks dim"
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text) if text != "edges peaks dim" else text.split():
            if name in steps and name not in order and name not in given:
                need(steps[name])
                if name not in order:
                    order.append(name)

    need(final)
    parts = [GREEDY_OTHER if name == "greedy" else f"{name} AS ({steps[name]})" for name in order]
    out = (f"WITH {'RECURSIVE ' if 'greedy' in order else ''}" + ",\n".join(parts) + "\n" if parts else "") + final
    if dialect == "spark":
        out = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join([*TABLES, *given]) + r")\b", r"\1 {\2}", out)
        swap = {"XOR": r"(\1 ^ \2)", "AT": r"get(\1, \2)"}
        out = out.replace("LEN(", "size(")
        out = out.replace("DAYS(ts)", "datediff(CAST(ts AS DATE), DATE '2024-01-01')")
        out = re.sub(r"RANGE\((\d+)\)", r"(SELECT CAST(id AS INT) AS x FROM range(\1))", out)
    else:
        swap = {"XOR": r"xor(\1, \2)", "AT": r"(\1)[\2 + 1]"}
        out = out.replace("LEN(", "len(")
        out = re.sub(r"RANGE\((\d+)\)", r"(SELECT CAST(range AS INT) AS x FROM range(\1))", out)
        out = out.replace("AS STRING)", "AS VARCHAR)").replace("DAYS(ts)", "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))").replace("ascii(", "unicode(")
    out = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", out)  # else decimals
    once = r"slice(sequence(0, \1), 1, \1)"
    out = re.sub(r"EACH\(((?:[^(),]|\((?:[^()]|\([^()]*\))*\))+),\s*(\w+)\)", f"LATERAL VIEW explode({once}) each_\\2 AS \\2" if dialect == "spark" else r"CROSS JOIN unnest(range(0, \1)) AS each_\2(\2)", out)
    out = re.sub(r"CHARS\(([\w.]+),\s*(\w+)\)", r"LATERAL VIEW explode(split(\1, '')) each_\2 AS \2" if dialect == "spark" else r"CROSS JOIN unnest(string_split(\1, '')) AS each_\2(\2)", out)
    for name, form in swap.items():
        while re.search(rf"\b{name}\(", out):
            new = re.sub(rf"\b{name}\(((?:[^(),]|\([^()]*\))+),\s*((?:[^(),]|\([^()]*\))+)\)", form, out)
            if new == out:
                raise ValueError(f"{name}() isn't understood")
            out = new
    return out


def needed(final: str, fixture: str, given: tuple[str, ...] = ()) -> list[str]:
    """The steps of ``final`` in order."""
    return re.findall(r"^(?:WITH )?(\w+) AS \(", sql(final, fixture, "spark", given), re.M)


def shared(final: str, fixture: str, given: tuple[str, ...] = ()) -> list[str]:
    """The steps of ``final`` that are read more than once, in order; small constant tables don't count."""
    steps = _steps(fixture)
    chain = needed(final, fixture, given)
    reads = [name for text in [final, *(steps[c] for c in chain)] for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)]
    return [name for name in chain if reads.count(name) > 1 and "VALUES" not in steps[name]]


def run(spark: SparkSession, final: str, sf_dir: str | None = None, fixture: str = "lineitem", **relations: DataFrame) -> DataFrame:
    """``final`` on the tables of ``sf_dir``, or on ``relations`` (ones and dim of any raster, or any other step).

    A step that is read more than once is written once, which cuts the plan of those behind it; all else is one plan for Catalyst.
    """
    for name in shared(final, fixture, tuple(relations)):
        if name in needed(final, fixture, tuple(relations)):
            relations[name] = kept(_one(spark, f"SELECT * FROM {name}", sf_dir, fixture, relations), name)
    return _one(spark, final, sf_dir, fixture, relations)


def _one(spark: SparkSession, final: str, sf_dir: str | None, fixture: str, relations: dict[str, DataFrame]) -> DataFrame:
    text = sql(final, fixture, "spark", tuple(relations))
    used = set(re.findall(r"\{(\w+)\}", text))
    text = text.replace("SLICES", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in used - set(relations)}
    return spark.sql(text, **{name: df for name, df in (tables | relations).items() if name in used})
