"""Every query of the raster operators, by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from rasterlake.operators import analysis, custom, layers, placement, study, sweeps
from rasterlake.plans import steps
from rasterlake.plans.definitions import DEFINITIONS

def _d(expression: str, name: str | None = None) -> str:
    """A double to nine places: sums come in another order on another engine."""
    return f"round(CAST({expression} AS DOUBLE), 9) + 0.0 AS {name or expression.rsplit('.', 1)[-1]}"


def _n(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression.rsplit('.', 1)[-1]}"


#: name: (raster, SELECT over steps). Flags count as 0 or 1.
SELECTS: dict[str, tuple[str, str]] = {
    # Geometry and tiles
    "px_binary": ("embeddings", f"SELECT image_id, {_n('count(*)', 'pixels')}, {_n('sum(v)', 'foreground')}, {_n('sum(v * (r * 7 + c))', 'checksum')} FROM px GROUP BY image_id"),
    "threshold_source": ("lineitem", f"SELECT image_id, {_n('sum(n)', 'pixels')}, {_n('sum(CASE WHEN g >= 110 THEN n ELSE 0 END)', 'foreground')} FROM gray_hist GROUP BY image_id"),
    "blocks": ("lineitem", "SELECT image_id, br, bc, pat FROM blocks"),
    "blocks_events": ("events", "SELECT image_id, br, bc, pat FROM blocks"),
    "pattern_hist": ("lineitem", f"SELECT image_id, pat, {_n('n')} FROM hist"),
    "pattern_hist_dense": ("embeddings", f"SELECT image_id, pat, {_n('n')} FROM hist"),
    "pattern_array": ("lineitem", f"SELECT x AS pat, b, {_n('CASE WHEN (x & (1 << (8 - b))) <> 0 THEN 1 ELSE 0 END', 'v')} FROM RANGE(512) k CROSS JOIN bits9 q"),
    "pattern_hamming": ("lineitem", f"SELECT image_id, peak, zero, {_n('bit_count(XOR(peak, zero))', 'distance')} FROM edges"),
    "uniform_blocks": ("embeddings", "SELECT image_id, br, bc, pat FROM uniform"),
    "usable_peaks": ("lineitem", f"SELECT image_id, pat, {_n('n')}, rk FROM peaks"),
    "pattern_positions": ("embeddings", f"SELECT image_id, pat, {_n('count(*)', 'n')}, {_n('min(br * 100000 + bc)', 'first_at')}, {_n('max(br * 100000 + bc)', 'last_at')} FROM blocks GROUP BY image_id, pat"),
    "zero_set": ("lineitem", "SELECT image_id, pat FROM zeros"),
    "hamming_edges": ("lineitem", f"SELECT image_id, rk, peak, b, zero, {_n('n')} FROM edges"),
    "duplicate_patterns": ("lineitem", f"SELECT image_id, pattern, {_n('count(*)', 'n')} FROM inverse GROUP BY image_id, pattern HAVING count(*) > 1"),
    # Distance-one policy
    "h1_mapping": ("lineitem", f"SELECT image_id, rk, peak, zero, {_n('n')} FROM h1map"),
    "h1_mapping_dense": ("embeddings", f"SELECT image_id, rk, peak, zero, {_n('n')} FROM h1map"),
    "h1_capacity": ("lineitem", f"SELECT image_id, {_n('tables')}, {_n('gross_all')}, {_n('best_tables')}, {_n('gross_bits')}, {_n('wire_bits')}, {_n('net_bits')} FROM capacity"),
    "h1_capacity_events": ("events", f"SELECT image_id, {_n('tables')}, {_n('gross_all')}, {_n('best_tables')}, {_n('gross_bits')}, {_n('wire_bits')}, {_n('net_bits')} FROM capacity"),
    "net_prefix": ("lineitem", f"SELECT image_id, t, peak, zero, {_n('gross')}, {_n('wire_bits')}, {_n('net')} FROM net"),
    "payload_prefix": ("lineitem", f"SELECT image_id, t, peak, {_n('gross')} FROM ranked_h1 WHERE gross - n < 256"),
    "wire_bits_h1": ("lineitem", f"SELECT t, {_n('bits')} FROM wire"),
    "embed_h1": ("lineitem", f"SELECT image_id, br, bc, peak, zero, {_n('i')}, bit FROM embedded"),
    "stego_pixels": ("lineitem", f"SELECT image_id, {_n('count(*)', 'ones')}, {_n('sum(r * 7 + c)', 'checksum')} FROM stego GROUP BY image_id"),
    "modified_blocks": ("lineitem", f"SELECT image_id, {_n('count(*)', 'changed_pixels')}, {_n('sum(was)', 'cleared')} FROM flips GROUP BY image_id"),
    "extract_h1": ("lineitem", f"SELECT image_id, br, bc, peak, bit, {_n('i')} FROM extracted"),
    "roundtrip_flags": ("lineitem", f"SELECT e.image_id, {_n('count(*)', 'bits')}, {_n('sum(CASE WHEN x.bit = e.bit THEN 1 ELSE 0 END)', 'bits_equal')}, {_n('sum(CASE WHEN x.peak = e.peak THEN 1 ELSE 0 END)', 'blocks_restored')} FROM embedded e LEFT JOIN extracted x ON x.image_id = e.image_id AND x.i = e.i AND x.br = e.br AND x.bc = e.bc GROUP BY e.image_id"),
    "psnr": ("lineitem", f"SELECT d.image_id, {_n('coalesce(f.n, 0)', 'changed')}, CASE WHEN f.n IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE round(10 * log10(CAST(d.h AS DOUBLE) * d.w / f.n), 9) END AS psnr_db FROM dim d LEFT JOIN (SELECT image_id, count(*) AS n FROM flips GROUP BY image_id) f ON f.image_id = d.image_id"),
    "drd": ("lineitem", f"SELECT d.image_id, {_n('coalesce(m.n, 0)', 'mixed_blocks')}, {_d('coalesce(f.cost, 0.0) / greatest(coalesce(m.n, 0), 1)', 'drd')} FROM dim d LEFT JOIN (SELECT image_id, sum(cost) AS cost FROM flip_costs GROUP BY image_id) f ON f.image_id = d.image_id LEFT JOIN mixed8 m ON m.image_id = d.image_id"),
    "net_payload": ("lineitem", f"SELECT image_id, {_n('gross_bits - wire_bits', 'net')}, CASE WHEN gross_bits > wire_bits THEN 1 ELSE 0 END AS positive FROM capacity"),
    "flip_cost_map": ("embeddings", f"SELECT image_id, r, c, v, {_d('cost')} FROM flip_cost_map"),
    "drd_kernel": ("lineitem", f"SELECT dr, dc, {_d('wt')} FROM kernel"),
    # Single peak within distance five
    "hn_mapping": ("lineitem", "SELECT image_id, peak, symbol, pattern, bits FROM hn_map"),
    "hn_capacity": ("lineitem", f"SELECT image_id, peak, {_n('n')}, {_n('near')}, bits, {_n('n * bits', 'capacity_bits')} FROM hn_bits"),
    # Opposite pairs of neighbourhood levels
    "level_table": ("lineitem", "SELECT nn, fn, lvl FROM levels"),
    "level_map": ("embeddings", "SELECT image_id, r, c, lvl FROM level_px"),
    "level_profile": ("embeddings", f"SELECT lvl, {_n('n')}, {_d('cost')} FROM profile"),
    "pair_positions": ("embeddings", f"SELECT image_id, first_level, {_n('n1')}, {_n('n2')} FROM pairs"),
    "pair_scores": ("embeddings", f"SELECT image_id, first_level, {_n('capacity')}, {_d('score')} FROM scores"),
    "pair_select": ("embeddings", f"SELECT image_id, first_level, {_n('capacity')}, {_d('score')} FROM selected"),
    "pair_select_payload": ("embeddings", f"SELECT image_id, first_level, {_n('capacity')} FROM (SELECT s.*, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, first_level) AS o FROM scores s WHERE score IS NOT NULL AND capacity >= 100) q WHERE o = 1"),
    "ppocp_roundtrip": ("embeddings", f"SELECT image_id, {_n('count(*)', 'bits')}, {_n('sum(CASE WHEN v <> bit THEN 1 ELSE 0 END)', 'changed')}, {_n('sum(v * (i + 1))', 'originals')} FROM (SELECT p.*, {steps.BIT.format(i='p.i')} AS bit FROM pair_px p) q WHERE i < 100 GROUP BY image_id"),
    # Differences
    "diff_matrix": ("embeddings", "SELECT image_id, r, c, d FROM diff"),
    "inverse_diff": ("embeddings", f"SELECT u.image_id, {_n('count(*)', 'pixels')}, {_n('sum(CASE WHEN u.v = p.v THEN 1 ELSE 0 END)', 'equal')} FROM undone u JOIN px p ON p.image_id = u.image_id AND p.r = u.r AND p.c = u.c GROUP BY u.image_id"),
    "diff_pattern_hist": ("embeddings", f"SELECT image_id, p, {_n('count(*)', 'n')} FROM heads GROUP BY image_id, p"),
    "context_counts_static": ("embeddings", f"SELECT image_id, head, {_n('coalesce(sum(CASE WHEN p = 15 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY head ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING), 0)', 'n15')} FROM heads"),
    "substitutes": ("lineitem", "SELECT p, q FROM subst"),
    # Result facts and their analysis
    "runs_fact": ("lineitem", f"SELECT image, method, payload_bits, available, {_n('net')}, {_d('drd')}, {_n('changed')} FROM runs"),
    "method_summary": ("lineitem", f"SELECT payload_bits, method, {_n('count(*)', 'images')}, {_d('avg(CASE WHEN available THEN 1.0 ELSE 0.0 END)', 'available_fraction')}, {_d('avg(CASE WHEN available THEN net END)', 'mean_net')}, {_d('median(CASE WHEN available THEN net END)', 'median_net')}, {_d('max(CASE WHEN available THEN drd END)', 'max_drd')}, {_d('avg(CASE WHEN available THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END)', 'positive')}, bool_and(NOT available OR drd <= 1) AS all_low FROM runs GROUP BY payload_bits, method"),
    "fraction_summary": ("lineitem", f"SELECT payload_bits, method, {_n('count(*)', 'n')}, {_d('avg(CASE WHEN changed > 0 THEN 10 * log10(1000.0 / changed) END)', 'mean_finite_psnr')}, {_n('sum(CASE WHEN changed = 0 THEN 1 ELSE 0 END)', 'infinite')} FROM runs WHERE available GROUP BY payload_bits, method"),
    "capacity_summary": ("lineitem", f"SELECT {_n('count(*)', 'images')}, {_d('avg(net_bits)', 'mean_net')}, {_d('median(net_bits)', 'median_net')}, {_n('sum(CASE WHEN net_bits > 0 THEN 1 ELSE 0 END)', 'positive')} FROM capacity"),
    "fold_macro": ("lineitem", f"SELECT {_d('avg(m)', 'macro')}, {_d('sum(s) / sum(n)', 'pooled')} FROM (SELECT image, avg(drd) AS m, sum(drd) AS s, count(*) AS n FROM runs WHERE available GROUP BY image) q"),
    "resource_summary": ("lineitem", f"SELECT method, {_d('median(changed)', 'median_changed')}, {_n('max(changed)', 'max_changed')} FROM runs WHERE available GROUP BY method"),
    "drd_reduction": ("lineitem", f"SELECT a.image, a.payload_bits, {_d('CASE WHEN b.drd = 0 THEN 0.0 ELSE 100 * (b.drd - a.drd) / b.drd END', 'reduction')} FROM runs a JOIN runs b ON b.image = a.image AND b.payload_bits = a.payload_bits AND a.method = 'm1' AND b.method = 'm2' AND a.available AND b.available"),
    "matched_cohort": ("lineitem", "SELECT payload_bits, image FROM matched"),
    "matched_curves": ("lineitem", f"SELECT r.payload_bits, r.method, {_n('count(*)', 'n')}, {_d('avg(r.net)', 'mean_net')}, {_d('median(r.net)', 'median_net')}, {_d('median(r.drd)', 'median_drd')} FROM runs r JOIN matched m ON m.payload_bits = r.payload_bits AND m.image = r.image GROUP BY r.payload_bits, r.method"),
    "paired_deltas": ("lineitem", f"SELECT payload_bits, competitor, metric, {_n('count(*)', 'n')}, {_d('median(d)', 'median_delta')}, {_n('sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)', 'wins')}, {_n('sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)', 'ties')} FROM deltas GROUP BY payload_bits, competitor, metric"),
    "wilcoxon_stats": ("lineitem", f"SELECT payload_bits, competitor, metric, {_n('n')}, {_d('w_plus')}, {_d('w_minus')}, {_d('tie_term')} FROM wilcoxon"),
    "wilcoxon_z": ("lineitem", f"SELECT payload_bits, competitor, metric, {_d('z')} FROM z_scores"),
    "wilcoxon_p": ("lineitem", f"SELECT payload_bits, competitor, metric, {_d('p')} FROM p_values"),
    "holm_adjust": ("lineitem", f"SELECT payload_bits, competitor, metric, {_d('p')}, {_d('max(least(1.0, (m - o + 1) * p)) OVER (PARTITION BY payload_bits ORDER BY o ROWS UNBOUNDED PRECEDING)', 'adjusted')} FROM (SELECT payload_bits, competitor, metric, p, row_number() OVER (PARTITION BY payload_bits ORDER BY round(p, 12), competitor, metric) AS o, count(*) OVER (PARTITION BY payload_bits) AS m FROM p_values) q"),
    "strata": ("lineitem", f"SELECT r.payload_bits, r.method, s.suitable, {_n('sum(CASE WHEN r.available THEN 1 ELSE 0 END)', 'n')}, {_n('count(*)', 'images')}, {_d('avg(CASE WHEN r.available THEN r.net END)', 'mean_net')}, {_d('median(CASE WHEN r.available THEN r.drd END)', 'median_drd')} FROM runs r JOIN (SELECT image, avg(drd) > 0.005 AS suitable FROM runs GROUP BY image) s ON s.image = r.image GROUP BY r.payload_bits, r.method, s.suitable"),
    "tradeoff_area": ("lineitem", f"SELECT method, {_d('sum((drd - x) * (net + y) / 2.0)', 'area')} FROM (SELECT method, drd, net, lag(drd) OVER w AS x, lag(net) OVER w AS y FROM (SELECT method, payload_bits, avg(drd) AS drd, avg(net) AS net FROM runs WHERE available GROUP BY method, payload_bits) q WINDOW w AS (PARTITION BY method ORDER BY round(drd, 9), payload_bits)) z WHERE x IS NOT NULL GROUP BY method"),
    "availability": ("lineitem", f"SELECT payload_bits, method, {_d('100 * avg(CASE WHEN available THEN 1.0 ELSE 0.0 END)', 'percent')} FROM runs GROUP BY payload_bits, method"),
    "otsu_threshold": ("lineitem", f"SELECT image_id, {_n('threshold')} FROM otsu"),
    "otsu_suitability": ("lineitem", f"SELECT image_id, {_d('agreement')}, {_d('foreground')}, CASE WHEN agreement >= 0.95 AND foreground BETWEEN 0.05 AND 0.95 THEN 1 ELSE 0 END AS suitable FROM (SELECT g.image_id, sum(CASE WHEN (g.g >= 128) = (g.g >= o.threshold) THEN g.n ELSE 0 END) / CAST(sum(g.n) AS DOUBLE) AS agreement, sum(CASE WHEN g.g >= 128 THEN g.n ELSE 0 END) / CAST(sum(g.n) AS DOUBLE) AS foreground FROM gray_hist g JOIN otsu o ON o.image_id = g.image_id GROUP BY g.image_id) q"),
    "train_test_split": ("lineitem", f"SELECT part, {_n('count(*)', 'n')}, {_n('sum(p_partkey)', 'checksum')} FROM (SELECT p.p_partkey, CASE WHEN t.p_partkey IS NULL THEN 'test' ELSE 'train' END AS part FROM part p LEFT JOIN (SELECT p_partkey FROM part ORDER BY (p_partkey * 1103515245 + 12345) % 1000003, p_partkey LIMIT 100) t ON t.p_partkey = p.p_partkey) q GROUP BY part"),
    "seeded_sample": ("lineitem", "SELECT p_partkey FROM part ORDER BY (p_partkey * 1103515245 + 12345) % 1000003, p_partkey LIMIT 50"),
    "message_bits": ("lineitem", f"SELECT x AS i, {_n(steps.BIT.format(i='x'), 'bit')} FROM RANGE(4096) k"),
    "image_union": ("lineitem", f"SELECT source, {_n('count(*)', 'n')} FROM (SELECT 'blocks' AS source, image_id FROM blocks UNION ALL SELECT 'zeros', image_id FROM zeros) q GROUP BY source"),
    "image_intersect": ("lineitem", "SELECT image FROM runs WHERE method = 'm1' AND available INTERSECT SELECT image FROM runs WHERE method = 'm2' AND available"),
    "image_except": ("lineitem", "SELECT DISTINCT image FROM runs EXCEPT SELECT image FROM matched"),
    # Detector features and learning inputs
    "pattern_hist_2x2": ("embeddings", f"SELECT image_id, code2, {_n('count(*)', 'n')} FROM codes GROUP BY image_id, code2"),
    "pattern_hist_3x3": ("embeddings", f"SELECT image_id, code3, {_n('count(*)', 'n')} FROM codes3 GROUP BY image_id, code3"),
    "transition_rates": ("embeddings", f"SELECT image_id, {_d('foreground')}, {_d('horizontal')}, {_d('vertical')} FROM transitions"),
    "detector_features": ("embeddings", f"""SELECT d.image_id, CAST(k.x AS INT) AS feature, {_d('CASE WHEN k.x = 0 THEN t.foreground WHEN k.x = 1 THEN t.horizontal WHEN k.x = 2 THEN t.vertical WHEN k.x < 19 THEN coalesce(a.n, 0) / CAST((d.h - 1) * (d.w - 1) AS DOUBLE) ELSE coalesce(b.n, 0) / CAST((d.h - 2) * (d.w - 2) AS DOUBLE) END', 'value')}
        FROM dim d CROSS JOIN RANGE(531) k JOIN transitions t ON t.image_id = d.image_id LEFT JOIN (SELECT image_id, code2, count(*) AS n FROM codes GROUP BY image_id, code2) a ON a.image_id = d.image_id AND a.code2 = k.x - 3 LEFT JOIN (SELECT image_id, code3, count(*) AS n FROM codes3 GROUP BY image_id, code3) b ON b.image_id = d.image_id AND b.code3 = k.x - 19"""),
    "context_patches": ("embeddings", f"SELECT image_id, br, bc, i, v FROM context"),
    "average_peak_context": ("embeddings", f"SELECT image_id, peak, i, {_d('mean')} FROM peak_context"),
    "context_features": ("embeddings", f"SELECT image_id, br, bc, pat, {_d('density')}, {_d('horizontal')}, {_d('vertical')} FROM context_summary"),
    "best_uniform_flip": ("embeddings", f"SELECT image_id, br, bc, pat, position, {_d('cost')} FROM best_flip"),
    "uniform_samples": ("embeddings", f"SELECT image_id, br, bc, safe FROM (SELECT q.*, row_number() OVER (PARTITION BY image_id, safe ORDER BY (br * 7919 + bc * 104729) % 10007, br, bc) AS o, sum(safe) OVER (PARTITION BY image_id) AS positives FROM (SELECT image_id, br, bc, CASE WHEN round(cost, 9) <= 0.5 THEN 1 ELSE 0 END AS safe FROM best_flip) q) z WHERE safe = 1 OR o <= 5 * greatest(positives, 1)"),
    "bit_costs": ("embeddings", f"SELECT image_id, peak, bit, {_d('cost')} FROM bit_costs"),
    "ranker_dataset": ("embeddings", f"SELECT image_id, peak, candidate, {_n('dist', 'distance')}, {_d('target')} FROM ranker_rows"),
    "auc_rank": ("embeddings", f"SELECT {_n('sum(pos)', 'positives')}, {_d('(sum(pos * k) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * CAST(sum(n) - sum(pos) AS DOUBLE))', 'auc')} FROM score_ranks"),
    "group_folds": ("embeddings", f"SELECT image_id, CAST((dense_rank() OVER (ORDER BY image_id) - 1) % 5 AS INT) AS fold FROM dim"),
}


def _run(select: tuple[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.run(spark, select[1], sf_dir, select[0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, select) for name, select in SELECTS.items()} | custom.queries() | study.queries() | placement.queries() | layers.queries() | analysis.queries() | sweeps.queries()


def oracle_sql() -> dict[str, str]:
    return {name: steps.sql(text, fixture, "other") for name, (fixture, text) in SELECTS.items()} | study.oracle_sql() | layers.oracle_sql() | DEFINITIONS
