"""DuckDB SQL for the catalogue's queries, on the same tables."""

from __future__ import annotations

SEG = "seg AS (SELECT strftime(ts, '%Y-%m-%d') AS rec, event_id AS ord, (epoch_us(ts) % 86400000000)::DOUBLE / 1e6 AS s, (epoch_us(ts) % 86400000000)::DOUBLE / 1e6 + value AS e, event_type AS spk FROM events)"
HYP = "hyp AS (SELECT rec, ord, s + (ord % 5)::DOUBLE * 0.4::DOUBLE AS s, e + (ord % 5)::DOUBLE * 0.4::DOUBLE AS e, CASE WHEN ord % 11 = 0 THEN 'click' ELSE spk END AS spk FROM seg WHERE ord % 7 <> 0)"
PAIRS = "pairs AS (SELECT a.rec, a.ord AS a, b.ord AS b, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM seg a JOIN seg b ON a.rec = b.rec AND a.ord < b.ord AND a.spk <> b.spk AND a.s < b.e AND b.s < a.e AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5)"
POINTS = "points AS (SELECT rec, ord, s + 1.5::DOUBLE AS t FROM seg)"


def islands(name: str, source: str, by: str = "rec", gap: str = "0") -> str:
    """Merged intervals of ``source`` as the views name_1, name_2 and name."""
    return f"""{name}_1 AS (SELECT {by}, s, e, CASE WHEN s > max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}::DOUBLE THEN 1
  WHEN row_number() OVER (PARTITION BY {by} ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS fresh FROM {source}),
{name}_2 AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_1),
{name} AS (SELECT {by}, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}_2 GROUP BY {by}, island)"""


REGIONS = islands("merged", "pairs") + ", regions AS (SELECT * FROM merged WHERE e - s >= 0.5)"
CHANGES = "SELECT rec, ord, s AS ts FROM (SELECT *, lag(spk) OVER (PARTITION BY rec ORDER BY s, ord) AS b FROM {0}) WHERE spk <> b"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * ({a}) / ({b}) END)"


def frames(name: str, source: str, widen: int = 0) -> str:
    cells = f"{name}_0 AS (SELECT rec, greatest(floor(s / 0.01::DOUBLE)::BIGINT{f' - {widen}' if widen else ''}, {0 if widen else -1000000000}) AS s, floor(e / 0.01::DOUBLE)::BIGINT{f' + {widen}' if widen else ''} AS e FROM {source} WHERE floor(e / 0.01::DOUBLE) > floor(s / 0.01::DOUBLE))"
    return cells + ", " + islands(name, f"{name}_0")


def frame_counts(widen: int) -> str:
    return f"""WITH {SEG}, {HYP}, {frames('t', 'seg')}, {frames('p', 'hyp')}, {frames('w', 'seg', widen)},
tp AS (SELECT w.rec, sum(least(w.e, p.e) - greatest(w.s, p.s)) AS tp FROM w JOIN p ON w.rec = p.rec AND w.s < p.e AND p.s < w.e GROUP BY 1),
hit AS (SELECT t.rec, sum(least(t.e, p.e) - greatest(t.s, p.s)) AS hit FROM t JOIN p ON t.rec = p.rec AND t.s < p.e AND p.s < t.e GROUP BY 1),
np AS (SELECT rec, sum(e - s) AS np FROM p GROUP BY 1), nt AS (SELECT rec, sum(e - s) AS nt FROM t GROUP BY 1),
c AS (SELECT rec, coalesce(tp, 0)::BIGINT AS tp, (coalesce(np, 0) - coalesce(tp, 0))::BIGINT AS fp, (coalesce(nt, 0) - coalesce(hit, 0))::BIGINT AS fn
  FROM (SELECT DISTINCT rec FROM seg) LEFT JOIN tp USING (rec) LEFT JOIN hit USING (rec) LEFT JOIN np USING (rec) LEFT JOIN nt USING (rec)),
x AS (SELECT *, {pct('tp', 'tp + fp')} AS p, {pct('tp', 'tp + fn')} AS r FROM c)
SELECT rec, tp, fp, fn, round(p, 6) AS precision_pct, round(r, 6) AS recall_pct, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * p * r / (p + r) END, 6) AS f1_pct FROM x"""


UNIT = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), elements AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM vec)"
CENTRES = UNIT + """, cent AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM elements GROUP BY 1, 2), c AS (SELECT label AS name, list(x ORDER BY pos) AS w FROM cent GROUP BY 1),
scored AS (SELECT vec_id, name, list_cosine_similarity(v, w) AS score FROM vec, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS r FROM scored),
matches AS (SELECT vec_id, max(name) FILTER (r = 1) AS best, max(score) FILTER (r = 1) AS score, max(score) FILTER (r = 2) AS second FROM ranked GROUP BY 1)"""
TOKENS = "list_filter(regexp_split_to_array(trim(text, chr(32)), '\\s+'), lambda t: t <> '')"
MODEL = "runs AS (SELECT l_returnflag || l_linestatus AS model, l_returnflag AS flag, l_linestatus AS status, l_orderkey AS file_id, l_linenumber AS ord, l_extendedprice AS price, l_discount AS discount, l_quantity AS quantity FROM lineitem)"

CELLS = f"""WITH {SEG}, {HYP}, u AS (SELECT rec, s, e, spk, 0 AS side FROM seg UNION ALL SELECT rec, s, e, spk, 1 FROM hyp),
t AS (SELECT DISTINCT rec, t FROM (SELECT rec, s AS t FROM u UNION ALL SELECT rec, e FROM u)),
k AS (SELECT rec, t AS s, lead(t) OVER (PARTITION BY rec ORDER BY t) AS e FROM t),
inside AS (SELECT k.rec, k.s, k.e, u.side, u.spk FROM k JOIN u ON k.rec = u.rec AND u.s < k.e AND k.s < u.e WHERE k.e IS NOT NULL),
cells AS (SELECT rec, s, e, count(DISTINCT spk) FILTER (side = 0) AS r, count(DISTINCT spk) FILTER (side = 1) AS h FROM inside GROUP BY 1, 2, 3)"""
DER = """SELECT rec, round(sum(d * r), 6) AS total, round(sum(d * greatest(r - h, 0)), 6) AS miss, round(sum(d * greatest(h - r, 0)), 6) AS false_alarm, round(sum(d * (least(r, h) - ok)), 6) AS confusion,
round(CASE WHEN sum(d * r) > 0 THEN 100.0::DOUBLE * (sum(d * greatest(r - h, 0)) + sum(d * greatest(h - r, 0)) + sum(d * (least(r, h) - ok))) / sum(d * r) ELSE 0.0::DOUBLE END, 6) AS der_pct FROM z GROUP BY 1"""

RATES = f"""t AS (SELECT conv_id::VARCHAR AS file, turn AS chunk, role = 'user' AS speech, {TOKENS} AS raw FROM conversations),
p AS (SELECT *, list_filter(list_transform(raw, lambda t: regexp_replace(lower(t), '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$', '', 'g')), lambda t: t <> '') AS w FROM t),
f AS (SELECT file, count(*) AS responses, avg(speech::INT) AS has_speech_rate, flatten(list(w ORDER BY chunk)) AS w, sum(len(raw)) AS n_raw, sum(len(list_filter(raw, lambda t: contains(t, '...')))) AS dots, sum((len(raw) > 0)::INT) AS snippets, sum((len(raw) > 0 AND len(w) <= 2)::INT) AS short FROM p GROUP BY file),
rates AS (SELECT file, responses, len(w)::BIGINT AS total_words, has_speech_rate,
  CASE WHEN len(w) < 2 THEN 0.0::DOUBLE ELSE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::DOUBLE / (len(w) - 1) END AS adj_dup_rate,
  CASE WHEN len(w) < 6 THEN 0.0::DOUBLE ELSE (len(w) - 2 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))))::DOUBLE / (len(w) - 2) END AS trigram_repeat_rate,
  dots::DOUBLE / greatest(n_raw, 1) AS ellipsis_token_rate, short::DOUBLE / greatest(snippets, 1) AS short_snippet_rate FROM f)"""
RATE_NAMES = ("has_speech_rate", "adj_dup_rate", "trigram_repeat_rate", "ellipsis_token_rate", "short_snippet_rate")

def lloyd_sql(k: int, passes: int) -> str:
    """Clusters after ``passes`` rounds from the first ``k`` vectors."""
    near = lambda n: f"a{n} AS (SELECT vec_id, v, cl FROM (SELECT u.vec_id, u.v, c.cl, row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_distance(u.v, c.v) ** 2, 12), c.cl) AS i FROM u CROSS JOIN c{n} c) WHERE i = 1)"
    mean = lambda n: f"m{n} AS (SELECT cl, list(x ORDER BY pos) AS v FROM (SELECT cl, pos, avg(x) AS x FROM (SELECT cl, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{n}) GROUP BY cl, pos) GROUP BY cl), c{n + 1} AS (SELECT c.cl, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (cl))"
    steps = [x for n in range(passes) for x in (near(n), mean(n))]
    return f"WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cl, v FROM u WHERE vec_id < {k}), {', '.join([*steps, near(passes)])} SELECT vec_id, cl::INTEGER AS cluster FROM a{passes}"


SQL = {
    "q01_overlap_regions": f"WITH {SEG}, {PAIRS}, {REGIONS} SELECT rec, count(*) AS n_regions, round(sum(e - s), 6) AS seconds FROM regions GROUP BY 1",
    "q02_mask_intersection": f"WITH {SEG}, {HYP}, {islands('m', 'hyp')} SELECT seg.rec, ord, round(greatest(seg.s, m.s), 6) AS s, round(least(seg.e, m.e), 6) AS e, round(least(seg.e, m.e) - greatest(seg.s, m.s), 6) AS dur FROM seg JOIN m ON seg.rec = m.rec AND seg.s < m.e AND m.s < seg.e",
    "q03_segment_text": f"WITH {SEG}, {HYP} SELECT seg.rec, seg.ord, count(hyp.ord) AS n, string_agg(hyp.spk, ' ' ORDER BY hyp.ord) AS text FROM seg LEFT JOIN hyp ON seg.rec = hyp.rec AND seg.s < hyp.e AND hyp.s < seg.e GROUP BY 1, 2",
    "q04_first_overlap_region": f"WITH {SEG}, {PAIRS}, {REGIONS} SELECT rec, ord, round(rs, 6) AS region_s, round(re, 6) AS region_e FROM (SELECT seg.rec, seg.ord, r.s AS rs, r.e AS re, row_number() OVER (PARTITION BY seg.rec, seg.ord ORDER BY r.s) AS k FROM seg LEFT JOIN regions r ON seg.rec = r.rec AND seg.s < r.e AND r.s < seg.e) WHERE k = 1",
    "q05_speaker_at_time": f"WITH {SEG}, {POINTS} SELECT rec, ord, coalesce(spk, 'unknown') AS spk FROM (SELECT p.rec, p.ord, seg.spk, row_number() OVER (PARTITION BY p.rec, p.ord ORDER BY seg.ord DESC NULLS LAST) AS k FROM points p LEFT JOIN seg ON p.rec = seg.rec AND p.t >= seg.s AND p.t <= seg.e) WHERE k = 1",
    "q06_padded_lookup": f"WITH {SEG}, {PAIRS}, {POINTS} SELECT rec, ord, a, b FROM (SELECT p.rec, p.ord, q.a, q.b, row_number() OVER (PARTITION BY p.rec, p.ord ORDER BY q.s, q.a, q.b) AS k FROM points p LEFT JOIN pairs q ON p.rec = q.rec AND p.t >= q.s - 0.25::DOUBLE AND p.t <= q.e + 0.1::DOUBLE) WHERE k = 1",
    "q07_active_speakers": f"WITH {SEG} SELECT a.rec, a.ord, string_agg(DISTINCT b.spk, ',' ORDER BY b.spk) AS speakers FROM seg a LEFT JOIN seg b ON a.rec = b.rec AND b.s < a.e AND b.e > a.s - 2.0::DOUBLE GROUP BY 1, 2",
    "q08_nearest_region": f"WITH {SEG}, {HYP}, {PAIRS}, {REGIONS}, x AS (SELECT h.rec, h.ord, r.s, abs(h.s - r.s) + abs(h.e - r.e) AS dist FROM hyp h JOIN regions r ON h.rec = r.rec AND abs(h.s - r.s) + abs(h.e - r.e) < 1.0) SELECT rec, ord, round(dist, 6) AS dist, round(s, 6) AS region_s FROM (SELECT *, row_number() OVER (PARTITION BY rec, ord ORDER BY dist, s) AS k FROM x) WHERE k = 1",
    "q09_merge": f"WITH {SEG}, {islands('m', 'seg')} SELECT rec, round(s, 6) AS s, round(e, 6) AS e, n FROM m",
    "q09b_merge_same_speaker": f"WITH {SEG}, t AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec ORDER BY s, ord) THEN 0 ELSE 1 END AS turn FROM seg), u AS (SELECT *, sum(turn) OVER (PARTITION BY rec ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS run FROM t), {islands('m', 'u', 'rec, run, spk', '0.1')} SELECT rec, spk, round(s, 6) AS s, round(e, 6) AS e, n FROM m",
    "q09c_close_silences": f"WITH {SEG}, {islands('m', 'seg')}, a AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY rec ORDER BY s) < 60 THEN 0 ELSE 1 END AS fresh2 FROM m), b AS (SELECT *, sum(fresh2) OVER (PARTITION BY rec ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT rec, round(min(s), 6) AS s, round(max(e), 6) AS e, count(*) AS n FROM b GROUP BY rec, i",
    "q10_change_points": f"WITH {SEG} SELECT rec, ord, round(ts, 6) AS ts FROM ({CHANGES.format('seg')})",
    "q10b_boundaries": f"WITH {SEG}, t AS (SELECT DISTINCT rec, ts FROM (SELECT rec, ts FROM ({CHANGES.format('seg')}) UNION ALL SELECT rec, 0.0::DOUBLE FROM seg UNION ALL SELECT rec, max(e) FROM seg GROUP BY 1)) SELECT rec, round(ts, 6) AS s, round(e, 6) AS e FROM (SELECT rec, ts, lead(ts) OVER (PARTITION BY rec ORDER BY ts) AS e FROM t) WHERE e IS NOT NULL",
    "q10c_segment_ends": f"WITH {SEG} SELECT rec, ord, round(e, 6) AS ts FROM (SELECT *, max(ord) OVER (PARTITION BY rec) AS last FROM seg) WHERE ord < last",
    "q11_change_points_skip_overlap": f"WITH {SEG}, {PAIRS}, free AS (SELECT * FROM seg WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.rec = seg.rec AND (p.a = seg.ord OR p.b = seg.ord))) SELECT rec, ord, round(ts, 6) AS ts FROM ({CHANGES.format('free')})",
    "q12_min_gap_thinning": f"WITH RECURSIVE {SEG}, kept AS (SELECT rec, min(s) AS ts FROM seg GROUP BY 1 UNION ALL SELECT rec, nxt FROM (SELECT k.rec, (SELECT min(seg.s) FROM seg WHERE seg.rec = k.rec AND seg.s - k.ts >= 600.0::DOUBLE) AS nxt FROM kept k) WHERE nxt IS NOT NULL) SELECT rec, round(ts, 6) AS ts FROM kept",
    "q13_hysteresis": "WITH f AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ix, value / 500.0::DOUBLE AS score FROM events), a AS (SELECT *, coalesce(last_value(CASE WHEN score >= 0.15 THEN 1 WHEN score < 0.08 THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING), 0) AS is_on FROM f), b AS (SELECT *, CASE WHEN is_on = 1 AND coalesce(lag(is_on) OVER (PARTITION BY rec ORDER BY ix), 0) = 0 THEN 1 ELSE 0 END AS fresh FROM a), c AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY ix ROWS UNBOUNDED PRECEDING) AS i FROM b) SELECT rec, min(ix)::BIGINT AS first, max(ix)::BIGINT AS last, count(*) AS n FROM c WHERE is_on = 1 GROUP BY rec, i",
    "q14_sweep": f"WITH {SEG}, t AS (SELECT rec, t, sum(d) AS d FROM (SELECT rec, s AS t, 1 AS d FROM seg UNION ALL SELECT rec, e, -1 FROM seg) GROUP BY 1, 2), k AS (SELECT rec, t AS s, lead(t) OVER (PARTITION BY rec ORDER BY t) AS e, sum(d) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS depth FROM t) SELECT rec, max(depth)::BIGINT AS depth, round(sum(CASE WHEN depth >= 2 THEN e - s ELSE 0.0::DOUBLE END), 6) AS seconds FROM k WHERE e IS NOT NULL GROUP BY 1",
    "q15_run_lengths": f"WITH {SEG}, t AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec ORDER BY s, ord) THEN 0 ELSE 1 END AS turn FROM seg), u AS (SELECT *, sum(turn) OVER (PARTITION BY rec ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS run FROM t), g AS (SELECT rec, run, spk, min(s) AS s, max(e) AS e0, count(*) AS n, avg(e - s) AS mean FROM u GROUP BY 1, 2, 3) SELECT rec, spk, round(s, 6) AS s, round(coalesce(lead(s) OVER (PARTITION BY rec ORDER BY run), max(e0) OVER (PARTITION BY rec)), 6) AS e, n, round(mean, 6) AS mean FROM g",
    "q16_frame_prf": frame_counts(0),
    "q17_frame_prf_tolerant": frame_counts(50),
    "q18_change_point_prf": f"""WITH {SEG}, {HYP}, t AS ({CHANGES.format('seg')}), p AS ({CHANGES.format('hyp')}),
tp AS (SELECT rec, count(DISTINCT ts) AS tp FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.rec = p.rec AND abs(t.ts - p.ts) <= 0.5) GROUP BY 1), a AS (SELECT rec, count(*) AS n_pred FROM p GROUP BY 1), b AS (SELECT rec, count(*) AS n_ref FROM t GROUP BY 1),
c AS (SELECT rec, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_ref, 0) AS n_ref FROM (SELECT rec FROM p UNION SELECT rec FROM t) LEFT JOIN tp USING (rec) LEFT JOIN a USING (rec) LEFT JOIN b USING (rec)),
x AS (SELECT *, 100.0::DOUBLE * tp / greatest(n_pred, 1) AS p, 100.0::DOUBLE * tp / greatest(n_ref, 1) AS r FROM c)
SELECT rec, tp, n_pred, n_ref, round(CASE WHEN n_ref = 0 AND n_pred > 0 THEN 0.0::DOUBLE WHEN n_pred = 0 THEN 100.0::DOUBLE ELSE p END, 6) AS precision_pct, round(CASE WHEN n_ref = 0 THEN 100.0::DOUBLE WHEN n_pred = 0 THEN 0.0::DOUBLE ELSE r END, 6) AS recall_pct,
round(CASE WHEN n_ref = 0 AND n_pred = 0 THEN 100.0::DOUBLE WHEN n_ref = 0 OR n_pred = 0 OR p + r = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * p * r / (p + r) END, 6) AS f1_pct FROM x""",
    "q21_max_overlap_label": f"WITH {SEG}, {HYP}, x AS (SELECT h.rec, h.ord, h.spk, seg.spk AS t, row_number() OVER (PARTITION BY h.rec, h.ord ORDER BY least(h.e, seg.e) - greatest(h.s, seg.s) DESC NULLS LAST, seg.ord) AS k FROM hyp h LEFT JOIN seg ON h.rec = seg.rec AND h.s < seg.e AND seg.s < h.e) SELECT spk, coalesce(t, 'none') AS true_spk, count(*) AS n FROM x WHERE k = 1 GROUP BY 1, 2",
    "q22_der_by_name": f"{CELLS}, same AS (SELECT a.rec, a.s, count(DISTINCT a.spk) AS ok FROM inside a JOIN inside b ON a.rec = b.rec AND a.s = b.s AND a.side = 0 AND b.side = 1 AND a.spk = b.spk GROUP BY 1, 2), z AS (SELECT rec, e - s AS d, r, h, coalesce(ok, 0) AS ok FROM cells LEFT JOIN same USING (rec, s)) {DER}",
    "q24_speech_share": f"WITH {SEG}, t AS (SELECT rec, spk, sum(e - s) AS total FROM seg GROUP BY 1, 2) SELECT rec, spk, round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY rec), 6) AS share FROM t",
    "q25_model_rollup": f"WITH {MODEL} SELECT model, round(avg(price), 4) AS price_mean, round(stddev_pop(price), 4) AS price_std, round(sum(price), 4) AS price_total, round(avg(discount), 4) AS discount_mean, round(stddev_pop(discount), 4) AS discount_std, round(sum(discount), 4) AS discount_total, count(price) AS price_n, count(discount) AS discount_n FROM runs GROUP BY 1",
    "q26_ranking": f"WITH {MODEL}, m AS (SELECT model, round(avg(price), 4) AS mean FROM runs GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mean, model) AS rank FROM m), b AS (SELECT model, file_id * 10 + ord AS best_row, row_number() OVER (PARTITION BY model ORDER BY price DESC, file_id * 10 + ord) AS i FROM runs) SELECT model, mean, rank, best_row FROM k JOIN b USING (model) WHERE rank <= 3 AND i = 1",
    "q27_pivot_mean": f"WITH {MODEL} SELECT flag, round(avg(discount) FILTER (status = 'F'), 6) AS mean_f, round(avg(discount) FILTER (status = 'O'), 6) AS mean_o FROM runs GROUP BY 1",
    "q28_capped_sample": f"WITH {SEG}, k AS (SELECT spk, ord, e - s AS len, row_number() OVER (PARTITION BY spk ORDER BY e - s DESC, ord) AS rank FROM seg WHERE e - s >= 1.0) SELECT spk, ord, round(len, 6) AS len, rank FROM k WHERE rank <= 20",
    "q29_config_sweep": f"WITH {MODEL}, c AS (SELECT * FROM (VALUES ('AF'), ('NF'), ('NO'), ('RF')) a(model), (VALUES (1::BIGINT), (2), (3)) b(size), (VALUES ('a'), ('b')) c(mode)) SELECT model, size, mode FROM c WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.model = c.model AND ord % 4 = size AND ord < 3 AND runs.model <> 'NF')",
    "q30_centroids": f"WITH {UNIT} SELECT label, count(*) AS n, pos::BIGINT AS pos, round(avg(x), 9) AS x FROM elements GROUP BY label, pos",
    "q31_naming": f"WITH {CENTRES} SELECT vec_id, CASE WHEN score > 0.4 THEN best::VARCHAR ELSE 'SPEAKER_' || vec_id END AS speaker, round(score, 6) AS score FROM matches",
    "q31b_fresh_labels": f"WITH {CENTRES} SELECT vec_id, (CASE WHEN score < 0.4 THEN 9 + row_number() OVER (PARTITION BY score < 0.4 ORDER BY vec_id) ELSE best END)::BIGINT AS assigned FROM matches",
    "q32_leave_one_out": f"WITH {UNIT}, sums AS (SELECT label, pos, sum(x) AS x, count(*) AS n FROM elements GROUP BY 1, 2), c AS (SELECT label AS other, max(n) AS n, list(x ORDER BY pos) AS w FROM sums GROUP BY 1), scored AS (SELECT vec_id, label, other, list_cosine_similarity(CASE WHEN label = other THEN list_transform(list_zip(w, v), lambda z: z[1] - z[2]) ELSE w END, v) AS score FROM vec, c WHERE label <> other OR n > 1), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, other) AS r FROM scored) SELECT label, count(*) AS n, round(avg((label = other)::INT::DOUBLE), 6) AS accuracy FROM k WHERE r = 1 GROUP BY 1",
    "q33_top2_margin": f"WITH {CENTRES} SELECT vec_id, best, score >= 0.21 AND score - coalesce(second, 0) >= 0.09 AS accepted, round(score - second, 6) AS margin FROM matches",
    "q34_cosine_silhouette": f"WITH {UNIT}, far AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - list_cosine_similarity(a.v, b.v)) AS d, count(*) AS n FROM vec a JOIN vec b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), sides AS (SELECT vec_id, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM far GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides GROUP BY 1",
    "q35_adjusted_rand": f"WITH {CENTRES}, l AS (SELECT label AS a, best AS b FROM vec JOIN matches USING (vec_id)), ij AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ij, sum(n) AS n FROM (SELECT count(*)::DOUBLE AS n FROM l GROUP BY a, b)), i AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS i FROM (SELECT count(*)::DOUBLE AS n FROM l GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS j FROM (SELECT count(*)::DOUBLE AS n FROM l GROUP BY b)) SELECT n::BIGINT AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM ij, i, j",
    "q36_components": f"WITH RECURSIVE {UNIT}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.6), reach AS (SELECT vec_id AS id, vec_id AS o FROM vec UNION SELECT p.b, reach.o FROM reach JOIN p ON p.a = reach.id), c AS (SELECT id AS vec_id, min(o) AS component FROM reach GROUP BY 1) SELECT vec_id, component, count(*) OVER (PARTITION BY component) = 1 AS is_noise FROM c",
    "q40_repetition": f"WITH w AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(w) < 2 THEN 0.0::DOUBLE ELSE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::DOUBLE / (len(w) - 1) END, 6) AS adjacent, round(CASE WHEN len(w) < 6 THEN 0.0::DOUBLE ELSE (len(w) - 2 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))))::DOUBLE / (len(w) - 2) END, 6) AS trigram, len(list_filter(w, lambda t: contains(t, '...')))::BIGINT AS ellipses FROM w",
    "q41_repeat_squash": f"WITH w AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(len(w))) AS pos FROM w), p AS (SELECT *, regexp_replace(lower(w), '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$', '', 'g') AS p FROM u), b AS (SELECT *, lag(p) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS b FROM p) SELECT conv_id, turn, count(*) AS n, string_agg(w, ' ' ORDER BY pos) AS text FROM b WHERE NOT coalesce(p = b AND p <> '' AND length(p) <= 4, false) GROUP BY 1, 2",
    "q42_word_attribution": f"WITH {SEG}, w AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), u AS (SELECT conv_id, turn, len(w) AS n, unnest(range(len(w))) AS pos FROM w), day AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events), t AS (SELECT strftime(a + (conv_id % (b - a + 1))::INTEGER, '%Y-%m-%d') AS rec, conv_id, turn, pos, (conv_id * 100 + turn * 30)::DOUBLE % 86400.0::DOUBLE + (pos + 0.5::DOUBLE) * 30.0::DOUBLE / n AS t FROM u, day), h AS (SELECT t.conv_id, t.turn, t.pos, seg.spk, row_number() OVER (PARTITION BY t.conv_id, t.turn, t.pos ORDER BY seg.ord DESC NULLS LAST) AS k FROM t LEFT JOIN seg ON t.rec = seg.rec AND t.t >= seg.s AND t.t <= seg.e) SELECT conv_id, turn, coalesce(spk, 'unknown') AS spk, count(*) AS n FROM h WHERE k = 1 GROUP BY 1, 2, 3",
    "q43_word_bubbles": f"WITH t AS (SELECT conv_id, turn, role, {TOKENS} AS w, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations), r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM t), u AS (SELECT conv_id, run, role, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM r), b AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id, run ORDER BY turn, pos) - 1) // 18)::BIGINT AS bubble FROM u) SELECT conv_id, run, role, bubble, count(*) AS n, string_agg(word, ' ' ORDER BY turn, pos) AS text FROM b GROUP BY 1, 2, 3, 4",
    "q44_backfill": f"WITH {SEG}, x AS (SELECT rec, ord, s, CASE WHEN ord % 4 <> 0 THEN spk END AS spk FROM seg) SELECT rec, ord, coalesce(first_value(spk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY s, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(spk IGNORE NULLS) OVER (PARTITION BY rec ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS spk FROM x",
    "q45_prompt_worthy": f"SELECT conv_id, turn, NOT contains(text, '...') AND len({TOKENS}) >= 3 AND (regexp_matches(trim(text, chr(32)), '[.!?]$') OR len({TOKENS}) >= 6) AS worthy FROM conversations",
    "q45b_confidence": "SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value / 500.0::DOUBLE - 0.05::DOUBLE) / (0.35::DOUBLE - 0.05::DOUBLE))), 6) AS confidence FROM events",
    "q46_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "q46b_sliding": "WITH w AS (SELECT date_trunc('hour', ts) AS start, value FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, value FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1",
    "q47_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM b GROUP BY user_id, i",
    "q50_si_sdr": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS x0, b.v AS r0 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
c AS (SELECT vec_id, x0, r0, list_transform(x0, lambda t: t - list_avg(x0)) AS x, list_transform(r0, lambda t: t - list_avg(r0)) AS r FROM p), g AS (SELECT *, list_dot_product(r, r) AS energy, list_dot_product(x, r) / list_dot_product(r, r) AS gain FROM c),
h AS (SELECT vec_id, x0, r0, energy * gain * gain AS target, list_sum(list_transform(list_zip(x, r), lambda z: (z[1] - gain * z[2]) * (z[1] - gain * z[2]))) AS rest FROM g)
SELECT vec_id, round(CASE WHEN rest < 1e-8 THEN 'inf'::DOUBLE ELSE 10.0::DOUBLE * log10(target / rest) END, 6) AS si_sdr, round(list_cosine_similarity(x0, r0), 6) AS cosine FROM h""",
}

SCORES = """f AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ix, value / 500.0::DOUBLE AS a, (event_id * 7 % 500)::DOUBLE / 500.0::DOUBLE AS b, (event_id * 13 % 500)::DOUBLE / 500.0::DOUBLE AS c FROM events)"""
CLASSES = """SELECT sum(nt)::BIGINT AS n, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * nt) / sum(nt), 6) AS weighted_precision,
round(sum(r * nt) / sum(nt), 6) AS weighted_recall, round(sum(f * nt) / sum(nt), 6) AS weighted_f1 FROM (SELECT nt, CASE WHEN np = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / np END AS p, CASE WHEN nt = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / nt END AS r,
CASE WHEN np + nt = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (np + nt) END AS f FROM (SELECT c, count(*) FILTER (side = 0) AS nt, count(*) FILTER (side = 1) AS np, count(*) FILTER (side = 2) AS tp FROM
(SELECT label AS c, 0 AS side FROM l UNION ALL SELECT best, 1 FROM l UNION ALL SELECT label, 2 FROM l WHERE label = best) GROUP BY 1))"""

SQL |= {
    "q51_min_duration": f"WITH {SEG} SELECT rec, ord, trunc(s * 16000.0::DOUBLE)::BIGINT AS first, trunc(e * 16000.0::DOUBLE)::BIGINT AS last FROM seg WHERE trunc(e * 16000.0::DOUBLE)::BIGINT - trunc(s * 16000.0::DOUBLE)::BIGINT >= 8000",
    "q52_signal_windows": f"""WITH {SEG}, d AS (SELECT rec, max(e) AS dur FROM seg GROUP BY 1), w AS (SELECT *, CASE WHEN dur >= 600 THEN floor((dur - 600.0::DOUBLE) / 300.0::DOUBLE)::BIGINT + 1 ELSE 0 END AS whole FROM d), n AS (SELECT *, unnest(range(whole + 1)) AS n FROM w)
SELECT rec, n, round(n * 300.0::DOUBLE, 6) AS s, round(least(n * 300.0::DOUBLE + 600.0::DOUBLE, dur), 6) AS e FROM n WHERE n < whole OR dur - whole * 300.0::DOUBLE > 300""",
    "q53_several_active": f"""WITH {SCORES}, x AS (SELECT rec, ix, (a >= 0.3)::INT + (b >= 0.3)::INT + (c >= 0.3)::INT > 1 AS is_on FROM f), y AS (SELECT *, ix - row_number() OVER (PARTITION BY rec ORDER BY ix) AS i FROM x WHERE is_on)
SELECT rec, min(ix) AS first, max(ix) AS last, count(*) AS n FROM y GROUP BY rec, i""",
    "q54_class_probability": f"WITH {SCORES} SELECT rec, ix, round(b + c, 6) AS score FROM f",
    "q55_change_score": f"""WITH {SCORES}, x AS (SELECT rec, ix, coalesce(abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w), 0.0::DOUBLE) AS d FROM f WINDOW w AS (PARTITION BY rec ORDER BY ix)),
y AS (SELECT *, max(d) OVER (PARTITION BY rec) AS top FROM x) SELECT rec, ix, round(CASE WHEN top > 0 THEN d / top ELSE 0.0::DOUBLE END, 6) AS score FROM y""",
    "q55b_change_score_logs": f"""WITH {SCORES.replace("f AS", "g AS")}, f AS (SELECT rec, ix, (a + 0.01::DOUBLE) / 1.01::DOUBLE AS a, (b + 0.01::DOUBLE) / 1.01::DOUBLE AS b, (c + 0.01::DOUBLE) / 1.01::DOUBLE AS c FROM g), x AS (SELECT rec, ix, coalesce(abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w), 0.0::DOUBLE) AS d FROM f WINDOW w AS (PARTITION BY rec ORDER BY ix)),
y AS (SELECT *, max(d) OVER (PARTITION BY rec) AS top FROM x) SELECT rec, ix, round(CASE WHEN top > 0 THEN d / top ELSE 0.0::DOUBLE END, 6) AS score FROM y""",
    "q56_class_scores": f"WITH {CENTRES}, l AS (SELECT label, best FROM vec JOIN matches USING (vec_id)) {CLASSES}",
    "q57_similarity": f"WITH {CENTRES} SELECT (SELECT round(avg(list_cosine_similarity(v, w)), 6) FROM vec JOIN c ON label = name) AS intra, (SELECT round(avg(list_cosine_similarity(a.w, b.w)), 6) FROM c a JOIN c b ON a.name < b.name) AS inter",
    "q58_named_clusters": f"""WITH {UNIT}, cent AS (SELECT label, pos, avg(x) AS x FROM elements GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS v FROM cent GROUP BY 1), reg AS (SELECT vec_id % 7 AS name, pos, avg(x) AS x FROM elements GROUP BY 1, 2),
r AS (SELECT name, list(x ORDER BY pos) AS w FROM reg GROUP BY 1), k AS (SELECT label, name, list_cosine_similarity(v, w) AS score, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(v, w) DESC, name) AS i FROM c, r)
SELECT label, CASE WHEN score > 0.3 THEN name::VARCHAR ELSE 'SPEAKER_' || label END AS speaker, round(score, 6) AS score FROM k WHERE i = 1""",
    "q59_two_strikes": """WITH f AS (SELECT user_id AS session, event_id AS ord, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value / 500.0::DOUBLE - 0.05::DOUBLE) / (0.35::DOUBLE - 0.05::DOUBLE))) < 0.1 AS q, ts FROM events),
g AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY session ORDER BY ts, ord), false) AS before FROM f) SELECT session, ord, q AND NOT before AS flagged, q AND before AS silent FROM g""",
    "q60_best_config": f"WITH {MODEL}, m AS (SELECT status, model, (avg(discount) + avg(quantity)) / 2.0::DOUBLE AS score FROM runs GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, model) AS i FROM m) SELECT status, model, round(score, 6) AS score FROM k WHERE i = 1",
    "q61_first_seen": f"WITH {SEG} SELECT spk, arg_min(rec, ord) AS rec FROM seg GROUP BY 1",
    "q62_distinct_speakers": f"WITH {SEG} SELECT rec, count(DISTINCT spk) AS n FROM seg GROUP BY 1",
    "q63_der_uem": f"""{CELLS.replace("u AS (SELECT rec, s, e, spk, 0 AS side FROM seg UNION ALL SELECT rec, s, e, spk, 1 FROM hyp)", "v AS (SELECT rec, s, e, spk, 0 AS side FROM seg UNION ALL SELECT rec, s, e, spk, 1 FROM hyp), u AS (SELECT rec, s, least(e, 43200.0::DOUBLE) AS e, spk, side FROM v WHERE s < 43200.0::DOUBLE)")},
same AS (SELECT a.rec, a.s, count(DISTINCT a.spk) AS ok FROM inside a JOIN inside b ON a.rec = b.rec AND a.s = b.s AND a.side = 0 AND b.side = 1 AND a.spk = b.spk GROUP BY 1, 2), z AS (SELECT rec, e - s AS d, r, h, coalesce(ok, 0) AS ok FROM cells LEFT JOIN same USING (rec, s)) {DER}""",
    "q64_stitched": f"WITH {SEG}, d AS (SELECT *, 1 AS dup FROM seg UNION ALL SELECT rec, ord, s, e - 0.001::DOUBLE, spk, 0 FROM seg WHERE floor(s / 25.0::DOUBLE) > 0 AND s - floor(s / 25.0::DOUBLE) * 25.0::DOUBLE < 5.0::DOUBLE), t AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec ORDER BY s, ord, dup) THEN 0 ELSE 1 END AS turn FROM d), u AS (SELECT *, sum(turn) OVER (PARTITION BY rec ORDER BY s, ord, dup ROWS UNBOUNDED PRECEDING) AS run FROM t), {islands('m', 'u', 'rec, run, spk', '0.1')} SELECT rec, spk, round(s, 6) AS s, round(e, 6) AS e, n FROM m",
    "q65_numbered_frames": f"WITH {SCORES} SELECT rec, ix - 1 AS ix, round(a, 6) AS score FROM f",
    "q67_noise": "SELECT vec_id, (CASE WHEN label = 3 THEN (SELECT max(label) + 1 FROM embeddings WHERE label <> 3) ELSE label END)::BIGINT AS label FROM embeddings",
    "q68_verification": "SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.1 AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}

CHUNKS = """c AS (SELECT user_id AS session, event_id AS ord, epoch_us(ts)::DOUBLE / 1e6 AS s, epoch_us(ts)::DOUBLE / 1e6 + value AS e, event_type AS spk,
greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value / 500.0::DOUBLE - 0.05::DOUBLE) / (0.35::DOUBLE - 0.05::DOUBLE))) >= 0.5::DOUBLE AS speech FROM events)"""

SQL |= {
    "q72_best_reference": """WITH v AS (SELECT vec_id, vec_id % 5 AS cell, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT cell, label, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM v),
m AS (SELECT cell, label, pos, avg(x) AS x FROM x GROUP BY 1, 2, 3), r AS (SELECT cell, label AS name, list(x ORDER BY pos) AS r0 FROM m GROUP BY 1, 2),
p AS (SELECT v.cell, vec_id, name, v AS x0, r0 FROM v JOIN r ON v.cell = r.cell), c AS (SELECT cell, vec_id, name, list_transform(x0, lambda t: t - list_avg(x0)) AS x, list_transform(r0, lambda t: t - list_avg(r0)) AS r FROM p),
g AS (SELECT *, list_dot_product(r, r) AS energy, list_dot_product(x, r) / list_dot_product(r, r) AS gain FROM c), h AS (SELECT *, energy * gain * gain AS target, list_dot_product(x, x) - gain * list_dot_product(x, r) AS rest FROM g),
k AS (SELECT *, CASE WHEN rest < 1e-8 THEN 'inf'::DOUBLE ELSE 10.0::DOUBLE * log10(target / rest) END AS ratio FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ratio DESC, name) AS i FROM k)
SELECT cell, vec_id, name::BIGINT AS name, round(ratio, 6) AS si_sdr FROM o WHERE i = 1""",
    "q73_euclidean_silhouette": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0.0::DOUBLE ELSE list_distance(a.v, b.v) END) AS d, count(*) AS n FROM v a CROSS JOIN v b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, label, max(CASE WHEN label = other THEN d / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM d GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 OR b IS NULL THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m GROUP BY 1""",
    "q78_display_hold": f"""WITH {CHUNKS}, r AS (SELECT *, sum(speech::INT) OVER w AS run, last_value(CASE WHEN speech THEN spk END IGNORE NULLS) OVER w AS held FROM c WINDOW w AS (PARTITION BY session ORDER BY s, ord ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, min(CASE WHEN NOT speech THEN s END) OVER (PARTITION BY session, run) AS began FROM r) SELECT session, ord, CASE WHEN speech THEN spk WHEN s - began < 3600 THEN held END AS shown FROM b""",
    "q15b_flagged_runs": f"WITH {SEG}, x AS (SELECT *, ord % 3 = 0 AS loud FROM seg), t AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec ORDER BY s, ord) AND loud = lag(loud) OVER (PARTITION BY rec ORDER BY s, ord) THEN 0 ELSE 1 END AS turn FROM x), r AS (SELECT *, sum(turn) OVER (PARTITION BY rec ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS run FROM t), g AS (SELECT rec, run, spk, loud, min(s) AS s, count(*) AS n, avg(e - s) AS mean FROM r GROUP BY 1, 2, 3, 4) SELECT rec, spk, loud, round(s, 6) AS s, round(coalesce(lead(s) OVER (PARTITION BY rec ORDER BY run), 129600.0::DOUBLE), 6) AS e, n, round(mean, 6) AS mean FROM g",
    "q33b_best_or_unknown": f"WITH {CENTRES} SELECT vec_id, CASE WHEN score >= 0.2 THEN best::VARCHAR ELSE 'unknown' END AS speaker, score >= 0.2 AND coalesce(second >= 0.2 AND second >= score * 0.8, false) AS is_overlap FROM matches",
    "q70_accumulation": f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT *, e - s AS d, row_number() OVER (PARTITION BY session ORDER BY s, ord) AS k FROM c),
f AS (SELECT session, ord, k, CASE WHEN d > 300.0::DOUBLE THEN 200.0::DOUBLE ELSE d END AS held FROM n WHERE k = 1
  UNION ALL SELECT n.session, n.ord, n.k, CASE WHEN f.held + n.d > 300.0::DOUBLE THEN 200.0::DOUBLE ELSE f.held + n.d END FROM f JOIN n ON n.session = f.session AND n.k = f.k + 1)
SELECT session, ord, round(held, 6) AS held, held >= 100.0::DOUBLE AS ready FROM f""",
    "q71_buffer": f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT *, e - s AS d, row_number() OVER (PARTITION BY session ORDER BY s, ord) AS k FROM c),
f AS (SELECT DISTINCT session, NULL::BIGINT AS ord, 0::BIGINT AS k, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS length, 0.0::DOUBLE AS cur, '-infinity'::DOUBLE AS last, false AS due FROM c
  UNION ALL SELECT session, ord, k, t0, length, CASE WHEN due THEN length ELSE cur END, CASE WHEN due THEN s ELSE last END, due FROM (
    SELECT session, ord, k, s, last, t0 + over AS t0, length - over AS length, greatest(0.0::DOUBLE, cur - over) AS cur, length - over - greatest(0.0::DOUBLE, cur - over) >= 10.0::DOUBLE AND s - last >= 600.0::DOUBLE AS due FROM (
      SELECT n.session, n.ord, n.k, n.s, f.last, f.t0, f.cur, f.length + n.d AS length, greatest(0.0::DOUBLE, f.length + n.d - 120.0::DOUBLE) AS over FROM f JOIN n ON n.session = f.session AND n.k = f.k + 1)))
SELECT session, ord, round(t0, 6) AS t0, round(length, 6) AS length, due FROM f WHERE k > 0""",
    "q77_microbatch": f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT *, e - s AS d, row_number() OVER (PARTITION BY session ORDER BY s, ord) AS k FROM c),
f AS (SELECT DISTINCT session, NULL::BIGINT AS ord, 0::BIGINT AS k, 0.0::DOUBLE AS begins, 0.0::DOUBLE AS length, 0.0::DOUBLE AS last, false AS due, 0.0::DOUBLE AS b, 0.0::DOUBLE AS l FROM c
  UNION ALL SELECT session, ord, k, CASE WHEN due THEN b + greatest(0.0::DOUBLE, l - 60.0::DOUBLE) ELSE b END, CASE WHEN due THEN least(l, 60.0::DOUBLE) ELSE l END, CASE WHEN due THEN s ELSE last END, due, b, l FROM (
    SELECT *, l >= 0.6::DOUBLE AND s - last >= 1800.0::DOUBLE AS due FROM (
      SELECT n.session, n.ord, n.k, n.s, f.last, f.begins + greatest(0.0::DOUBLE, f.length + n.d - 300.0::DOUBLE) AS b, least(f.length + n.d, 300.0::DOUBLE) AS l FROM f JOIN n ON n.session = f.session AND n.k = f.k + 1)))
SELECT session, ord, round(b, 6) AS begins, round(l, 6) AS length, due FROM f WHERE k > 0""",
    "q82_turn_truth": f"""WITH RECURSIVE {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, ord) AS k FROM seg WHERE NOT (e - s < 20.0::DOUBLE)),
f AS (SELECT rec, k, spk, e AS until, NULL::DOUBLE AS ts FROM n WHERE k = 1
  UNION ALL SELECT rec, k, CASE WHEN takes OR same THEN spk ELSE held END, CASE WHEN same THEN greatest(until, e) WHEN takes THEN e ELSE until END, CASE WHEN takes THEN s END FROM (
    SELECT n.rec, n.k, n.spk, n.s, n.e, f.spk AS held, f.until, n.spk = f.spk AS same, n.spk <> f.spk AND (n.s >= f.until - 30.0::DOUBLE OR n.e > f.until) AS takes FROM f JOIN n ON n.rec = f.rec AND n.k = f.k + 1))
SELECT rec, round(ts, 6) AS ts FROM f WHERE ts IS NOT NULL""",
    "q43b_separated_bubbles": f"WITH t AS (SELECT conv_id, turn, role, turn % 5 = 4 AS separated, {TOKENS} AS w FROM conversations), x AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND separated = lag(separated) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM t), r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM x), u AS (SELECT conv_id, run, role, separated, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM r), b AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id, run ORDER BY turn, pos) - 1) // 18)::BIGINT AS bubble FROM u) SELECT conv_id, run, role, separated, bubble, count(*) AS n, string_agg(word, ' ' ORDER BY turn, pos) AS text FROM b GROUP BY 1, 2, 3, 4, 5",
    "q49_speaker_fold": f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT c.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value / 500.0::DOUBLE - 0.05::DOUBLE) / (0.35::DOUBLE - 0.05::DOUBLE))) AS confidence, row_number() OVER (PARTITION BY session ORDER BY s, ord) AS k FROM c JOIN events ON event_id = ord),
f AS (SELECT session, ord, k, spk, confidence, s AS since FROM n WHERE k = 1
  UNION ALL SELECT session, ord, k, CASE WHEN same OR due THEN spk ELSE held END, CASE WHEN same THEN 0.3::DOUBLE * confidence + 0.7::DOUBLE * old WHEN due THEN confidence ELSE old END, CASE WHEN same OR due THEN s ELSE since END FROM (
    SELECT n.session, n.ord, n.k, n.spk, n.confidence, n.s, f.spk AS held, f.confidence AS old, f.since, n.spk = f.spk AS same, n.s - f.since >= 3600.0::DOUBLE AS due FROM f JOIN n ON n.session = f.session AND n.k = f.k + 1))
SELECT session, ord, spk AS speaker, round(confidence, 6) AS confidence FROM f""",
    "q37_lloyd": lloyd_sql(8, 3),
    "q88_report": "SELECT l_returnflag || l_linestatus AS model, count(*) AS files, round(avg(l_extendedprice), 4) AS price_mean, round(stddev_pop(l_discount), 4) AS discount_std FROM lineitem GROUP BY 1",
    "q81_stream_rates": f"WITH {RATES} SELECT file, responses, total_words, {', '.join(f'round({c}, 6) AS {c}' for c in RATE_NAMES)} FROM rates",
    "q81b_stream_summary": f"WITH {RATES} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in RATE_NAMES)} FROM rates",
    "q78b_display_timers": f"""WITH {CHUNKS}, r AS (SELECT *, sum(speech::INT) OVER w AS run, last_value(CASE WHEN speech THEN spk END IGNORE NULLS) OVER w AS held FROM c WINDOW w AS (PARTITION BY session ORDER BY s, ord ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT *, min(CASE WHEN NOT speech THEN s END) OVER (PARTITION BY session, run) AS began FROM r), g AS (SELECT session, run, min(began) AS began FROM x WHERE run > 0 AND held IS NOT NULL GROUP BY 1, 2), n AS (SELECT session, run, min(s) AS s FROM x WHERE speech GROUP BY 1, 2)
  SELECT session, ord, round(s, 6) AS t, CASE WHEN speech THEN spk WHEN run > 0 AND s < began + 3600.0::DOUBLE THEN held END AS shown FROM x
  UNION ALL SELECT g.session, NULL, round(g.began + 3600.0::DOUBLE, 6), NULL FROM g LEFT JOIN n ON n.session = g.session AND n.run = g.run + 1 WHERE g.began IS NOT NULL AND (n.s IS NULL OR n.s >= g.began + 3600.0::DOUBLE)""",
    "q79_expanded_speakers": f"""WITH {CHUNKS}, g AS (SELECT session, arg_min(spk, (s, ord)) AS a, arg_max(spk, (s, ord)) AS b, min(spk) AS l FROM c GROUP BY 1),
n AS (SELECT session, x FROM (SELECT session, a AS x FROM g UNION SELECT session, b FROM g UNION SELECT session, l FROM g)), z AS (SELECT session, list(x) AS xs FROM n GROUP BY 1)
SELECT session, array_to_string(list_sort(CASE WHEN len(xs) >= 2 THEN xs ELSE list_append(xs, list_filter(['click', 'view', 'zoom'], lambda k: NOT list_contains(xs, k))[1]) END), ',') AS speakers FROM z""",
    "q79b_overlap_history": f"WITH {CHUNKS}, t AS (SELECT max(e) AS top FROM c) SELECT session, ord, round(s, 6) AS s, round(e, 6) AS e FROM c, t WHERE e >= top - 3600 - 86400 AND s >= top - 90000",
    "q80_timing_report": """WITH t AS (SELECT event_type AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS place, max(n) OVER () AS top, sum(n) OVER () AS total FROM t)
SELECT place, concat(rpad('Stage ' || upper(k[1]) || lower(k[2:]), 30, ' '), ' ', rpad(repeat('█', floor(n / top * 40.0::DOUBLE)::INT), 40, ' '), ' ', printf('%6.2f', n), 's (', printf('%5.1f', n * 100.0::DOUBLE / total), '%)') AS line FROM o""",
}
