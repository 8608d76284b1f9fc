"""DuckDB SQL of the near-duplicate queries: independent, brute-force statements over the same tables."""

from __future__ import annotations

import math

from quernlake.operators.lsh import PRIME, portable_constants

WHITE = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]+"
KEPT = r"[^\p{L}\p{N}_<>\p{Z}\x09-\x0d\x1c-\x1f\x85]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


def _key(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace(lower({x}), '{KEPT}', ' ', 'g'), '[ \\t]+', ' ', 'g')"
    return _strip(spaced)


def _values(cases: list[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in cases)


def _hash(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


NORM = f"""docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
norm AS (SELECT doc_id AS id, regexp_replace({_key('text')}, '\\n{{2,}}', chr(10), 'g') AS t FROM docs),
word_lists AS (SELECT id, list_filter(regexp_split_to_array(t, '{WHITE}'), lambda w: w <> '') AS w FROM norm)"""


def _sets(k: int) -> str:
    grams = f"list_transform(range(len(p) - {k - 1}), lambda i: {_hash(f'''array_to_string(p[i + 1 : i + {k}], ' ')''')})"
    return f"""{NORM},
padded AS (SELECT id, list_concat(w, list_transform(range(greatest(0, {k} - len(w))), lambda i: '<pad>')) AS p FROM word_lists),
sets AS MATERIALIZED (SELECT id, list_distinct({grams}) AS shingles FROM padded)"""


_DIGEST = "SELECT id AS doc_id, len(shingles) AS n_shingles, CAST(CAST(coalesce(list_sum(list_transform(shingles, lambda x: CAST(x AS HUGEINT))), 0) AS HUGEINT) AS VARCHAR) AS hash_sum FROM "


def with_sql(k: int, bands: int, rows: int, tau: float, tau_sketch: float, cap: int, frac: float, frequent: float, grid: list[tuple[int, int]], money: list[tuple[str, str]], lines: list[tuple[str, str]], n_random: int, seed: int, resamples: int) -> dict[str, str]:
    constants = ", ".join(f"{{'a': {a}::BIGINT, 'c': {c}::BIGINT}}" for a, c in portable_constants(k))
    w5 = _sets(5)
    classes = f"""{w5},
keyed AS MATERIALIZED (SELECT id, list_sort(shingles) AS key FROM sets),
classes AS MATERIALIZED (SELECT id, CASE WHEN len(key) = 0 THEN id ELSE min(id) OVER (PARTITION BY key) END AS class_id FROM keyed),
firsts AS MATERIALIZED (SELECT s.* FROM sets s JOIN classes c USING (id) WHERE s.id = c.class_id)"""
    sig = f"list_transform([{constants}], lambda r: list_min(list_transform(shingles, lambda s: ((s % {PRIME}) * r.a + r.c) % {PRIME})))"
    band = lambda b, r: f"SELECT id, CAST(j AS INT) AS band_no, {_hash(f'''concat(CAST(j AS VARCHAR), ':', array_to_string(sig[j * {r} + 1 : j * {r} + {r}], ','))''')} AS bucket_key FROM sketches, range({b}) js(j)"
    index = f"""{classes},
sketches AS MATERIALIZED (SELECT id, len(shingles) AS size, {sig} AS sig FROM firsts WHERE len(shingles) > 0),
buckets AS MATERIALIZED ({band(bands, rows)}),
sizes AS MATERIALIZED (SELECT band_no, bucket_key, count(*) AS members FROM buckets GROUP BY ALL),
candidates AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM buckets a JOIN buckets b ON a.band_no = b.band_no AND a.bucket_key = b.bucket_key AND a.id < b.id)"""
    brute = """postings AS MATERIALIZED (SELECT id, len(shingles) AS n, unnest(shingles) AS s FROM firsts),
exact AS MATERIALIZED (SELECT a, b, shared, shared / (na + nb - shared) AS jaccard FROM (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM postings x JOIN postings y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id))"""
    share = lambda n: f"list_sum([CAST(x.sig[i] = y.sig[i] AS INT) FOR i IN range(1, {n + 1})]) / {n}.0"
    estimates = f"""{index}, {brute},
estimates AS MATERIALIZED (SELECT e.a, e.b, {share(k)} AS j_sketch, e.jaccard AS j_exact, x.sig AS sig_a, y.sig AS sig_b FROM exact e JOIN sketches x ON x.id = e.a JOIN sketches y ON y.id = e.b WHERE e.jaccard >= 0.3)"""
    scores = f"{estimates}, scores AS (SELECT j_sketch AS score, j_exact >= 0.7 AS positive FROM estimates)"
    cascade = f"""{index}, {brute},
scored AS (SELECT c.a, c.b, {share(k)} AS j_sketch, coalesce(e.jaccard, 0) AS j_exact FROM candidates c JOIN sketches x ON x.id = c.a JOIN sketches y ON y.id = c.b LEFT JOIN exact e ON e.a = c.a AND e.b = c.b),
decided AS (SELECT a, b, j_sketch, j_exact, CASE WHEN j_exact >= {tau} THEN 'merge' WHEN j_exact >= 0.3 THEN 'review' ELSE 'reject' END AS decision FROM scored WHERE j_sketch >= {tau_sketch})"""
    single = f"""{classes}, {brute},
edges AS MATERIALIZED (SELECT a, b FROM exact WHERE jaccard >= {tau} UNION SELECT b, a FROM exact WHERE jaccard >= {tau}),
reach AS (SELECT id AS x, id AS y FROM firsts UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
component AS MATERIALIZED (SELECT x AS class_id, min(y) AS founder FROM reach GROUP BY x),
members AS MATERIALIZED (SELECT c.id AS doc_id, 'OPP-' || CAST(p.founder AS VARCHAR) AS opportunity_id FROM classes c JOIN component p USING (class_id))"""
    probes = f"SELECT DISTINCT p.id AS probe_id, b.id AS id FROM buckets p JOIN buckets b ON p.band_no = b.band_no AND p.bucket_key = b.bucket_key AND p.id <> b.id WHERE p.id % 50 = 0"
    emissions = lambda c: f"SELECT CAST({c or 0} AS INT) AS cap, CAST(coalesce(sum(members * (members - 1) // 2) FILTER (members > 1{f' AND members <= {c}' if c else ''}), 0) AS BIGINT) AS emissions, count(*) FILTER (members > 1{f' AND members <= {c}' if c else ''}) AS colliding_buckets, max(members) AS largest_bucket, count(*) FILTER ({f'members > {c}' if c else 'false'}) AS suppressed_buckets, CAST(coalesce(sum(members) FILTER ({f'members > {c}' if c else 'false'}), 0) AS BIGINT) AS suppressed_members FROM sizes"
    work = "work AS MATERIALIZED (SELECT id, CAST(sum(members - 1) AS BIGINT) AS emissions FROM buckets JOIN sizes USING (band_no, bucket_key) GROUP BY id)"
    cost = lambda r: f"SELECT CAST({r} AS DOUBLE) AS ratio, threshold, round(price, 9) AS cost FROM (SELECT t.score AS threshold, {r} * (SELECT count(*) FROM scores n WHERE NOT n.positive AND n.score >= t.score) / (SELECT count(*) FROM scores WHERE NOT positive) + (SELECT count(*) FROM scores p WHERE p.positive AND p.score < t.score) / (SELECT count(*) FROM scores WHERE positive) AS price FROM (SELECT DISTINCT score FROM scores) t) ORDER BY round(price, 12), threshold LIMIT 1"
    error = lambda n: f"SELECT CAST({n} AS INT) AS k, count(*) AS pairs, round(avg(e), 9) AS bias, round(sqrt(avg(e * e)), 9) AS rmse, round(sqrt(avg(j * (1 - j) / {n})), 9) AS theory, round(max(abs(e)), 9) AS worst, round(avg(CAST(abs(e) <= 1.96 * sqrt(j * (1 - j) / {n}) AS INT)), 9) AS inside_95 FROM (SELECT list_sum([CAST(sig_a[i] = sig_b[i] AS INT) FOR i IN range(1, {n + 1})]) / {n}.0 - j_exact AS e, j_exact AS j FROM estimates)"
    errors = " UNION ALL ".join(error(n) for n in (4, 8, 16))
    candidate = lambda b, r: "(" + " OR ".join(f"sig_a[{j * r + 1} : {j * r + r}] = sig_b[{j * r + 1} : {j * r + r}]" for j in range(b)) + ")"
    grid_rows = " UNION ALL ".join(f"SELECT CAST({b} AS INT) AS bands, CAST({r} AS INT) AS rows, (SELECT CAST(coalesce(sum(m * (m - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS m FROM ({band(b, r)}) GROUP BY band_no, bucket_key)) AS emissions, round(avg(CAST({candidate(b, r)} AS INT)), 9) AS recall FROM estimates WHERE j_exact >= {tau}" for b, r in grid)
    quantiles = ", ".join(f"quantile_cont(score, {q}) AS q{round(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
    hexed = "hex(encode(t))"
    # Limits of a Poisson count in 32 bits: the distribution's sums, computed here by its formula.
    limits = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(13)]
    times = " + ".join(f"CAST(u >= {x} AS INT)" for x in limits)
    boot = f"""drawn AS (SELECT r, j_sketch AS score, j_exact >= 0.7 AS positive, {times} AS times FROM (SELECT *, CAST('0x' || substr(md5(concat_ws(':', a, b, r, {seed})), 1, 8) AS BIGINT) AS u FROM estimates, range({resamples}) rs(r))),
highest AS (SELECT r, max(score) FILTER (NOT positive AND times > 0) AS top FROM drawn GROUP BY r),
recalls AS (SELECT r, sum(times) FILTER (positive AND (top IS NULL OR score > top)) AS hit, sum(times) FILTER (positive) AS n FROM drawn JOIN highest USING (r) GROUP BY r),
shares AS (SELECT coalesce(hit, 0) / n AS recall FROM recalls WHERE n > 0)"""
    w9 = _sets(9).removeprefix(NORM + ",\n").replace("padded", "padded9").replace("sets AS", "sets9 AS")
    overlap = lambda t: f"(SELECT e.a, e.b, e.j_exact, len(list_intersect(x.shingles, y.shingles)) AS n, len(x.shingles) AS na, len(y.shingles) AS nb FROM estimates e JOIN {t} x ON x.id = e.a JOIN {t} y ON y.id = e.b)"
    shifts = f"shifts AS (SELECT a, b, CASE WHEN j_exact >= 0.7 THEN 'same' ELSE 'different' END AS label, n / (na + nb - n) - j_exact AS s FROM {overlap('sets9')})"
    stopped = f"stop AS MATERIALIZED (SELECT s FROM (SELECT unnest(shingles) AS s FROM sets) GROUP BY s HAVING count(*) > {frequent} * (SELECT count(*) FROM sets)), wanted AS (SELECT a AS id FROM estimates UNION SELECT b FROM estimates), lists AS (SELECT id, list(s) AS l FROM (SELECT id, unnest(shingles) AS s FROM sets WHERE id IN (SELECT id FROM wanted)) WHERE s NOT IN (SELECT s FROM stop) GROUP BY id), rare AS MATERIALIZED (SELECT w.id, coalesce(l, []) AS shingles FROM wanted w LEFT JOIN lists USING (id)), rescored AS MATERIALIZED (SELECT a, b, j_exact, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE n / (na + nb - n) END AS other FROM {overlap('rare')})"
    separation = lambda name: f"""SELECT '{name}' AS representation, round((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM s p, s n WHERE p.positive AND NOT n.positive), 6) AS auc,
round((SELECT avg(CAST(score > diff_max AS INT)) FROM s WHERE positive), 6) AS recall, tau, diff_max, round(diff_p99, 6) AS diff_p99, round(greatest(tau - diff_p99, 0.001), 6) AS resolution,
round((SELECT quantile_cont(score, 0.5) FROM s WHERE positive), 6) AS same_median, round((SELECT avg(CAST(score >= tau AS INT)) FROM s WHERE positive), 6) AS merged_share,
CAST(ceil(round(3.0902 * 3.0902 * tau * (1 - tau) / pow(greatest(tau - diff_p99, 0.001), 2), 6)) AS BIGINT) AS rows_required"""  # noqa: E731
    scored = lambda name, column: f"""SELECT * FROM (WITH s AS MATERIALIZED (SELECT round({column}, 4) AS score, j_exact >= 0.7 AS positive FROM rescored),
priced AS (SELECT t.score AS tau, 50.0 * (SELECT count(*) FROM s n WHERE NOT n.positive AND n.score >= t.score) / (SELECT count(*) FROM s WHERE NOT positive) + (SELECT count(*) FROM s p WHERE p.positive AND p.score < t.score) / (SELECT count(*) FROM s WHERE positive) AS price FROM (SELECT DISTINCT score FROM s) t),
best AS (SELECT tau FROM priced ORDER BY round(price, 12), tau LIMIT 1),
far AS (SELECT max(score) AS diff_max, quantile_cont(score, 0.99) AS diff_p99 FROM s WHERE NOT positive) {separation(name)} FROM best, far)"""  # noqa: E731
    return {
        "recall_interval": f"WITH {estimates}, {boot} SELECT count(*) AS resamples, round(quantile_cont(recall, 0.025), 9) AS low, round(quantile_cont(recall, 0.975), 9) AS high FROM shares",
        "paired_shift_w9": f"WITH {estimates}, {w9}, {shifts} SELECT label, count(*) AS pairs, round(avg(s), 6) AS mean_shift, count(*) FILTER (s > 0.02) AS lifted, count(*) FILTER (s < -0.02) AS hurt, (array_agg(a ORDER BY round(s, 9) DESC, a, b))[1] AS top_a, (array_agg(b ORDER BY round(s, 9) DESC, a, b))[1] AS top_b FROM shifts GROUP BY label",
        "representations": f"WITH {estimates}, {stopped} {scored('whole', 'j_exact')} UNION ALL {scored('stop_list', 'other')}",
        "sketch_row_dependence": f"WITH {estimates}, e AS (SELECT j_exact AS j, [CAST(sig_a[i] = sig_b[i] AS INT) FOR i IN range(1, {k + 1})] AS q FROM estimates), h AS (SELECT j, list_sum(q[1 : {k // 2}]) / {k // 2}.0 - j AS e, list_sum(q[{k // 2 + 1} : {k}]) / {k // 2}.0 - j AS f, list_var_samp([{', '.join(f'list_sum(q[{i * k // bands + 1} : {(i + 1) * k // bands}]) / {k // bands}.0' for i in range(bands))}]) AS v FROM e) SELECT count(*) AS pairs, round(corr(e, f), 6) AS half_correlation, round(var_samp(e), 6) AS half_variance, round(stddev_pop(e - f), 6) AS half_spread, round(sqrt(2 * avg(j * (1 - j) / {k // 2})), 6) AS expected_spread, round(avg(v), 6) AS block_variance, round(avg(j * (1 - j) / {k // bands}), 6) AS binomial_variance FROM h",
        "cascade_recall": f"WITH {estimates} SELECT count(*) AS pairs, count(*) FILTER ({candidate(bands, rows)}) AS met, count(*) FILTER ({candidate(bands, rows)} AND j_sketch >= {tau_sketch}) AS merged, round(avg(CAST({candidate(bands, rows)} AND j_sketch >= {tau_sketch} AS INT)), 9) AS recall FROM estimates WHERE j_exact >= {tau}",
        "doc_normalise": f"WITH {NORM} SELECT id AS doc_id, md5(t) AS text_md5, len(w) AS n_words FROM norm JOIN word_lists USING (id)",
        "money_canonicalisation": f"SELECT * FROM (VALUES {_values(money)}) v(text, token)",
        "line_key": f"SELECT * FROM (VALUES {_values(lines)}) v(line, line_key)",
        "doc_boilerplate_lines": f"WITH lines AS (SELECT DISTINCT doc_id, source, {_key('line')} AS line_key FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)), n AS (SELECT source, count(*) AS portal_notices FROM documents GROUP BY 1 HAVING count(*) >= 20) SELECT source, line_key, count(*) AS notices, any_value(portal_notices) AS portal_notices FROM lines JOIN n USING (source) WHERE length(line_key) >= 25 GROUP BY source, line_key HAVING count(*) / any_value(portal_notices) > {frac}",
        "doc_shingles_w3": f"WITH {_sets(3)} {_DIGEST} sets",
        "doc_shingles_w5": f"WITH {w5} {_DIGEST} sets",
        "doc_shingles_w9": f"WITH {_sets(9)} {_DIGEST} sets",
        "doc_shingles_c5": f"WITH {NORM}, hexed AS (SELECT id, {hexed} AS h FROM norm), sets AS (SELECT id, list_distinct(list_transform(range(greatest(0, length(h) // 2 - 4)), lambda i: {_hash('unhex(substr(h, 2 * i + 1, 10))')})) AS shingles FROM hexed) {_DIGEST} sets",
        "shingle_df": f"WITH {w5} SELECT df, count(*) AS n_shingles FROM (SELECT s, count(*) AS df FROM (SELECT unnest(shingles) AS s FROM sets) GROUP BY s) GROUP BY df",
        "df_stoplist": f"WITH {w5}, stop AS (SELECT s FROM (SELECT unnest(shingles) AS s FROM sets) GROUP BY s HAVING count(*) > {frequent} * (SELECT count(*) FROM sets)), left_over AS (SELECT id, list_filter(shingles, lambda x: x NOT IN (SELECT s FROM stop)) AS shingles FROM sets) SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, coalesce(total, '0') AS hash_sum FROM sets LEFT JOIN (SELECT id, count(*) AS n, CAST(sum(CAST(s AS HUGEINT)) AS VARCHAR) AS total FROM (SELECT id, unnest(shingles) AS s FROM sets) WHERE s NOT IN (SELECT s FROM stop) GROUP BY id) USING (id)".replace(", left_over AS (SELECT id, list_filter(shingles, lambda x: x NOT IN (SELECT s FROM stop)) AS shingles FROM sets)", ""),
        "set_classes": f"WITH {classes} SELECT id AS doc_id, class_id FROM classes",
        "jaccard_search": f"WITH {w5}, p AS (SELECT id, len(shingles) AS n, unnest(shingles) AS s FROM sets) SELECT query_id, doc_id, shared, round(shared / (q + n - shared), 9) AS jaccard FROM (SELECT x.id AS query_id, y.id AS doc_id, any_value(x.n) AS q, any_value(y.n) AS n, count(*) AS shared FROM p x JOIN p y USING (s) WHERE x.id % 50 = 0 AND x.id <> y.id GROUP BY x.id, y.id) WHERE shared / (q + n - shared) >= 0.1",
        "exact_jaccard_pairs": f"WITH {classes}, {brute} SELECT a, b, shared, round(jaccard, 9) AS jaccard FROM exact WHERE jaccard >= {tau}",
        "exact_jaccard_top20": f"WITH {classes}, {brute} SELECT a, b, shared, round(jaccard, 9) AS jaccard FROM exact WHERE jaccard >= {tau} AND jaccard < 1 ORDER BY round(jaccard, 9) DESC, a, b LIMIT 20",
        "minhash_portable_k16": f"WITH {w5} SELECT id AS doc_id, array_to_string({sig}, ',') AS sig FROM sets WHERE len(shingles) > 0",
        "sketch_vs_exact": f"WITH {estimates} SELECT a, b, round(j_sketch, 9) AS j_sketch, round(j_exact, 9) AS j_exact FROM estimates",
        "lsh_candidates_b4r4": f"WITH {index} SELECT a, b FROM candidates",
        "lsh_candidates_capped": f"WITH {index} SELECT DISTINCT a.id AS a, b.id AS b FROM buckets a JOIN buckets b ON a.band_no = b.band_no AND a.bucket_key = b.bucket_key AND a.id < b.id JOIN sizes s ON s.band_no = a.band_no AND s.bucket_key = a.bucket_key WHERE s.members <= {cap}",
        "lsh_suppressed": f"WITH {index} SELECT band_no, bucket_key, members FROM sizes WHERE members > {cap}",
        "lsh_suppressed_links": f"WITH {index}, f AS (SELECT band_no, bucket_key, min(id) AS a FROM buckets GROUP BY ALL HAVING count(*) > {cap}) SELECT DISTINCT a, id AS b FROM buckets JOIN f USING (band_no, bucket_key) WHERE id <> a",
        "lsh_single_key_probe": f"WITH {index} {probes}",
        "lsh_index_totals": f"WITH {index} SELECT count(*) AS n_rows, count(DISTINCT (band_no, bucket_key)) AS n_buckets FROM buckets",
        "random_and_lsh_pairs": f"WITH {index}, drawn AS (SELECT id, row_number() OVER (ORDER BY md5(concat(CAST(id AS VARCHAR), ':{seed}')), id) - 1 AS place FROM sketches QUALIFY place < {2 * n_random}), random_pairs AS (SELECT min(id) AS a, max(id) AS b FROM drawn GROUP BY place // 2 HAVING count(*) = 2) SELECT a, b FROM random_pairs UNION SELECT a, b FROM candidates",
        "pair_endpoints": f"WITH {classes}, {brute} SELECT a AS doc_id FROM exact WHERE jaccard >= {tau} UNION SELECT b FROM exact WHERE jaccard >= {tau}",
        "sources_by_size": "SELECT source, count(*) AS n_documents FROM documents GROUP BY source",
        "lsh_probe": f"WITH {index} {probes}",
        "lsh_array_overlap_join": f"WITH {index}, arrays AS (SELECT id, array_agg(bucket_key ORDER BY band_no) AS keys FROM buckets GROUP BY id) SELECT p.id AS probe_id, b.id AS id FROM arrays p JOIN arrays b ON p.id <> b.id AND list_has_any(p.keys, b.keys) WHERE p.id % 50 = 0",
        "lsh_access_paths": f"WITH {index}, p AS ({probes}) SELECT path, (SELECT count(*) FROM p) AS pairs FROM (VALUES ('chosen'), ('merge'), ('shuffle_hash')) v(path)",
        "lsh_point_lookup": f"WITH {index} SELECT b.band_no, b.id FROM buckets b JOIN (SELECT band_no, bucket_key FROM sizes QUALIFY row_number() OVER (PARTITION BY band_no ORDER BY members DESC, bucket_key) = 1) USING (band_no, bucket_key)",
        "bucket_histogram": f"WITH {index} SELECT members, count(*) AS buckets FROM sizes GROUP BY members",
        "bucket_emissions": f"WITH {index} " + " UNION ALL ".join(emissions(c) for c in (None, 5, 3, 2)),
        "per_notice_emissions": f"WITH {index}, {work} SELECT id, emissions FROM work",
        "emission_quantiles": f"WITH {index}, {work} SELECT avg(emissions) AS mean, max(emissions) AS most, quantile_cont(emissions, 0.5) AS p50, quantile_cont(emissions, 0.95) AS p95, quantile_cont(emissions, 0.99) AS p99 FROM work",
        "skew_concentration": f"WITH {index}, ranked AS (SELECT members * (members - 1) / 2 AS e, row_number() OVER (ORDER BY members DESC) AS k, count(*) OVER () AS n FROM sizes WHERE members > 1) SELECT CAST(share AS DOUBLE) AS share, CAST(greatest(floor(n * share), 1) AS BIGINT) AS buckets, sum(e) FILTER (k <= greatest(floor(n * share), 1)) / sum(e) AS share_of_emissions FROM ranked, (VALUES (CAST(0.001 AS DOUBLE)), (0.005), (0.01), (0.05), (0.1)) v(share) GROUP BY share, n",
        "source_attribution": f"WITH {index}, {work}, w AS (SELECT source, emissions FROM work JOIN documents ON doc_id = id) SELECT source, count(*) AS notices, round(avg(emissions), 9) AS mean_work, CAST(sum(emissions) AS BIGINT) AS total_work, round(sum(emissions) / (SELECT sum(emissions) FROM w), 9) AS share_of_work, round(count(*) / (SELECT count(*) FROM w), 9) AS share_of_corpus FROM w GROUP BY source",
        "worst_bucket": f"WITH {index} SELECT * FROM sizes ORDER BY members DESC, band_no, bucket_key LIMIT 1",
        "cascade_decisions": f"WITH {cascade} SELECT a, b, round(j_sketch, 9) AS j_sketch, round(j_exact, 9) AS j_exact, decision FROM decided",
        "decision_summary": f"WITH {cascade} SELECT decision, count(*) AS pairs, round(avg(round(j_exact, 9)), 4) AS mean_exact_jaccard FROM decided GROUP BY decision",
        "auc": f"WITH {scores} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 9) AS auc, (SELECT count(*) FROM scores WHERE positive) AS positives, (SELECT count(*) FROM scores WHERE NOT positive) AS negatives FROM scores p, scores n WHERE p.positive AND NOT n.positive",
        "recall_at_zero_fp": f"WITH {scores} SELECT (SELECT max(score) FROM scores WHERE NOT positive) AS highest_negative, avg(CAST(score > (SELECT max(score) FROM scores WHERE NOT positive) AS INT)) AS recall FROM scores WHERE positive",
        "threshold_by_ratio": f"WITH {scores} SELECT * FROM ({cost(1)}) UNION ALL SELECT * FROM ({cost(10)}) UNION ALL SELECT * FROM ({cost(50)})",
        "score_quantiles": f"WITH {scores} SELECT positive, count(*) AS n, {quantiles} FROM scores GROUP BY positive",
        "s_curve": f"WITH {estimates} SELECT bin, pairs, candidates, round(candidates / pairs, 9) AS share, round(1 - pow(1 - pow((bin + 0.5) / 10, {rows}), {bands}), 9) AS expected FROM (SELECT CAST(least(floor(j_exact * 10), 9) AS INT) AS bin, count(*) AS pairs, count(*) FILTER ({candidate(bands, rows)}) AS candidates FROM estimates GROUP BY 1)",
        "sketch_error_by_k": f"WITH {estimates} {errors}",
        "sketch_error_slope": f"WITH {estimates}, p AS ({errors}) SELECT round(regr_slope(ln(rmse), ln(k)), 6) AS slope, round(regr_intercept(ln(rmse), ln(k)), 6) AS intercept, round(corr(ln(k), ln(rmse)), 6) AS correlation FROM p",
        "sketch_error_by_bin": f"WITH {estimates} SELECT CAST(least(floor(j_exact * 10), 9) AS INT) AS bin, count(*) AS pairs, round(sqrt(avg((j_sketch - j_exact) * (j_sketch - j_exact))), 9) AS rmse, round(stddev_pop(j_sketch - j_exact), 9) AS spread FROM estimates GROUP BY 1",
        "lsh_grid": f"WITH {estimates} {grid_rows}",
        "lsh_grid_operating_point": f"WITH {estimates}, grid AS ({grid_rows}) SELECT * FROM grid ORDER BY recall >= 0.9 DESC, CASE WHEN recall >= 0.9 THEN emissions ELSE -recall END, bands LIMIT 1",
        "growth_projection": "SELECT n AS notices, round(5464739 * 3.125e-6 * pow(n / 12000, 2), 3) AS bucket_seconds, round(n * (n - 1) / 2 * 3.125e-6, 3) AS all_pairs_seconds FROM (VALUES (12000::BIGINT), (50000), (220000)) v(n)",
        "cluster_single": f"WITH RECURSIVE {single} SELECT doc_id, opportunity_id FROM members",
        "cluster_size_histogram": f"WITH RECURSIVE {single} SELECT members, count(*) AS opportunities FROM (SELECT count(*) AS members FROM members GROUP BY opportunity_id) GROUP BY members",
        "opportunity_card": f"WITH RECURSIVE {single}, top AS (SELECT opportunity_id, count(*) AS member_count FROM members GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT t.opportunity_id, t.member_count, d.doc_id, d.source, left(d.text, 52) AS title FROM top t JOIN members m USING (opportunity_id) JOIN docs d USING (doc_id)",
        "alias_resolve": "WITH RECURSIVE chain AS (SELECT doc_id AS alias_id, doc_id // 3 AS target FROM documents WHERE doc_id > 0 UNION ALL SELECT c.alias_id, c.target // 3 FROM chain c WHERE c.target > 0 AND c.target IN (SELECT doc_id FROM documents)) SELECT CAST(alias_id AS VARCHAR) AS alias_id, CAST(min(target) AS VARCHAR) AS opportunity_id FROM chain GROUP BY alias_id",
    }
