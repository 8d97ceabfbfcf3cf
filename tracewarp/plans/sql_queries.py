"""Queries that are one SQL statement. {name} stands for a table; the same text runs on DuckDB, where names are views."""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()

#: A trace of a user: its samples in order of time.
TRACE = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM {events}"

LEVELS = """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM {events}),
m AS (SELECT user_id, pos, value, trunc_(avg(value) OVER (PARTITION BY user_id)) AS mu FROM s),
d AS (SELECT *, greatest(trunc_(avg(abs(value - mu)) OVER (PARTITION BY user_id)), 1) AS mad FROM m)
SELECT user_id, pos, trunc_((greatest(least((value - mu) / mad, REACH.0), -REACH.0) + REACH) * LEVELS / (2 * REACH)) AS code FROM d"""

SCORES = "SELECT event_type = 'purchase' AS target, value AS cost FROM {events}"

STATEMENTS = {
    "pa_filter": "WITH p AS (SELECT user_id, (value + 10) * 1.5 AS pa FROM {events}) SELECT user_id, count(*) AS n, round(sum(pa), 6) AS total FROM p WHERE pa > 30 AND pa < 200 GROUP BY user_id",
    "zscore": f"WITH s AS ({TRACE}) SELECT user_id, pos, round((value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id), 6) AS z FROM s",
    "discrete_norm_4": LEVELS.replace("REACH", "4").replace("LEVELS", "256"),
    "discrete_norm_8": LEVELS.replace("REACH", "8").replace("LEVELS", "255"),
    "prefix_sums": f"WITH s AS ({TRACE}) SELECT user_id, pos, round(sum(value) OVER w, 6) AS total, round(sum(value * value) OVER w, 6) AS squares FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)",
    "first_difference": f"WITH s AS ({TRACE}) SELECT user_id, pos, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos), 6) AS diff FROM s",
    "expanding_norm": f"""WITH s AS ({TRACE}), b AS (SELECT user_id, pos, value, pos - pos % 20 AS block FROM s),
k AS (SELECT DISTINCT user_id, block FROM b),
m AS (SELECT k.user_id, k.block, trunc_(avg(b.value)) AS mu FROM k JOIN b ON k.user_id = b.user_id AND b.block <= k.block GROUP BY k.user_id, k.block),
d AS (SELECT m.user_id, m.block, m.mu, greatest(trunc_(avg(abs(b.value - m.mu))), 1) AS mad FROM m JOIN b ON m.user_id = b.user_id AND b.block <= m.block GROUP BY m.user_id, m.block, m.mu)
SELECT b.user_id, b.pos, trunc_((greatest(least((b.value - d.mu) / d.mad, 4.0), -4.0) + 4) * 256 / 8) AS code FROM b JOIN d ON b.user_id = d.user_id AND b.block = d.block""",
    "histogram": "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM {events}) SELECT CAST(least(floor((value - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM {events} CROSS JOIN r GROUP BY 1",
    "interpolate": f"""WITH s AS ({TRACE}), p AS (SELECT user_id, pos, value, lead(value) OVER (PARTITION BY user_id ORDER BY pos) AS later FROM s)
SELECT user_id, pos + 0.5 AS moment, round(value + 0.5 * (later - value), 6) AS value FROM p WHERE later IS NOT NULL""",
    "threshold_sweep": f"""WITH s AS ({SCORES}), t AS (SELECT DISTINCT CAST(floor(cost / 5) AS BIGINT) * 5.0 AS thr FROM s),
c AS (SELECT thr, target, count(*) AS n FROM t JOIN s ON s.cost < t.thr GROUP BY thr, target), p AS (SELECT count(*) AS positives FROM s WHERE target)
SELECT thr, coalesce(sum(CASE WHEN target THEN n END), 0) AS tp, coalesce(sum(CASE WHEN NOT target THEN n END), 0) AS fp, max(positives) - coalesce(sum(CASE WHEN target THEN n END), 0) AS fn FROM c CROSS JOIN p GROUP BY thr""",
    "best_threshold": f"""WITH s AS ({SCORES}), t AS (SELECT DISTINCT CAST(floor(cost / 5) AS BIGINT) * 5.0 AS thr FROM s),
c AS (SELECT thr, sum(CASE WHEN target THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN target THEN 0 ELSE 1 END) AS fp FROM t JOIN s ON s.cost < t.thr GROUP BY thr),
p AS (SELECT count(*) AS positives FROM s WHERE target), f AS (SELECT thr + 0.01 AS thr, round(tp / (tp + 0.5 * (fp + positives - tp)), 9) AS f1 FROM c CROSS JOIN p)
SELECT thr, f1 FROM f ORDER BY f1 DESC, thr LIMIT 1""",
    "discard_curve": f"""WITH s AS ({SCORES}), t AS (SELECT DISTINCT CAST(floor(cost / 5) AS BIGINT) * 5.0 AS thr FROM s)
SELECT thr, target, round(avg(CASE WHEN cost > thr THEN 1.0 ELSE 0.0 END), 9) AS discarded FROM s CROSS JOIN t GROUP BY thr, target""",
    "confusion": "SELECT quality = 1 AS truth, toxic = 1 AS predicted, count(*) AS n FROM {labels} GROUP BY 1, 2",
    "precision_recall": """WITH c AS (SELECT sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS fn FROM {labels})
SELECT round(coalesce(tp / nullif(tp + fp + 0.0, 0), 0), 9) AS prec, round(coalesce(tp / nullif(tp + fn + 0.0, 0), 0), 9) AS rec, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""",
    "mean_times": "SELECT event_type, round(avg(value), 6) AS mean_time, round(median(value), 6) AS median_time, round(max(value), 6) AS max_time, round(sum(value), 4) AS total_time, count(*) AS reads FROM {events} GROUP BY event_type",
    "relative_abundance": """WITH g AS (SELECT n_name AS organism, count(*) AS reads, sum(o_totalprice) AS bases FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT organism, reads, round(reads * 1.0 / sum(reads) OVER (), 9) AS read_share, round(bases / sum(bases) OVER (), 9) AS base_share, round(bases / reads, 4) AS mean_length FROM g""",
    "abundance_distance": """WITH a AS (SELECT c_nationkey AS k, count(*) AS n, sum(o_totalprice) AS b FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey),
r AS (SELECT k, n * 1.0 / sum(n) OVER () AS x, b / sum(b) OVER () AS y FROM a) SELECT round(sqrt(sum((x - y) * (x - y))), 9) AS distance FROM r""",
    "running_abundance": """WITH a AS (SELECT o_orderkey, c_nationkey AS k, o_totalprice AS len, row_number() OVER (ORDER BY o_orderkey) AS tick FROM {orders} JOIN {customer} ON o_custkey = c_custkey),
t AS (SELECT DISTINCT tick FROM a WHERE tick % 500 = 0) SELECT t.tick, a.k AS organism, round(sum(len), 2) AS bases FROM t JOIN a ON a.tick <= t.tick GROUP BY t.tick, a.k""",
    "primary_overlap": """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS id, l_suppkey AS ref, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) AS hi, l_extendedprice AS score FROM {lineitem}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS rnk FROM i), f AS (SELECT * FROM r WHERE rnk = 1)
SELECT r.k, r.id FROM r LEFT JOIN f ON r.k = f.k AND r.ref = f.ref AND greatest(r.lo, f.lo) <= least(r.hi, f.hi) AND r.rnk > 1 WHERE f.k IS NULL""",
    "mapq_confidence": """WITH s AS (SELECT l_orderkey AS k, l_extendedprice AS score, l_quantity AS anchors, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rnk, avg(l_extendedprice) OVER (PARTITION BY l_orderkey) AS mean, count(*) OVER (PARTITION BY l_orderkey) AS n, lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS s2 FROM {lineitem})
SELECT k, CASE WHEN s2 IS NULL THEN 60 ELSE trunc_(greatest(0.0, least(60.0, 40 * (1 - s2 / score)))) END AS mapq, CASE WHEN n >= 2 THEN score / s2 >= 1.2 OR score >= 5 * mean ELSE anchors >= 2 END AS confident FROM s WHERE rnk = 1""",
    "chain_end_pruning": """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS score, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM {lineitem})
SELECT k, i, score FROM s WHERE score >= 10 AND score > best / 2""",
    "top_chains": """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2, l_partkey % 2 ORDER BY l_quantity DESC, l_linenumber DESC) AS rnk, max(l_quantity) OVER (PARTITION BY l_orderkey, l_suppkey % 2, l_partkey % 2) AS best FROM {lineitem})
SELECT k, i, rnk FROM s WHERE rnk <= 3 AND score >= best / 2""",
    "minmax_scale": "WITH g AS (SELECT n_regionkey AS metric, n_name AS tool, avg(s_acctbal) AS v FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT metric, tool, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS scaled FROM g WINDOW w AS (PARTITION BY metric)",
    "best_metric": "WITH g AS (SELECT n_regionkey AS metric, n_name AS tool, round(avg(s_acctbal), 6) AS v FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT metric, tool, v, v = max(v) OVER (PARTITION BY metric) AS is_best FROM g",
    "parameter_sweep": f"""WITH s AS ({SCORES}), b AS (SELECT 5.0 AS bonus UNION ALL SELECT 10.0 UNION ALL SELECT 20.0), m AS (SELECT 10.0 AS least UNION ALL SELECT 30.0 UNION ALL SELECT 60.0)
SELECT bonus, least, sum(CASE WHEN cost + bonus >= least AND target THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN cost + bonus >= least AND NOT target THEN 1 ELSE 0 END) AS fp FROM s CROSS JOIN b CROSS JOIN m GROUP BY bonus, least""",
    "first_fail_stage": f"""WITH s AS ({TRACE}), c AS (SELECT user_id, pos, sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cost FROM s),
st AS (SELECT 9 AS pos, 480.0 AS thr UNION ALL SELECT 19, 1000.0 UNION ALL SELECT 39, 2000.0)
SELECT c.user_id, min(CASE WHEN cost > thr THEN c.pos END) AS fail_pos, count(*) AS stages FROM c JOIN st ON c.pos = st.pos GROUP BY c.user_id""",
    "cascade_reject": f"""WITH s AS ({TRACE}), c AS (SELECT user_id, pos, sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cost FROM s),
a AS (SELECT user_id FROM c WHERE pos = 9 AND cost <= 520), b AS (SELECT c.user_id FROM c JOIN a ON c.user_id = a.user_id WHERE pos = 19 AND cost <= 1040)
SELECT 1 AS stage, count(*) AS kept FROM a UNION ALL SELECT 2, count(*) FROM b""",
    "runtime_model": f"""WITH s AS ({SCORES}), t AS (SELECT DISTINCT CAST(floor(cost / 10) AS BIGINT) * 10.0 AS thr FROM s),
c AS (SELECT thr, avg(CASE WHEN target AND cost < thr THEN 1.0 WHEN target THEN 0.0 END) AS keep_t, avg(CASE WHEN NOT target AND cost < thr THEN 1.0 WHEN NOT target THEN 0.0 END) AS keep_o FROM s CROSS JOIN t GROUP BY thr)
SELECT thr, round(30000.0 * 30 * 4000 / 450.0 / ((0.01 * keep_t * 4000) / (0.01 * (1 + keep_t * 3 + (1 - keep_t) * 0.5) + 0.99 * (1 + keep_o * 3 + (1 - keep_o) * 0.5))), 3) AS duration FROM c WHERE keep_t > 0""",
    "optimal_threshold": f"""WITH s AS ({SCORES}), t AS (SELECT DISTINCT CAST(floor(cost / 10) AS BIGINT) * 10.0 AS thr FROM s),
c AS (SELECT thr, avg(CASE WHEN target AND cost < thr THEN 1.0 WHEN target THEN 0.0 END) AS keep_t, avg(CASE WHEN NOT target AND cost < thr THEN 1.0 WHEN NOT target THEN 0.0 END) AS keep_o FROM s CROSS JOIN t GROUP BY thr),
d AS (SELECT thr, round((0.01 * (1 + keep_t * 3) + 0.99 * (1 + keep_o * 3)) / keep_t, 9) AS cost FROM c WHERE keep_t > 0) SELECT thr, cost FROM d ORDER BY cost, thr LIMIT 1""",
    "simple_runtime": "SELECT s_suppkey, round(30000.0 * 30 * (1 + s_acctbal / 450 / 4) / (1 + abs(s_acctbal)), 6) AS seconds FROM {supplier}",
    "read_counts": "SELECT source, count(*) AS reads, sum(n_chars) AS bases, round(avg(n_chars), 6) AS mean_length FROM {documents} GROUP BY source",
    "semi_membership": "SELECT d.doc_id FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality = 1)",
    "anti_membership": "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)",
    "union_labelled": "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM {customer} GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM {supplier} GROUP BY s_nationkey",
    "prefixed_union": "SELECT 'c_' || c_name AS name, c_nationkey AS nation FROM {customer} UNION ALL SELECT 's_' || s_name, s_nationkey FROM {supplier}",
    "key_intersection": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_difference": "SELECT l_partkey % 400 AS a, l_suppkey AS b FROM {lineitem} EXCEPT SELECT p_partkey % 400, p_partkey % 100 FROM {part}",
    "merge_right_precedence": "WITH u AS (SELECT s_nationkey AS k, s_suppkey AS v, 1 AS side FROM {supplier} UNION ALL SELECT c_nationkey, c_custkey, 2 FROM {customer}), r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY side DESC, v DESC) AS rn FROM u) SELECT k, v FROM r WHERE rn = 1",
    "sample_top": "SELECT event_id, value FROM {events} WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 50",
    "truth_compare": """WITH m AS (SELECT l_orderkey AS k, l_suppkey AS ref, l_partkey AS lo, l_partkey + 50 AS hi FROM {lineitem} WHERE l_linenumber = 1 AND l_quantity > 10), t AS (SELECT l_orderkey AS k, l_suppkey AS ref, l_partkey AS lo, l_partkey + 50 AS hi FROM {lineitem} WHERE l_linenumber = 1 AND l_discount < 0.05)
SELECT CASE WHEN m.k IS NULL AND t.k IS NULL THEN 'tn' WHEN m.k IS NULL THEN 'fn' WHEN t.k IS NOT NULL AND m.ref = t.ref AND greatest(m.lo, t.lo) <= least(m.hi, t.hi) THEN 'tp' ELSE 'fp' END AS verdict, count(*) AS n FROM {orders} o LEFT JOIN m ON m.k = o.o_orderkey LEFT JOIN t ON t.k = o.o_orderkey GROUP BY 1""",
}


#: Columns of the results and their types, the same in both engines.
COLUMNS = {
    "pa_filter": "user_id BIGINT, n BIGINT, total DOUBLE",
    "zscore": "user_id BIGINT, pos BIGINT, z DOUBLE",
    "discrete_norm_4": "user_id BIGINT, pos BIGINT, code BIGINT",
    "discrete_norm_8": "user_id BIGINT, pos BIGINT, code BIGINT",
    "prefix_sums": "user_id BIGINT, pos BIGINT, total DOUBLE, squares DOUBLE",
    "first_difference": "user_id BIGINT, pos BIGINT, diff DOUBLE",
    "expanding_norm": "user_id BIGINT, pos BIGINT, code BIGINT",
    "histogram": "bin BIGINT, n BIGINT",
    "interpolate": "user_id BIGINT, moment DOUBLE, value DOUBLE",
    "threshold_sweep": "thr DOUBLE, tp BIGINT, fp BIGINT, fn BIGINT",
    "best_threshold": "thr DOUBLE, f1 DOUBLE",
    "discard_curve": "thr DOUBLE, target BOOLEAN, discarded DOUBLE",
    "confusion": "truth BOOLEAN, predicted BOOLEAN, n BIGINT",
    "precision_recall": "prec DOUBLE, rec DOUBLE, f1 DOUBLE",
    "mean_times": "event_type VARCHAR, mean_time DOUBLE, median_time DOUBLE, max_time DOUBLE, total_time DOUBLE, reads BIGINT",
    "relative_abundance": "organism VARCHAR, reads BIGINT, read_share DOUBLE, base_share DOUBLE, mean_length DOUBLE",
    "abundance_distance": "distance DOUBLE",
    "running_abundance": "tick BIGINT, organism BIGINT, bases DOUBLE",
    "primary_overlap": "k BIGINT, id BIGINT",
    "mapq_confidence": "k BIGINT, mapq BIGINT, confident BOOLEAN",
    "chain_end_pruning": "k BIGINT, i BIGINT, score DOUBLE",
    "top_chains": "k BIGINT, i BIGINT, rnk BIGINT",
    "minmax_scale": "metric BIGINT, tool VARCHAR, scaled DOUBLE",
    "best_metric": "metric BIGINT, tool VARCHAR, v DOUBLE, is_best BOOLEAN",
    "parameter_sweep": "bonus DOUBLE, least DOUBLE, tp BIGINT, fp BIGINT",
    "first_fail_stage": "user_id BIGINT, fail_pos BIGINT, stages BIGINT",
    "cascade_reject": "stage BIGINT, kept BIGINT",
    "runtime_model": "thr DOUBLE, duration DOUBLE",
    "optimal_threshold": "thr DOUBLE, cost DOUBLE",
    "simple_runtime": "s_suppkey BIGINT, seconds DOUBLE",
    "read_counts": "source VARCHAR, reads BIGINT, bases BIGINT, mean_length DOUBLE",
    "semi_membership": "doc_id BIGINT",
    "anti_membership": "doc_id BIGINT",
    "union_labelled": "kind VARCHAR, nation BIGINT, n BIGINT",
    "prefixed_union": "name VARCHAR, nation BIGINT",
    "key_intersection": "k BIGINT",
    "set_difference": "a BIGINT, b BIGINT",
    "merge_right_precedence": "k BIGINT, v BIGINT",
    "sample_top": "event_id BIGINT, value DOUBLE",
    "truth_compare": "verdict VARCHAR, n BIGINT",
}


def _cast(sql: str) -> str:
    """trunc_(x) as a whole number, cut towards zero, in words that both engines take."""
    while "trunc_(" in sql:
        at = sql.index("trunc_(")
        depth, end = 1, at + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[at + 7 : end - 1]
        sql = f"{sql[:at]}CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS BIGINT){sql[end:]}"
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)  # numbers with a point are doubles in both engines


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(c if c.endswith("VARCHAR") else f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in COLUMNS[name].split(", "))
    return f"SELECT {casts.replace(' VARCHAR', '')} FROM ({_cast(sql)})"


def query(name: str, sql: str):
    text = _typed(name, sql)
    used = [t for t in TABLES if re.search(rf"\{{{t}\}}", text)]

    def run(spark, sf_dir: str):
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run


def oracle(name: str, sql: str) -> str:
    text = _typed(name, sql)
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


QUERIES = {name: query(name, sql) for name, sql in STATEMENTS.items()}  # frame_queries has others for five of them, which scale better
ORACLES = {name: oracle(name, sql) for name, sql in STATEMENTS.items()}
