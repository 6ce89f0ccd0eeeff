"""Pieces of SQL that several queries share: the tables of plans.adapters in DuckDB's SQL."""

C4 = "test_subject, test_trial, task, fold"
EV = """ev AS (SELECT (user_id % 6)::INT AS test_subject, ((user_id // 6) % 2)::INT AS test_trial, event_type AS task, event_id AS base_index,
  CAST(floor((epoch_us(ts) - 1704067200000000) * 2048 / 1000000.0) AS BIGINT) AS window_from, (value >= 35)::INT AS label, value FROM events)"""
FI = (
    EV
    + """, h AS (SELECT *, ntile(2) OVER (PARTITION BY test_subject, test_trial, task, label ORDER BY window_from, base_index) - 1 AS h FROM ev),
q AS (SELECT *, ntile(2) OVER (PARTITION BY test_subject, test_trial, task, label, h ORDER BY window_from, base_index) AS q FROM h),
fi AS (SELECT test_subject, test_trial, task, h::INT AS fold, CASE WHEN q = 1 THEN 'val' ELSE 'test' END AS role, base_index, window_from, label FROM q
  UNION ALL SELECT test_subject, test_trial, task, (1 - h)::INT, 'train', base_index, window_from, label FROM q)"""
)
LI = """dec AS (SELECT l_returnflag AS model, (l_suppkey % 6)::INT AS subject, ((l_suppkey // 6) % 2)::INT AS trial, l_linenumber::VARCHAR AS task, (l_orderkey % 2)::INT AS fold, l_discount * 10 AS x FROM lineitem),
cells AS (SELECT model, subject, trial, task, avg(x) AS auroc FROM dec GROUP BY ALL),
ov AS (SELECT model, subject, trial, avg(auroc) AS auroc FROM cells GROUP BY ALL HAVING count(DISTINCT task) = 7)"""
PA = """el AS (SELECT p_type || (b * 4 + least(p_size % 5, b % 4))::VARCHAR AS electrode, avg(p_retailprice) AS mean_auroc
  FROM (SELECT *, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS b FROM part) x GROUP BY 1),
na AS (SELECT electrode, mean_auroc, regexp_extract(electrode, '^(.*[A-Za-z])([0-9]+)$', 1) AS stem, regexp_extract(electrode, '^(.*[A-Za-z])([0-9]+)$', 2)::INT AS num FROM el),
br AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM na b WHERE b.stem = a.stem AND b.num = a.num - 1) AS starts FROM na a),
st AS (SELECT *, (SELECT max(b.num) FROM br b WHERE b.stem = a.stem AND b.starts AND b.num <= a.num) AS lo FROM br a),
rn AS (SELECT stem, lo, count(*) AS len, max(num) AS hi, avg(mean_auroc) AS perf FROM st GROUP BY stem, lo)"""
EM = """em AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
PROFILES = (
    EM
    + """, mu AS (SELECT vec_id, avg(x) AS m FROM em GROUP BY vec_id),
pr AS (SELECT e.vec_id, i, sum(x - m) OVER (PARTITION BY e.vec_id ORDER BY i) AS y FROM em e JOIN mu ON e.vec_id = mu.vec_id)"""
)
PR = (
    PROFILES
    + """,
sg AS (SELECT vec_id, s AS scale, i // s AS segment, i % s AS t, y FROM pr, (SELECT unnest([8, 9, 10, 11, 12, 13, 14, 16]) AS s) z WHERE i < (64 // s) * s),
rw AS (SELECT vec_id, scale, segment, sqrt(greatest(regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t), 0) / count(*)) AS r FROM sg GROUP BY ALL),
fl AS (SELECT vec_id, scale, coalesce(median(CASE WHEN r > 0 THEN r END) * 0.001, 0) AS f FROM rw GROUP BY ALL),
rm AS (SELECT rw.vec_id, rw.scale, segment, greatest(r, f, 2.220446049250313e-16::DOUBLE) AS rms FROM rw JOIN fl ON rw.vec_id = fl.vec_id AND rw.scale = fl.scale)"""
)
