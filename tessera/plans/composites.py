"""SQL of the composite analyses, for the engine that they are checked with."""

from __future__ import annotations

from .inputs import HALF, SQL_CUSTOMERS, SQL_FLOWS, SQL_MONTHLY, SQL_PANEL

#: The SQL of each query that ``analyses`` and ``checks`` build from DataFrame operators.
SQL: dict[str, str] = {}


def said(name: str, text: str) -> None:
    SQL[name] = text


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


_C, _M, _P = f"WITH {SQL_CUSTOMERS}", f"WITH {SQL_MONTHLY}", f"WITH {SQL_PANEL}"
_AT = "at_ AS (SELECT n_nationkey AS id, n_regionkey AS g, (n_nationkey * 37 % 120) - 60 AS x, (n_nationkey * 53 % 300) - 150 AS y FROM nation)"

said("regional_centers", f"WITH {_AT}, c AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END, id) AS n FROM at_) SELECT g, id FROM c WHERE n = 1")
said(
    "distance_to_capital",
    f"""WITH {_AT}, cap AS (SELECT g, min(id) AS c FROM at_ GROUP BY g), e AS (SELECT a.id AS a, b.id AS b, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS double)) AS d FROM at_ a JOIN at_ b ON a.id < b.id AND (a.id + b.id) % 3 <> 0),
    two AS (SELECT a, b, d FROM e UNION ALL SELECT b, a, d FROM e), near AS (SELECT two.a AS id, min(d) AS d FROM two JOIN at_ ON two.a = at_.id JOIN cap ON cap.g = at_.g AND cap.c = two.b GROUP BY two.a)
    SELECT at_.id, CASE WHEN at_.id = cap.c THEN 0.0e0 ELSE {_r("near.d")} END AS km FROM at_ JOIN cap ON cap.g = at_.g LEFT JOIN near ON near.id = at_.id""",
)
said("lineage", "WITH v AS (SELECT s_suppkey AS id, s_suppkey % 40 AS died, s_suppkey % 30 AS born FROM supplier), r AS (SELECT a.id, 'predecessor' AS role FROM v a JOIN v b ON a.died = b.born AND a.id < b.id UNION ALL SELECT b.id, 'successor' FROM v a JOIN v b ON a.died = b.born AND a.id < b.id) SELECT id, min(role) AS role, count(*) AS n FROM r GROUP BY id")
said("road_pairs", "WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, l_quantity AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d, max(d) - min(d) AS spread, count(*) AS n FROM e WHERE a <> b GROUP BY 1, 2")
said("node_rollup", f"{_C}, m AS (SELECT id, CASE WHEN g < 5 THEN 1000 + g ELSE id END AS node, bal AS v, n_orders AS w FROM cust) SELECT node, count(*) AS members, {_r('sum(CASE WHEN w > 0 THEN v * w END) / sum(CASE WHEN w > 0 THEN w END)', 4)} AS v, CAST(sum(w) AS bigint) AS w FROM m GROUP BY node HAVING sum(w) > 0")
said("node_distance", f"WITH {_AT}, m AS (SELECT id, g AS node, x, y, id + 1 AS w FROM at_), d AS (SELECT a.node AS a, b.node AS b, a.w * b.w AS w, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS double)) AS d FROM m a JOIN m b ON a.node < b.node) SELECT a, b, {_r('sum(w * d) / sum(w)')} AS d, {_r('min(d)')} AS least_d FROM d GROUP BY a, b")

#: The ten nearest by balance are among the ten before and the ten after in order of balance.
_OFF = "off AS (" + " UNION ALL ".join(f"SELECT {i} AS o" for i in range(-10, 11) if i) + ")"
_SETS = f"""{_C}, {_OFF}, c AS (SELECT id, g, seg, bal, spend, row_number() OVER (PARTITION BY seg ORDER BY bal, id) AS rs, row_number() OVER (PARTITION BY g ORDER BY bal, id) AS rg FROM cust),
near AS (SELECT a.id, a.spend AS y, b.spend AS z, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.bal - b.bal), b.id) AS k FROM c a CROSS JOIN off JOIN c b ON a.seg = b.seg AND b.rs = a.rs + o),
own AS (SELECT a.id, b.spend AS z, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.bal - b.bal), b.id) AS k FROM c a CROSS JOIN off JOIN c b ON a.g = b.g AND b.rg = a.rg + o),
ea AS (SELECT id, abs(max(y) - median(z)) AS e FROM near WHERE k <= 10 GROUP BY id),
eb AS (SELECT own.id, abs(max(c.spend) - median(z)) AS e FROM own JOIN c ON c.id = own.id WHERE k <= 10 GROUP BY own.id)"""
said("comparable_set_errors", f"{_SETS} SELECT ea.id, {_r('ea.e', 4)} AS by_type, {_r('eb.e', 4)} AS by_group FROM ea JOIN eb ON ea.id = eb.id")
said("rule_share", f"{_SETS}, w AS (SELECT c.seg, CASE WHEN ea.e < eb.e - 1e-9 THEN 1 ELSE 0 END AS win, CASE WHEN abs(ea.e - eb.e) <= 1e-9 THEN 1 ELSE 0 END AS tie, eb.e - ea.e AS gain FROM ea JOIN eb ON ea.id = eb.id JOIN c ON c.id = ea.id) SELECT seg, count(*) AS n, {_r('avg(CAST(win AS double))')} AS win_share, CAST(sum(tie) AS bigint) AS ties, {_r('median(gain)', 4)} AS gain FROM w GROUP BY seg")

said("funnel", f"{_C} SELECT count(*) AS all_, count(CASE WHEN n_orders > 0 THEN 1 END) AS active, count(CASE WHEN n_orders > 0 AND bal > 0 THEN 1 END) AS solvent, count(CASE WHEN n_orders > 8 AND bal > 0 THEN 1 END) AS loyal FROM cust")
said("incomplete_by_region", f"{_P}, m AS (SELECT id, g, count(DISTINCT t) AS n FROM panel WHERE cat = '2-HIGH' GROUP BY id, g) SELECT g, count(*) AS n, count(CASE WHEN n < 24 THEN 1 END) AS partial, {_r('avg(CASE WHEN n < 24 THEN 1.0e0 ELSE 0.0e0 END)')} AS share FROM m GROUP BY g")
said("story_scores", f"{_C}, k AS (SELECT seg, avg(bal) AS a, avg(CAST(n_orders AS double)) AS b, median(spend) AS c FROM cust GROUP BY seg), s AS (SELECT seg, CASE WHEN a >= 4600 THEN 5 WHEN a >= 4400 THEN 3 ELSE 1 END AS pa, CASE WHEN b >= 10 THEN 5 WHEN b >= 9.5 THEN 3 ELSE 1 END AS pb, CASE WHEN c >= 1500000 THEN 5 WHEN c >= 1000000 THEN 3 ELSE 1 END AS pc FROM k) SELECT seg, {_r('0.5e0 * pa + 0.3e0 * pb + 0.2e0 * pc')} AS score FROM s")
_NOISE = f"{_M}, d AS (SELECT id, y - avg(y) OVER (PARTITION BY id) AS r, sum(v) OVER (PARTITION BY id) AS size FROM monthly), m AS (SELECT id, round(max(size), 0) AS size, 1.4826e0 * median(abs(r)) AS sd FROM d GROUP BY id), b AS (SELECT id, sd, ntile(5) OVER (ORDER BY size, id) AS bin FROM m)"
said("noise_by_size", f"{_NOISE} SELECT CAST(bin AS integer) AS bin, count(*) AS n, {_r('median(sd)')} AS sd FROM b GROUP BY bin")
said("noise_ratio", f"{_NOISE} SELECT {_r('median(CASE WHEN bin = 1 THEN sd END) / median(CASE WHEN bin = 5 THEN sd END)')} AS ratio FROM b")
said("type_signatures", f"{_C}, t AS (SELECT 'rich' AS kind, id, bal, spend FROM cust WHERE bal > 7000 UNION ALL SELECT 'busy', id, bal, spend FROM cust WHERE n_orders > 12 UNION ALL SELECT 'idle', id, bal, spend FROM cust WHERE n_orders = 0) SELECT kind, count(*) AS n, {_r('median(bal)', 4)} AS bal, {_r('median(spend)', 4)} AS spend FROM t GROUP BY kind")
said("context_hints", f"{_C}, l AS (SELECT id, seg, 'bal' AS f, bal AS x FROM cust UNION ALL SELECT id, seg, 'orders', CAST(n_orders AS double) FROM cust UNION ALL SELECT id, seg, 'spend', spend FROM cust), m AS (SELECT *, x - median(x) OVER (PARTITION BY f, seg) AS d FROM l), z AS (SELECT *, d / nullif(1.4826e0 * median(abs(d)) OVER (PARTITION BY f, seg), 0) AS z FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(round(z, 6)) DESC, f) AS n FROM z WHERE z IS NOT NULL) SELECT id, f, CAST(n AS integer) AS place, {_r('z')} AS z FROM k WHERE n <= 2")
said("step_test", f"{_M}, d AS (SELECT id, t, y - lag(y) OVER (PARTITION BY id ORDER BY t) AS d FROM monthly), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(round(d, 9)) DESC, t) AS n FROM d WHERE d IS NOT NULL) SELECT id, t, {_r('d')} AS step FROM k WHERE n = 1")
said("quintile_gap", f"{_C}, b AS (SELECT ntile(5) OVER (ORDER BY bal, id) AS bin, spend FROM cust), m AS (SELECT bin, median(spend) AS m, count(*) AS n FROM b GROUP BY bin) SELECT CAST(bin AS integer) AS bin, n, {_r('m', 4)} AS med, {_r('m - avg(m) OVER ()', 4)} AS gap FROM m")
said("base_ratio", f"{_C}, b AS (SELECT ntile(5) OVER (ORDER BY spend, id) AS bin, bal FROM cust) SELECT {_r('median(CASE WHEN bin = 5 THEN bal END) / median(CASE WHEN bin = 1 THEN bal END)')} AS ratio FROM b")
said(
    "place_groups",
    f"""{_C}, p AS (SELECT CASE WHEN n_orders = 0 THEN 'none' WHEN bal < 0 THEN 'debt' ELSE 'rest' END AS place, bal, spend FROM cust),
    k AS (SELECT place, rank() OVER (PARTITION BY place ORDER BY bal) + (count(*) OVER (PARTITION BY place, bal) - 1) / 2.0e0 AS x, rank() OVER (PARTITION BY place ORDER BY spend) + (count(*) OVER (PARTITION BY place, spend) - 1) / 2.0e0 AS y FROM p WHERE bal IS NOT NULL AND spend IS NOT NULL),
    c AS (SELECT place, {_r('CASE WHEN count(*) >= 3 THEN corr(x, y) END')} AS r FROM k GROUP BY place)
    SELECT p.place, count(*) AS n, {_r('median(bal)', 4)} AS bal, max(r) AS r FROM p LEFT JOIN c ON p.place = c.place GROUP BY p.place""",
)
said("outer_center", f"{_C}, {_AT}, m AS (SELECT at_.id, x, y, count(*) AS w FROM at_ JOIN cust ON cust.g = at_.id GROUP BY at_.id, x, y), c AS (SELECT sum(w * x) / CAST(sum(w) AS double) AS cx, sum(w * y) / CAST(sum(w) AS double) AS cy FROM m) SELECT m.id, {_r('sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))')} AS d FROM m CROSS JOIN c")
said("work_home_ratio", f"{_C}, r AS (SELECT g, count(CASE WHEN n_orders > 8 THEN 1 END) / CAST(count(CASE WHEN bal > 0 THEN 1 END) AS double) AS ratio FROM cust GROUP BY g HAVING count(CASE WHEN bal > 0 THEN 1 END) > 0) SELECT {_r('min(ratio)')} AS low, {_r('median(ratio)')} AS med, {_r('max(ratio)')} AS high, count(*) AS n FROM r")
said("exclusive_missing", f"{_P}, has AS (SELECT DISTINCT id, t FROM panel), g AS (SELECT n_nationkey AS id, n_regionkey AS g FROM nation) SELECT g.g, g.id FROM g WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.id = g.id AND has.t = 3)")

_METRICS = f"{_C}, k AS (SELECT g AS cand, avg(bal) AS a, avg(CAST(n_orders AS double)) AS b, median(spend) AS c FROM cust GROUP BY g)"
said("kendall_tau", f"{_METRICS}, p AS (SELECT sign(x.a - y.a) AS u, sign(x.b - y.b) AS v FROM k x JOIN k y ON x.cand < y.cand) SELECT {_r('sum(u * v) / sqrt(CAST(sum(abs(u)) AS double) * sum(abs(v)))')} AS tau FROM p")
said("metric_with_size", f"{_METRICS}, s AS (SELECT g AS cand, count(*) AS n FROM cust GROUP BY g), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0e0 AS x, rank() OVER (ORDER BY a) AS y FROM k JOIN s ON k.cand = s.cand) SELECT {_r('corr(x, y)')} AS rho FROM r")
said("mean_metric_rank", f"{_METRICS} SELECT cand, {_r('(rank() OVER (ORDER BY a) + rank() OVER (ORDER BY b) + rank() OVER (ORDER BY c)) / 3.0e0')} AS r FROM k")
said("pair_table_rank_corr", f"{_METRICS}, p AS (SELECT x.cand AS i, y.cand AS j, abs(x.a - y.a) AS d1, abs(x.c - y.c) AS d2 FROM k x JOIN k y ON x.cand < y.cand), r AS (SELECT rank() OVER (ORDER BY d1) AS a, rank() OVER (ORDER BY d2) AS b FROM p) SELECT {_r('corr(a, b)')} AS rho, count(*) AS n FROM r")
said("ordered_trend", f"{_C}, m AS (SELECT CASE WHEN n_orders = 0 THEN 0 WHEN n_orders <= 8 THEN 1 WHEN n_orders <= 16 THEN 2 ELSE 3 END AS k, bal FROM cust), j AS (SELECT a.k AS a, b.k AS b, sum(CASE WHEN b.bal > a.bal THEN 1.0e0 WHEN b.bal = a.bal THEN 0.5e0 ELSE 0.0e0 END) AS u, count(*) AS n FROM m a JOIN m b ON a.k < b.k GROUP BY a.k, b.k) SELECT a, b, u, n, {_r('u / n')} AS p FROM j")
said("monotone_medians", f"{_C}, m AS (SELECT seg, ntile(3) OVER (PARTITION BY seg ORDER BY spend, id) AS k, bal FROM cust), d AS (SELECT seg, k, median(bal) AS m FROM m GROUP BY seg, k), s AS (SELECT seg, m - lag(m) OVER (PARTITION BY seg ORDER BY k) AS d FROM d) SELECT seg, min(CASE WHEN d < 0 THEN 0 ELSE 1 END) = 1 AS rising FROM s WHERE d IS NOT NULL GROUP BY seg")
said("direction_test", f"{_M}, d AS (SELECT b.y - a.y AS d FROM monthly a JOIN monthly b ON a.id = b.id AND b.t = a.t + 12) SELECT count(CASE WHEN d > 0 THEN 1 END) AS up, count(CASE WHEN d < 0 THEN 1 END) AS down, {_r('(count(CASE WHEN d > 0 THEN 1 END) - count(CASE WHEN d < 0 THEN 1 END)) / sqrt(CAST(count(CASE WHEN d <> 0 THEN 1 END) AS double))')} AS z FROM d")
said("minimum_effect", f"{_C} SELECT seg, {_r('2.801585e0 * sqrt(var_samp(bal) / count(CASE WHEN n_orders > 8 THEN 1 END) + var_samp(bal) / count(CASE WHEN n_orders <= 8 THEN 1 END))', 4)} AS mde FROM cust GROUP BY seg")
said("split_half_reliability", f"{_M}, h AS (SELECT id, avg(CASE WHEN t % 2 = 0 THEN y END) AS a, avg(CASE WHEN t % 2 = 1 THEN y END) AS b FROM monthly GROUP BY id), r AS (SELECT corr(a, b) AS r, count(*) AS n FROM h WHERE a IS NOT NULL AND b IS NOT NULL) SELECT {_r('r')} AS r, {_r('2 * r / (1 + r)')} AS spearman_brown, n FROM r")
said("adjusted_r2", f"{_C}, f AS (SELECT regr_r2(spend, bal) AS r2, count(*) AS n FROM cust) SELECT {_r('r2')} AS r2, {_r('1 - (1 - r2) * (n - 1) / CAST(n - 2 AS double)')} AS adj FROM f")
said("group_dummy_gain", f"{_C}, d AS (SELECT n_orders - avg(CAST(n_orders AS double)) OVER () AS y, bal - avg(bal) OVER () AS x, n_orders - avg(CAST(n_orders AS double)) OVER (PARTITION BY seg) AS yw, bal - avg(bal) OVER (PARTITION BY seg) AS xw FROM cust), s AS (SELECT sum(y * y) AS t, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS e0, sum(yw * yw) - sum(xw * yw) * sum(xw * yw) / sum(xw * xw) AS e1 FROM d) SELECT {_r('(e0 - e1) / t')} AS gain FROM s")
said("interaction_shares", f"{_C}, s AS (SELECT seg, g, count(*) AS n FROM cust GROUP BY seg, g) SELECT seg, count(CASE WHEN share >= 0.05e0 THEN 1 END) AS big FROM (SELECT seg, n / CAST(sum(n) OVER (PARTITION BY seg) AS double) AS share FROM s) t GROUP BY seg")
said("matched_placebo", f"{_M}, h AS (SELECT id, avg(CASE WHEN t < {HALF} AND t % 2 = 0 THEN y END) AS a0, avg(CASE WHEN t < {HALF} AND t % 2 = 1 THEN y END) AS a1, avg(CASE WHEN t >= {HALF} THEN y END) AS b FROM monthly GROUP BY id) SELECT {_r('avg(abs(b - (a0 + a1) / 2))')} AS change, {_r('avg(abs(a0 - a1))')} AS noise, count(*) AS n FROM h WHERE a0 IS NOT NULL AND a1 IS NOT NULL AND b IS NOT NULL")
said("events_by_threshold", f"{_M}, q AS (SELECT id, CAST(floor(t / 12.0e0) AS integer) AS win, sum(v) AS v FROM monthly GROUP BY 1, 2), l AS (SELECT id, win, ntile(4) OVER (PARTITION BY win ORDER BY v, id) AS label FROM q), c AS (SELECT a.label AS x, b.label AS y, count(*) AS c FROM l a JOIN l b ON a.id = b.id AND a.win = 0 AND b.win = 1 GROUP BY 1, 2), j AS (SELECT x, y, c / CAST(sum(c) OVER (PARTITION BY x) + sum(c) OVER (PARTITION BY y) - c AS double) AS j FROM c) SELECT tau, count(CASE WHEN j >= tau THEN 1 END) AS links FROM j CROSS JOIN (SELECT 0.2e0 AS tau UNION ALL SELECT 0.4e0 UNION ALL SELECT 0.6e0) t GROUP BY tau")
said("quantile_regression_bins", f"{_C}, b AS (SELECT ntile(10) OVER (ORDER BY spend, id) AS bin, spend, bal FROM cust) SELECT CAST(bin AS integer) AS bin, {_r('avg(spend)', 4)} AS spend, {_r('avg(bal)', 4)} AS bal, count(*) AS n FROM b GROUP BY bin")
said("chance_jaccard", f"WITH {SQL_FLOWS}, perm AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS string)), id) - 1 AS p FROM (SELECT n_nationkey AS id FROM nation) n), moved AS (SELECT least(x.p, y.p) AS a, greatest(x.p, y.p) AS b FROM strong JOIN perm x ON strong.a = x.id JOIN perm y ON strong.b = y.id), both_ AS (SELECT count(*) AS n FROM moved JOIN strong ON moved.a = strong.a AND moved.b = strong.b), m AS (SELECT count(*) AS m FROM strong) SELECT {_r('n / CAST(2 * m - n AS double)')} AS jaccard FROM both_ CROSS JOIN m")
said("degree_distribution", f"WITH {SQL_FLOWS}, d AS (SELECT a AS id, count(*) AS degree FROM both_ways GROUP BY a) SELECT degree, count(*) AS n FROM d GROUP BY degree")
