"""Consistency checks, class and bin assignments, and example pickers: the SQL that they are checked with."""

from __future__ import annotations

from .composites import _AT, _C, _M, _P, _r, said
from .inputs import CATEGORIES, HALF, PARTS, SQL_FLOWS, SQL_WIDE

_W = f"WITH {SQL_WIDE}"
_SUM = " + ".join(PARTS)

# ---- consistency ------------------------------------------------------------
said("check_shares_sum_to_one", f"{_W}, s AS (SELECT id, t, {', '.join(f'{p} / ({_SUM}) AS {p}' for p in PARTS)} FROM full_) SELECT count(*) AS n, count(CASE WHEN abs({_SUM} - 1) > 1e-9 THEN 1 END) AS bad FROM s")
said("check_parts_sum_to_all", f"{_W}, a AS (SELECT id, t, sum(v) AS v FROM panel GROUP BY id, t) SELECT count(*) AS n, count(CASE WHEN abs({_SUM} - a.v) > 0.005 THEN 1 END) AS bad FROM full_ JOIN a ON full_.id = a.id AND full_.t = a.t")
said("check_clr_rows_zero", f"{_W}, l AS (SELECT {', '.join(f'ln({p}) AS {p}' for p in PARTS)} FROM full_), c AS (SELECT {', '.join(f'{p} - ({_SUM}) / 5 AS {p}' for p in PARTS)} FROM l) SELECT count(*) AS n, count(CASE WHEN abs({_SUM}) > 1e-9 THEN 1 END) AS bad FROM c")
said("check_month_ordinal", f"{_P} SELECT count(*) AS n, count(CASE WHEN t < 0 OR t > 23 THEN 1 END) AS bad, count(DISTINCT t) AS months FROM panel")
said("check_log_column", f"{_M} SELECT count(*) AS n, count(CASE WHEN abs(exp(y) - v) > 1e-6 * v THEN 1 END) AS bad FROM monthly")
said("check_edge_order", f"WITH {SQL_FLOWS} SELECT count(*) AS n, count(CASE WHEN a >= b THEN 1 END) AS bad, count(CASE WHEN w <= 0 THEN 1 END) AS nonpositive FROM flows")
said("check_keys_unique", f"{_P}, k AS (SELECT id, t, cat, count(*) AS n FROM panel GROUP BY id, t, cat) SELECT count(*) AS n_keys, count(CASE WHEN n > 1 THEN 1 END) AS repeated FROM k")
said("check_references", "SELECT count(*) AS n, count(CASE WHEN c.c_custkey IS NULL THEN 1 END) AS orphans FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey")
said("check_fact_threshold", f"{_C}, f AS (SELECT seg, avg(bal) AS x FROM cust GROUP BY seg) SELECT seg, x >= 4500 AS holds FROM f")
said("controls_by_kind", f"{_C}, f AS (SELECT 'hard' AS kind, count(*) = count(DISTINCT id) AS ok FROM cust UNION ALL SELECT 'soft', abs(avg(bal) - 4500) <= 450 FROM cust UNION ALL SELECT 'info', true) SELECT kind, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS passed FROM f GROUP BY kind")
said("nonnull_coverage", f"{_W} SELECT count(*) AS n, {', '.join(f'count({p}) AS {p}' for p in PARTS)} FROM wide")

# ---- bins and classes -------------------------------------------------------
said("histogram", f"{_C} SELECT CAST(floor(bal / 500.0e0) AS integer) AS bin, count(*) AS n, {_r('count(*) / CAST(sum(count(*)) OVER () AS double)')} AS share FROM cust GROUP BY 1")
said("diverging_classes", f"{_C}, z AS (SELECT (bal - 4500) / 2000.0e0 AS z FROM cust) SELECT CAST(CASE WHEN abs(z) < 0.5 THEN 0 WHEN abs(z) < 1.5 THEN sign(z) ELSE 2 * sign(z) END AS integer) AS class, count(*) AS n FROM z GROUP BY 1")
said("map_classes", f"{_C}, g AS (SELECT g, avg(bal) AS x, count(*) AS w FROM cust GROUP BY g), q AS (SELECT g, w, ntile(5) OVER (ORDER BY round(x, 6), g) AS class FROM g) SELECT CAST(class AS integer) AS class, count(*) AS n, {_r('sum(w) / CAST(sum(sum(w)) OVER () AS double)')} AS w_share FROM q GROUP BY class")
said("binned_median", f"{_C}, b AS (SELECT ntile(20) OVER (ORDER BY n_orders, id) AS bin, bal FROM cust) SELECT CAST(bin AS integer) AS bin, count(*) AS n, {_r('median(bal)', 4)} AS med FROM b GROUP BY bin")
said("sized_groups", f"{_C}, r AS (SELECT id, row_number() OVER (ORDER BY bal, id) - 1 AS p FROM cust) SELECT id, CASE WHEN p < 100 THEN 0 WHEN p < 400 THEN 1 ELSE 2 END AS grp FROM r")
said("south_west", f"WITH {_AT}, m AS (SELECT median(x) AS mx, median(y) AS my FROM at_) SELECT id FROM at_ CROSS JOIN m WHERE x < mx AND y < my")
said("region_or_place", f"{_C}, m AS (SELECT bal, avg(bal) OVER (PARTITION BY g) AS m, avg(bal) OVER () AS gm FROM cust), e AS (SELECT sum((m - gm) * (m - gm)) / sum((bal - gm) * (bal - gm)) AS e FROM m) SELECT {_r('e')} AS eta2, CASE WHEN e >= 0.3e0 THEN 'region' WHEN e >= 0.1e0 THEN 'both' ELSE 'place' END AS class FROM e")
said("settlement_shares", f"{_C} SELECT seg, {_r('avg(CASE WHEN bal > 5000 THEN 1.0e0 ELSE 0.0e0 END)')} AS share, {_r('sum(CASE WHEN bal > 5000 THEN n_orders ELSE 0 END) / CAST(nullif(sum(n_orders), 0) AS double)')} AS w_share FROM cust GROUP BY seg")
said("coverage_class", f"{_C} SELECT least(3, CASE WHEN bal < 0 THEN 1 ELSE 0 END + CASE WHEN n_orders = 0 THEN 1 ELSE 0 END + CASE WHEN spend = 0 THEN 1 ELSE 0 END) AS missing, count(*) AS n FROM cust GROUP BY 1")
said("profile_table", f"{_C}, z AS (SELECT seg, bal, median(bal) OVER () AS m FROM cust), s AS (SELECT seg, bal, m, median(abs(bal - m)) OVER () AS mad FROM z) SELECT seg, count(*) AS n, {_r('median(bal)', 4)} AS med, {_r('(median(bal) - max(m)) / (1.4826e0 * max(mad))')} AS effect FROM s GROUP BY seg")
said("status_counts", f"{_C}, h AS (SELECT g, seg, count(*) AS n, count(CASE WHEN n_orders > 8 THEN 1 END) AS busy FROM cust GROUP BY g, seg) SELECT seg, count(*) AS groups, CAST(sum(busy) AS bigint) AS busy, {_r('sum(busy) / CAST(sum(n) AS double)')} AS share FROM h GROUP BY seg")

# ---- top rows and examples --------------------------------------------------
said("typical_examples", f"{_C}, d AS (SELECT id, g, seg, abs(bal - avg(bal) OVER (PARTITION BY seg)) AS d FROM cust), o AS (SELECT *, row_number() OVER (PARTITION BY seg, g ORDER BY round(d, 6), id) AS first_of FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY round(d, 6), id) AS n FROM o WHERE first_of = 1) SELECT seg, id, CAST(n AS integer) AS place FROM k WHERE n <= 3")
said("largest_examples", f"{_C}, k AS (SELECT id, seg, row_number() OVER (PARTITION BY seg ORDER BY spend DESC, id) AS n FROM cust) SELECT seg, id, CAST(n AS integer) AS place FROM k WHERE n <= 3")
said("top_counts", "WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY p_brand), k AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS place FROM c) SELECT v, n, CAST(place AS integer) AS place FROM k WHERE place <= 10")
said("residual_labels", f"{_C}, f AS (SELECT regr_slope(n_orders, bal) AS b, avg(bal) AS mx, avg(CAST(n_orders AS double)) AS my FROM cust), r AS (SELECT id, n_orders - my - b * (bal - mx) AS e FROM cust CROSS JOIN f), k AS (SELECT id, e, row_number() OVER (ORDER BY round(e, 6) DESC, id) AS hi, row_number() OVER (ORDER BY round(e, 6), id) AS lo FROM r) SELECT id, {_r('e')} AS e FROM k WHERE hi <= 5 OR lo <= 5")
said("lowest_row", f"{_P}, c AS (SELECT t, count(*) AS n FROM panel GROUP BY t), k AS (SELECT t, n, row_number() OVER (ORDER BY n, t) AS r FROM c) SELECT t, n FROM k WHERE r = 1")
said("column_leaders", f"{_C}, r AS (SELECT seg, 'bal' AS f, corr(bal, spend) AS r FROM cust GROUP BY seg UNION ALL SELECT seg, 'orders', corr(CAST(n_orders AS double), spend) FROM cust GROUP BY seg), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY abs(round(r, 6)) DESC, seg) AS n FROM r) SELECT f, seg, {_r('r')} AS r FROM k WHERE n = 1")
said("top_neighbors", f"WITH {SQL_FLOWS}, k AS (SELECT a, b, w, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS n FROM both_ways) SELECT a, b, w, CAST(n AS integer) AS place FROM k WHERE n <= 3")
said("rank_scores", f"{_C}, k AS (SELECT g, avg(bal) AS a, avg(CAST(n_orders AS double)) AS b FROM cust GROUP BY g), r AS (SELECT g, (rank() OVER (ORDER BY a) - 1) / CAST(count(*) OVER () - 1 AS double) AS x, (rank() OVER (ORDER BY b) - 1) / CAST(count(*) OVER () - 1 AS double) AS y FROM k) SELECT g, {_r('(x + y) / 2')} AS score FROM r")
said("flow_examples", f"{_M}, h AS (SELECT id, avg(CASE WHEN t < {HALF} THEN y END) AS a, avg(CASE WHEN t >= {HALF} THEN y END) AS b FROM monthly GROUP BY id), d AS (SELECT id, CASE WHEN b > a THEN 'up' ELSE 'down' END AS flow, b - a AS d FROM h WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT *, abs(d - median(d) OVER (PARTITION BY flow)) AS e FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY round(e, 9), id) AS n FROM m) SELECT flow, id, {_r('d')} AS d FROM k WHERE n = 1")

# ---- group and series measures ----------------------------------------------
said("group_share_of_variance", f"{_M}, d AS (SELECT t, y - avg(y) OVER (PARTITION BY id) AS d FROM monthly), c AS (SELECT d, avg(d) OVER (PARTITION BY t) AS m FROM d) SELECT {_r('sum(m * m) / sum(d * d)')} AS share, count(*) AS n FROM c")
said("row_correlations", f"{_M}, c AS (SELECT t, avg(y) AS m FROM monthly GROUP BY t) SELECT id, {_r('corr(y, m)')} AS r, count(*) AS n FROM monthly JOIN c ON monthly.t = c.t GROUP BY id HAVING count(*) >= 3")
said("common_month_excess", f"{_M}, d AS (SELECT t, y - avg(y) OVER (PARTITION BY id) AS d FROM monthly) SELECT t % 12 AS m, {_r('avg(d)')} AS excess, count(*) AS n FROM d GROUP BY 1")
said("december_peak", f"{_M}, d AS (SELECT id, CASE WHEN t % 12 = 11 THEN 1 ELSE 0 END AS dec_, y FROM monthly) SELECT id, {_r('avg(CASE WHEN dec_ = 1 THEN y END) - avg(CASE WHEN dec_ = 0 THEN y END)')} AS excess FROM d GROUP BY id")
said("target_change", f"{_M}, h AS (SELECT id, sum(CASE WHEN t < {HALF} THEN v END) AS a, sum(CASE WHEN t >= {HALF} THEN v END) AS b FROM monthly GROUP BY id) SELECT id, {_r('ln(1 + b) - ln(1 + a)')} AS d FROM h WHERE a IS NOT NULL AND b IS NOT NULL")
said("part_stability", f"{_W}, y AS (SELECT id, CAST(floor(t / 12.0e0) AS integer) AS yr, {', '.join(f'sum({p}) AS {p}' for p in PARTS)} FROM full_ GROUP BY 1, 2), s AS (SELECT id, yr, p1 / ({_SUM}) AS s FROM y), r AS (SELECT rank() OVER (ORDER BY a.s) AS x, rank() OVER (ORDER BY b.s) AS z FROM s a JOIN s b ON a.id = b.id AND a.yr = 0 AND b.yr = 1) SELECT {_r('corr(x, z)')} AS rho, count(*) AS n FROM r")
said("adjacent_change", f"{_M}, q AS (SELECT id, CAST(floor(t / 3.0e0) AS integer) AS win, sum(v) AS v FROM monthly GROUP BY 1, 2), l AS (SELECT id, win, ntile(3) OVER (PARTITION BY win ORDER BY v, id) AS label FROM q) SELECT a.win, CAST(a.label AS integer) AS label, count(*) AS n, count(CASE WHEN a.label < b.label THEN 1 END) AS up, count(CASE WHEN a.label > b.label THEN 1 END) AS down FROM l a JOIN l b ON a.id = b.id AND b.win = a.win + 1 GROUP BY 1, 2")
said("clipped_values", f"{_C}, q AS (SELECT min(CASE WHEN c >= 0.05e0 THEN bal END) AS lo, min(CASE WHEN c >= 0.95e0 THEN bal END) AS hi FROM (SELECT bal, cume_dist() OVER (ORDER BY bal) AS c FROM cust) t) SELECT id, least(greatest(bal, lo), hi) AS bal FROM cust CROSS JOIN q")
said("same_group_edges", f"WITH {SQL_FLOWS} SELECT p.n_regionkey AS g, count(*) AS n, count(CASE WHEN p.n_regionkey = q.n_regionkey THEN 1 END) AS inside, {_r('avg(w)', 4)} AS w FROM both_ways JOIN nation p ON a = p.n_nationkey JOIN nation q ON b = q.n_nationkey GROUP BY p.n_regionkey")
said("boundary_edges", f"WITH {SQL_FLOWS} SELECT a, b, w FROM strong JOIN nation p ON a = p.n_nationkey JOIN nation q ON b = q.n_nationkey WHERE p.n_regionkey <> q.n_regionkey")
said("mean_over_targets", f"{_C}, t AS (SELECT seg, 'bal' AS target, avg(CASE WHEN bal > 5000 THEN 1.0e0 ELSE 0.0e0 END) AS share FROM cust GROUP BY seg UNION ALL SELECT seg, 'orders', avg(CASE WHEN n_orders > 8 THEN 1.0e0 ELSE 0.0e0 END) FROM cust GROUP BY seg) SELECT seg, {_r('avg(share)')} AS share FROM t GROUP BY seg")
said("outer_merge", f"{_C}, x AS (SELECT id, bal FROM cust WHERE bal > 0), y AS (SELECT id, spend FROM cust WHERE n_orders > 0) SELECT coalesce(x.id, y.id) AS id, bal, spend FROM x FULL OUTER JOIN y ON x.id = y.id")
said("grid_fill", f"{_P}, g AS (SELECT DISTINCT id FROM panel), m AS (SELECT DISTINCT t FROM panel), has AS (SELECT DISTINCT id, t FROM panel WHERE cat = '5-LOW') SELECT g.id, m.t, CASE WHEN has.id IS NULL THEN 0 ELSE 1 END AS present FROM g CROSS JOIN m LEFT JOIN has ON has.id = g.id AND has.t = m.t")
said("category_reference", f"{_P} SELECT cat, CASE cat {' '.join(f'''WHEN '{c}' THEN {i}''' for i, c in enumerate(CATEGORIES))} END AS place, count(*) AS n FROM panel GROUP BY cat")
