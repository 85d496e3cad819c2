"""Consistency counts, bins and classes, example pickers and group measures as DataFrame plans; their SQL is in ``checks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import compositions as comp
from tessera.functions.ranks import avg_rank
from tessera.operators import summaries as S

from . import checks  # noqa: F401  (its SQL)
from .analyses import both_ways, metrics, n_rows, places, registered, share_of
from .inputs import CATEGORIES, HALF, PARTS, customers, flows, monthly, panel, read, strong_flows
from .panels import clr, complete, rounded, shares, wide

def total() -> Column:
    return sum((F.col(p) for p in PARTS), F.lit(0.0))


# ---- consistency -----------------------------------------------------------------
@registered("check_shares_sum_to_one")
def check_shares_sum_to_one(spark, sf_dir):
    return S.count_bad(shares(spark, sf_dir), bad=F.abs(total() - 1) > 1e-9)


@registered("check_parts_sum_to_all")
def check_parts_sum_to_all(spark, sf_dir):
    whole = panel(spark, sf_dir).groupBy("id", "t").agg(F.sum("v").alias("v"))
    return S.count_bad(complete(spark, sf_dir).join(whole, ["id", "t"]), bad=F.abs(total() - F.col("v")) > 0.005)


@registered("check_clr_rows_zero")
def check_clr_rows_zero(spark, sf_dir):
    return S.count_bad(clr(spark, sf_dir), bad=F.abs(total()) > 1e-9)


@registered("check_month_ordinal")
def check_month_ordinal(spark, sf_dir):
    return panel(spark, sf_dir).agg(n_rows().alias("n"), F.count_if(~F.col("t").between(0, 23)).alias("bad"), F.countDistinct("t").alias("months"))


@registered("check_log_column")
def check_log_column(spark, sf_dir):
    return S.count_bad(monthly(spark, sf_dir), bad=F.abs(F.exp("y") - F.col("v")) > 1e-6 * F.col("v"))


@registered("check_edge_order")
def check_edge_order(spark, sf_dir):
    return S.count_bad(flows(spark, sf_dir), bad=F.col("a") >= F.col("b"), nonpositive=F.col("w") <= 0)


@registered("check_keys_unique")
def check_keys_unique(spark, sf_dir):
    k = panel(spark, sf_dir).groupBy("id", "t", "cat").agg(n_rows().alias("k"))
    return S.count_bad(k, repeated=F.col("k") > 1).withColumnRenamed("n", "n_keys")


@registered("check_references")
def check_references(spark, sf_dir):
    return S.references(read(spark, sf_dir, "orders", "o_custkey"), "o_custkey", read(spark, sf_dir, "customer", "c_custkey"), "c_custkey")


@registered("check_fact_threshold")
def check_fact_threshold(spark, sf_dir):
    return customers(spark, sf_dir).groupBy("seg").agg((F.avg("bal") >= 4500).alias("holds"))


@registered("controls_by_kind")
def controls_by_kind(spark, sf_dir):
    facts = customers(spark, sf_dir).agg((n_rows() == F.countDistinct("id")).alias("hard"), (F.abs(F.avg("bal") - 4500) <= 450).alias("soft"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), ok.alias("ok")) for k, ok in (("hard", F.col("hard")), ("soft", F.col("soft")), ("info", F.lit(True)))])
    return facts.select(F.inline(kinds)).groupBy("kind").agg(n_rows().alias("n"), F.count_if("ok").alias("passed"))


@registered("nonnull_coverage")
def nonnull_coverage(spark, sf_dir):
    return wide(spark, sf_dir).agg(n_rows().alias("n"), *[F.count(p).alias(p) for p in PARTS])


# ---- bins and classes ---------------------------------------------------------------
@registered("histogram")
def histogram(spark, sf_dir):
    b = customers(spark, sf_dir).groupBy(F.floor(F.col("bal") / 500.0).cast("int").alias("bin")).agg(n_rows().alias("n"))
    return rounded(S.beside(b, F.sum("n").alias("_all")).select("bin", "n", (F.col("n") / F.col("_all").cast("double")).alias("share")), "share")


@registered("diverging_classes")
def diverging_classes(spark, sf_dir):
    z = (F.col("bal") - 4500) / 2000.0
    size = S.steps(F.abs(z), [(1.5, 2), (0.5, 1)], 0)
    return customers(spark, sf_dir).groupBy((size * F.signum(z)).cast("int").alias("class")).agg(n_rows().alias("n"))


@registered("map_classes")
def map_classes(spark, sf_dir):
    g = customers(spark, sf_dir).groupBy("g").agg(F.round(F.avg("bal"), 6).alias("x"), n_rows().alias("w"))
    q = S.tiles(g, "x", "g", 5, "class").groupBy("class").agg(n_rows().alias("n"), F.sum("w").alias("w"))
    return rounded(S.beside(q, F.sum("w").alias("_all")).select("class", "n", (F.col("w") / F.col("_all").cast("double")).alias("w_share")), "w_share")


@registered("binned_median")
def binned_median(spark, sf_dir):
    b = S.tiles(customers(spark, sf_dir), "n_orders", "id", 20)
    return rounded(b.groupBy("bin").agg(n_rows().alias("n"), F.median("bal").alias("med")), "med", digits=4)


@registered("sized_groups")
def sized_groups(spark, sf_dir):
    return S.positions(customers(spark, sf_dir), "bal", "id").select("id", S.steps("pos", [(400, 2), (100, 1)], 0).alias("grp"))


@registered("south_west")
def south_west(spark, sf_dir):
    return S.beside(places(spark, sf_dir), F.median("x").alias("mx"), F.median("y").alias("my")).filter("x < mx and y < my").select("id")


@registered("region_or_place")
def region_or_place(spark, sf_dir):
    """Between-group share of the variance, from one row of moments a group."""
    g = customers(spark, sf_dir).groupBy("g").agg(n_rows().alias("n"), F.avg("bal").alias("m"), F.var_pop("bal").alias("v"))
    g = S.beside(g, (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    between = F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm")))
    e = g.agg((between / (between + F.sum(F.col("n") * F.col("v")))).alias("eta2"))
    return rounded(e.withColumn("class", S.steps("eta2", [(0.3, "region"), (0.1, "both")], "place")), "eta2")


@registered("settlement_shares")
def settlement_shares(spark, sf_dir):
    rich, n = F.col("bal") > 5000, F.col("n_orders")
    weighted = F.try_divide(F.sum(F.when(rich, n).otherwise(0)).cast("double"), F.sum(n).cast("double"))
    return rounded(customers(spark, sf_dir).groupBy("seg").agg(share_of(rich).alias("share"), weighted.alias("w_share")), "share", "w_share")


@registered("coverage_class")
def coverage_class(spark, sf_dir):
    missing = sum(((c).cast("int") for c in (F.col("bal") < 0, F.col("n_orders") == 0, F.col("spend") == 0)), F.lit(0))
    return customers(spark, sf_dir).groupBy(F.least(F.lit(3), missing).alias("missing")).agg(n_rows().alias("n"))


@registered("profile_table")
def profile_table(spark, sf_dir):
    z = S.beside(customers(spark, sf_dir).select("seg", "bal"), F.median("bal").alias("m"))
    z = S.beside(z, F.median(F.abs(F.col("bal") - F.col("m"))).alias("mad"))
    effect = (F.median("bal") - F.max("m")) / (1.4826 * F.max("mad"))
    return rounded(rounded(z.groupBy("seg").agg(n_rows().alias("n"), F.median("bal").alias("med"), effect.alias("effect")), "effect"), "med", digits=4)


@registered("status_counts")
def status_counts(spark, sf_dir):
    h = customers(spark, sf_dir).groupBy("seg", "g").agg(n_rows().alias("n"), F.count_if(F.col("n_orders") > 8).alias("b"))
    r = h.groupBy("seg").agg(n_rows().alias("groups"), F.sum("b").alias("busy"), (F.sum("b") / F.sum("n").cast("double")).alias("share"))
    return rounded(r, "share")


# ---- top rows and examples ------------------------------------------------------------
@registered("typical_examples")
def typical_examples(spark, sf_dir):
    """Rows nearest to their segment's mean, no two of one nation."""
    c = customers(spark, sf_dir).select("id", "g", "seg", "bal")
    near = c.join(c.groupBy("seg").agg(F.avg("bal").alias("m")), "seg").withColumn("d", F.round(F.abs(F.col("bal") - F.col("m")), 6))
    first = near.groupBy("seg", "g").agg(F.min(F.struct("d", "id")).alias("f")).select("seg", "f.d", "f.id")
    return S.top_rows(first, ["seg"], ["d", "id"], 3).select("seg", "id", "place")


@registered("largest_examples")
def largest_examples(spark, sf_dir):
    return S.top_rows(customers(spark, sf_dir), ["seg"], [F.desc("spend"), "id"], 3).select("seg", "id", "place")


@registered("top_counts")
def top_counts(spark, sf_dir):
    c = read(spark, sf_dir, "part", "p_brand").groupBy(F.col("p_brand").alias("v")).agg(n_rows().alias("n"))
    return S.top_rows(c, [], [F.desc("n"), "v"], 10)


@registered("residual_labels")
def residual_labels(spark, sf_dir):
    """The five highest and five lowest residuals of a line over all rows."""
    c = customers(spark, sf_dir).select("id", "bal", F.col("n_orders").cast("double").alias("y"))
    fit = S.beside(c, F.regr_slope("y", "bal").alias("b"), F.avg("bal").alias("mx"), F.avg("y").alias("my"))
    r = fit.select("id", (F.col("y") - F.col("my") - F.col("b") * (F.col("bal") - F.col("mx"))).alias("e"))
    ends = S.top_rows(r, [], [F.round("e", 6).desc(), "id"], 5).unionByName(S.top_rows(r, [], [F.round("e", 6), "id"], 5))
    return rounded(ends.groupBy("id").agg(F.first("e").alias("e")), "e")


@registered("lowest_row")
def lowest_row(spark, sf_dir):
    return S.top_rows(panel(spark, sf_dir).groupBy("t").agg(n_rows().alias("n")), [], ["n", "t"]).select("t", "n")


@registered("column_leaders")
def column_leaders(spark, sf_dir):
    r = customers(spark, sf_dir).groupBy("seg").agg(F.corr("bal", "spend").alias("bal"), F.corr(F.col("n_orders").cast("double"), F.col("spend")).alias("orders"))
    long = S.unpivot_values(r, ["seg"], {"bal": "bal", "orders": "orders"}, value="r")
    return rounded(S.top_rows(long, ["f"], [F.abs(F.round("r", 6)).desc(), "seg"]).select("f", "seg", "r"), "r")


@registered("top_neighbors")
def top_neighbors(spark, sf_dir):
    return S.top_rows(both_ways(strong_flows(spark, sf_dir)), ["a"], [F.desc("w"), "b"], 3)


@registered("rank_scores")
def rank_scores(spark, sf_dir):
    k = S.beside(metrics(spark, sf_dir), (n_rows() - 1).cast("double").alias("most"))
    x, y = [(F.rank().over(Window.orderBy(m)) - 1) / F.col("most") for m in "ab"]
    return rounded(k.select(F.col("cand").alias("g"), ((x + y) / 2).alias("score")), "score")


def halves(spark, sf_dir, value: str, how) -> DataFrame:
    """``id, a, b`` of both halves of the months; nations with both."""
    first = F.col("t") < HALF
    parts = {"a": first, "b": ~first}
    return monthly(spark, sf_dir).groupBy("id").agg(*[how(F.when(c, F.col(value))).alias(k) for k, c in parts.items()]).dropna()


@registered("flow_examples")
def flow_examples(spark, sf_dir):
    d = halves(spark, sf_dir, "y", F.avg).select("id", (F.col("b") - F.col("a")).alias("d"), F.when(F.col("b") > F.col("a"), "up").otherwise("down").alias("flow"))
    e = F.round(F.abs(F.col("d") - F.median("d").over(Window.partitionBy("flow"))), 9)
    return rounded(S.top_rows(d.withColumn("e", e), ["flow"], ["e", "id"]).select("flow", "id", "d"), "d")


# ---- group and series measures -----------------------------------------------------------
def deviations(spark, sf_dir) -> DataFrame:
    """``id, t, d``: log totals less the nation's mean."""
    return monthly(spark, sf_dir).select("id", "t", (F.col("y") - F.avg("y").over(Window.partitionBy("id"))).alias("d"))


@registered("group_share_of_variance")
def group_share_of_variance(spark, sf_dir):
    m = deviations(spark, sf_dir).groupBy("t").agg(n_rows().alias("k"), F.avg("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("s"))
    return rounded(m.agg((F.sum(F.col("k") * F.col("m") * F.col("m")) / F.sum("s")).alias("share"), F.sum("k").alias("n")), "share")


@registered("row_correlations")
def row_correlations(spark, sf_dir):
    m = monthly(spark, sf_dir).select("id", "t", "y", F.avg("y").over(Window.partitionBy("t")).alias("m"))
    return rounded(m.groupBy("id").agg(F.corr("y", "m").alias("r"), n_rows().alias("n")).filter("n >= 3"), "r")


@registered("common_month_excess")
def common_month_excess(spark, sf_dir):
    return rounded(deviations(spark, sf_dir).groupBy((F.col("t") % 12).alias("m")).agg(F.avg("d").alias("excess"), n_rows().alias("n")), "excess")


@registered("december_peak")
def december_peak(spark, sf_dir):
    december = F.col("t") % 12 == 11
    inside, outside = [F.avg(F.when(c, F.col("y"))) for c in (december, ~december)]
    return rounded(monthly(spark, sf_dir).groupBy("id").agg((inside - outside).alias("excess")), "excess")


@registered("target_change")
def target_change(spark, sf_dir):
    return rounded(halves(spark, sf_dir, "v", F.sum).select("id", (F.log1p("b") - F.log1p("a")).alias("d")), "d")


@registered("part_stability")
def part_stability(spark, sf_dir):
    """Rank correlation of a part's shares in the first two years, over nations."""
    y = complete(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 12.0).cast("int").alias("yr")).agg(*[F.sum(p).alias(p) for p in PARTS])
    s = y.select("id", "yr", comp.closure(PARTS)[PARTS[0]].alias("s"))
    both = s.filter("yr = 0").select("id", F.col("s").alias("s0")).join(s.filter("yr = 1").select("id", F.col("s").alias("s1")), "id")
    return rounded(both.select(avg_rank("s0").alias("x"), avg_rank("s1").alias("z")).agg(F.corr("x", "z").alias("rho"), n_rows().alias("n")), "rho")


@registered("adjacent_change")
def adjacent_change(spark, sf_dir):
    q = monthly(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 3.0).cast("int").alias("win")).agg(F.sum("v").alias("v"))
    a = q.select("id", "win", F.ntile(3).over(Window.partitionBy("win").orderBy("v", "id")).alias("label"))
    both = a.join(a.select("id", (F.col("win") - 1).alias("win"), F.col("label").alias("next")), ["id", "win"])
    return both.groupBy("win", "label").agg(n_rows().alias("n"), F.count_if(F.col("label") < F.col("next")).alias("up"), F.count_if(F.col("label") > F.col("next")).alias("down"))


@registered("clipped_values")
def clipped_values(spark, sf_dir):
    """Values drawn in to the 5 and 95 per cent points, the least values whose share of rows reaches them."""
    n = customers(spark, sf_dir).select("id", "bal")
    placed = S.beside(S.positions(n, "bal", "id"), n_rows().alias("_n"))
    reached = [F.min(F.when(F.col("pos") + 1 >= q * F.col("_n"), F.col("bal"))) for q in (0.05, 0.95)]
    return S.beside(placed, reached[0].alias("lo"), reached[1].alias("hi")).select("id", F.least(F.greatest("bal", "lo"), F.col("hi")).alias("bal"))


def grouped_edges(spark, sf_dir, edges: DataFrame) -> DataFrame:
    """Edges with the regions ``ga, gb`` of both ends."""
    p = places(spark, sf_dir)
    return edges.join(p.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(p.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")


@registered("same_group_edges")
def same_group_edges(spark, sf_dir):
    e = grouped_edges(spark, sf_dir, both_ways(strong_flows(spark, sf_dir)))
    r = e.groupBy(F.col("ga").alias("g")).agg(n_rows().alias("n"), F.count_if(F.col("ga") == F.col("gb")).alias("inside"), F.avg("w").alias("m")).withColumnRenamed("m", "w")
    return rounded(r, "w", digits=4)


@registered("boundary_edges")
def boundary_edges(spark, sf_dir):
    return grouped_edges(spark, sf_dir, strong_flows(spark, sf_dir)).filter("ga <> gb").select("a", "b", "w")


@registered("mean_over_targets")
def mean_over_targets(spark, sf_dir):
    t = customers(spark, sf_dir).groupBy("seg").agg(share_of(F.col("bal") > 5000).alias("x"), share_of(F.col("n_orders") > 8).alias("y"))
    return rounded(t.select("seg", ((F.col("x") + F.col("y")) / 2).alias("share")), "share")


@registered("outer_merge")
def outer_merge(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.filter("bal > 0").select("id", "bal").join(c.filter("n_orders > 0").select("id", "spend"), "id", "full")


@registered("grid_fill")
def grid_fill(spark, sf_dir):
    """Every nation in every month, and whether the category has a value; both lists are short."""
    p = panel(spark, sf_dir)
    grid = p.select("id").distinct().crossJoin(F.broadcast(p.select("t").distinct()))
    has = p.filter("cat = '5-LOW'").select("id", "t", F.lit(1).alias("_p")).distinct()
    return grid.join(has, ["id", "t"], "left").select("id", "t", F.coalesce("_p", F.lit(0)).alias("present"))


@registered("category_reference")
def category_reference(spark, sf_dir):
    place = F.nullif(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("cat")), F.lit(0)) - 1
    return panel(spark, sf_dir).groupBy("cat").agg(n_rows().alias("n")).withColumn("place", place.cast("int"))
