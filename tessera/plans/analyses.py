"""Composite analyses as DataFrame plans; their SQL is in ``composites``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import avg_rank
from tessera.functions.scalars import compare_errors
from tessera.operators import resolve as R
from tessera.operators import stats
from tessera.operators import summaries as S

from .base import query
from .composites import SQL
from .inputs import HALF, customers, flows, monthly, panel, read, strong_flows
from .panels import rounded

def n_rows() -> Column:
    return F.count(F.lit(1))


def share_of(condition) -> Column:
    return F.avg(condition.cast("double"))


def when_sum(condition, value) -> Column:
    return F.sum(F.when(condition, value))


def places(spark, sf_dir) -> DataFrame:
    """``id, g, x, y`` of every nation."""
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(
        n.alias("id"), F.col("n_regionkey").alias("g"), ((n * 37) % 120 - 60).alias("x"), ((n * 53) % 300 - 150).alias("y")
    )


def distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def registered(name: str):
    return query(name, SQL[name])


# ---- places and nodes --------------------------------------------------------
@registered("regional_centers")
def regional_centers(spark, sf_dir):
    return S.top_rows(places(spark, sf_dir), ["g"], [(F.col("id") % 2 != 0), "id"]).select("g", "id")


@registered("distance_to_capital")
def distance_to_capital(spark, sf_dir):
    at = places(spark, sf_dir)
    met = at.alias("p").join(at.alias("q"), (F.col("p.id") < F.col("q.id")) & ((F.col("p.id") + F.col("q.id")) % 3 != 0))
    edges = met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), distance("p", "q").alias("d"))
    return rounded(S.distance_to_center(at, at.groupBy("g").agg(F.min("id").alias("c")), edges), "km")


@registered("lineage")
def lineage(spark, sf_dir):
    s = F.col("s_suppkey")
    return S.lineage(read(spark, sf_dir, "supplier", "s_suppkey").select(s.alias("id"), (s % 40).alias("died"), (s % 30).alias("born")), "id", "died", "born")


@registered("road_pairs")
def road_pairs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    home = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    met = li.join(home.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return S.undirected_pairs(met, "c_nationkey", "s_nationkey", "l_quantity")


@registered("node_rollup")
def node_rollup(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("node", F.when(F.col("g") < 5, 1000 + F.col("g")).otherwise(F.col("id")))
    rolled = R.weighted_rollup(c, ["node"], "bal", "n_orders", 0.0).select("node", F.col("n_members").alias("members"), F.col("value").alias("v"))
    return rounded(rolled.join(c.groupBy("node").agg(F.sum("n_orders").alias("w")).filter("w > 0"), "node"), "v", digits=4)


@registered("node_distance")
def node_distance(spark, sf_dir):
    m = places(spark, sf_dir).withColumn("w", F.col("id") + 1)
    met = m.alias("p").join(m.alias("q"), F.col("p.g") < F.col("q.g"))
    d = met.select(F.col("p.g").alias("a"), F.col("q.g").alias("b"), (F.col("p.w") * F.col("q.w")).alias("w"), distance("p", "q").alias("d"))
    both = d.groupBy("a", "b").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("d0"), F.min("d").alias("least_d"))
    return rounded(both.withColumnRenamed("d0", "d"), "d", "least_d")


def set_errors(spark, sf_dir) -> DataFrame:
    """Errors of the median spend of ten comparable customers, of the segment and of the nation."""
    c = customers(spark, sf_dir)
    near = c.select("id", "seg", "spend", S.near_values(c, "seg", "bal", "id", "spend", 10).alias("t"), S.near_values(c, "g", "bal", "id", "spend", 10).alias("o"))
    errors = near.select("id", "seg", *[F.abs(F.col("spend") - S.array_median(F.col(x))).alias(e) for x, e in (("t", "by_type"), ("o", "by_group"))])
    return errors.filter("by_type is not null and by_group is not null")


@registered("comparable_set_errors")
def comparable_set_errors(spark, sf_dir):
    return rounded(set_errors(spark, sf_dir).drop("seg"), "by_type", "by_group", digits=4)


@registered("rule_share")
def rule_share(spark, sf_dir):
    e = set_errors(spark, sf_dir).withColumns({"k": compare_errors("by_type", "by_group", 1e-9), "gain": F.col("by_group") - F.col("by_type")})
    w = e.groupBy("seg").agg(n_rows().alias("n"), share_of(F.col("k") == "a").alias("win_share"), F.count_if(F.col("k") == "tie").alias("ties"), F.median("gain").alias("gain"))
    return rounded(rounded(w, "win_share"), "gain", digits=4)


# ---- coverage and scores -------------------------------------------------------
@registered("funnel")
def funnel(spark, sf_dir):
    c = customers(spark, sf_dir)
    return S.funnel(c, {"all_": F.lit(True), "active": F.col("n_orders") > 0, "solvent": F.col("bal") > 0, "loyal": F.col("n_orders") > 8})


@registered("incomplete_by_region")
def incomplete_by_region(spark, sf_dir):
    m = panel(spark, sf_dir).filter("cat = '2-HIGH'").groupBy("id", "g").agg(F.countDistinct("t").alias("k"))
    few = F.col("k") < 24
    return rounded(m.groupBy("g").agg(n_rows().alias("n"), F.count_if(few).alias("partial"), share_of(few).alias("share")), "share")


@registered("story_scores")
def story_scores(spark, sf_dir):
    k = customers(spark, sf_dir).groupBy("seg").agg(F.avg("bal").alias("a"), F.avg(F.col("n_orders").cast("double")).alias("b"), F.median("spend").alias("c"))
    rules = {"a": (0.5, [(4600, 5), (4400, 3)], 1), "b": (0.3, [(10, 5), (9.5, 3)], 1), "c": (0.2, [(1_500_000, 5), (1_000_000, 3)], 1)}
    return rounded(k.select("seg", S.rule_score(rules).alias("score")), "score")


def noise(spark, sf_dir) -> DataFrame:
    """``id, sd, bin``: robust spread around the own mean, in five bins of size."""
    w = Window.partitionBy("id")
    d = monthly(spark, sf_dir).select("id", (F.col("y") - F.avg("y").over(w)).alias("r"), F.sum("v").over(w).alias("size"))
    m = d.groupBy("id").agg(F.round(F.max("size"), 0).alias("size"), (1.4826 * F.median(F.abs("r"))).alias("sd"))
    return S.tiles(m, "size", "id", 5)


@registered("noise_by_size")
def noise_by_size(spark, sf_dir):
    return rounded(noise(spark, sf_dir).groupBy("bin").agg(n_rows().alias("n"), F.median("sd").alias("sd")), "sd")


@registered("noise_ratio")
def noise_ratio(spark, sf_dir):
    first, last = [F.median(F.when(F.col("bin") == b, F.col("sd"))) for b in (1, 5)]
    return rounded(noise(spark, sf_dir).agg((first / last).alias("ratio")), "ratio")


@registered("type_signatures")
def type_signatures(spark, sf_dir):
    kinds = {"rich": F.col("bal") > 7000, "busy": F.col("n_orders") > 12, "idle": F.col("n_orders") == 0}
    t = S.overlapping_types(customers(spark, sf_dir), kinds)
    return rounded(t.groupBy("kind").agg(n_rows().alias("n"), F.median("bal").alias("bal"), F.median("spend").alias("spend")), "bal", "spend", digits=4)


@registered("context_hints")
def context_hints(spark, sf_dir):
    long = S.unpivot_values(customers(spark, sf_dir), ["id", "seg"], {"bal": "bal", "orders": "n_orders", "spend": "spend"})
    z = stats.robust_z(long, "x", ["f", "seg"]).filter("z is not null")
    return rounded(S.top_rows(z, ["id"], [F.abs(F.round("z", 6)).desc(), "f"], 2).select("id", "f", "place", "z"), "z")


@registered("step_test")
def step_test(spark, sf_dir):
    d = monthly(spark, sf_dir).select("id", "t", (F.col("y") - F.lag("y").over(Window.partitionBy("id").orderBy("t"))).alias("step")).filter("step is not null")
    return rounded(S.top_rows(d, ["id"], [F.abs(F.round("step", 9)).desc(), "t"]).drop("place"), "step")


# ---- bins and groups -----------------------------------------------------------
@registered("quintile_gap")
def quintile_gap(spark, sf_dir):
    m = S.tiles(customers(spark, sf_dir), "bal", "id", 5).groupBy("bin").agg(n_rows().alias("n"), F.median("spend").alias("med"))
    gap = S.beside(m, F.avg("med").alias("_m")).select("bin", "n", "med", (F.col("med") - F.col("_m")).alias("gap"))
    return rounded(gap, "med", "gap", digits=4)


@registered("base_ratio")
def base_ratio(spark, sf_dir):
    b = S.tiles(customers(spark, sf_dir), "spend", "id", 5)
    high, low = [F.median(F.when(F.col("bin") == i, F.col("bal"))) for i in (5, 1)]
    return rounded(b.agg((high / low).alias("ratio")), "ratio")


@registered("place_groups")
def place_groups(spark, sf_dir):
    p = customers(spark, sf_dir).withColumn("place", F.when(F.col("n_orders") == 0, "none").when(F.col("bal") < 0, "debt").otherwise("rest"))
    ranks = stats.pair_ranks(p.select("place", "bal", "spend"), "bal", "spend", ["place"])
    g = ranks.groupBy("place").agg(n_rows().alias("n"), F.median("bal").alias("b"), stats.rho().alias("r")).withColumnRenamed("b", "bal")
    return rounded(rounded(g, "r"), "bal", digits=4)


@registered("outer_center")
def outer_center(spark, sf_dir):
    w = customers(spark, sf_dir).groupBy(F.col("g").alias("id")).agg(n_rows().alias("w"))
    m = places(spark, sf_dir).drop("g").join(w, "id")
    centre = [(F.sum(F.col("w") * F.col(c)) / F.sum("w").cast("double")).alias(f"c{c}") for c in "xy"]
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return rounded(S.beside(m, *centre).select("id", F.sqrt(dx * dx + dy * dy).alias("d")), "d")


@registered("work_home_ratio")
def work_home_ratio(spark, sf_dir):
    r = customers(spark, sf_dir).groupBy("g").agg(F.count_if(F.col("n_orders") > 8).alias("a"), F.count_if(F.col("bal") > 0).cast("double").alias("b")).filter("b > 0")
    r = r.select((F.col("a") / F.col("b")).alias("r"))
    return rounded(r.agg(F.min("r").alias("low"), F.median("r").alias("med"), F.max("r").alias("high"), n_rows().alias("n")), "low", "med", "high")


@registered("exclusive_missing")
def exclusive_missing(spark, sf_dir):
    there = panel(spark, sf_dir).filter("t = 3").select("id").distinct()
    return places(spark, sf_dir).select("g", "id").join(there, "id", "left_anti").select("g", "id")


@registered("interaction_shares")
def interaction_shares(spark, sf_dir):
    s = customers(spark, sf_dir).groupBy("seg", "g").agg(n_rows().alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("seg")).cast("double")
    return s.select("seg", (share >= 0.05).alias("big")).groupBy("seg").agg(F.count_if("big").alias("big"))


@registered("quantile_regression_bins")
def quantile_regression_bins(spark, sf_dir):
    b = S.tiles(customers(spark, sf_dir), "spend", "id", 10)
    return rounded(b.groupBy("bin").agg(F.avg("spend").alias("spend"), F.avg("bal").alias("bal"), n_rows().alias("n")), "spend", "bal", digits=4)


# ---- metrics of candidates -------------------------------------------------------
def metrics(spark, sf_dir) -> DataFrame:
    """``cand, a, b, c, n``: a few metrics of every candidate, here a nation's customers."""
    c = customers(spark, sf_dir).groupBy(F.col("g").alias("cand"))
    return c.agg(F.avg("bal").alias("a"), F.avg(F.col("n_orders").cast("double")).alias("b"), F.median("spend").alias("c"), n_rows().alias("n"))


def candidate_pairs(k: DataFrame) -> DataFrame:
    """All pairs of candidates, of which there are as many as settings tried."""
    return k.alias("p").join(k.alias("q"), F.col("p.cand") < F.col("q.cand"))


@registered("kendall_tau")
def kendall_tau(spark, sf_dir):
    u, v = [F.signum(F.col(f"p.{m}") - F.col(f"q.{m}")) for m in "ab"]
    p = candidate_pairs(metrics(spark, sf_dir)).select(u.alias("u"), v.alias("v"))
    tau = F.sum(F.col("u") * F.col("v")) / F.sqrt(F.sum(F.abs("u")) * F.sum(F.abs("v")))
    return rounded(p.agg(tau.alias("tau")), "tau")


@registered("metric_with_size")
def metric_with_size(spark, sf_dir):
    r = metrics(spark, sf_dir).select(avg_rank("n").alias("x"), F.rank().over(Window.orderBy("a")).alias("y"))
    return rounded(r.agg(F.corr("x", "y").alias("rho")), "rho")


@registered("mean_metric_rank")
def mean_metric_rank(spark, sf_dir):
    total = sum((F.rank().over(Window.orderBy(m)) for m in "abc"), F.lit(0))
    return rounded(metrics(spark, sf_dir).select("cand", (total / 3.0).alias("r")), "r")


@registered("pair_table_rank_corr")
def pair_table_rank_corr(spark, sf_dir):
    d = candidate_pairs(metrics(spark, sf_dir)).select(*[F.abs(F.col(f"p.{m}") - F.col(f"q.{m}")).alias(f"d{m}") for m in "ac"])
    r = d.select(*[F.rank().over(Window.orderBy(f"d{m}")).alias(m) for m in "ac"])
    return rounded(r.agg(F.corr("a", "c").alias("rho"), n_rows().alias("n")), "rho")


# ---- tests and models --------------------------------------------------------------
@registered("ordered_trend")
def ordered_trend(spark, sf_dir):
    n = F.col("n_orders")
    c = customers(spark, sf_dir).withColumn("k", F.when(n == 0, 0).when(n <= 8, 1).when(n <= 16, 2).otherwise(3))
    return rounded(S.ordered_superiority(c, [0, 1, 2, 3], "k", "bal").withColumn("p", F.col("u") / F.col("n")), "p")


@registered("monotone_medians")
def monotone_medians(spark, sf_dir):
    m = customers(spark, sf_dir).select("seg", "bal", F.ntile(3).over(Window.partitionBy("seg").orderBy("spend", "id")).alias("k"))
    d = m.groupBy("seg", "k").agg(F.median("bal").alias("m")).withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy("seg").orderBy("k")))
    return d.filter("d is not null").groupBy("seg").agg(F.bool_and(F.col("d") >= 0).alias("rising"))


@registered("direction_test")
def direction_test(spark, sf_dir):
    m = monthly(spark, sf_dir).select("id", "t", "y")
    d = m.join(m.select("id", (F.col("t") - 12).alias("t"), F.col("y").alias("later")), ["id", "t"]).select((F.col("later") - F.col("y")).alias("d"))
    r = d.agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return rounded(r.withColumn("z", (F.col("up") - F.col("down")) / F.sqrt((F.col("up") + F.col("down")).cast("double"))), "z")


@registered("minimum_effect")
def minimum_effect(spark, sf_dir):
    busy, v = F.col("n_orders") > 8, F.var_samp("bal")
    mde = 2.801585 * F.sqrt(v / F.count_if(busy) + v / F.count_if(~busy))
    return rounded(customers(spark, sf_dir).groupBy("seg").agg(mde.alias("mde")), "mde", digits=4)


@registered("split_half_reliability")
def split_half_reliability(spark, sf_dir):
    a, b = [F.avg(F.when(F.col("t") % 2 == k, F.col("y"))) for k in (0, 1)]
    h = monthly(spark, sf_dir).groupBy("id").agg(a.alias("a"), b.alias("b")).dropna()
    r = h.agg(F.corr("a", "b").alias("r"), n_rows().alias("n"))
    return rounded(r.withColumn("spearman_brown", 2 * F.col("r") / (1 + F.col("r"))), "r", "spearman_brown")


@registered("adjusted_r2")
def adjusted_r2(spark, sf_dir):
    f = customers(spark, sf_dir).agg(F.regr_r2("spend", "bal").alias("r2"), n_rows().alias("n"))
    adjusted = 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2).cast("double")
    return rounded(f.select("r2", adjusted.alias("adj")), "r2", "adj")


@registered("group_dummy_gain")
def group_dummy_gain(spark, sf_dir):
    """Explained variance that group effects add, from one row of moments a group."""
    y, x = F.col("n_orders").cast("double"), F.col("bal")
    g = customers(spark, sf_dir).groupBy("seg").agg(
        n_rows().alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(y, x).alias("c")
    )
    g = S.beside(g, (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("gy"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("gx"))
    dy, dx, n = F.col("my") - F.col("gy"), F.col("mx") - F.col("gx"), F.col("n")
    s = g.agg(
        F.sum(n * F.col("vy")).alias("wy"), F.sum(n * F.col("vx")).alias("wx"), F.sum(n * F.col("c")).alias("wc"),
        F.sum(n * (F.col("vy") + dy * dy)).alias("ty"), F.sum(n * (F.col("vx") + dx * dx)).alias("tx"), F.sum(n * (F.col("c") + dy * dx)).alias("tc"),
    )
    e0, e1 = [F.col(f"{k}y") - F.col(f"{k}c") * F.col(f"{k}c") / F.col(f"{k}x") for k in "tw"]
    return rounded(s.select(((e0 - e1) / F.col("ty")).alias("gain")), "gain")


@registered("matched_placebo")
def matched_placebo(spark, sf_dir):
    first, t, y = F.col("t") < HALF, F.col("t"), F.col("y")
    parts = {"a0": first & (t % 2 == 0), "a1": first & (t % 2 == 1), "b": ~first}
    h = monthly(spark, sf_dir).groupBy("id").agg(*[F.avg(F.when(c, y)).alias(k) for k, c in parts.items()]).dropna()
    change, gap = F.abs(F.col("b") - (F.col("a0") + F.col("a1")) / 2), F.abs(F.col("a0") - F.col("a1"))
    return rounded(h.agg(F.avg(change).alias("change"), F.avg(gap).alias("noise"), n_rows().alias("n")), "change", "noise")


@registered("events_by_threshold")
def events_by_threshold(spark, sf_dir):
    q = monthly(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 12.0).cast("int").alias("win")).agg(F.sum("v").alias("v"))
    labels = q.filter("win in (0, 1)").select("id", "win", F.ntile(4).over(Window.partitionBy("win").orderBy("v", "id")).alias("label"))
    pair = labels.filter("win = 0").select("id", F.col("label").alias("x")).join(labels.filter("win = 1").select("id", F.col("label").alias("y")), "id")
    c = pair.groupBy("x", "y").agg(n_rows().alias("c"))
    union = F.sum("c").over(Window.partitionBy("x")) + F.sum("c").over(Window.partitionBy("y")) - F.col("c")
    taus = F.array(*[F.struct(F.lit(t).alias("tau")) for t in (0.2, 0.4, 0.6)])
    j = c.withColumn("j", F.col("c") / union.cast("double"))  # before the rows are tripled
    return j.select("j", F.inline(taus)).groupBy("tau").agg(F.count_if(F.col("j") >= F.col("tau")).alias("links"))


# ---- graphs ------------------------------------------------------------------------
@registered("chance_jaccard")
def chance_jaccard(spark, sf_dir):
    """Overlap of the edges with those of a graph whose nodes change places by the digest of their number."""
    edges = strong_flows(spark, sf_dir).select("a", "b")
    n = places(spark, sf_dir).select("id")
    moved_to = n.select("id", (F.row_number().over(Window.orderBy(F.md5(F.col("id").cast("string")), "id")) - 1).alias("p"))
    x, y = [moved_to.select(F.col("id").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
    moved = edges.join(x, "a").join(y, "b").select(F.least("pa", "pb").cast("long").alias("a"), F.greatest("pa", "pb").cast("long").alias("b"))
    both = moved.join(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), ["a", "b"]).agg(n_rows().alias("n"))
    whole = edges.agg(n_rows().alias("m"))
    return rounded(both.crossJoin(F.broadcast(whole)).select((F.col("n") / (2 * F.col("m") - F.col("n")).cast("double")).alias("jaccard")), "jaccard")


@registered("degree_distribution")
def degree_distribution(spark, sf_dir):
    d = both_ways(strong_flows(spark, sf_dir)).groupBy("a").agg(n_rows().alias("degree"))
    return d.groupBy("degree").agg(n_rows().alias("n"))


