"""Positions, bins, top rows, funnels, rule scores and consistency counts over tables of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that a whole table is dealt over for global positions.
RANGES = 64


def beside(df: DataFrame, *totals: Column) -> DataFrame:
    """``df`` with one-row aggregates of itself on every row, without a window over the whole table."""
    return df.crossJoin(F.broadcast(df.agg(*totals)))


def running_totals(df: DataFrame, value: str, tie: str, sums: Mapping[str, Column], ranges: int = RANGES) -> DataFrame:
    """``df`` with running sums in order of ``value, tie``, whole table, no task for all rows.

    Rows are dealt over ranges of the value.  A value that many rows share is
    always an edge of the ranges, and its rows are dealt once more over ranges
    of ``tie``.  Totals of the ranges (at most ``2 * ranges ** 2`` rows) give the
    offsets.  Rows with a null value or tie are left out; ``value, tie`` must be
    numbers and unique together.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    rows = df.filter(F.col(value).isNotNull() & F.col(tie).isNotNull()).withColumns({f"_s{i}": c for i, c in enumerate(sums.values())})
    rows = beside(rows, F.percentile_approx(value, shares, 10_000).alias("_e"), F.percentile_approx(tie, shares, 10_000).alias("_f"))
    shared = F.array_contains("_e", F.col(value))
    rows = rows.withColumns({
        "_b": F.size(F.filter("_e", lambda e: e < F.col(value))), "_h": shared.cast("int"),
        "_t": F.when(shared, F.size(F.filter("_f", lambda e: e < F.col(tie)))).otherwise(0),
    }).drop("_e", "_f")
    key = ["_b", "_h", "_t"]
    names = [f"_s{i}" for i in range(len(sums))]
    ahead = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).agg(*[F.sum(s).alias(s) for s in names])
    offsets = offsets.select(*key, *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"_o{s}") for s in names])
    inside = Window.partitionBy(*key).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(F.broadcast(offsets), key)
    return found.withColumns({out: F.sum(s).over(inside) + F.col(f"_o{s}") for out, s in zip(sums, names, strict=True)}).drop(*key, *names, *[f"_o{s}" for s in names])


def positions(df: DataFrame, value: str, tie: str, out: str = "pos") -> DataFrame:
    """``df`` with the row's position from 0 in order of ``value, tie``."""
    return running_totals(df, value, tie, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)


def ranked(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """``df`` with the rank from 1 over the whole table, ties averaged, from counts by value; rows with a null value go."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_z", F.lit(0))
    upto = running_totals(counted, "__v", "_z", {"_c": F.col("_n")})
    return df.join(upto.select("__v", (F.col("_c") - (F.col("_n") - 1) / F.lit(2.0)).alias("__r")), F.col(value) == F.col("__v")).withColumn(out, F.col("__r")).drop("__v", "__r")


def ranked_within(df: DataFrame, ranks: Mapping[str, str], by: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with ranks ``out: value`` within groups, ties averaged; null where the value or a group is null.

    From counts by value like ``ranked``, so that a large group is not a task.
    A group has a value once, so the ranges need no tie; totals of the ranges (at
    most ``ranges`` rows a group) come from the same shuffle as the running sums.
    """
    out = df
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    for k, value in ranks.items():
        counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0")
        counted = beside(counted, F.percentile_approx("__v", shares, 10_000).alias("__e"))
        # The value's place among the edges; a function over the array takes several times as long.
        below = F.coalesce(F.array_position(F.sort_array(F.array_append("__e", F.col("__v"))), F.col("__v")), F.lit(0))
        dealt = counted.select(*by, "__v", "__n", below.alias("__b")).repartition(ranges, "__b")
        ahead = Window.partitionBy(*by).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
        offsets = dealt.groupBy(*by, "__b").agg(F.max("__v").alias("__m"), F.sum("__n").alias("__t"))
        offsets = offsets.select(*by, "__b", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__o"))
        inside = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        upto = dealt.withColumn("__c", F.sum("__n").over(inside)).join(F.broadcast(offsets), [*by, "__b"])
        rank = F.col("__o") + F.col("__c") - (F.col("__n") - 1) / F.lit(2.0)
        out = out.join(upto.select(*by, F.col("__v").alias(value), rank.alias(k)), [*by, value], "left")
    return out


def tiles(df: DataFrame, value: str, tie: str, q: int, out: str = "bin") -> DataFrame:
    """``df`` with ``q`` equal-count bins from 1; the first bins take the rows left over, as SQL's ntile does."""
    placed = beside(positions(df, value, tie, "_p"), F.count(F.lit(1)).alias("_n"))
    small, more = F.floor(F.col("_n") / q), F.col("_n") % q
    wide = more * (small + 1)
    tile = F.when(F.col("_p") < wide, F.floor(F.col("_p") / (small + 1))).otherwise(more + F.floor((F.col("_p") - wide) / F.greatest(small, F.lit(1))))
    return placed.withColumn(out, (tile + 1).cast("int")).drop("_p", "_n")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int = 1, place: str = "place") -> DataFrame:
    """The first ``n`` rows of every group, or of the table, with their place from 1."""
    if not by:
        df = df.orderBy(*order).limit(n)
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= n)


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows pass each step and all steps before it."""
    passed, out = F.lit(True), []
    for name, step in steps.items():
        passed = passed & F.coalesce(step, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out)


def count_bad(df: DataFrame, **bad: Column) -> DataFrame:
    """``n`` and the number of rows for which each condition holds."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()])


def references(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """``n, orphans``: rows whose key the other table lacks; null keys count as lacking."""
    known = other.select(F.col(other_key).alias("_k")).distinct()
    met = rows.join(known, F.col(key) == F.col("_k"), "left")
    return count_bad(met, orphans=F.col("_k").isNull())


def steps(c: str | Column, levels: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """Value of the first level ``(least, value)`` that the column reaches."""
    column = F.col(c) if isinstance(c, str) else c
    out = None
    for least, value in levels:
        out = (F.when if out is None else out.when)(column >= least, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def rule_score(rules: Mapping[str, tuple[float, Sequence[tuple[float, float]], float]]) -> Column:
    """Weighted sum of points: ``column: (weight, levels, otherwise)``."""
    total = F.lit(0.0)
    for column, (weight, levels, otherwise) in rules.items():
        total = total + weight * steps(column, levels, otherwise)
    return total


def overlapping_types(df: DataFrame, types: Mapping[str, Column], out: str = "kind") -> DataFrame:
    """A row per type that a row belongs to."""
    named = F.array(*[F.when(c, F.lit(k)) for k, c in types.items()])
    return df.withColumn(out, F.explode(F.filter(named, lambda k: k.isNotNull())))


def unpivot_values(df: DataFrame, ids: Sequence[str], values: Mapping[str, str], name: str = "f", value: str = "x") -> DataFrame:
    """Long form of columns: ``values`` maps the shown name to the column."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), F.col(c).cast("double").alias(value)) for k, c in values.items()])
    return df.select(*ids, F.inline(pairs))


def near_values(df: DataFrame, by: str, order: str, tie: str, value: str, k: int) -> Column:
    """Array of ``value`` of the ``k`` rows of the same group nearest in ``order``, itself left out.

    The k nearest are among the k before and the k after in order, so a window
    of 2k + 1 rows holds them.
    """
    w = Window.partitionBy(by).orderBy(order, tie).rowsBetween(-k, k)
    around = F.collect_list(F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), F.col(value).alias("v"))).over(w)
    ranked = F.transform(
        F.filter(around, lambda r: r["t"] != F.col(tie)),
        lambda r: F.struct(F.abs(F.col(order) - r["o"]).alias("d"), r["t"].alias("t"), r["v"].alias("v")),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda r: r["v"])


def array_median(values: Column) -> Column:
    """Median of an array; null for an empty one."""
    s = F.array_sort(values)
    n = F.size(values)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def lineage(df: DataFrame, key: str, ended: str, began: str) -> DataFrame:
    """``key, role, n``: links from rows whose end is another's beginning, to rows of a greater key.

    Links are counted by running sums over each year, never listed.
    """
    ends = df.filter(F.col(ended).isNotNull()).select(F.col(ended).alias("_y"), F.col(key), F.lit(0).alias("_k"))
    begins = df.filter(F.col(began).isNotNull()).select(F.col(began).alias("_y"), F.col(key), F.lit(1).alias("_k"))
    w = Window.partitionBy("_y").orderBy(key)
    after = F.sum(F.col("_k")).over(w.rangeBetween(1, Window.unboundedFollowing))
    before = F.sum(1 - F.col("_k")).over(w.rangeBetween(Window.unboundedPreceding, -1))
    linked = ends.unionByName(begins).withColumn("_n", F.coalesce(F.when(F.col("_k") == 0, after).otherwise(before), F.lit(0))).filter("_n > 0")
    role = F.when(F.min("_k") == 0, "predecessor").otherwise("successor")
    return linked.groupBy(key).agg(role.alias("role"), F.sum("_n").alias("n"))


def undirected_pairs(df: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """``a, b, d, spread, n``: one row per unordered pair with its least distance; loops go."""
    both = df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(distance).alias("_d"))
    return both.groupBy("a", "b").agg(F.min("_d").alias("d"), (F.max("_d") - F.min("_d")).alias("spread"), F.count(F.lit(1)).alias("n"))


def distance_to_center(nodes: DataFrame, centers: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, km`` of ``nodes`` (``id, g``): least edge to the group's centre (``g, c``), 0 for the centre, null without an edge."""
    two = edges.select("a", "b", "d").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    placed = nodes.select("id", "g").join(centers, "g")
    near = two.groupBy(F.col("a").alias("id"), F.col("b").alias("c")).agg(F.min("d").alias("km"))
    return placed.join(near, ["id", "c"], "left").select("id", F.when(F.col("id") == F.col("c"), 0.0).otherwise(F.col("km")).alias("km"))


def ordered_superiority(df: DataFrame, classes: Sequence[int], cls: str, value: str) -> DataFrame:
    """``a, b, u, n`` for every two ordered classes: pairs in which the higher class has the higher value, ties half.

    From running counts by value: rows, not pairs, are read.
    """
    one = {k: F.count_if(F.col(cls) == k) for k in classes}
    counted = df.groupBy(value).agg(*[c.cast("double").alias(f"_c{k}") for k, c in one.items()]).withColumn("_z", F.lit(0))
    cum = running_totals(counted, value, "_z", {f"_g{k}": F.col(f"_c{k}") for k in classes})
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    won = [F.sum(F.col(f"_c{a}") * (0.5 * F.col(f"_c{b}") - F.col(f"_g{b}"))).alias(f"_w{a}_{b}") for a, b in pairs]
    row = cum.agg(*won, *[F.sum(f"_c{k}").alias(f"_t{k}") for k in classes])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"_w{a}_{b}") + F.col(f"_t{a}") * F.col(f"_t{b}")).alias("u"), (F.col(f"_t{a}") * F.col(f"_t{b}")).cast("long").alias("n"))
        for a, b in pairs
    ])
    return row.select(F.inline(cells)).filter("n > 0")
