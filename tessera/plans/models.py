"""Queries on clustering methods and models; no plain SQL form, so tests check planted answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import stats as S

from .base import query
from .inputs import customers, monthly, read, strong_flows, vectors
from .panels import rounded


@query("kmeans_types")
def kmeans_types(spark, sf_dir):
    return K.kmeans(_labelless(spark, sf_dir), "v", 5).select("id", "label")


def _labelless(spark, sf_dir):
    return vectors(spark, sf_dir).drop("label")


@query("bisecting_types")
def bisecting_types(spark, sf_dir):
    return K.bisecting(_labelless(spark, sf_dir), "v", 5).select("id", "label")


@query("gmm_types")
def gmm_types(spark, sf_dir):
    return K.gaussian_mixture(_labelless(spark, sf_dir), "v", 3).select("id", "label")


@query("pca_scores")
def pca_scores(spark, sf_dir):
    p = K.principal_components(_labelless(spark, sf_dir), "v", 2)
    return rounded(p.select("id", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2")), "pc1", "pc2", digits=4)


def _on_graph(method):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, w = K.weights_matrix(pdf)
        return pd.DataFrame({"id": ids, "label": method(w)})

    return run


@query("louvain_types")
def louvain_types(spark, sf_dir):
    return K.per_group(strong_flows(spark, sf_dir).withColumn("run", F.lit(0)), ["run"], _on_graph(K.louvain), "id long, label int")


@query("spectral_types")
def spectral_types(spark, sf_dir):
    return K.per_group(strong_flows(spark, sf_dir).withColumn("run", F.lit(0)), ["run"], _on_graph(lambda w: K.spectral(w, min(3, len(w)))), "id long, label int")


def _series(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    wide = pdf.pivot_table(index="id", columns="t", values="y", aggfunc="first").sort_index()
    return wide.index.to_numpy(), wide.apply(lambda r: r.fillna(r.mean()), axis=1).to_numpy()


@query("ward_types")
def ward_types(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = _series(pdf)
        return pd.DataFrame({"id": ids, "label": K.ward(x, min(4, len(x)))})

    return K.per_group(monthly(spark, sf_dir).select("id", "t", "y").withColumn("run", F.lit(0)), ["run"], run, "id long, label int")


@query("feature_link_types")
def feature_link_types(spark, sf_dir):
    m = monthly(spark, sf_dir).select("id", F.lit(0).cast("long").alias("b"), "t", "y", F.lit(None).cast("double").alias("w"))
    e = strong_flows(spark, sf_dir).select(F.col("a").alias("id"), F.col("b").cast("long"), F.lit(-1).alias("t"), F.lit(None).cast("double").alias("y"), "w")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = _series(pdf[pdf["t"] >= 0])
        edges = pdf[pdf["t"] < 0]
        w = np.zeros((len(ids), len(ids)))
        known = edges[edges["id"].isin(ids) & edges["b"].isin(ids)]
        i, j = np.searchsorted(ids, known["id"]), np.searchsorted(ids, known["b"])
        w[i, j] = w[j, i] = known["w"]
        links = K.modularity_links(w) if w.sum() else w
        scale = [a / (np.sqrt((a**2).sum()) or 1.0) for a in (x - x.mean(0), links)]
        seeds = K.maxmin_seeds(np.hstack(scale), min(4, len(ids)))
        return pd.DataFrame({"id": ids, "label": K.feature_link_clusters(*scale, seeds)})

    return K.per_group(m.unionByName(e).withColumn("run", F.lit(0)), ["run"], run, "id long, label int")


@query("dtw_pairs")
def dtw_pairs(spark, sf_dir):
    series = monthly(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s")).select("id", F.col("s.y").alias("y"))
    two = series.select(F.col("id").alias("b"), F.col("y").alias("y2"))
    met = series.select(F.col("id").alias("a"), F.col("y").alias("y1")).join(two, F.col("a") < F.col("b"))

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([K.dtw(np.asarray(a), np.asarray(b), 2 + abs(len(a) - len(b))) for a, b in zip(x, y, strict=True)])

    return rounded(met.select("a", "b", distance("y1", "y2").alias("d")), "d")


@query("label_agreement_ami")
def label_agreement_ami(spark, sf_dir):
    c = customers(spark, sf_dir).groupBy((F.col("id") % 5).cast("int").alias("x"), (F.ascii("seg") % 4).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A contingency table, whatever the number of rows behind it; AMI needs whole counts.
        x, y = np.repeat(pdf["x"].to_numpy(), pdf["c"]), np.repeat(pdf["y"].to_numpy(), pdf["c"])
        return pd.DataFrame({"ami": [K.mutual_information(x, np.unique(y, return_inverse=True)[1])]})

    return rounded(K.per_group(c.withColumn("run", F.lit(0)), ["run"], run, "ami double"), "ami")


@query("missingness_auc")
def missingness_auc(spark, sf_dir):
    """Area under the curve of a logistic model of which documents have labels, over three folds."""
    has = read(spark, sf_dir, "labels", "doc_id").distinct().withColumn("label", F.lit(1.0))
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars", "lang").join(has, "doc_id", "left").fillna(0.0, ["label"])
    d = S.robust_scale(d.withColumn("x", F.log1p("n_chars")), "x", [], "z").select("doc_id", "label", "z", *[(F.col("lang") == x).cast("double").alias(x) for x in ("de", "es", "fr")])
    d = VectorAssembler(inputCols=["z", "de", "es", "fr"], outputCol="features").transform(d).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    folds = [LogisticRegression(regParam=0.01).fit(d.filter(F.col("fold") != k)).transform(d.filter(F.col("fold") == k)) for k in range(3)]
    auc = [BinaryClassificationEvaluator().evaluate(f) for f in folds]
    return spark.createDataFrame([(k, float(round(a, 4))) for k, a in enumerate(auc)], "fold int, auc double")


@query("tree_kappa")
def tree_kappa(spark, sf_dir):
    """Agreement beyond chance of a shallow tree with the labels of the vectors, on held-out rows."""
    v = vectors(spark, sf_dir).select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    held = v.filter("id % 5 = 0")
    guess = DecisionTreeClassifier(maxDepth=3).fit(v.filter("id % 5 <> 0")).transform(held)
    cells = guess.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy()
    margins = cells.select(
        "c", (F.col("label") == F.col("prediction")).alias("hit"), F.sum("c").over(every).alias("n"),
        F.sum("c").over(Window.partitionBy("label")).alias("r"), F.sum("c").over(Window.partitionBy("prediction")).alias("q"),
    )
    agg = margins.agg(F.sum(F.when(F.col("hit"), F.col("c") / F.col("n")).otherwise(0.0)).alias("po"), F.sum(F.when(F.col("hit"), F.col("r") * F.col("q") / (F.col("n") * F.col("n"))).otherwise(0.0)).alias("pe"))
    return rounded(agg.select(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa")), "kappa")


@query("closed_itemsets")
def closed_itemsets(spark, sf_dir):
    """Frequent sets of customers' traits that no larger set matches in support.

    If any larger set has the same support, one with a single trait more does,
    so each set is compared with the sets that it leaves when a trait is dropped.
    """
    c = customers(spark, sf_dir)
    traits = F.array_compact(F.array(F.col("seg"), F.when(F.col("bal") > 5000, "rich"), F.when(F.col("n_orders") > 10, "busy"), F.when(F.col("n_orders") == 0, "idle")))
    sets = FPGrowth(itemsCol="items", minSupport=0.05).fit(c.select(traits.alias("items"))).freqItemsets
    named = sets.select(F.array_sort("items").alias("traits"), F.col("freq").alias("n"))
    smaller = named.select(
        F.explode(F.transform("traits", lambda t: F.array_join(F.array_remove("traits", t), ";"))).alias("items"), "n"
    ).distinct()
    return named.select(F.array_join("traits", ";").alias("items"), "n").join(smaller, ["items", "n"], "left_anti")


@query("leiden_types")
def leiden_types(spark, sf_dir):
    return K.per_group(strong_flows(spark, sf_dir).withColumn("run", F.lit(0)), ["run"], _on_graph(K.leiden), "id long, label int")


@query("density_types")
def density_types(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = _series(pdf)
        return pd.DataFrame({"id": ids, "label": K.density_clusters(x, 3)})

    return K.per_group(monthly(spark, sf_dir).select("id", "t", "y").withColumn("run", F.lit(0)), ["run"], run, "id long, label int")


@query("rewired_modularity")
def rewired_modularity(spark, sf_dir):
    """Modularity of the communities of the flows and of rewired graphs of the same degrees, a task per draw."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, w = K.weights_matrix(pdf)
        rep = int(pdf["rep"].iloc[0])
        graph = w if rep == 0 else K.rewired(w, 10 * len(pdf), rep)
        label = K.leiden(graph)
        hot = np.eye(label.max() + 1)[label]
        m = hot.T @ graph @ hot / graph.sum()
        return pd.DataFrame({"rep": [rep], "communities": [int(label.max() + 1)], "modularity": [round(float(np.trace(m) - (m.sum(1) ** 2).sum()), 6)]})

    draws = strong_flows(spark, sf_dir).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return K.per_group(draws, ["rep"], run, "rep int, communities int, modularity double")
