"""Clustering and anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.shape import col
from millrace.operators.stats import beside, eventstats


def kmeans(df: DataFrame, names: Sequence[str], centroids: int = 2, iterations: int = 10, cosine: bool = False, seed: int = 1) -> DataFrame:
    """Each row with its ClusterID, by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(names), outputCol="__v").transform(df.dropna(subset=list(names)))
    model = KMeans(k=centroids, maxIter=iterations, seed=seed, featuresCol="__v", predictionCol="ClusterID", distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).drop("__v")


def medians(df: DataFrame, value: Column, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """(__k0, ..., ``name``): each group's exact lower median, without nulls.

    Two approximate quantiles cut a group's values in three; the part with the median, some 4 values in 10,000 as a rule, is
    counted value by value. Wherever the cuts lie, the result is exact.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    v = df.select(*[col(k).alias(g) for k, g in zip(by, keys, strict=True)], value.alias("__v")).where("__v IS NOT NULL")
    near = eventstats(v, {"__cut": F.percentile_approx("__v", [0.4998, 0.5002], 10_000)}, keys)
    placed = near.select(*keys, "__v", F.when(F.col("__v") < F.col("__cut")[0], 0).when(F.col("__v") <= F.col("__cut")[1], 1).otherwise(2).alias("__part"))
    held = eventstats(placed, {"__low": F.count_if(F.col("__part") == 0), "__mid": F.count_if(F.col("__part") == 1), "__rank": F.expr("(count(*) + 1) div 2")}, keys)
    low, upto = F.col("__low"), F.col("__low") + F.col("__mid")
    held = held.where(F.col("__part") == F.when(F.col("__rank") <= low, 0).when(F.col("__rank") <= upto, 1).otherwise(2))
    before = F.when(F.col("__part") == 0, 0).when(F.col("__part") == 1, low).otherwise(upto)
    each = held.groupBy(*keys, "__v", F.col("__rank"), before.alias("__before")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    reached = each.withColumn("__upto", F.col("__before") + F.sum("__n").over(order)).where("__upto >= __rank")
    return reached.groupBy(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(keys)]).agg(F.min("__v").alias(name))


def anomalies(df: DataFrame, name: str, by: Sequence[str] = (), threshold: float = 3.5) -> DataFrame:
    """Robust z-scores (by exact median and median deviation) and who lies beyond the threshold; it stands in for random cut forests.

    Null groups are a group. A null value, or a group without spread, has a null score and is no anomaly.
    """
    with_mid = beside(df, medians(df, col(name), by, "__mid"), by)
    both = beside(with_mid, medians(with_mid, F.abs(col(name) - F.col("__mid")), by, "__mad"), by)
    score = F.abs(col(name) - F.col("__mid")) * 0.6745 / F.nullif(F.col("__mad"), F.lit(0.0))
    return both.withColumn("score", score).withColumn("is_anomaly", F.coalesce(score > threshold, F.lit(False))).drop("__mid", "__mad")


def ml_classify(train: DataFrame, rows: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """``rows`` with a prediction (0 or 1) of a logistic regression fitted on ``train``; rows with a null input get none."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    def laid(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(names), outputCol="__v").transform(df.dropna(subset=list(names)))

    known = laid(train.dropna(subset=[label])).withColumn("__y", col(label).cast("double"))
    scale = StandardScaler(inputCol="__v", outputCol="__x", withMean=True).fit(known)
    model = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="prediction", maxIter=50).fit(scale.transform(known))
    return model.transform(scale.transform(laid(rows))).drop("__v", "__x", "rawPrediction", "probability")
