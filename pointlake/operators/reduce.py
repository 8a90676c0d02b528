"""Principal components and grouping of vectors."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(df: DataFrame, vector: str, k: int = 32, name: str = "reduced") -> DataFrame:
    """Add the projection of mean-centred vectors on their first ``k`` components."""
    features = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_features", outputCol="_projected").fit(features)
    # The projection is linear, so subtracting the projected mean centres it.
    projected = model.transform(features).withColumn("_projected", vector_to_array("_projected"))
    means = projected.agg(*[F.avg(F.col("_projected")[i]) for i in range(k)]).first()
    centred = F.array(*[F.col("_projected")[i] - F.lit(m or 0.0) for i, m in enumerate(means)])
    return projected.withColumn(name, centred).drop("_features", "_projected")


def group_vectors(
    df: DataFrame, vector: str, groups: int = 20, seed: int = 0, name: str = "label", iterations: int = 5
) -> DataFrame:
    """Add a label from hierarchical (bisecting) k-means; it scales where a full linkage tree does not."""
    features = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    clusterer = BisectingKMeans(k=groups, seed=seed, maxIter=iterations, featuresCol="_features", predictionCol=name)
    model = clusterer.fit(features)
    return model.transform(features).drop("_features")
