"""2-D projection of embeddings for plotting (R4, re-aimed t-SNE).

t-SNE is a single-machine solver; the Spark form is PCA (``pyspark.ml``): the
covariance is a distributed tree aggregation of a ``dim x dim`` Gram matrix,
the eigen-decomposition happens on that small matrix, and the projection is a
per-row map.  Output is scatter-ready ``(..., target, pc0, pc1)``.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_project(df: DataFrame, x_col: str = "x", k: int = 2, keep: list[str] | None = None) -> DataFrame:
    keep = keep or [c for c in df.columns if c != x_col]
    vec = df.select(*keep, array_to_vector(x_col).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vec)
    out = model.transform(vec).select(*keep, vector_to_array("_pc").alias("_a"))
    return out.select(*keep, *[F.col("_a")[i].alias(f"pc{i}") for i in range(k)])
