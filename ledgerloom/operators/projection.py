"""A two-dimensional map of customers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_projection(points: DataFrame, keep: list[str], axes: int = 2) -> DataFrame:
    """Leading principal components of the ``point`` vectors as PC1, PC2, ...

    The sign of each axis makes its largest loading positive. The driver sees
    the loadings only: one number per feature and axis.
    """
    model = PCA(k=axes, inputCol="point", outputCol="projected").fit(points)
    loadings = np.asarray(model.pc.toArray())
    largest = np.abs(loadings).argmax(axis=0)
    signs = np.sign(loadings[largest, range(axes)])
    location = vector_to_array("projected")
    return model.transform(points).select(
        *keep,
        *[(location[i] * F.lit(float(signs[i]))).alias(f"PC{i + 1}") for i in range(axes)],
    )
