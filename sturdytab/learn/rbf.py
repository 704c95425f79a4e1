"""Random Fourier features (Rahimi and Recht, 2007): a linear model on them approximates an RBF kernel machine."""

from __future__ import annotations

import math
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F


def fourier_udf(numeric_width: int, sizes: list[int], outputs: int, gamma: float, seed: int):
    """Arrow-batched map of (numeric array, category index array) to cosine features.

    A batch stays one matrix from Arrow to Arrow: an object a row would cost several times what the features do. One-hot columns never become dense: each category index picks its row of the weight matrix, which every task
    makes once from the seed. The function carries all it needs, so executors do not import this package.
    """
    offsets = [int(x) for x in np.cumsum([numeric_width, *sizes])[:-1]]
    width = numeric_width + sum(sizes)

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rng = np.random.default_rng(seed)
        weights = rng.normal(0.0, math.sqrt(2 * gamma), (width, outputs))
        shift = rng.uniform(0.0, 2 * math.pi, outputs)
        for numbers, codes in batches:
            rows = len(numbers)
            if not rows:
                yield pa.array([], pa.list_(pa.float64()))
                continue
            total = np.tile(shift, (rows, 1))
            if numeric_width:
                total += numbers.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) @ weights[:numeric_width]
            if sizes:
                index = codes.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(int)
                for j, size in enumerate(sizes):
                    known = index[:, j] < size  # an unseen category adds nothing
                    if known.all():
                        total += weights[offsets[j] + index[:, j]]
                    else:
                        total[known] += weights[offsets[j] + index[known, j]]
            np.cos(total, out=total)
            total *= math.sqrt(2.0 / outputs)
            yield pa.ListArray.from_arrays(np.arange(0, rows * outputs + 1, outputs, dtype=np.int32), total.ravel())

    return project


class FourierFeatures(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """inputCols = [numeric vector, category index columns...]; `sizes` are the category counts."""

    numericWidth = Param(Params._dummy(), "numericWidth", "length of the numeric vector", TypeConverters.toInt)
    sizes = Param(Params._dummy(), "sizes", "categories per index column", TypeConverters.toListInt)
    outputs = Param(Params._dummy(), "outputs", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the weights", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None, numericWidth=0, sizes=None, outputs=256, gamma=1.0, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _get(self, name, default=None):
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isSet(param) else default

    def _transform(self, df):
        numbers, *codes = self.getInputCols()
        project = fourier_udf(self._get("numericWidth", 0), self._get("sizes", []), self._get("outputs", 256),
                              self._get("gamma", 1.0), self._get("seed", 42))
        index = F.array(*[F.col(c) for c in codes]) if codes else F.array().cast("array<double>")
        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(numbers), index)))
