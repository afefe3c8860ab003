"""Search by byte codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Metric
from palimpsest.functions import quant
from palimpsest.operators import ann
from palimpsest.operators.knn import top_k


@pytest.mark.parametrize("outliers", [False, True])
def test_two_stage_is_exact(spark, outliers):
    dice = np.random.default_rng(5)
    matrix = dice.normal(size=(600, 8)).astype(np.float32)
    if outliers:
        # One row of huge components leaves the others a few codes.
        matrix[0], matrix[1] = 3000, -3000
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "rowid bigint, vector array<float>")
    codes = quant.fit(frame)
    coded = frame.withColumn("code", F.when(F.col("rowid") != 17, codes.encode(F.col("vector"))))
    for metric in Metric:
        for q in (17, 300):
            query = [float(x) for x in matrix[q]]
            found = [(r.rowid, r.score) for r in ann.two_stage(coded, query, 10, codes, metric).collect()]
            assert found == [(r.rowid, r.score) for r in top_k(frame, query, 10, metric).collect()]
