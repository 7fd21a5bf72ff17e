"""Nearest neighbours of vectors whose squares leave the range of a double, and of mixed dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import ann


@pytest.mark.parametrize("scale", [1e-200, 1e-150, 1.0, 1e150, 1e200])
def test_candidates_don_t_depend_on_the_scale(scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    plain, scaled = ann.Index(x, 32, 1), ann.Index(x * scale, 32, 1)
    (a, _), (b, _) = (i.candidates(q, 60, 20, 0.01, 1.25) for i, q in ((plain, x[:4]), (scaled, x[:4] * scale)))
    assert all(60 <= len(f) and len(set(f) ^ set(g)) <= 0.2 * len(f) + 100 for f, g in zip(a, b, strict=True))
    assert sorted(np.concatenate(ann.bands(x * scale)).tolist()) == list(range(400))


def test_extreme_vectors_give_whole_results(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=8) * (1e-200, 1e-160, 1.0, 1e160, 1e200)[i % 5]]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda v: F.pmod(v, F.lit(20)) == 0, k=20).collect()
    assert len(got) == 15 * 20
    vector = {i: np.array(v) for i, v in rows}
    with np.errstate(over="ignore", invalid="ignore"):
        want = [float(vector[r.vec_id] @ vector[r.query_id]) for r in got]
    assert all(r.score == (pytest.approx(w, rel=1e-9) if not np.isnan(w) else -np.inf) for r, w in zip(got, want, strict=True))


def test_each_dimension_is_searched(spark):
    rows = [(i, [float(i + 1)] * (2 + i % 2)) for i in range(10)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v < 2, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 8), (0, 6), (0, 4), (1, 9), (1, 7), (1, 5)]
