"""Merged sketches against exact quantiles."""

import numpy as np

from lexiloom.operators import profile as R


def test_merged_sketches_are_near_the_exact_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(p), float(v)) for g, p, v in zip(rng.integers(0, 2, 4000), rng.integers(0, 7, 4000), rng.lognormal(0, 2, 4000))]
    df = spark.createDataFrame(rows + [(0, 0, None), (5, 0, None)], "grp int, part int, v double")
    got = R.merged_quantiles(R.quantile_sketches(df, "v", ["grp", "part"]), [0.1, 0.5, 0.9], ["grp"]).collect()
    assert {r.grp for r in got} == {0, 1}
    for r in got:
        values = np.array([v for g, _, v in rows if g == r.grp])
        assert r.n_values == len(values)
        assert (values < r.value).mean() - 0.02 <= r.prob <= (values <= r.value).mean() + 0.02


def test_no_values(spark):
    empty = spark.createDataFrame([], "v double")
    assert R.merged_quantiles(R.quantile_sketches(empty, "v"), [0.5]).collect() == []
