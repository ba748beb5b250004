import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slipstream import config
from slipstream.operators import concentration
from slipstream.operators.rank import gini, ordered_counts, percentile_ranks
from slipstream.operators.skew import lookup


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    values = np.round(rng.pareto(1.5, 3000), 2)
    values[:1000] = 0.0  # a third of all rows share one value
    other = np.where(rng.random(3000) < 0.2, np.nan, rng.integers(0, 9, 3000))
    return pd.DataFrame({"uid": [str(i) for i in range(3000)], "a": values, "b": other})


def test_percentiles_are_average_ranks(spark, sample):
    df = spark.createDataFrame(sample).withColumn("b", F.nanvl("b", F.lit(None)))
    got = percentile_ranks(df, "uid", ["a", "b"]).toPandas().set_index("uid").sort_index()
    want = sample.set_index("uid").rank(pct=True).sort_index()
    np.testing.assert_allclose(got["a_pctl"], want["a"], atol=1e-12)
    np.testing.assert_allclose(got["b_pctl"], want["b"], atol=1e-12)


def test_order_does_not_depend_on_partitions(spark, sample):
    want = None
    for parts in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = ordered_counts(spark.createDataFrame(sample), "a").toPandas().sort_values("a")
        rows = got[["a", "n", "before"]].values.tolist()
        want = want or rows
        assert rows == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert want[0][:2] == [0.0, 1000 + int((sample["a"][1000:] == 0).sum())]


def test_gini_and_lorenz_match_the_formulas(spark, sample):
    v = np.sort(sample["a"][sample["a"] > 0].to_numpy())
    n = len(v)
    rows = spark.createDataFrame(sample).select(F.col("a").cast("decimal(18,6)").alias("stake"))
    want = ((2 * np.arange(1, n + 1) - n - 1) * v).sum() / (n * v.sum())
    assert gini(ordered_counts(rows.where("stake > 0"), "stake"), "stake").first()["gini"] == pytest.approx(want)
    curve = concentration.lorenz(rows).orderBy("point").toPandas()
    step = max(1, n // 200)
    picks = [i for i in range(n) if i % step == 0 or i == n - 1]
    np.testing.assert_allclose(curve["x"], [0] + [(i + 1) / n for i in picks])
    np.testing.assert_allclose(curve["y"], [0] + [v[: i + 1].sum() / v.sum() for i in picks], atol=1e-9)


def test_lorenz_of_nothing_is_the_origin(spark):
    rows = spark.createDataFrame([(0.0,)], "stake double").select(F.col("stake").cast("decimal(18,6)"))
    assert concentration.lorenz(rows).count() == 1


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_lookup_with_a_hot_and_a_null_key(spark, monkeypatch, hot):
    monkeypatch.setattr(config, "HOT_KEYS", hot)
    keys = ["hot"] * 50 + [None] * 30 + [f"k{i}" for i in range(20)] + ["absent"] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    table = (
        rows.where("k is null or k <> 'absent'").groupBy("k").agg(F.count("*").alias("n"))
        .withColumn("label", F.coalesce("k", F.lit("none")))
    )
    got = lookup(rows, table, ["k"], "n", F.col("id")).toPandas().sort_values("id")
    assert len(got) == len(keys)
    want = [None if k == "absent" else (k or "none") for k in keys]
    assert [None if pd.isna(x) else x for x in got["label"]] == want
