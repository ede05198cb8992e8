"""Engine, registry, exploratory runs and the simulation."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import eda, serving
from brindle.operators.contracts import ContractError, Feature, Signature


def engine(score=lambda df: df.withColumn("p", F.col("x") / 10)):
    registry = serving.Registry()
    registry.add(serving.Model("m", "1", Signature((Feature("x"),)), score, {"p": "probability"}))
    return registry, serving.Engine(registry)


def test_versions(spark):
    registry, e = engine()
    with pytest.raises(ContractError, match="MODEL_CONFLICT"):
        registry.add(registry.find("m"))
    registry.add(serving.Model("m", "2", Signature((Feature("x"),)), lambda df: df))
    for version, code in ((None, "VERSION_REQUIRED"), ("3", "MODEL_NOT_FOUND")):
        with pytest.raises(ContractError, match=code):
            registry.find("m", version)
    assert registry.find("m", "2").version == "2"


def test_batches_are_bounded_and_checked(spark):
    told = []
    _, e = engine()
    e.observers = (told.append,)
    records, facts = e.infer_batch("m", spark.createDataFrame([(5.0,), (10.0,)], "x double"))
    assert [r["p"] for r in records] == [0.5, 1.0] and told == [facts] and facts["rows"] == 2
    for bad in (spark.createDataFrame([], "x double"), spark.range(1001).select(F.col("id").cast("double").alias("x"))):
        with pytest.raises(ContractError, match="INVALID_BATCH"):
            e.infer_batch("m", bad)
    with pytest.raises(ContractError, match="INVALID_OUTPUT"):
        e.infer_batch("m", spark.createDataFrame([(50.0,)], "x double"))
    _, lost = engine(lambda df: df)
    with pytest.raises(ContractError, match="INVALID_OUTPUT"):
        lost.infer("m", spark.createDataFrame([(5.0,)], "x double"))


def test_output_faults_count_without_collecting(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,), (float("nan"),)], "p double")
    assert serving.output_faults(df, {"p": "probability"}).first().p == 3


def test_mixed_rows_get_scores_or_codes(spark):
    seen = []

    def score(df):
        seen.append(df.columns)
        return df.withColumn("p", F.col("x") / 10)

    _, e = engine(score)
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 50.0), (5, 0.0)], "k int, x double")
    got = {r.k: (r.p, [(f.feature, f.code) for f in r.faults]) for r in e.infer_rows("m", df, keep=["k"]).collect()}
    assert got == {1: (0.5, []), 2: (None, [("x", "NULL_FEATURE")]), 3: (None, [("x", "INVALID_FEATURE")]), 4: (None, [("p", "INVALID_OUTPUT")]), 5: (0.0, [])}
    assert e.infer_rows("m", df.filter("k > 9"), keep=["k"]).count() == 0 and seen[0] == ["k", "x"]
    for bad, code in ((df.withColumn("y", F.lit(1)), "UNEXPECTED_FEATURE"), (df.drop("x"), "MISSING_FEATURE")):
        with pytest.raises(ContractError, match=code):
            e.infer_rows("m", bad, keep=["k"])
    with pytest.raises(ContractError, match="INVALID_SCHEMA"):
        e.infer_rows("m", df, keep=["x"])


def test_features_resolve_to_the_latest_row_without_outcomes(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1.0, 9), (1, "2024-01-02", float("nan"), 9), (2, "2024-01-03", 3.0, 9)], "k int, d string, x double, y int").withColumn("d", F.to_date("d"))
    row = serving.resolve_features(df, {"k": 1}, "d", ["y"]).first()
    assert (str(row.d), row.x) == ("2024-01-02", None) and "y" not in row
    assert serving.resolve_features(df, {"k": 1}, "d", ["y"], F.to_date(F.lit("2024-01-01"))).first().x == 1.0
    assert serving.fill_categories(spark.createDataFrame([(None,)], "c string"), ["c"]).first().c == "__MISSING__"


def test_exploratory_runs(spark):
    df = spark.createDataFrame([(i, float(i % 5), "a" if i % 2 else None) for i in range(40)], "k int, x double, c string")
    run = eda.run_eda(df, ["k"], "x")
    assert run["readiness"] == "READY" and run["metrics"]["repeated_keys"] == 0
    assert eda.run_eda(df.unionByName(df), ["k"], "x")["readiness"] == "BLOCKED"
    assert eda.run_eda(df, ["k"], "c")["readiness"] == "LIMITED"
    assert eda.fingerprint(df)["content"] == eda.fingerprint(df.repartition(7))["content"]
    delta = eda.compare_runs(run, eda.run_eda(df.limit(30).withColumn("z", F.lit(1)).drop("c"), ["k"], "x"))
    assert (delta["added"], delta["removed"], delta["metrics"]["rows"]["absolute"]) == (["z"], ["c"], -10)
