"""Contracts, filters, sources and sinks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from brindle.operators.contracts import ContractError, DomainPack, Feature, Signature, TableContract, capabilities
from brindle.plans import bi
from brindle.sources import readers, roles, sinks


def test_table_contract(spark):
    contract = TableContract("sales_daily", ("d", "store", "observed_units"), ("d", "store"), ("observed_units",), {"positive": "observed_units >= 0"})
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, None)], "d string, store int, observed_units int")
    report = contract.validate(df)
    assert (report["status"], report["duplicates"], report["nulls"]) == ("FAIL", 1, {"observed_units": 1})
    assert contract.validate(df.limit(1))["status"] == "PASS"
    assert contract.validate(df.drop("store"))["missing"] == ["store"]


SIGNATURE = Signature((Feature("x"), Feature("n", "integer"), Feature("c", "string", categories=("a", "b"))), forbidden=("target",))


@pytest.mark.parametrize("rows,schema,code", [
    ([(1.0, 1)], "x double, n int", "MISSING_FEATURE"),
    ([(None, 1, "a")], "x double, n int, c string", "NULL_FEATURE"),
    ([(True, 1, "a")], "x boolean, n int, c string", "INVALID_FEATURE"),
    ([("1", 1, "a")], "x string, n int, c string", "INVALID_FEATURE"),
    ([(float("inf"), 1, "a")], "x double, n int, c string", "INVALID_FEATURE"),
    ([(1.0, 1, "z")], "x double, n int, c string", "INVALID_FEATURE"),
    ([(1.0, 1, "a", 1)], "x double, n int, c string, target int", "FORBIDDEN_FEATURE"),
    ([(1.0, 1, "a", 1)], "x double, n int, c string, more int", "UNEXPECTED_FEATURE"),
    ([(1.0, 2.5, "a")], "x double, n double, c string", "INVALID_FEATURE"),
])
def test_signature_codes(spark, rows, schema, code):
    with pytest.raises(ContractError) as e:
        SIGNATURE.validate(spark.createDataFrame(rows, schema))
    assert e.value.code == code


def test_coercion_is_opt_in(spark):
    got = Signature((Feature("n", "integer", coerce=True),)).validate(spark.createDataFrame([("2",)], "n string")).first()
    assert got.n == 2
    for kind, value in (("integer", "2.5"), ("boolean", "maybe"), ("datetime", "yesterday-ish")):
        with pytest.raises(ContractError):
            Signature((Feature("n", kind, coerce=True),)).validate(spark.createDataFrame([(value,)], "n string"))


@pytest.mark.parametrize("kind,coerce,value,dtype,good", [
    ("string", False, 5, "int", False), ("string", True, 5, "int", True), ("string", False, "x", "string", True),
    ("datetime", False, "2024-01-02", "string", False), ("datetime", True, "2024-01-02", "string", True), ("datetime", False, date(2024, 1, 2), "date", True),
    ("boolean", True, "true", "string", False), ("boolean", True, 1, "int", False), ("boolean", False, True, "boolean", True),
    ("number", True, True, "boolean", False), ("integer", True, "7", "string", True), ("number", False, "7", "string", False),
])
def test_types_of_kinds(spark, kind, coerce, value, dtype, good):
    df = spark.createDataFrame([(value,), (None,)], f"x {dtype}")
    signature = Signature((Feature("x", kind, nullable=True, coerce=coerce),))
    codes = [[f.code for f in r.faults] for r in signature.faults(df).collect()]
    assert codes == [[] if good else ["INVALID_FEATURE"], []]
    if good:
        assert signature.validate(df).filter("x is not null").count() == 1
    else:
        with pytest.raises(ContractError, match="INVALID_FEATURE"):
            signature.validate(df)


def test_repeated_names_are_an_invalid_schema(spark):
    with pytest.raises(ContractError, match="INVALID_SCHEMA"):
        SIGNATURE.validate(spark.createDataFrame([(1.0, 2.0)], "x double, n double").select("x", "x", "n"))


def test_domain_pack(spark):
    pack = DomainPack(Signature((Feature("x"),)), {"raw": "x"}, {"x": 2.0})
    assert pack.normalize(spark.createDataFrame([(3.0,)], "raw double")).first().x == 6.0
    with pytest.raises(ContractError):
        pack.normalize(spark.createDataFrame([(3.0, 1.0)], "raw double, x double"))


def test_capabilities():
    got = capabilities({"forecasting": ["sales_daily"], "basket": ["orders"], "membership": ["sales_daily"], "supervised": ["sales_daily"], "broken": ["locations"]}, {"sales_daily": True, "locations": False}, ("supervised",), ("membership",))
    assert got == {"forecasting": "AVAILABLE", "basket": "UNAVAILABLE_MISSING_CONTRACT", "membership": "ACTIVE_EXPERIMENTAL", "supervised": "BLOCKED_SCIENTIFICALLY", "broken": "INVALID_CONTRACT"}


def test_filters_refuse_bad_input(spark):
    with pytest.raises(ValueError):
        bi.Filters(date(2024, 2, 1), date(2024, 1, 1)).condition()
    with pytest.raises(ValueError):
        bi.Filters(stores=range(1000)).condition()
    with pytest.raises(ValueError):
        bi.breakdown(roles.sales(spark, "/root/testdata/sf0.001"), "colour", bi.Filters())


def test_filters_reach_the_scan(spark):
    sales = roles.sales(spark, "/root/testdata/sf0.001")
    plan = bi.summary(sales, bi.Filters(channels=("BUILDING",), categories=("PROMO",)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan.replace("In(c_mktsegment, [BUILDING])", "EqualTo(c_mktsegment,BUILDING)") and "p_name" not in plan


def test_sources(spark, tmp_path):
    assert readers.read_source(spark, [{"a": 1}, {"a": 2}]).count() == 2
    with pytest.raises(readers.SourceError):
        readers.read_source(spark, [{"a": 1}, {"b": 2}])
    with pytest.raises(readers.SourceError):
        readers.read_source(spark, "x.xyz")
    with pytest.raises(readers.SourceError):
        readers.page(spark.range(3), ["id"], 0, 501)
    df = readers.finite_or_null(spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),)], "x double"))
    assert df.filter("x is not null").count() == 1
    spark.range(3).createOrReplaceTempView("some_view")
    assert ("some_view", 0, "id", "bigint") in [tuple(r) for r in readers.table_columns(spark).collect()]


def test_save_dataset(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2024, 1, 1)), (1, date(2024, 1, 1)), (2, date(2024, 1, 3))], "k int, d date")
    facts = sinks.save_dataset(df, str(tmp_path / "out"), ["k", "d"], "d", ["k"])
    assert (facts["n_rows"], facts["n_duplicate_keys"], facts["first_day"], facts["last_day"]) == (3, 1, "2024-01-01", "2024-01-03")
    assert sinks.load_document(spark, str(tmp_path / "out.metadata"))["n_rows"] == 3
    manifest = sinks.publish({"rows": df}, "test_core").first()
    assert (manifest.table_name, manifest.row_count) == ("test_core_rows", 3)
    spark.sql("DROP TABLE test_core_rows")
    assert sinks.flat_row(spark, {"a": 1, "b": {"c": [1, 2]}}).first().b == '{"c": [1, 2]}'
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count(F.lit(1))).first()[0] == 3
