"""Ward's clustering against brute force, the frozen selection, and the store of runs."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import selection, ward
from brindle.sources.runs import RunError, RunStore


def brute(points, ks):
    """Merges of the pair that adds least to the squared distances within clusters; the clusters when each of ``ks`` are left."""
    groups, found = [[i] for i in range(len(points))], {}
    while len(groups) >= min(ks):
        if len(groups) in ks:
            found[len(groups)] = {frozenset(g) for g in groups}
        centres, n = np.array([points[g].mean(axis=0) for g in groups]), np.array([len(g) for g in groups], float)
        cost = n[:, None] * n / (n[:, None] + n) * ((centres[:, None] - centres) ** 2).sum(axis=2)
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        groups[min(i, j)] += groups.pop(max(i, j))
    return found


def test_ward_as_by_brute_force(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 1.0, (40, 2)) for c in ((0, 0), (3, 1), (8, 8), (-4, 6), (1, 9))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(1000, None, 1.0)], "i long, x double, y double")
    rows = ward.ward_labels(df, ["x", "y"], (2, 3, 5)).collect()
    assert {r.i: r.ward_3 for r in rows}[1000] is None and len(rows) == 201
    for k, want in brute(points, (2, 3, 5)).items():
        assert {frozenset(r.i for r in rows if r[f"ward_{k}"] == c) for c in range(k)} == want


def test_ward_of_many_points_goes_through_cells(spark):
    rng = np.random.default_rng(2)
    centres = ((0.0, 0.0), (50.0, 0.0), (0.0, 80.0))
    rows = [(int(k), float(rng.normal(centres[k][0])), float(rng.normal(centres[k][1]))) for k in rng.integers(0, 3, 3000)]
    labelled = ward.ward_labels(spark.createDataFrame(rows, "k int, x double, y double"), ["x", "y"], (3,), most=100)
    found = {(r.k, r.ward_3) for r in labelled.select("k", "ward_3").distinct().collect()}
    assert len(found) == 3 and len({c for _, c in found}) == 3
    marked, leaves, names = ward.leaves(spark.createDataFrame(rows, "k int, x double, y double"), ["x", "y"], 100)
    assert leaves.count() <= 100 and leaves.agg(F.sum("_n")).first()[0] == 3000
    sums = leaves.agg(F.sum("_s0"), F.sum("_s1")).first()
    assert np.allclose(tuple(sums), np.array(rows)[:, 1:].sum(axis=0))


def test_ward_of_few_points_and_ties(spark):
    df = lambda rows: spark.createDataFrame(rows, "x double")
    assert ward.ward_labels(df([]), ["x"], (2,)).collect() == []
    assert [r.ward_2 for r in ward.ward_labels(df([(1.0,)] * 4), ["x"], (2,)).collect()] == [0] * 4
    rows = ward.ward_labels(df([(0.0,), (1.0,), (2.0,), (3.0,)]), ["x"], (2, 4)).collect()
    assert {r.x: r.ward_4 for r in rows} == {0.0: 0, 1.0: 1, 2.0: 2, 3.0: 3}
    assert {r.x: r.ward_2 for r in rows} == {0.0: 0, 1.0: 0, 2.0: 1, 3.0: 1}


@pytest.fixture
def frames(spark):
    return {"train": spark.createDataFrame([(1, date(2024, 1, 1), 2.0)], "k int, d date, y double"), "validation": spark.range(5)}


def test_a_simple_model_wins_within_the_tolerance():
    order = ("zero", "ridge", "boosted")
    assert selection.select_model({"zero": 0.502, "ridge": 0.5015, "boosted": 0.5}, order) == "zero"
    assert selection.select_model({"zero": 0.6, "ridge": 0.502, "boosted": 0.5}, order) == "ridge"
    assert selection.select_model({"zero": 0.6, "ridge": 0.6, "boosted": 0.5}, order) == "boosted"


def test_a_selection_is_written_once(spark, tmp_path, frames):
    path = str(tmp_path / "s")
    record = selection.freeze(spark, path, {"a": 0.3, "b": 0.2}, ("a", "b"), frames)
    assert selection.load(spark, path, frames) == record and record["selected"] == "b"
    with pytest.raises(selection.SelectionError, match="ALREADY_FROZEN"):
        selection.freeze(spark, path, {"a": 0.1, "b": 0.2}, ("a", "b"), frames)
    assert selection.load(spark, path, frames)["selected"] == "b"


def test_other_frames_and_changed_records_are_refused(spark, tmp_path, frames):
    path = str(tmp_path / "s")
    record = selection.freeze(spark, path, {"a": 0.3, "b": 0.2}, ("a", "b"), frames)
    for other in (spark.range(6), spark.range(1, 6), spark.range(5).withColumnRenamed("id", "other")):
        with pytest.raises(selection.SelectionError, match="INPUT_CHANGED"):
            selection.load(spark, path, frames | {"validation": other})
    with pytest.raises(selection.SelectionError, match="INPUT_CHANGED"):
        selection.load(spark, path, {"test": frames["train"]})
    for k, change in enumerate(({"selected": "a"}, {"errors": {"a": 0.1, "b": 0.2}}, {"tolerance": 1.0})):
        where = str(tmp_path / f"changed{k}")
        spark.createDataFrame([(json.dumps(record | change),)], "value string").coalesce(1).write.text(where)
        with pytest.raises(selection.SelectionError, match="RECORD_CHANGED"):
            selection.load(spark, where, frames)
    for k, text in enumerate(("{", "[]", "{}")):
        where = str(tmp_path / f"malformed{k}")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(where)
        with pytest.raises(selection.SelectionError, match="MALFORMED_RECORD"):
            selection.load(spark, where, frames)


def test_runs_appear_whole_or_not_at_all(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.names() == [] and store.list("eda") == []
    with pytest.raises(RunError, match="NO_SUCH_RUN"):
        store.latest("eda")
    a, b = spark.range(3), spark.range(5).withColumn("x", F.lit("y"))
    assert store.save("eda", {"a": a, "b": b}, {"note": "first"}) == 1
    assert store.save("eda", {"a": b}, {"note": "second"}) == 2
    assert (store.names(), store.list("eda"), store.latest("eda")) == (["eda"], [1, 2], 2)
    assert store.facts("eda", 1) == {"facts": {"note": "first"}, "rows": {"a": 3, "b": 5}}
    assert store.load("eda", "a").count() == 5 and store.load("eda", "a", 1).count() == 3
    with pytest.raises(RunError, match="NO_SUCH_RUN"):
        store.load("eda", "b")
    with pytest.raises(RunError, match="NO_SUCH_RUN"):
        store.facts("eda", 3)
    with pytest.raises(Exception, match="planned"):
        store.save("eda", {"a": a, "b": b.withColumn("x", F.raise_error(F.lit("planned")))})
    assert store.list("eda") == [1, 2] and not list((tmp_path / "runs" / "_staged").iterdir())
    for name, tables in (("_x", {"a": a}), ("x/y", {"a": a}), ("x", {"facts": a}), ("", {"a": a})):
        with pytest.raises(RunError, match="INVALID_NAME"):
            store.save(name, tables)


def test_a_number_taken_in_between_is_left_alone(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "runs"))
    store.save("eda", {"a": spark.range(1)})
    real, calls = RunStore.list, []

    def stale(self, name):
        calls.append(name)
        return [] if len(calls) == 1 else real(self, name)

    monkeypatch.setattr(RunStore, "list", stale)
    assert store.save("eda", {"a": spark.range(7)}) == 2
    assert store.load("eda", "a", 1).count() == 1 and store.load("eda", "a", 2).count() == 7


@pytest.mark.parametrize("name, role", [("snk06_run_store", "sales"), ("ed01_readiness", "inventory")])
def test_what_is_read_many_times_is_computed_once(spark, monkeypatch, name, role):
    """Lines that pass through the role's frame: once each, however many tables or profiles are made of it."""
    import __spark_entry__ as entry
    from brindle.sources import roles

    passed, plain = spark.sparkContext.accumulator(0), getattr(roles, role)

    def counted(session, d):
        frame = plain(session, d)

        def run(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield batch

        return frame.mapInArrow(run, frame.schema)

    monkeypatch.setattr(roles, role, counted)
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert passed.value == plain(spark, "/root/testdata/sf0.001").count()
