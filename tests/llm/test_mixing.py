import pytest

from brindle.llm import mixing as M

DOCS = "doc_id long, text string, source string, size string, key int"


def rows():
    out = [(i, "w " * (1 + i * 7 % 90), f"s{i % 4}", "clash", 1) for i in range(400)]
    return out + [(i, "w " * 30, "s0", "", 0) for i in range(1000, 1300)] + [(1, None, None, "", 0), (None, "a b c", None, "", 0), (None, "a b c", None, "", 0), (3, "", "empty", "", 0), (2, "w " * 15, "s2", "clash", 1)]


def slow_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > 2 * sizes[n]}
        if not over:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: 2.0 * sizes[n] for n in over}
        left -= sum(2 * sizes[n] for n in over)
        open_ -= over
    return target


def test_targets_and_takes(spark):
    got = M.mix_sources(spark.createDataFrame(rows(), DOCS)).collect()
    assert len(got) == len(rows())
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
    want = slow_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for source, n in taken.items():
        assert abs(n - want[source]) <= largest[source], source
    again = M.mix_sources(spark.createDataFrame(rows()[::-1], DOCS).repartition(3)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixture_agrees(spark):
    df = spark.createDataFrame(rows(), DOCS)
    out = M.mixture(df)
    assert out.columns == [*df.columns, "copies"]
    want = sorted((r.doc_id, r.copies) for r in M.mix_sources(df).collect() if r.taken and r.doc_id is not None)
    assert sorted((r.doc_id, r.copies) for r in out.collect() if r.doc_id is not None) == want


def test_clashing_names(spark):
    df = spark.createDataFrame(rows(), DOCS)
    odd = df.withColumnsRenamed({"size": "_mix_size", "key": "copies"}).withColumn("_goal_epochs", M.F.lit(9))
    out = M.mixture(odd)
    assert out.columns == ["doc_id", "text", "source", "_mix_size", "_goal_epochs", "copies"]
    assert sorted((str(r.doc_id), r.copies) for r in out.collect()) == sorted((str(r.doc_id), r.copies) for r in M.mixture(df).collect())


def test_better_texts_go_first(spark):
    good = [(i, "w " * 50, "a", "", 0) for i in range(500)]
    bad = [(i + 500, "w# " * 50, "a", "", 0) for i in range(500)]
    other = [(i + 2000, "w " * 50, "b", "", 0) for i in range(20)]
    got = M.mix_sources(spark.createDataFrame(good + bad + other, DOCS)).filter("source = 'a'").collect()
    assert sum(r.copies for r in got if r.doc_id < 500) > sum(r.copies for r in got if r.doc_id >= 500)


def test_empty_table(spark):
    assert M.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert M.mixture(spark.createDataFrame([(1, None, None, "", 0)], DOCS)).count() == 0


def test_budget_end_against_brute_force(spark, monkeypatch):
    alike = [(None, "one text " * 5, "a", "", 0)] * 400
    docs = alike + [(i, "w " * (i % 23), "abc"[i % 3], "", 0) for i in range(600)]
    df = spark.createDataFrame(docs, DOCS)
    keyed = M.keyed(df.select("doc_id", "text", "source"), "doc_id", "text", "source").collect()
    for bins in (1, 2, 4096):
        monkeypatch.setattr(M, "BINS", bins)
        got = M.mix_sources(df).collect()
        for source in "abc":
            mine = [r for r in got if r.source == source]
            rest = mine[0].target - mine[0].target // mine[0].source_size * mine[0].source_size
            ordered, seen, want = sorted((r.key, r.tie, r.size, r.doc_id) for r in keyed if r.source == source), 0, []
            begins = {}
            for key, tie, size, doc_id in ordered:
                begin = begins.setdefault((key, tie, size), seen)
                want.append((str(doc_id), size, int(begin + size / 2 <= rest) + int(mine[0].target // mine[0].source_size)))
                seen += size
            assert sorted((str(r.doc_id), r.size, r.copies) for r in mine if r.size) == sorted(w for w in want if w[1]), (bins, source)
