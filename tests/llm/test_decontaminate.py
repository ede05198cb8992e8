import random
import re

import pytest

from brindle.llm import decontaminate as D

DOCS = "doc_id long, text string, row string, n_chars long"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(10, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(name)
    return len(w), len(hit), sorted(str(x) for x in found)


def cases():
    rng = random.Random(2)
    vocabulary = ["a", "b", "C", "é", "12"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(40)]
    items += [(100, None), (101, "only once!"), (102, "only once!")]
    texts = [None, "", "Only, ONCE"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 20, 80]))) for _ in range(60)]
    for _ in range(60):
        texts.append(" ".join([rng.choice(vocabulary), rng.choice(items[:40])[1], "zz", rng.choice(items[:40])[1][3:]]))
    return items, texts


@pytest.mark.parametrize("block_words,least", [(2_000_000, 0), (60, 0), (2_000_000, 9)])
def test_against_brute_force(spark, block_words, least):
    items, texts = cases()
    items = [(i, t) for i, t in items if len(words(t)) >= least]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, texts[-1], "", 0), (4, texts[4], "", 0)]
    found = D.find_contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert len(found) == len(rows)
    for r in found:
        text = texts[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_words, sum(x.stop - x.start for x in r.runs), r["items"]) == slow(text, items), text


def test_cleaning(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep this text here as it is. {item.upper()}! And then some more words follow here, all of them fine.", "r", 1), (2, item, "r", 2), (3, None, "r", 3), (4, "clean", "r", 5), (5, "", "", 0)]
    out = D.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "row", "n_chars"]
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    text = "Keep this text here as it is. ! And then some more words follow here, all of them fine."
    assert got == {1: (text, len(text)), 3: (None, 3), 4: ("clean", 5), 5: ("", 0)}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(spark.createDataFrame([], DOCS), items).count() == 0
    assert D.digest(D.find_contamination(spark.createDataFrame([(1, "a b", "", 0)], DOCS), items)).first().n_hit == 0


@pytest.mark.parametrize("max_run", [1, 8])
def test_blocks_change_nothing(spark, max_run):
    items, texts = cases()
    rng = random.Random(5)
    # Hits of two items add up in one text, and cuts bring further windows together.
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(20)) for _ in range(2))
    texts += [f"{a} " + " ".join(f"x{k}" for k in range(30)) + f" {b}", f"tail {a[: len(a) // 2]} {b} {a[len(a) // 2 :].strip()} " + "y " * 80]
    items += [(200, a), (201, b)]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(4, texts[4], "", 0), (None, None, None, None)]
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    run = lambda words: sorted(map(tuple, D.decontaminate(docs, bench, max_run=max_run, block_words=words).collect()), key=repr)
    one = run(1_000_000)
    assert run(60) == one and len(one) < len(rows)
    assert len(texts) - 2 not in {r[0] for r in one}  # 40 of 70 words


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path):
    items, texts = cases()
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(7).write.parquet(str(tmp_path / "docs"))
    docs, bench = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(docs, bench, block_words=60)
    spark.conf.set("spark.sql.files.minPartitionNum", "12")
    try:
        got = {r.doc_id: (r.n_words, sum(x.stop - x.start for x in r.runs), r["items"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == {i: slow(t, items) for i, t in enumerate(texts)}


def test_very_long_text(spark):
    item = " ".join(f"w{k}" for k in range(12))
    text = "filler words here " * 200_000 + item + " end" * 1000
    row = D.find_contamination(spark.createDataFrame([(1, text, "", 0)], DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row["items"]) == (601_012, [(600_000, 600_012)], ["1"])
