import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from brindle.llm import phrases

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType())])


def brute(rows, least, longest, top, covered=100):
    out, found, totals = [], Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for stop in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(stop, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    found = {p: f for p, f in found.items() if f >= least}
    for (lang, p), a in found.items():
        if len(p) < 2:
            continue
        longer = [f for (x, q), f in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * f >= covered * a for f in longer):
            continue
        score, k = min((1000 * a * totals[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, found[lang, p[:k]], found[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in totals:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["red", "Red", "éclair", "É", "the", "of", "#", "x\x1fy", "日本", "a\xa0b", "'s"]
    fixed = ["new york city hall", "the quick red fox of the north", "a a a a a a"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((i, "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for p in parts), rng.choice(["en", "de", None, "und"]), "clash"))
    return rows + [(None, None, "en", None), (7, "", None, ""), (8, " ., ", "fr", "")] + rows[:20]


@pytest.mark.parametrize(("seed", "covered", "chunk"), [(1, 100, 2_000_000), (2, 60, 50)])
def test_as_by_brute_force(spark, seed, covered, chunk):
    rows = texts(seed)
    got = phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA), min_count=8, longest=5, top=40, covered=covered, chunk_words=chunk)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 8, 5, 40, covered)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = texts(3, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in phrases.mine_phrases(df, min_count=5, top=100).collect())
    monkeypatch.setattr(phrases, "has_bit", lambda bitmap, h: np.ones(len(h), bool))
    monkeypatch.setattr(phrases, "_bitmap", lambda slices, bits: np.full(bits // 8, 255, np.uint8))
    assert sorted(tuple(r) for r in phrases.mine_phrases(df, min_count=5, top=100).collect()) == want == brute(rows, 5, 5, 100)


def test_empty_table(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_hashes_are_told_apart():
    ids, h = np.array([1, 2, 1, 3, 1, 2], np.int32), np.zeros(5, np.uint64)
    assert sorted((tuple(ids[a : a + 2]), n) for a, n in zip(*phrases.tally(ids, h, np.arange(5), 2))) == [((1, 2), 2), ((1, 3), 1), ((2, 1), 1), ((3, 1), 1)]


def test_long_texts_are_cut_at_breaks_only():
    text = b"Aa bb, " * 1000 + b"c" * 5000 + b" d! e"
    parts = list(phrases.segments(text, 100))
    assert b"".join(parts) == text.translate(phrases.CLEAN) and len(parts) > 50 and all(p.startswith(b".") for p in parts[1:])


def test_a_pass_sends_a_row_a_part_not_a_row_a_phrase(spark):
    text = " ".join(f"w{k % 997}" for k in range(5000))
    docs = spark.createDataFrame([("en", text), ("de", text)], "lang string, text string").coalesce(1)
    counts = phrases._first_pass(docs, 1 << 18, 5, 2, 64, 4000)  # two chunks of 997 words
    assert counts.filter("slice is null and ids is null").count() == 2 * (64 + 1)
    got = {held: sorted(map(tuple, phrases._frequent(counts, 6, held).select("lang", "phrase", "f").collect())) for held in (1, 10**6)}
    want = sorted((lang, f"w{k}", 6 if k < 5000 % 997 else 5) for lang in ("de", "en") for k in range(997))
    assert got[1] == got[10**6] == [r for r in want if r[2] >= 6]
