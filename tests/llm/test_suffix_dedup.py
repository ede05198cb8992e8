import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from brindle.llm import suffix_dedup as S

DOCS = "doc_id long, text string, h string, row int"


def slow(texts, length):
    bodies = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), len(S.runs_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    for n in [1, 2, 3, 4, 5, 6, 7, 50, 51, 52, 300]:
        s = rng.integers(1, rng.choice([2, 3, 200]), n).astype(np.int64)
        assert S.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    big = rng.integers(1, 2**40, 40).astype(np.int64)
    assert S.suffix_array(big).tolist() == sorted(range(40), key=lambda i: big[i:].tolist())


def test_suffix_array_of_more_names_than_packed_keys_hold():
    # Over two million names at a level of the recursion: three of them do not fit into 63 bits.
    rng = np.random.default_rng(7)
    s = rng.integers(1, 27, 6_000_000).astype(np.int64)
    s[4_000_000:] = s[:2_000_000]
    order = S.suffix_array(s)
    assert np.array_equal(np.sort(order), np.arange(len(s)))
    place = np.empty(len(s) + 1, dtype=np.int64)
    place[order] = np.arange(1, len(s) + 1)
    place[len(s)] = 0
    # Neighbours in order differ by a smaller first number, or by the same and a smaller rest.
    a, b = order[:-1], order[1:]
    assert ((s[a] < s[b]) | (s[a] == s[b]) & (place[a + 1] < place[b + 1])).all()


def test_one_line_in_many_surroundings(spark, tmp_path):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefghij ") for _ in range(100))
    words = ["".join(rng.choice("klmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(50_000)]
    around = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, around(15) + line + around(15), "", 0) for i in range(25_000)]
    rows += [(30_000 + i, "-" * i + rows[i][1], "", 0) for i in range(3)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in S.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).filter("n_removed > 0").collect()}
    want = {k: (len(rows[i][1]) + (k >= 30_000) * i, len(rows[i][1])) for i in range(3) for k in (i, 30_000 + i)}
    assert got == want


def texts(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abé d\0") for _ in range(rng.choice([30, 60, 200, 500]))) for _ in range(12)]
    out = [None, "", "short", "a" * 1000, "ab" * 300, "xyz" * 100 + "q" + "xyz" * 100, passage[3], passage[3]]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passage)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], "".join(rng.choice("abcdefgh") for _ in range(100))]))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed,length,gram,chunk,heavy", [(1, 50, 20, 1 << 20, 1 << 23), (2, 50, 20, 500, 1 << 23), (3, 40, 30, 1 << 20, 300), (4, 200, 80, 1 << 20, 1 << 23)])
def test_against_brute_force(spark, tmp_path, seed, length, gram, chunk, heavy):
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts(seed))] + [(None, "lone " * 3, "", 0), (5, texts(seed)[5], "", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "d"))
    got = S.digest(S.remove_repeats(spark.read.parquet(str(tmp_path / "d")), length=length, gram=gram, chunk=chunk, heavy=heavy)).collect()
    want = slow([r[1] for r in rows], length)
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=str)


def test_long_periodic_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1000)
    body = "abcdefghij" * 3000
    rows = [(1, body, "", 0), (2, "x" * 5000 + body[:250] + "y", "", 0), (3, "q" * 199, "", 0), (4, "unlike " + body[:150], "", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d"))
    for heavy in (1 << 23, 2000):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(spark.read.parquet(str(tmp_path / "d")), heavy=heavy).collect()}
        assert got == {1: (30000, 30000, 1), 2: (5251, 5250, 1), 3: (199, 0, 0), 4: (157, 0, 0)}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path):
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(20)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("ghijkl") for _ in range(rng.randint(0, 200))) for _ in range(5)) for _ in range(80)]
    spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS).repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    try:
        found = S.digest(S.remove_repeats(docs))
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == dict(enumerate(slow(texts, 200)))
