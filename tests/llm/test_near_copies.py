import random

import numpy as np
import pytest

from brindle.llm import near_copies as N
from brindle.llm.common import Hashes

DOCS = "doc_id long, text string, lang string, fp string"


def grams(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_classes(texts, similarity=0.8):
    """For each text the smallest place in its class, by comparing all pairs."""
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def texts(n=150, seed=5, length=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, length]))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def written(spark, tmp_path, rows, schema=DOCS, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def test_against_all_pairs(spark, tmp_path):
    some = texts(500)
    docs = written(spark, tmp_path, [(i, t, "", "") for i, t in enumerate(some)])
    kept = {r.doc_id for r in N.one_of_each(docs).collect()}
    want = set(slow_classes(some))
    # No text without a near copy goes; of the copies nearly all go (partitions are probed by value, not exhaustively).
    assert kept >= want and len(some) - len(kept) >= 0.95 * (len(some) - len(want))


def test_hot_groups_in_blocks(spark, tmp_path, monkeypatch):
    # Several hundred near copies of one text: buckets are dealt into blocks, and large ones grow a tree.
    rng = random.Random(2)
    base = [f"b{k}" for k in range(200)]
    near = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        near.append(" ".join(words))
    some = near + texts(40)
    monkeypatch.setattr(N, "BLOCK_ROWS", 60)
    kept = {r.doc_id for r in N.one_of_each(written(spark, tmp_path, [(i, t, "", "") for i, t in enumerate(some)])).collect()}
    assert kept == set(slow_classes(some))


@pytest.mark.parametrize("size", [2, 30, 200])
def test_spanning_edges_join_what_links_join(size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 2**63, 5)[rng.integers(0, 5, size)] ^ (np.int64(1) << rng.integers(0, 60, size))
    y = np.zeros(size, dtype=np.uint64)
    edges = N.spanning_edges(x.view(np.uint64), y, 2)
    label = np.arange(size)
    for i in range(size):
        for j in range(i):
            if bin(int(x[i] ^ x[j])).count("1") <= 2:
                label[label == label[i]] = label[j]
    assert len(edges) == size - len(set(label.tolist()))
    assert all(label[i] == label[j] for i, j in edges)


def test_fingerprints_of_odd_texts():
    hashes = Hashes()
    assert len(N.shingles(b"", hashes)) == 0 and set(N.wide_fingerprint(N.shingles(b" \t", hashes))) == {0}
    assert len(N.shingles(b"A b", hashes)) == 1 and N.shingles(b"A b", hashes)[0] == N.shingles(b"a  B", hashes)[0]
    assert len(N.shingles(b"x " * 70_000, hashes)) == 1
    assert len(N.wide_fingerprint(N.shingles(b"a b c d e f g", hashes))) == 8 * N.WORDS


def test_rows_of_one_class(spark, tmp_path):
    rows = [(5, "a b c d e f", "x", "q"), (5, "a b c d e f", "x", "q"), (2, "A b c d e f", "y", "q"), (7, "other words are here", None, "q"), (None, "other words are here", None, "q"), (None, None, None, None), (9, "", "z", "")]
    docs = written(spark, tmp_path, rows)
    odd = docs.withColumnsRenamed({"lang": "_place", "fp": "_metadata"})
    want = [(2, "A b c d e f", "y", "q"), (7, "other words are here", None, "q"), (9, "", "z", "")]
    for made in (docs, odd, spark.createDataFrame(rows, DOCS)):
        kept = N.one_of_each(made)
        assert kept.columns == made.columns
        assert sorted(map(tuple, kept.collect())) == want


def test_empty_table(spark):
    assert N.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_a_pair_outside_the_spanning_forest_is_verified_too(spark, tmp_path, monkeypatch):
    """Of three near copies the forest has two pairs; where those fall short and the third does not, it is a link all the same."""
    words = [f"w{k}" for k in range(400)]
    docs = written(spark, tmp_path, [(i, " ".join([*words[: 100 * i], "x", *words[100 * i :]]), "", "") for i in range(3)])
    plain, calls = N.verified, []

    def forest_fails(edges, *rest):
        calls.append(edges.count())
        return plain(edges, *rest).filter("false") if len(calls) == 1 else plain(edges, *rest)

    monkeypatch.setattr(N, "verified", forest_fails)
    assert N.one_of_each(docs).count() == 2
    assert calls == [2, 1]


def test_pairs_between_classes_do_not_grow_with_the_square_of_a_group(spark, tmp_path, monkeypatch):
    """Texts of one base, six words changed in each: all lie in the reach of each other, none is similar, and hardly any pair leaves its bucket."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(300)]
    some = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(300), 6):
            words[k] = f"x{i}.{k}"
        some.append(" ".join(words))
    some += texts(60, seed=9)
    plain, calls = N.verified, []
    monkeypatch.setattr(N, "verified", lambda edges, *rest: calls.append(edges.count()) or plain(edges, *rest))
    kept = {r.doc_id for r in N.one_of_each(written(spark, tmp_path, [(i, t, "", "") for i, t in enumerate(some)])).collect()}
    assert kept == set(slow_classes(some)) and calls[1] < 500


def test_sketches_rule_out_no_similar_pair():
    rng, hashes = np.random.default_rng(3), Hashes()
    some = [N.shingles(t.encode(), hashes) for t in texts(120, seed=6)] + [N.shingles(b"", hashes)] * 2
    bits = np.zeros((len(some), N.SKETCH), dtype=np.uint8)
    for k, found in enumerate(some):
        bits[k, (found % np.uint64(N.SKETCH)).astype(np.int64)] = 1
    sketch, size = np.packbits(bits, axis=1).view(np.uint64), np.array([len(x) for x in some])
    i, j = np.triu_indices(len(some), 1)
    both = np.array([len(np.intersect1d(some[a], some[b])) for a, b in zip(i, j)])
    similar = both >= 0.8 * (size[i] + size[j] - both)
    may = N.may_be_similar(size, sketch, i, j, 0.8)
    assert similar.sum() > 20 and may[similar].all() and not may.all()
