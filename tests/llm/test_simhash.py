import random

import numpy as np
import pytest
import xxhash

from brindle.llm import simhash as S

DOCS = "doc_id long, text string, lang string, fp string"


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=4):
    """rows: (doc_id, fp)."""
    fps = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    low = {}
    for i, fp in rows:
        if i is not None:
            low[find(fp)] = min(low.get(find(fp), i), i)
    return sorted(((i, f"{fp:016x}", low.get(find(fp))) for i, fp in rows), key=str)


def test_fingerprints():
    for text in ["", None, " \t", "One", "a b c", "A b\tC d", "É a b c d é " * 30, "x " * 70000]:
        assert S.fingerprint((text or "").encode()) == slow_fingerprint(text)


def texts(n=300):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 400]))] for _ in range(20)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("parts,block_rows", [(4, 20_000), (4, 10), (8, 20_000)])
def test_components(spark, parts, block_rows):
    rows = [(i, t, "en", "clash") for i, t in enumerate(texts())] + [(900, None, "en", ""), (901, "", None, ""), (None, "lone row", "", ""), (3, texts()[3], "", "")]
    if parts == 8:
        rows = rows[100:]
    got = S.simhash_components(spark.createDataFrame(rows, DOCS), parts=parts, block_rows=block_rows).collect()
    want = slow_components([(r[0], slow_fingerprint(r[1])) for r in rows])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_dense_and_chained_fingerprints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    chain, x = [], rng.getrandbits(64)
    for k in range(0, 60, 3):
        x ^= 7 << k
        chain.append(x)
    fps |= set(chain) | {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1}
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    found = {r.fp: r.root for r in S.fingerprint_classes(df, block_rows=100).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(found.get(S._signed(f), S._signed(f)), set()).add(f)
    want = {}
    ids = sorted(fps)
    for (_, fp, low) in slow_components(list(enumerate(ids))):
        want.setdefault(low, set()).add(int(fp, 16))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_are_a_forest():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 64, 60).astype(np.uint64))
    assert len(S.forest(fps, 6)) == len(fps) - 1


def test_thresholds_cover_the_pigeonhole():
    chosen = S.allocate_thresholds([[0, 5, 100, 1000], [0, 1, 2, 3], [0, 5, 100, 1000], [0, 5, 100, 1000]], 4)
    assert sum(t + 1 for t in chosen) == 5 and chosen[1] == 2


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("t", [0, 1, 2])
def test_loads_count_what_neighbours_send(spark, t):
    rng = random.Random(1)
    values = [rng.choice([5, 5, 5, rng.randrange(256)]) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    probes = rows.select(S.F.explode(S._probes(S.F.col("v"), S.flips(8, t), 0)).alias("key")).groupBy("key").count().collect()
    loads = S.probe_loads(np.bincount(values, minlength=256), 8, t)
    assert {r["key"]: r["count"] for r in probes} == {v: n for v, n in enumerate(loads) if n}
    assert t == 0 or loads[7] > 100 > values.count(7)
