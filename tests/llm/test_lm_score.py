import math
import re
import zlib
from collections import Counter

import pytest

from brindle.llm import lm_score as L

DOCS = "doc_id long, text string, word string, score double"


def rows():
    out = []
    for i in range(120):
        words = ["The", "cat", "sat", f"on{i % 7}", "the", "mat", "é" * (i % 3 + 1), f"rare{i}x"] * (i % 4 + 1)
        out.append((i, " ".join(words), "clash", 0.0))
    return out + [(500, None, "", 0.0), (501, "", "", 0.0), (502, "\t \n", "", 0.0), (None, "the cat unseen-word", "", 0.0), (7, out[7][1], "", 0.0), (503, "word" * 20000, "", 0.0), (504, "zq " * 500, "", 0.0)]


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def sizes(share):
    """Chunks and buckets from tiny to larger than the corpus."""
    return {"chunk_tokens": share, "bucket_grams": share}


@pytest.mark.parametrize("share", [50, 700, 1 << 20])
def test_base_scores_against_brute_force(spark, share):
    counts = Counter(w for i, t, *_ in rows() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = L.score_texts(spark.createDataFrame(rows(), DOCS), **sizes(share)).collect()
    assert len(got) == len(rows())
    texts = {i: t for i, t, *_ in rows()}
    for r in got:
        ws = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0


def automaton(texts):
    """The automaton of all texts in one process, and the number of each word."""
    seqs = [tokens(t) for t in texts]
    words = sorted({w for s in seqs for w in s})
    ids = {w: k for k, w in enumerate(words, start=1)}
    grams = Counter(tuple(ids[w] for w in s[i : i + k]) for s in seqs for k in (1, 2, 3) for i in range(len(s) - k + 1))
    floor = sum(map(len, seqs)) + 0.5 * (len(words) + 1)
    roots = {0: math.log10(0.5 / floor)} | {k: math.log10((grams[(k,)] + 0.5) / floor) for k in ids.values()}
    longer = {g: n for g, n in grams.items() if len(g) > 1 and n >= L.LEAST}
    return L.BackoffAutomaton(roots, longer, grams), ids


def test_states_sum_to_one_and_traversal_follows_failures():
    a, ids = automaton([t for _, t, *_ in rows()])
    assert len(a.arcs) > 8
    for state in range(len(a.arcs)):
        assert sum(10 ** a.weight(state, s) for s in [0, *ids.values()]) == pytest.approx(1.0)
    symbols = [ids.get(w, 0) for w in tokens("the cat sat on3 the rare3x the cat é zzz")]
    state, total = 0, 0.0
    for s in symbols:
        total += a.weight(state, s)
        while s not in a.arcs[state]:
            state = a.fail[state]
        state = a.arcs[state][s][0]
    assert a.score(symbols) == pytest.approx(total)


def test_held_out_texts_score_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.score_texts(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty_table(spark):
    assert L.score_texts(spark.createDataFrame([], DOCS)).count() == 0


def slow_score(words, grams, tokens, types):
    """log10 probability by interpolated absolute discounting with all pairs and triples of two occurrences and more."""

    def p(context, w):
        if not context:
            return (grams[(w,)] + 0.5) / (tokens + 0.5 * (types + 1))
        below, total = p(context[1:], w), grams[context]
        kept = {g[-1]: n - 0.5 for g, n in follow.get(context, ())}
        return kept.get(w, 0) / total + (total - sum(kept.values())) / total * below if kept else below

    follow = {}
    for g, n in grams.items():
        if len(g) > 1 and n >= 2:
            follow.setdefault(g[:-1], []).append((g, n))
    return sum(math.log10(p(tuple(words[max(0, i - 2) : i]), w)) for i, w in enumerate(words))


@pytest.mark.parametrize("share", [1000, 1 << 20])
def test_repeated_grams_count_whatever_the_size_of_the_corpus(spark, share):
    # 900,000 tokens in training: 5e-6 of them would be four or five occurrences.
    some = rows() + [(600 + i, "zq " * 300_000, "", 0.0) for i in range(6)] + [(i, f"one two pair of old oak{i}", "", 0.0) for i in (700, 701, 702)]
    seqs = [tokens(t) for i, t, *_ in some if not held(i)]
    grams = Counter(tuple(s[i : i + k]) for s in seqs for k in (1, 2, 3) for i in range(len(s) - k + 1))
    assert grams[("one", "two", "pair")] == 2 and 4 < 5e-6 * sum(map(len, seqs))
    types = sum(len(g) == 1 for g in grams)
    got = {r.doc_id: r for r in L.score_texts(spark.createDataFrame(some, DOCS), **sizes(share)).filter("doc_id >= 8").collect()}
    for i, t, *_ in some:
        if i is not None and i >= 8 and not 600 <= i < 700:
            assert got[i].score == pytest.approx(slow_score(tokens(t), grams, sum(map(len, seqs)), types)), i


def test_table_scores_like_the_automaton_in_one_process(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    a, ids = automaton([t for i, t in texts.items() if not held(i)])
    for r in L.score_texts(docs, **sizes(1500)).collect():
        assert r.score == pytest.approx(a.score([ids.get(w, 0) for w in tokens(texts[r.doc_id])]))


def test_texts_that_occur_twice_stand_out(spark):
    # Documents of words of their own, some of them twice: only a model of the whole corpus tells these apart.
    texts = [" ".join(f"w{(i * 7919 + k * k * 31) % 4000}" for k in range(60)) for i in range(200)]
    ids = [i for i in range(1000) if not held(i)]
    some = list(zip(ids, texts + texts[:20]))
    per = {r.doc_id: r.score / r.n_tokens for r in L.score_texts(spark.createDataFrame(some, "doc_id long, text string"), **sizes(3000)).collect()}
    twice = [per[i] for k, i in enumerate(ids[:220]) if k < 20 or k >= 200]
    once = [per[i] for i in ids[20:200]]
    assert min(twice) > max(once)
