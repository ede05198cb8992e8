"""Properties of the local steps on random input."""

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from brindle.llm import decontaminate as D
from brindle.llm import simhash as H
from brindle.llm import suffix_dedup as S
from brindle.llm.toxicity import LetterModel


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_suffix_arrays_sort_suffixes(s):
    assert S.suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab\0", min_size=12, max_size=60), min_size=1, max_size=4))
def test_repeated_windows(texts):
    bodies = [t.encode() for t in texts]
    windows = [len(b) - 11 for b in bodies]
    every = [b[i : i + 12] for b, n in zip(bodies, windows) for i in range(n)]
    got = S.repeated_windows(bodies, windows, 12)
    for b, n, marked in zip(bodies, windows, got):
        assert marked.tolist() == [every.count(b[i : i + 12]) > 1 for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=40, max_size=200).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_contexts_cover_every_window_once_and_equal_windows_share_anchors(text):
    h, start, n, twice = S.contexts(text, 40, 12)
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and start[-1] + n[-1] == len(text) - 39
    anchor = {}
    for a, s, k in zip(h.tolist(), start.tolist(), n.tolist()):
        for i in range(s, s + k):
            assert anchor.setdefault(text[i : i + 40], a) == a


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30))
def test_automaton_finds_all_windows(items, words):
    named = [(str(k), v) for k, v in enumerate(items)]
    runs, found = D.Automaton(named, 4).scan(words)
    hit, want = set(), set()
    for name, v in named:
        k = min(4, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                want.add(name)
    assert {p for a, b in runs for p in range(a, b)} == hit and found == want
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 255), min_size=1, max_size=40), st.integers(0, 3))
def test_forests_connect_what_links_connect(values, distance):
    fps = np.array(sorted(values), dtype=np.uint64)

    def classes(edges):
        root = {int(f): int(f) for f in fps}
        for a, b in edges:
            x, y = root[a], root[b]
            root = {k: x if r == y else r for k, r in root.items()}
        groups = {}
        for k, r in root.items():
            groups.setdefault(r, set()).add(k)
        return sorted(map(sorted, groups.values()))

    links = [(int(a), int(b)) for a in fps for b in fps if a < b and (int(a) ^ int(b)).bit_count() <= distance]
    edges = H.forest(fps, distance)
    assert classes(edges) == classes(links) and len(edges) == len(fps) - len(classes(links))


@settings(max_examples=50, deadline=None)
@given(st.text("ab1*@", min_size=1, max_size=8))
def test_decoded_words_have_letters_only(signs):
    assert set(LetterModel({"a": 3, "b": 2, "^a": 1}).decode(signs)) <= set("abiletoumc")
