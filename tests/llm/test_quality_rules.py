import re

from brindle.llm import quality_rules as Q

DOCS = "doc_id long, text string, q string, n_words int"


def slow(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_symbols = sum(c in "#*$%&|<>" for c in t)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(hit), failed


CASES = [
    None, "", " \t\x0b\x0c\r\n", "one", "a b c d e", "a b c d e f", "a b c d e a b c d e", "x " * 40, "é𝄞 # | <b> " * 4,
    "the quick brown fox jumps over the lazy dog and then of the end of it in a day\n" * 3, "a\n\nb\na\n \nb", "the fox of a dog " + " ".join(f"w{i}" for i in range(30000)),
    " ".join(f"W%{i}" for i in range(50)), "THE " + " ".join(f"SHOUT{chr(65 + i % 26)}X{i}!!" for i in range(60)), "word join of the " + " ".join("abcdefghijklmnop"),
]


def test_counts_against_brute_force(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(CASES)] + [(None, CASES[9], "", 0), (4, CASES[4], "", 0)]
    got = Q.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = slow(CASES[9 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_verdicts(spark):
    kept = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(CASES)], DOCS)).collect()}
    assert kept[14] and not kept[12] and not kept[13] and not kept[11]
    clean = Q.keep_good(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(CASES)], DOCS))
    assert clean.columns == ["doc_id", "text", "q", "n_words"] and {r.doc_id for r in clean.collect()} == {i for i, k in kept.items() if k}


def test_no_user_functions_and_empty_table(spark):
    out = Q.quality_rules(spark.createDataFrame([], DOCS))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
