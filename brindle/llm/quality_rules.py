"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are maximal runs of characters other than space and ``\\t``..``\\r``.  A null or empty text has no words and fails
the base rule.  Every row is judged on its own, so repeated rows, ties, null ids and extra columns need no care; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, let

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in that is was for it with as on be at by are this from or an "
    "der die das und in zu den von mit ist des im für auf nicht ein eine als auch "
    "le la les de des et en un une du que qui est pour dans par sur pas au avec "
    "el los las y que del se con por su para una al lo como más"
).split()
SYMBOLS = "#*$%&|<>"
MARKS = "!?~^=_{}[]\\"


@dataclass(frozen=True)
class Rule:
    """Texts of at least ``from_words`` words pass if ``low <= measure <= high``."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


#: The production thresholds.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbols_per_word", high=0.3),
    Rule("marks_per_word", high=0.5),
    Rule("upper_ratio", high=0.6, from_words=20),
    Rule("stop_ratio", low=0.005, from_words=100),
    Rule("dup_line_ratio", high=0.5),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda w: w != "")


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            at = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

        def measure(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(let(ordered, twice), measure))

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, 0).otherwise(let(let(hashes, windows), covered)).cast("long")


def measures(text: Column) -> Column:
    """One struct with the counts and ratios of a text."""
    t = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("long")
        joined = F.concat_ws("", words)
        bare = F.length(F.translate(t, SYMBOLS, ""))
        return F.struct(
            n.alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(t) - bare).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.translate(t, MARKS, ""))).cast("long").alias("n_marks"),
            F.length(F.regexp_replace(joined, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, SPACES[1:], " " * 5))) > 0)
    return F.struct(let(_words(t), of_words).alias("w"), let(lines, of_lines).alias("l"))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct: the counts, ``base_failed`` and ``kept``."""

    def judge(m: Column) -> Column:
        w, lines = m["w"], m["l"]
        n = w["n_words"]

        def ratio(a: Column, b: Column) -> Column:
            return F.when(b > 0, a / b).otherwise(0.0)

        values = {
            "mean_word_chars": ratio(w["word_chars"], n),
            "symbols_per_word": ratio(w["n_symbols"], n),
            "marks_per_word": ratio(w["n_marks"], n),
            "upper_ratio": ratio(w["n_upper"], w["word_chars"]),
            "stop_ratio": ratio(w["n_stop"], n),
            "dup_line_ratio": ratio(lines["n_dup_lines"], lines["n_lines"]),
            "n_words": n.cast("double"),
        }
        base_failed = (n < 10) | (100 * w["n_repeat_words"] > 20 * n)
        kept = ~base_failed
        for rule in rules:
            value, ok = values[rule.measure], F.lit(True)
            if rule.low > float("-inf"):
                ok = ok & (value >= rule.low)
            if rule.high < float("inf"):
                ok = ok & (value <= rule.high)
            kept = kept & (ok if not rule.from_words else (n < rule.from_words) | ok)
        counts = [w[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")]
        return F.struct(*counts, lines["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"), kept.alias("kept"))

    return let(measures(text), judge)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every row of ``docs``: doc_id and the fields of :func:`verdict`."""
    judged = docs.select(F.col(id_col).alias("doc_id"), verdict(F.col(text_col), rules).alias("q"))
    return judged.select("doc_id", "q.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.filter(verdict(F.col(text_col), rules)["kept"])


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


#: The same counts and thresholds for DuckDB.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(0, 5) r(k) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^!?~^=_{{}}\[\]\\]+', '', 'g'))::BIGINT AS n_marks,
         length(regexp_replace(array_to_string(w, ''), '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
         len(list_filter(w, lambda x: lower(x) IN ({_in(STOP_WORDS)})))::BIGINT AS n_stop,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 1.5 AND 25.0
  AND n_symbols / n_words::DOUBLE <= 0.3 AND n_marks / n_words::DOUBLE <= 0.5
  AND (n_words < 20 OR n_upper / word_chars::DOUBLE <= 0.6)
  AND (n_words < 100 OR n_stop / n_words::DOUBLE >= 0.005)
  AND (n_lines = 0 OR n_dup_lines / n_lines::DOUBLE <= 0.5) AS kept
FROM b
"""
