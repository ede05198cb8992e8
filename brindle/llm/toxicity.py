"""Toxicity scores over text restored by a noisy-channel decoder.

Words written with look-alike signs (``1d10t``), spaced letters (``i d i o t``) or repeated letters (``idiooot``) become
lattices of the letters that each sign may stand for; a Viterbi search finds the path that a character language model of
the training words and the channel's costs like best; the lattice of a spaced run also has word breaks.  The restored words, together with the plain ones, are looked up in
a lexicon of words and word beginnings that the labels tie to toxicity; a document's score is a noisy-or of its features.

The model is fitted on all labelled rows outside the held-out bucket.  What is broadcast are the words that pass the evidence and the
letter model's runs of four letters at most, whose number the alphabets bound, not the rows.  Of texts that share a sketch the one of the smallest hash counts, so reruns agree.  Null and empty texts have no
features and get the share of label 1 among such.  A null id is not held out.  Repeated documents get their own rows; null labels
are ignored.  Without labels the score is 0.5.  Equally good readings of a lattice fall to the first in the alphabet.  An empty
table gives an empty result.  Columns beside id and text are not read.  Very long texts take time in proportion to their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import crc_bucket, materialise, sized_join, small_batches

#: Different features and n-grams that a task counts before it sends them on.
HELD_KEYS = 300_000
PREDICT_FROM = 0.7
#: Nats by which a feature's toxic share must speak against the base rate.
EVIDENCE = 16.0
PREFIXES = (4, 5, 6)

# The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
LETTER = r"[^\W\d_]"
SIGN = "[" + re.escape("".join(LOOKALIKES)) + "]"
WORD = re.compile(rf"{LETTER}+")
_ONE = rf"(?:{LETTER}|{SIGN})"
#: Three or more single letters or signs with blanks or line ends of any width, or one and the same mark, between them.
SPACED = re.compile(rf"(?<![\w@$!|+*]){_ONE}(?:(?:\s++{_ONE}){{2,}}|([.\-_*]){_ONE}(?:\1{_ONE})+)(?![\w@$|+])")
#: Two single letters or signs in a row, without which no run is spaced by blanks.
ALONE = re.compile(rf"\s(?=\S\s){_ONE}\s++{_ONE}(?![\w@$|+])")
#: Three letters or signs with one mark between them, without which a token is no spaced run.
DOTTED = re.compile(rf"{_ONE}([.\-_*]){_ONE}\1{_ONE}")
#: A mark inside a word.
BROKEN = re.compile(rf"{LETTER}[.\-_*~]{LETTER}")
PIECES = re.compile(rf"(?:{LETTER}|[.\-_*~])+")
#: Signs that also follow a word as punctuation.
OUTER = "*#%!("
#: Where a sign stands before a letter, or a sign that is no punctuation behind one; the whole run around it is masked.
MASK = re.compile(rf"{SIGN}{LETTER}|{LETTER}[{re.escape(''.join(c for c in LOOKALIKES if c not in OUTER))}]")
#: One punctuation sign behind a word, which may stand for its last letter.
ENDED = re.compile(rf"{LETTER}[{re.escape(OUTER)}](?!{SIGN}|{LETTER})")
RUN = re.compile(rf"(?:{LETTER}|{SIGN})+")
THREE = re.compile(rf"({LETTER})\1\1")
LONGEST = 64
#: Characters that are no letter, sign or mark.
CUTS = ",;:?\"'"
#: Tokens whose features a model keeps at most.
HELD_TOKENS = 200_000
#: Nats that a break between the words of a spaced run costs: 1, less the 3.6 that the letter model's missing contexts put on
#: the beginning of any word.
BREAK = -2.6


def _runs(lower: str, trigger: re.Pattern, wanted: re.Pattern) -> Iterator[str]:
    """The runs of ``wanted`` characters in which ``trigger`` occurs, each once; linear in the text."""
    done = 0
    while m := trigger.search(lower, done):
        start = m.start()
        while start > done and wanted.match(lower[start - 1]):
            start -= 1
        run = wanted.match(lower, start)
        yield run[0]
        done = max(run.end(), m.start() + 1)


def masked(lower: str) -> set[str]:
    """Words with signs in the place of letters: letters and signs in one run, its outer signs behind letters cut off.

    No word is longer than ``LONGEST`` signs; longer runs are taken in pieces.
    """
    out = set()
    for run in _runs(lower, MASK, RUN):
        run = run.rstrip(OUTER) or run
        out.update(run[i : i + LONGEST] for i in range(0, len(run), LONGEST))
    return out


def ended(lower: str) -> set[str]:
    """Words with one sign behind them that may be their last letter."""
    return {run[i : i + LONGEST] for run in _runs(lower, ENDED, RUN) for i in range(0, len(run), LONGEST)}


def spaced(lower: str) -> set[str]:
    """The letters and signs of spaced runs, of one word or several.

    Long runs are taken in pieces of 2 ``LONGEST`` that overlap by half, so that every word of ``LONGEST`` lies in one whole.
    """
    out = set()
    for m in SPACED.finditer(lower):
        run = m[0].replace(m[1], "") if m[1] else "".join(m[0].split())
        out.update(run[i : i + 2 * LONGEST] for i in range(0, max(len(run) - LONGEST, 1), LONGEST))
    return out


def joined(lower: str) -> set[str]:
    """Words that marks break apart, put together again."""
    return {"".join(WORD.findall(run)) for run in _runs(lower, BROKEN, PIECES)}


def stretched(lower: str) -> set[str]:
    """Words with a letter three times in a row."""
    return {run[i : i + LONGEST] for run in _runs(lower, THREE, WORD) for i in range(0, len(run), LONGEST)}


def tokens_of(lower: str) -> set[str]:
    """The different tokens of a lower-cased text.

    They end at blanks, at ``CUTS`` and at a full stop before a blank or line end, none of which lies within a word, a masked one, or one that marks break.
    """
    for cut in CUTS:
        lower = lower.replace(cut, " ")
    return set(lower.replace(". ", " ").replace(".\n", "\n").split())


def words_of(lower: str) -> set[str]:
    """The words of a lower-cased text; no word goes beyond a token, so each different token is looked at once."""
    tokens = tokens_of(lower)
    plain = set(filter(str.isalpha, tokens))
    return plain.union(WORD.findall(" ".join(tokens - plain)))


class LetterModel:
    """Character trigrams with a backoff weight, over words between ``^`` and ``$``."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.letters = max(sum(n for g, n in grams.items() if len(g) == 1), 1)

    def cost(self, context: str, letter: str) -> float:
        penalty = 0.0
        for k in (3, 2, 1):
            c = context[-k:]
            n = self.grams.get(c + letter, 0)
            if len(c) == k and n:
                return penalty - math.log(n / self.grams.get(c, n))
            penalty += 1.2
        return penalty - math.log((self.grams.get(letter, 0) + 0.1) / (self.letters + 10))

    def decode(self, signs: str) -> str:
        """The best reading of a lattice: each run of one sign as itself, once or twice, or as a look-alike letter."""
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", signs, re.S)]
        best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for sign, n in runs:
            letters = LOOKALIKES.get(sign, sign)
            step: dict[str, tuple[float, str]] = {}
            for context, (cost, text) in best.items():
                for letter in letters:
                    at, grown, c = context, text, cost + (0.0 if letter == sign else 0.3)
                    for times in range(1, min(n, 2) + 1):
                        c += self.cost(at, letter)
                        at, grown = (at + letter)[-3:], grown + letter
                        # Two alike may be meant; three or more are stretched for sure.
                        total = c + (0.0 if times == n else 6.0 if n == 2 else 0.5)
                        if at not in step or total < step[at][0]:
                            step[at] = (total, grown)
            best = step
        ends = [(c + self.cost(at, "$"), text) for at, (c, text) in best.items()]
        return min(ends)[1]

    def split(self, signs: str) -> list[str]:
        """The words of the best reading of a spaced run, whose lattice has an optional break before every sign."""
        stretch = {i for m in re.finditer(r"(.)\1\1+", signs, re.S) for i in range(m.start() + 1, m.end())}
        best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for i, sign in enumerate(signs):
            step: dict[str, tuple[float, str]] = {}
            if i in stretch:
                step = {at: (c + 0.25, text) for at, (c, text) in best.items()}
            if i:
                cost, text = min((c + self.cost(at, "$"), text) for at, (c, text) in best.items())
                best["^"] = (cost + BREAK, text + " ")
            for context, (cost, text) in best.items():
                for letter in LOOKALIKES.get(sign, sign):
                    total, at = cost + (0.0 if letter == sign else 0.3) + self.cost(context, letter), (context + letter)[-3:]
                    if at not in step or total < step[at][0]:
                        step[at] = (total, text + letter)
            best = step
        return min((c + self.cost(at, "$"), text) for at, (c, text) in best.items())[1].split(" ")


class Model:
    def __init__(self, letters: LetterModel, features: dict[str, float], floor: float):
        self.letters, self.features, self.floor = letters, features, floor
        #: How the features begin.
        self.heads = {f.rstrip("*")[: PREFIXES[0]] for f in features}
        self.known: dict[tuple[str, bool], list[str]] = {}
        #: Tokens without features, and the others' features with whether a token may be a spaced run; only a cache.
        self.plain: set[str] = set()
        self.marked: dict[str, tuple[set[str], bool]] = {}

    def restored(self, lower: str) -> set[str]:
        """Decoded readings of the masked, spaced and stretched words of a lower-cased text."""
        return self.read([(x, False) for x in masked(lower) | ended(lower) | stretched(lower)] + [(x, True) for x in spaced(lower)])

    def read(self, odd: Iterable[tuple[str, bool]]) -> set[str]:
        """The readings of words, or of spaced runs (True)."""
        out: set[str] = set()
        for key in odd:
            if key not in self.known:
                if len(self.known) > 50_000:
                    self.known.clear()  # only a cache
                self.known[key] = self.letters.split(key[0]) if key[1] else [self.letters.decode(key[0])]
            out.update(self.known[key])
        return out

    def found(self, words: Iterable[str]) -> set[str]:
        return features_of(words) & self.features.keys()

    def look(self, token: str) -> tuple[set[str], bool]:
        """The features of one token, and whether it may be a spaced run."""
        if token.isalpha() and token[: PREFIXES[0]] not in self.heads and not THREE.search(token):
            hits, dotted = set(), False
        else:
            odd = masked(token) | ended(token) | stretched(token)
            hits = self.found(joined(token).union(WORD.findall(token), self.read((x, False) for x in odd)))
            dotted = bool(DOTTED.search(token))
        if len(self.plain) + len(self.marked) >= HELD_TOKENS:
            self.plain.clear()
            self.marked.clear()
        if hits or dotted:
            self.marked[token] = hits, dotted
        else:
            self.plain.add(token)
        return hits, dotted

    def score(self, text: str) -> float:
        lower = text.lower()
        hits: set[str] = set()
        far = bool(ALONE.search(lower))
        # All but spaced runs lie within one token.
        for token in tokens_of(lower) - self.plain:
            own, dotted = self.marked.get(token) or self.look(token)
            hits |= own
            far |= dotted
        if far:
            hits |= self.found(self.read((x, True) for x in spaced(lower)))
        rest = 1.0 - self.floor
        for f in sorted(hits):
            rest *= 1.0 - self.features[f]
        return 1.0 - rest


def features_of(words: Iterable[str]) -> set[str]:
    """The words, and their beginnings (marked by a star)."""
    out = set(words)
    for k in PREFIXES:
        out |= {w[:k] + "*" for w in words if len(w) >= k}
    return out


def _with_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a text's three-word shingles: most near copies share it and so count once."""
    for batch in small_batches(batches, 500):
        sketches = []
        for text in batch.column("t").to_pylist():
            words = (text or "").lower().split()
            sketches.append(min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("t"), pa.array(sketches, pa.int64())], names=["label", "t", "sketch"])


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of runs of one to four letters, from words (w) and their counts (n)."""
    held: Counter = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["g", "n"])

    for batch in batches:
        for w, n in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist()):
            w = f"^{w}$"
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    held[w[i : i + k]] += n
        if len(held) > HELD_KEYS:
            yield counted()
            held.clear()
    yield counted()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", buckets: int = 3, held_out: int = 1, evidence: float = EVIDENCE) -> Model:
    """``docs``: doc_id, t."""
    own = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna().distinct()
    own = materialise(own.filter(crc_bucket(F.col("doc_id"), buckets) != held_out))
    rows = sized_join(docs, own, "doc_id").select("label", "t")
    rows = rows.mapInArrow(_with_sketches, "label int, t string, sketch long")
    rows = rows.groupBy("sketch", "label").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        totals = [0, 0]

        def counted() -> pa.RecordBatch:
            names = seen[0].keys() | seen[1].keys()
            keys = [*(f"f{x}" for x in names), "n"]
            toxic, clean = ([*(own[x] for x in names), n] for own, n in ((seen[1], totals[1]), (seen[0], totals[0])))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["k", "toxic", "clean"])

        for batch in small_batches(batches, 500):
            for text, label in zip(batch.column("t").to_pylist(), batch.column("label").to_pylist()):
                totals[label == 1] += 1
                seen[label == 1].update(features_of(words_of((text or "").lower())))
            if len(seen[0]) + len(seen[1]) > HELD_KEYS:
                yield counted()
                for held in seen:
                    held.clear()
                totals[:] = [0, 0]
        yield counted()

    counts = materialise(rows.mapInArrow(run, "k string, toxic long, clean long").groupBy("k").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # Features far more toxic than the base rate, beyond what the number of features lets chance bring, and all n-grams.
    sums = counts.filter("k = 'n'").first()
    n_toxic, n_clean = (sums["toxic"], sums["clean"]) if sums else (0, 0)
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    picked = counts.filter("k like 'f%' and toxic >= 3 and toxic >= 20 * clean").filter(surprise > evidence)
    # A word of n texts brings each of its n-grams n times, so each different word is taken apart once.
    words = counts.filter("k like 'f%' and k not like '%*'").selectExpr("substring(k, 2) AS w", "toxic + clean AS n")
    grams = words.mapInArrow(_grams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).selectExpr("concat('g', g) AS k", "n AS toxic", "0L AS clean")
    table = picked.unionByName(grams).toArrow()
    found = {k: (t, c) for k, t, c in zip(*(table.column(x).to_pylist() for x in ("k", "toxic", "clean")))}
    features = {k[1:]: (t + 0.5) / (t + c + 1.0) for k, (t, c) in found.items() if k[0] == "f"}
    floor = 0.5 if not n_toxic + n_clean else 0.25 * base
    return Model(LetterModel({k[1:]: t for k, (t, _) in found.items() if k[0] == "g"}), features, floor)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", buckets: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label_col, buckets, held_out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = [shared.value.score(t or "") for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    aside = F.coalesce(crc_bucket(F.col("doc_id"), buckets) == held_out, F.lit(False))
    return scored.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
