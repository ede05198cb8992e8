"""Secret scans with DataFrame functions only: fixed patterns, plus tokens that look random to two Markov models.

Two character bigram models, of random strings and of ordinary identifiers, words and numbers, are fitted on labelled samples;
a token's score is the mean log-likelihood ratio of its character pairs.  A token is a run of 20 or more characters of base64 or
of an identifier, the length from which the mean is reliable.  Tokens above the threshold that overlap no pattern match are
added as kind ``random``.

Positions are code points, the end exclusive.  A null text counts as empty; every row is judged on its own, so repeated
rows, null ids and extra columns need no care; spans of one start sort by kind; an empty table gives an empty result.  Work on a
very long text grows with its length and with the power 1.5 of its matches (sums and overlaps go by blocks of about the square
root of their number).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import let

# The patterns, in the order in which kinds are listed; (kind, pattern, group that must be long, its length).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
KINDS = (
    ("assign", ASSIGN + r"([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Patterns that any text with a match passes; they spare the others the closer look.
QUICK = {"assign": ASSIGN + r"[A-Za-z0-9+/_.=-]{6}", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: hex runs shorter than 24 are dropped, so only the long ones need be found (a run is matched whole).
FAST = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
#: Tokens are looked at from their start only, so a long one costs one pass; the models judge each.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

#: Spans sort by start, then by the kind's place in KINDS; ``body`` is the matched text.
SPANS = "array<struct<start:int,o:int,stop:int,kind:string,i:int,body:string>>"
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Mean log-likelihood ratio (nats a character pair) from which a token counts as random.
THRESHOLD = 0.7

# Parts of ordinary identifiers, joined in the usual ways to form the labelled samples.
PARTS = (
    "get set user name list item value index count total start end time date file path node tree left right "
    "parse read write open close order price store stock sales region product brand customer window stream "
    "batch model train test score label token text line word page table column row key map filter join group"
).split()


def labelled_samples(spark: SparkSession, random_rows: int = 2000) -> DataFrame:
    """(text, random): strings drawn by hashing numbers, and identifiers joined from ``PARTS``, long numbers, and rules of one
    character.

    The bound: ``random_rows`` times three random strings and one number, seven styles of every part, one rule a character.
    """
    n = spark.range(random_rows)
    seed = F.concat(F.lit("sample"), F.col("id").cast("string"))
    drawn = F.array(
        F.substring(F.sha2(seed, 256), 1, 40),
        F.regexp_replace(F.substring(F.base64(F.unhex(F.sha2(seed, 256))), 1, 40), "=", ""),
        F.substring(F.regexp_replace(F.upper(F.base64(F.unhex(F.sha2(seed, 512)))), "[+/=]", ""), 1, 24),
    )
    random = n.select(F.explode(drawn).alias("text"), F.lit(True).alias("random"))
    a = spark.createDataFrame([(i, p) for i, p in enumerate(PARTS)], "i int, p string")
    b = a.select(((F.col("i") * 7 + 3) % len(PARTS)).alias("i"), F.col("p").alias("q"))
    c = a.select(((F.col("i") * 11 + 5) % len(PARTS)).alias("i"), F.col("p").alias("r"))
    three = a.join(b, "i").join(c, "i")
    styles = F.array(
        F.concat_ws("_", "p", "q", "r"),
        F.concat("p", F.initcap("q"), F.initcap("r")),
        F.concat_ws("-", "p", "q", "r", (F.col("i") % 10).cast("string")),
        F.concat(F.upper("p"), F.lit("_"), F.upper("q"), F.lit("_"), F.col("i").cast("string")),
        F.concat_ws("/", "p", "q", "r"),
        F.concat("p", "q", "r", "p"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("i") % 28).cast("string"), 2, "0"), F.lit("_"), F.col("p"), F.lit("_v"), F.col("i").cast("string")),
    )
    numbers = n.select(F.translate(F.substring(F.sha2(seed, 256), 1, 24), "abcdef", "012345").alias("text"), F.lit(False).alias("random"))
    rules = spark.range(1).select(F.explode(F.transform(F.array(*map(F.lit, CLASSES)), lambda c: F.repeat(c, F.lit(24)))).alias("text"), F.lit(False).alias("random"))
    return random.unionByName(three.select(F.explode(styles).alias("text"), F.lit(False).alias("random"))).unionByName(numbers).unionByName(rules)


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of the character pairs, indexed first * 67 + second.

    Collected counts are bounded by twice the square of the number of character classes.
    """
    size = len(CLASSES)
    at = F.sequence(F.lit(1), F.length("text") - 1)
    pairs = samples.filter(F.length("text") > 1).select("random", F.explode(F.transform(at, lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    rows: dict[bool, list[float]] = {}
    for kind in (True, False):
        smooth = 0.5 if kind else 0.05
        rows[kind] = []
        for x in CLASSES:
            total = sum(counts.get((kind, x + y), 0) for y in CLASSES)
            rows[kind] += [math.log((counts.get((kind, x + y), 0) + smooth) / (total + smooth * size)) for y in CLASSES]
    return [a - b for a, b in zip(rows[True], rows[False])]


def _root(size: Column) -> Column:
    return F.ceil(F.sqrt(size)).cast("int") + 1


def _before(values: Column, fold: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The sum (or another fold) of the numbers before each, by those of blocks of about the square root of their number."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), fold)

    def by_blocks(width: Column) -> Column:
        def within(befores: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(values) - 1)
            return F.transform(at, lambda i: fold(F.get(befores, F.floor(i / width).cast("int")), total(F.slice(values, F.floor(i / width).cast("int") * width + 1, i % width))))

        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int"))
        sums = F.transform(blocks, lambda k: total(F.slice(values, k * width + 1, width)))
        return let(sums, lambda own: let(F.transform(blocks, lambda k: total(F.slice(own, F.lit(1), k))), within))

    return let(_root(F.size(values)), by_blocks)


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans of the matches of ``pattern`` whose group is long enough: the text is cut at the matches and lengths add up."""

    def place(found: Column) -> Column:
        def run(pieces: Column) -> Column:
            def spans(befores: Column) -> Column:
                def one(i: Column) -> Column:
                    start = F.get(befores, i) + F.length(F.get(pieces, i))
                    body = F.get(found, i)
                    return F.struct(start.alias("start"), F.lit(order).alias("o"), (start + F.length(body)).alias("stop"), F.lit(kind).alias("kind"), i.alias("i"), body.alias("body"))

                return F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)

            return let(let(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m)), lambda sizes: _before(sizes)), spans)

        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(let(F.split(text, pattern, -1), run))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    if group:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.filter(spans, lambda s: F.length(F.get(g, s["i"])) >= least))
    return F.filter(spans, lambda s: s["stop"] - s["start"] >= least)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    none = F.array().cast(SPANS)
    found = [F.when(text.rlike(QUICK[kind]), _spans(text, FAST.get(kind, pattern), group, least, kind, order)).otherwise(none) for order, (kind, pattern, group, least) in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


def _class(c: Column) -> Column:
    return F.call_function("instr", F.lit(CLASSES), c) - 1


def _score(token: Column, ratios: Column) -> Column:
    def total(codes: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(codes) - 1)
        size = len(CLASSES)
        return F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(codes, i - 1) * size + F.get(codes, i))) / (F.size(codes) - 1)

    return let(F.transform(F.split(token, ""), _class), total)


def _overlaps(base: Column, spans: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base`` (sorted): first by the reach of blocks of ``base``, then one by one."""

    def by_blocks(width: Column) -> Column:
        def block(k: Column) -> Column:
            own = F.slice(base, k * width + 1, width)
            return let(own, lambda x: F.struct(F.get(x, F.lit(0))["start"].alias("low"), F.array_max(F.transform(x, lambda b: b["stop"])).alias("high"), x.alias("own")))

        def free(blocks: Column) -> Column:
            meets = lambda s, a, b: (a < s["stop"]) & (s["start"] < b)
            return F.filter(spans, lambda s: ~F.exists(blocks, lambda k: meets(s, k["low"], k["high"]) & F.exists(k["own"], lambda b: meets(s, b["start"], b["stop"]))))

        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / width).cast("int")), block), free)

    return F.when(F.size(base) == 0, spans).otherwise(let(_root(F.size(base)), by_blocks))


def random_spans(text: Column, base: Column, ratios: Column, threshold: float = THRESHOLD) -> Column:
    """Spans of random-looking tokens that overlap none of ``base``."""
    none = F.array().cast(SPANS)
    free = let(_spans(text, CANDIDATE, 0, 20, "random", len(KINDS)), lambda tokens: _overlaps(base, tokens))
    return F.when(text.rlike(CANDIDATE), F.filter(free, lambda s: _score(s["body"], ratios) > threshold)).otherwise(none)


def find_secrets(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """One struct: ``base`` and ``all`` spans (start, kind order, stop, kind), each by start, then kind."""
    table = F.array(*[F.lit(round(x, 6)) for x in ratios])
    t = F.coalesce(text, F.lit(""))

    def add(base: Column) -> Column:
        return F.struct(base.alias("base"), F.sort_array(F.concat(base, random_spans(t, base, table, threshold))).alias("all"))

    return let(base_spans(t), add)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts of each kind, and the spans of every row."""
    ratios = fit(samples if samples is not None else labelled_samples(docs.sparkSession))
    found = docs.select(F.col(id_col).alias("doc_id"), find_secrets(F.col(text_col), ratios, threshold).alias("s"))
    n = [_count("s.base", kind).alias(f"n_{kind}") for kind, *_ in KINDS]
    extra = (F.size("s.all") - F.size("s.base")).cast("long").alias("n_random")
    return found.select("doc_id", *n, extra, F.sha2(_joined(F.col("s.base")), 256).alias("base_sha256"), _joined(F.col("s.all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[SECRET]", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret (overlapping spans as one) replaced by ``mask``; a text without one stays as it is."""
    ratios = fit(samples if samples is not None else labelled_samples(docs.sparkSession))
    text = F.col(text_col)

    def rebuild(spans: Column) -> Column:
        """The pieces between the spans, and a mask for each run of spans that overlap."""
        at = F.sequence(F.lit(0), F.size(spans) - 1)

        def masked(before: Column) -> Column:
            """``before``: how far the spans before each reach."""

            def piece(i: Column) -> Column:
                start, end = F.get(spans, i)["start"], F.get(before, i)
                return F.when((start >= end) | (i == 0), F.concat(text.substr(end + 1, start - end), F.lit(mask))).otherwise("")

            rest = F.greatest(F.get(before, F.size(before) - 1), F.get(spans, F.size(spans) - 1)["stop"])
            return F.concat(F.array_join(F.transform(at, piece), ""), text.substr(rest + 1, F.length(text)))

        reach = let(F.transform(spans, lambda s: s["stop"]), lambda stops: _before(stops, lambda a, b: F.greatest(a, b)))
        return F.when(F.size(spans) == 0, text).otherwise(let(reach, masked))

    out = docs.withColumn(text_col, let(find_secrets(text, ratios, threshold)["all"], rebuild))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(text.isNull(), F.col(chars_col)).otherwise(F.length(text).cast(docs.schema[chars_col].dataType)))
    return out
