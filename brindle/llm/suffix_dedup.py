"""Removal of byte strings of ``length`` (200) that occur more than once, by difference-cover suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes; matches stay within one text,
overlaps count, and all strings are judged on the input.  A null text counts as empty; texts below ``length`` bytes keep
all their bytes.  Repeated rows are copies of each other like any other rows, null ids keep their own rows, other columns
are not read, and an empty table gives an empty result.  A very long text is held by one task, some dozen numbers a byte; its contexts go in
pieces.

How the strings come to the suffix sort:

1. *Content-defined cover.*  In every window of ``length`` bytes the ``gram``-byte string with the smallest hash is the
   window's anchor.  Equal windows have equal anchors, so a window whose anchor occurs once in the corpus is unique.
2. *Contexts.*  Neighbouring windows with one anchor form a context.  Contexts that are equal as a whole are repeated as
   a whole.  What is left are contexts whose anchor has several different contexts.
3. *Difference-cover suffix sort.*  One copy of each of these contexts goes, dealt out by anchor, to tasks that sort the
   suffixes of their contexts: sort the sampled triples, recurse on their names, merge the remaining suffixes, then compare
   adjacent prefixes.  Windows of different anchors need no comparison, so the sorted parts need no merging.
4. Anchors with more than ``heavy`` bytes of different contexts are not gathered: their windows are counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import byte_texts, fresh, materialise, small_batches, with_row

LENGTH = 200
GRAM = 80
#: Bytes of contexts that one suffix sort takes at once, and those of one anchor beyond which its windows are counted.
CHUNK, HEAVY = 1 << 20, 1 << 23
#: Windows of one context that go as one row.
PIECE = 1 << 15

_MIX = np.random.default_rng(20240229)
_BYTE = _MIX.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            powers = np.full(n, base, dtype=np.uint64)
            powers[0] = 1
            _POWERS[name] = np.cumprod(powers, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position."""
    n = len(text)
    up, down = _powers(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[text] * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, from running ones within blocks of ``width``."""
    rows = -(-len(x) // width)
    block = np.full(rows * width, fill, dtype=x.dtype)
    block[: len(x)] = x
    block = block.reshape(rows, width)
    ahead = best.accumulate(block, axis=1).ravel()
    back = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor hash, first window, windows, and whether the anchor is in it twice."""
    h = gram_hashes(np.frombuffer(text, dtype=np.uint8), gram)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum, 2**64 - 1)
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    stops = np.append(starts[1:], len(low))
    twice = np.zeros(len(starts), dtype=bool)
    # A position is an anchor if its hash is the lowest of some window, so the highest of those windows' lowest ones.
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)])
    anchors = np.flatnonzero(h == _sliding(padded, width, np.maximum, 0))
    if len(anchors) != len(starts):
        values = h[anchors]
        for k, (a, b) in enumerate(zip(starts, stops)):
            inside = slice(*np.searchsorted(anchors, [a, b + width - 1]))
            twice[k] = np.count_nonzero(values[inside] == low[a]) > 1
    return low[starts], starts, stops - starts, twice


# ---- the suffix sort -------------------------------------------------------------------------------------------------


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, their dense ranks from 1, and the largest rank."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    steps = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    rank[order] = steps
    return order, rank, int(steps[-1]) if len(steps) else 0


def _packed(*columns: np.ndarray) -> np.ndarray:
    """Numbers that sort like the rows of the columns (none negative); what would pass 62 bits is ranked first."""
    keys, bound = np.zeros(len(columns[0]), dtype=np.int64), 1
    for column in columns:
        size = int(column.max(initial=0)) + 1
        if bound * size >= 1 << 62:
            _, keys, bound = _ranks(keys)
            bound += 1
        if bound * size >= 1 << 62:
            _, column, size = _ranks(column)
            size += 1
        keys = keys * size + column
        bound *= size
    return keys


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive numbers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, np.zeros(3, dtype=np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    order, rank, names = _ranks(_packed(t[sampled], t[sampled + 1], t[sampled + 2]))
    if names < len(sampled):
        # Recurse on the names: first those of the positions 1 mod 3, then those of 2 mod 3.
        order = suffix_array(rank)
        rank = np.empty(len(sampled), dtype=np.int64)
        rank[order] = np.arange(1, len(sampled) + 1)
    at = np.zeros(n + 3, dtype=np.int64)
    at[sampled] = rank
    ordered = sampled[order]
    ordered = ordered[ordered < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_packed(t[zero], at[zero + 1]), kind="stable")]
    # Merge: a remaining suffix is compared with a sampled one by one character and a rank, or by two and a rank.
    below = np.zeros(len(zero), dtype=np.int64)
    for rest, width in ((1, 1), (2, 2)):
        some = ordered[ordered % 3 == rest]
        both = np.concatenate([some, zero])
        place = _packed(*(t[both + k] for k in range(width)), at[both + width])
        below += np.searchsorted(place[: len(some)], place[len(some) :])
    out = np.empty(n, dtype=np.int64)
    place = below + np.arange(len(zero))
    out[place] = zero
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = ordered
    return out


def repeated_windows(texts: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its first ``windows`` positions start a string of ``length`` that starts elsewhere too."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    bases = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    s = joined.astype(np.int64) + 2
    s[bases + lengths] = 1  # text may hold zero bytes; the end of a text is below them
    start = np.zeros(len(s), dtype=bool)
    for base, n in zip(bases, windows):
        start[base : base + n] = True
    order = suffix_array(s)
    order = order[start[order]]
    marked = np.zeros(len(s), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(joined, length)
    for k in range(0, len(order) - 1, 8192):
        a, b = order[k : k + 8192], order[k + 1 : k + 8193]
        a = a[: len(b)]
        same = (views[a] == views[b]).all(axis=1)
        marked[a[same]] = True
        marked[b[same]] = True
    return [marked[base : base + n] for base, n in zip(bases, windows)]


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


# ---- the Spark job -----------------------------------------------------------------------------------------------------


def _anchor_rows(docs: DataFrame, length: int, gram: int, full: bool) -> DataFrame:
    """h (anchor), c (hash of the context), twice; and where ``full``, row, start and n (windows) as well."""
    names = ["h", "c", "twice", *(["row", "start", "n"] if full else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in small_batches(batches, 300):
            found: list[list[np.ndarray]] = []
            for row, text in zip(batch.column("row").to_pylist(), byte_texts(batch, "t")):
                if len(text) < length:
                    continue
                h, start, n, twice = contexts(text, length, gram)
                ends = (start + n + length - 1).tolist()
                c = np.array([digest(text[a:b]) for a, b in zip(start.tolist(), ends)], dtype=np.uint64)
                found.append([h.view(np.int64), c.view(np.int64), twice, *([np.full(len(h), row), start, n] if full else [])])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=names)

    schema = "h long, c long, twice boolean" + (", row long, start long, n long" if full else "")
    return docs.mapInArrow(run, schema)


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts of every document: h, single, row, start, n, s."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            out: list[tuple] = []
            for row, text, wanted in zip(batch.column("row").to_pylist(), byte_texts(batch, "t"), batch.column("wanted").to_pylist()):
                for w in wanted:  # very long contexts (periodic texts) in pieces
                    for at in range(w["start"], w["start"] + w["n"], PIECE):
                        n = min(PIECE, w["start"] + w["n"] - at)
                        out.append((w["h"], w["single"], row, at, n, text[at : at + n + length - 1]))
            if out:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["h", "single", "row", "start", "n", "s"])

    return joined.mapInArrow(run, "h long, single boolean, row long, start long, n long, s binary")


def _sorted_parts(contexts_: DataFrame, length: int, chunk: int) -> DataFrame:
    """Repeated windows of the contexts that occur once: row, start, stop (bytes).  Sorted by anchor within partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def resolve() -> Iterator[pa.RecordBatch]:
            out = []
            for (_, single, row, start, n, _), marked in zip(held, repeated_windows([x[5] for x in held], [x[4] for x in held], length)):
                if single:
                    out += [(row, start + a, start + b - 1 + length) for a, b in runs_of(marked)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["row", "start", "stop"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("h", "single", "row", "start", "n", "s"))):
                if size >= chunk and x[0] != last:
                    yield from resolve()
                    held, size = [], 0
                held.append(x)
                size, last = size + len(x[5]), x[0]
        if held:
            yield from resolve()

    return contexts_.mapInArrow(run, "row long, start long, stop long")


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of maximal removed runs."""
    kept, at, removed, count, end = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            kept.append(text[at:a])
            count += 1
            removed += b - a
            end = at = b
        elif b > end:
            removed += b - end
            end = at = b
    kept.append(text[at:])
    return b"".join(kept), removed, count


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """row, start, stop: byte spans whose union is what is to be removed.  ``docs``: row (unique), t (text)."""
    seen = _anchor_rows(docs, length, gram, False).groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("twice").alias("twice"))
    anchors = seen.filter("times > 1 or twice").select("h", (F.col("twice") | (F.col("low") != F.col("high"))).alias("mixed"))
    repeats = materialise(_anchor_rows(docs, length, gram, True).join(anchors, "h"))

    stop = (F.col("start") + F.col("n") + length - 1).alias("stop")
    plain = repeats.filter("not mixed").select("row", "start", stop)
    mixed = repeats.filter("mixed").drop("mixed")
    one = F.min(F.struct("row", "start", "n")).alias("x")
    classes = mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), one)
    classes = materialise(classes.select("h", "c", (F.col("times") == 1).alias("single"), "x.*"))
    # Anchors all of whose contexts are repeated need no sort; sums come from partial sums, never from one task's window.
    anchors = materialise(classes.groupBy("h").agg(F.sum(F.col("n") + length).alias("bytes"), F.max("single").alias("open")).filter("open"))
    copies = mixed.join(classes.filter("not single").select("h", "c"), ["h", "c"], "left_semi").select("row", "start", stop)

    wanted = classes.join(anchors.select("h"), "h", "left_semi").select("row", F.struct("h", "single", "start", "n").alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    big = anchors.filter(F.col("bytes") > heavy).select("h")
    cut = _cut(docs.join(wanted, "row").select("row", "t", "wanted"), length)
    if big.isEmpty():
        return plain.unionByName(copies).unionByName(_sorted_parts(cut.repartition("h").sortWithinPartitions("h"), length, chunk))
    cut = materialise(cut)
    usual = _sorted_parts(cut.join(big, "h", "left_anti").repartition("h").sortWithinPartitions("h"), length, chunk)
    windows = cut.join(big, "h", "left_semi").select("h", "single", "row", F.posexplode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.md5(F.substring("s", i.cast("int"), F.lit(length))))).alias("i", "w"), "start")
    counted = windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    hot = windows.filter("single").join(counted, ["h", "w"]).select("row", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + length).alias("stop"))
    return plain.unionByName(copies).unionByName(usual).unionByName(hot)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept, the remaining bytes, of every row.

    Rows are told apart by their place in the files of ``docs``; other input is written first.
    """
    row = fresh(docs, "_row")
    rows = with_row(docs, row).select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    found = find_repeats(rows.select("row", "t"), length, gram, chunk, heavy)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(spans, "row", "left").select("doc_id", "t", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            texts = byte_texts(batch, "t")
            out = [(len(t), *_without(t, [(s["start"], s["stop"]) for s in spans or []])) for t, spans in zip(texts, batch.column("spans").to_pylist())]
            made = [pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.int64()), (2, pa.int64()), (3, pa.int64()), (1, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([rows.schema["doc_id"], *T.DataType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    return joined.mapInArrow(run, schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by grouping all windows, for DuckDB; bytes are pairs of hex digits.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT rid, h, unnest(range(n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
s AS (SELECT rid, i, sum((gap IS NULL OR gap > {LENGTH})::INT) OVER (PARTITION BY rid ORDER BY i) AS run
      FROM (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1))),
r AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM s GROUP BY rid, run),
g AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS after FROM r),
k AS (SELECT d.rid, sum(b - a) AS removed, count(*) AS spans,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN after IS NULL THEN substr(h, 2 * b + 1) ELSE '' END) AS kept
      FROM d JOIN g USING (rid) GROUP BY d.rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
