"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Words are runs of digits, ASCII letters (lower-cased) and all characters above 0x7F.  A window is ten consecutive words of
an item; an item of fewer words, but not none, is one window.  A document word inside any occurrence of a window is hit.
Each text streams through the automaton, which tracks the longest item passage ending at every word.

Items are taken to the driver in blocks of at most ``block_words`` words (and the item that passes them), one automaton each, so
that what is broadcast has a bound, some 120 MB; each further block is one more pass over the documents.  Null and empty texts have no words and no hits, null and
empty items no windows.  An item listed twice counts once per distinct id; a null item id is ignored in the lists of items
but its windows hit.  Repeated rows and null document ids keep their own result rows; lists of items are
in code-point order, so there are no ties.  An empty table of documents gives an empty result, an empty benchmark no hits.  Other
columns are not read by the report and kept by the removal.  A very long text is one row of a task, some 100 bytes a word.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import byte_texts, fresh, materialise, small_batches, with_row

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each window.

    States and words are numbers in flat arrays; what only few states have (a second arc, a second item) is in dictionaries.
    Some 120 bytes an item word.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], width: int = 10):
        self.width = width
        self.words: dict[bytes, int] = {}
        #: The first arc of each state: word and target.  ``more``: the other arcs of a state.
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str] = []
        numbers: dict[str, int] = {}
        ends: list[tuple[int, int, int]] = []
        for name, words in items:
            item = -1 if name is None else numbers.setdefault(name, len(numbers))
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, self.words.setdefault(w, len(self.words)))
                if k + 1 >= width:
                    ends.append((last, item, width))
            if 0 < len(words) < width:
                ends.append((last, item, len(words)))
        self.names = list(numbers)
        self.least = min((k for *_, k in ends), default=0)
        #: The window that ends where a state does: its length (0: none) and item.  ``others``: all windows of states with several.
        self.size, self.item = array("i", bytes(4 * len(self.link))), array("i", bytes(4 * len(self.link)))
        self.others: dict[int, set[tuple[int, int]]] = {}
        for state, item, k in ends:
            while self.length[self.link[state]] >= k:
                state = self.link[state]
            if not self.size[state]:
                self.size[state], self.item[state] = k, item
            elif (self.size[state], self.item[state]) != (k, item):
                self.others.setdefault(state, {(self.size[state], self.item[state])}).add((k, item))
        #: The nearest state with a window: the state itself or one that its failure links lead to; -1 for none.
        self.near = array("i", [-1]) * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[state] = state if self.size[state] else self.near[self.link[state]]

    def arc(self, state: int, w: int) -> int:
        """Where the word leads from a state, or -1."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(w, -1)

    def _set(self, state: int, w: int, target: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _state(self, length: int, link: int) -> int:
        for column, value in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length

        def split(p: int, q: int) -> int:
            copy = self._state(length[p] + 1, link[q])
            self.word[copy], self.to[copy] = self.word[q], self.to[q]
            if q in self.more:
                self.more[copy] = dict(self.more[q])
            link[q] = copy
            while p >= 0 and self.arc(p, w) == q:
                self._set(p, w, copy)
                p = link[p]
            return copy

        q = self.arc(last, w)
        if q >= 0:
            return q if length[q] == length[last] + 1 else split(last, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and self.arc(p, w) < 0:
            self._set(p, w, new)
            p = link[p]
        if p >= 0:
            q = self.arc(p, w)
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def windows(self, state: int) -> Iterator[tuple[int, int]]:
        """Length and item of the windows that end where the state does."""
        at = self.near[state]
        while at >= 0:
            yield from self.others.get(at) or ((self.size[at], self.item[at]),)
            at = self.near[self.link[at]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words (end exclusive), and the items with windows in ``words``."""
        first, to, more, link, length, near, least = self.word, self.to, self.more, self.link, self.length, self.near, self.least
        root, runs, items = self.more.get(0, {}), [], set()
        if not least:
            return runs, items
        v = n = 0
        for i, w in enumerate(map(self.words.get, words)):
            if w is None:  # no item has the word
                v = n = 0
                continue
            while True:
                if first[v] == w:
                    t = to[v]
                else:
                    t = root.get(w) if not v else more[v].get(w) if v in more else None
                if t is not None or not v:
                    break
                v = link[v]
                n = length[v]
            v, n = t or 0, n + 1 if t else 0
            if n >= least and near[v] >= 0:
                longest = 0
                for k, item in self.windows(v):
                    if k <= n:
                        longest = max(longest, k)
                        if item >= 0:
                            items.add(self.names[item])
                if longest:
                    start = i + 1 - longest
                    while runs and runs[-1][1] >= start:
                        start = min(start, runs.pop()[0])
                    runs.append((start, i + 1))
        return runs, items


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10, block_words: int = 1_000_000) -> Iterator[Automaton]:
    """One automaton for each block of items."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).distinct().toLocalIterator():
        words = WORD.findall(bytes(row["t"] or b"").lower())
        block.append((row["i"], words))
        held += len(words)
        if held >= block_words:
            yield Automaton(block, width)
            block, held = [], 0
    yield Automaton(block, width)


def _scan_block(rows: DataFrame, automaton: Automaton) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for batch in small_batches(batches):
            found = [(len(words := WORD.findall(t.lower())), *scan(words)) for t in byte_texts(batch, "t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([n for n, *_ in found], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in r] for _, r, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(s) for *_, s in found], pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "runs", "items"],
            )

    schema = rows.select("row", "doc_id").schema
    for name, kind in (("n_words", "long"), ("runs", "array<struct<start:bigint,stop:bigint>>"), ("items", "array<string>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return rows.mapInArrow(run, schema)


def _hits(rows: DataFrame, benchmark: DataFrame, item_col: str, width: int, block_words: int) -> DataFrame:
    """row, doc_id, n_words, runs and items of every row, by all blocks of items; ``rows``: row, doc_id, t."""
    blocks = automata(benchmark, item_col, "text", width, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan_block(rows, first)
    every = None
    for automaton in itertools.chain([first, second], blocks):
        part = materialise(_scan_block(rows, automaton))  # so one automaton is held at a time
        every = part if every is None else every.unionByName(part)
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join_runs(acc, r):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["stop"] >= r["start"]), grown).otherwise(F.concat(acc, F.array(r)))

    runs = F.aggregate("runs", F.array().cast("array<struct<start:bigint,stop:bigint>>"), join_runs)
    return merged.withColumn("runs", F.when(F.size("runs") == 0, F.col("runs")).otherwise(runs))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, runs (hit word ranges, end exclusive, disjoint and in order) and items (sorted) of every row."""
    row = fresh(docs, "_row")
    rows = with_row(docs, row).select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return _hits(rows, benchmark, item_col, width, block_words).drop("row")


def digest(found: DataFrame) -> DataFrame:
    """The counts of :func:`find_contamination`'s rows, and a hash of the items' list."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    items = F.sha2(F.array_join("items", ","), 256)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut(text: bytes, runs: list[tuple[int, int]], max_coverage: float) -> bytes | None:
    """``text`` without the runs of words (disjoint, in order); None if they are over ``max_coverage`` of its words."""
    spans = [m.span() for m in WORD.finditer(text.lower())]
    if sum(b - a for a, b in runs) > max_coverage * len(spans):
        return None
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*kept, text[at:]])


def clean(text: bytes, scan, max_run: int, max_coverage: float) -> bytes | None:
    """``text`` cut until no run of ``max_run`` words or more is hit; None if that takes it away."""
    while True:
        words = WORD.findall(text.lower())
        runs = [r for r in scan(words)[0] if r[1] - r[0] >= max_run]
        if not runs:
            return text
        text = cut(text, runs, max_coverage)
        if text is None:
            return None


def _with_texts(docs: DataFrame, text_col: str, change, *also: str) -> DataFrame:
    """``docs`` with ``change(text, *also)`` for texts, without the rows where it gives None; null texts stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            column = batch.schema.get_field_index(text_col)
            texts = batch.column(column).cast(pa.binary()).to_pylist()
            changed = [t if t is None else change(t, *more) for t, *more in zip(texts, *(batch.column(c).to_pylist() for c in also))]
            keep = pa.array([t is None or c is not None for t, c in zip(texts, changed)])
            fresh_texts = pa.array(changed, pa.binary()).cast(batch.column(column).type)
            yield batch.set_column(column, batch.schema.field(column), fresh_texts).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _cut_by_blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, width: int, max_run: int, max_coverage: float, block_words: int) -> DataFrame:
    """As :func:`clean` by one automaton of all items: each round merges the hits of all blocks, and only cut texts go on to the next."""
    row, runs = fresh(docs, "_row"), fresh(docs, "_runs")
    done, rest = None, docs
    while True:
        rest = with_row(rest, row)
        found = _hits(rest.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("t")), benchmark, "item_id", width, block_words)
        long = F.filter("runs", lambda r: r["stop"] - r["start"] >= max_run)
        found = materialise(found.select(F.col("row").alias(row), long.alias(runs)).filter(F.size(runs) > 0))
        settled = rest.join(found, row, "left_anti").select(*docs.columns)
        done = settled if done is None else done.unionByName(settled)
        if found.isEmpty():
            return done
        hit = _with_texts(rest.join(found, row), text_col, lambda t, spans: cut(t, [(s["start"], s["stop"]) for s in spans], max_coverage), runs)
        rest = materialise(hit.select(*docs.columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", width: int = 10, max_run: int = 1, max_coverage: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` with the hit passages cut out of the texts, without the documents that mostly consist of them.

    Texts without a hit stay byte for byte; null texts stay null.  A text is cut until nothing in it is hit; before each cut, the hits
    of all items count for its coverage, so ``block_words`` changes no result.
    """
    blocks = automata(benchmark, width=width, block_words=block_words)
    automaton = next(blocks)
    if next(blocks, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        out = _with_texts(docs, text_col, lambda t: clean(t, shared.value.scan, max_run, max_coverage))
    else:
        out = _cut_by_blocks(docs, benchmark, text_col, width, max_run, max_coverage, block_words)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out


#: The same counts for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT rid, i, occ.k, item_id FROM occ JOIN win ON occ.k = win.k AND occ.s = win.s),
n_hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN its USING (rid)
"""
