"""Packing: documents of like wording share training sequences of ``window`` tokens.

A document is its token ids and an end id.  Whole windows of long documents are sequences of their own; what is left of every document is
dealt out to the shards of a BM25 inverted index.  In a shard each seed, longest first, asks the index for the unused documents that
score best, by all its words' postings, and they fill the seed's window in that order; the one that passes the end is cut there and its rest
stays in the index.  So every window is full.  What a shard cannot fill a window with goes on to the next one, and at the end of a
task into sequences whose lengths are powers of two, which need no padding.

Shards: documents lie in the order of three weighted min-hashes of their tokens (rarer ones are likelier to be the least), so those
of like wording are near each other, and a shard is the next ``shard_tokens`` tokens of that order.  The order ends with the place of
the row, so a group of copies or a language with a third of all rows spreads over as many shards as it needs.  Document
frequencies and the mean length are of all documents; both have one number a token of the vocabulary at most.

Parts of words are looked up in a cache that a worker empties when it grows.

Null and empty texts are the end id alone.  Null ids are kept, and repeated rows are documents of their own.  Ties fall to the order above.
An empty table gives an empty result.  Other columns are not read.  A very long text is one row of a task.  Which sequence a document lies in
depends on how Spark deals out ranges; its tokens and their number do not.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm.common import byte_texts, from_files, materialise, mix, place_of, small_batches

#: BM25's constants (fixed values), and parts of words after which a cache is emptied.
K1, B, CACHE = 1.2, 0.75, 1_200_000

#: Ranges at most, so that the sample of their bounds stays below some 500,000 rows.
MOST_RANGES = 10_000

#: The form of the vocabulary with word ends (fixed values): how it cleans texts and parts words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    """Latin signs of a kind, and U+0307, which lower-casing brings in, among the others."""
    return "".join(re.escape(c) for c in map(chr, [*range(33, 127), *range(0xA1, 0x180)]) if unicodedata.category(c)[0] == kind)


#: The same for plain texts: ASCII, Latin-1 and Latin Extended-A, whose lower case stays among them.
PLAIN = re.compile("[\t-\r -~\u00a1-\u017f]*").fullmatch
PARTS = re.compile(f"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^\\t-\\r {_class('L')}{_class('N')}]+").findall

#: Its letters for bytes: printable ones stand for themselves, the others for the signs from U+0100 on, in order.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}

PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Parts(dict):
    """Part of a word, in lower case, to its token ids, packed."""

    def __init__(self, model, code: str):
        super().__init__()
        self.model, self.code = model, code

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(LETTERS)
        self[part] = ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids


class Encoder:
    """Texts to token ids, packed.

    In the vocabulary with word ends no part of a word depends on its neighbours.  Plain Latin texts are parted here, and each
    different part goes through the merges once; of other texts, the words that are not plain go through the whole tokenizer.  Other
    vocabularies get whole texts.
    """

    def __init__(self, path: str, dtype: np.dtype):
        self.tokenizer, self.code = Tokenizer.from_file(path), "H" if dtype.itemsize == 2 else "I"
        form = json.loads(Path(path).read_text())
        self.by_part = form["model"].get("end_of_word_suffix") == "</w>" and form["normalizer"] == NORMALIZER and form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PATTERN
        self.parts = Parts(self.tokenizer.model, self.code)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, PARTS(text.lower())))

    def __call__(self, text: bytes) -> bytes:
        t = text.decode()
        if not self.by_part:
            return self.whole(t)
        if PLAIN(t) and "<|" not in t:
            return self.plain(t)
        return b"".join(self.plain(w) if PLAIN(w) and "<|" not in w else self.whole(w) for w in map(bytes.decode, text.split()))


@functools.cache
def encoder(path: str, dtype: np.dtype) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, dtype)


def width_of(path: str) -> np.dtype:
    """Two bytes a token where the vocabulary allows it."""
    return np.dtype(np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32)


def tokenize(docs: DataFrame, path: str, window: int, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """file, row, doc_id, n and ids (packed little-endian) of every row; and how many documents hold each token beyond their whole
    windows (token, df), a few rows a task."""
    docs = from_files(docs)
    place, dtype = place_of(docs), width_of(path)
    rows = docs.select(place["file"].alias("file"), place["row"].alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    last = np.array([end], dtype).tobytes()
    names = ["file", "row", "doc_id", "n", "ids", "token", "df"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, df, kind = encoder(path, dtype), np.zeros(0, np.int64), None
        for batch in small_batches(batches):
            kind = batch.schema.field("doc_id").type
            ids = [encode(t) + last for t in byte_texts(batch, "text")]
            for x in ids:
                seen = np.unique(left_over(np.frombuffer(x, dtype), window))
                if len(seen) and seen[-1] >= len(df):
                    df = np.pad(df, (0, int(seen[-1]) + 1 - len(df)))
                df[seen] += 1
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array([len(x) // dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()), none, none], names=names)
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), kind, pa.int64(), pa.binary())), pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = materialise(rows.mapInArrow(run, f"file long, row long, doc_id {kind}, n long, ids binary, token long, df long"))
    return found.filter("ids is not null").select(*names[:5]), found.filter("token is not null").select("token", "df")


def left_over(ids: np.ndarray, window: int) -> np.ndarray:
    """What a document has beyond its whole windows."""
    return ids[len(ids) - len(ids) % window :]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Shard:
    """Inverted index of a shard's documents, and which of their tokens are unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        counts = [np.unique(x, return_counts=True) for x in ids]
        sizes = [len(t) for t, _ in counts]
        token, tf = (np.concatenate([c[j] for c in counts]) for j in (0, 1))
        doc = np.repeat(np.arange(len(ids)), sizes)
        length = np.repeat([len(x) for x in ids], sizes)
        weight = (idf[token] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))).astype(np.float32)
        by_token = np.argsort(token, kind="stable")
        used, first = np.unique(token[by_token], return_index=True)
        self.doc, self.weight = doc[by_token].astype(np.int32), weight[by_token]
        bounds = np.append(first, len(token))
        self.places = [np.searchsorted(used, t) for t, _ in counts]
        self.bounds = bounds
        self.left = np.array([len(x) for x in ids])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the different tokens of ``seed``."""
        at = self.places[seed]
        spans = [slice(a, b) for a, b in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist())]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.left))

    def windows(self, window: int) -> Iterator[list[tuple[int, int]]]:
        """(document, tokens taken) of each window; the last one may have room left."""
        left = self.left
        for seed in np.argsort(-left, kind="stable").tolist():
            while left[seed]:
                taken = [(seed, int(left[seed]))]
                room, left[seed] = window - taken[0][1], 0
                rest = np.flatnonzero(left)
                if room and len(rest):
                    score = self.scores(seed)[rest]
                    for d in rest[nearest(score, left[rest], room)].tolist():
                        n = min(room, int(left[d]))
                        taken.append((d, n))
                        left[d] -= n
                        room -= n
                        if not room:
                            break
                yield taken


def nearest(score: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Places in falling order of the score, at least as many as fill ``room``, or all."""
    most = 64
    while most < len(score):
        some = np.argpartition(-score, most)[:most]
        if size[some].sum() >= room:
            break
        most *= 4
    else:
        some = np.arange(len(score))
    return some[np.lexsort((some, -score[some]))]


def powers(n: int) -> list[int]:
    """``n`` as a sum of different powers of two, the largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def _pack(rows: Iterator[tuple], idf: np.ndarray, mean: float, window: int, shard_tokens: int) -> Iterator[tuple]:
    """(doc_id, start, ids, doc tokens, sequence, offset) of ``rows`` (doc_id, start, ids, doc tokens) in their order; sequences count from 0."""
    held, size, sequence, done = [], 0, 0, False
    rows = iter(rows)
    while not done:
        for row in rows:
            held.append(row)
            size += len(row[2])
            if size >= shard_tokens:
                break
        else:
            done = True
        if not held:
            return
        shard = Shard([r[2] for r in held], idf, mean)
        used, over = [0] * len(held), []
        for taken in shard.windows(window):
            pieces = []
            for d, n in taken:
                doc, start, ids, total = held[d]
                pieces.append((doc, start + used[d], ids[used[d] : used[d] + n], total))
                used[d] += n
            if sum(len(p[2]) for p in pieces) < window:
                over += pieces  # the last one of the shard
                continue
            offset = 0
            for doc, start, ids, total in pieces:
                yield doc, start, ids, total, sequence, offset
                offset += len(ids)
            sequence += 1
        held, size = over, sum(len(p[2]) for p in over)
    for length in powers(size):
        offset = 0
        while offset < length:
            doc, start, ids, total = held.pop(0)
            n = min(length - offset, len(ids))
            yield doc, start, ids[:n], total, sequence, offset
            offset += n
            if n < len(ids):
                held.insert(0, (doc, start + n, ids[n:], total))
        sequence += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (packed little-endian)."""
    dtype, context = width_of(tokenizer), docs.sparkSession.sparkContext
    tokens, held = tokenize(docs, tokenizer, window, end, id_col, text_col)
    rest = F.col("n") % window
    count, total = tokens.agg(F.count_if(rest > 0), F.sum(rest)).first()
    total, mean = total or 0, (total or 0) / count if count else 1.0
    counts = held.groupBy("token").agg(F.sum("df").alias("df")).toArrow()  # a row a token of the vocabulary at most
    token, df = (counts.column(c).to_numpy() for c in ("token", "df"))
    idf = np.zeros(int(token.max(initial=0)) + 1)
    idf[token] = np.log1p((count - df + 0.5) / (df + 0.5))
    shared = context.broadcast(idf)
    kind = tokens.schema["doc_id"].dataType
    ddl = PIECES.format(kind.simpleString()) + (", ids binary" if with_ids else "")

    def out(pieces: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*pieces)
        columns = [pa.array(list(c), pa.int64()) for c in (start, map(len, ids), map(crc, ids), total, sequence, offset)]
        columns += [pa.array([x.tobytes() for x in ids], pa.binary())] if with_ids else []
        return pa.RecordBatch.from_arrays([pa.array(doc, doc_type), *columns], names=[p.split()[0] for p in ddl.split(", ")])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole windows of long documents; their sequences have odd numbers."""
        sequence = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, 100):
            pieces = []
            for doc, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids"))):
                ids = np.frombuffer(x, dtype)
                for at in range(0, len(ids) - window + 1, window):
                    pieces.append((doc, at, ids[at : at + window], len(ids), 2 * sequence + 1, 0))
                    sequence += 1
            if pieces:
                yield out(pieces, batch.schema.field("doc_id").type)

    def least(ids: list[bytes]) -> np.ndarray:
        """Three weighted min-hashes of each document's rest."""
        cost = costs(shared.value)
        different = [np.unique(left_over(np.frombuffer(x, dtype), window)) for x in ids]
        return np.array([d[cost[:, d].argmin(axis=1)] for d in different], np.int64).reshape(-1, 3)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each document, its min-hashes and the range that they lie in."""
        for batch in small_batches(batches):
            ids = batch.column("ids").to_pylist()
            m = least(ids)
            part = np.array([bisect.bisect(bounds.value, (*k, f, r)) for *k, f, r in zip(*m.T.tolist(), batch.column("file").to_pylist(), batch.column("row").to_pylist())], np.int64)
            left = [left_over(np.frombuffer(x, dtype), window).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("file", "row", "doc_id", "n")], pa.array(left, pa.binary()), *[pa.array(c) for c in (*m.T, part)]], names=["file", "row", "doc_id", "n", "ids", "m1", "m2", "m3", "part"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, first = [], TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field("doc_id").type]
                for doc, n, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                    yield doc, n - n % window, np.frombuffer(x, dtype), n

        held = []
        for doc, start, ids, total, sequence, offset in _pack(rows(), shared.value, mean, window, shard_tokens):
            held.append((doc, start, ids, total, 2 * (first + sequence), offset))
            if len(held) >= 2000:
                yield out(held, *kind)
                held = []
        if held:
            yield out(held, *kind)

    # Ranges of the order with about eight shards each, by a sample of some 50 rows a range.  A task streams its range shard by shard, so
    # large or uneven ones only cost time.
    some, parts = tokens.filter(rest > 0), min(total // (8 * shard_tokens) + 1, MOST_RANGES)
    sample = some.sample(min(1.0, 50 * parts / max(count, 1)), seed=1).select("file", "row", "ids") if parts > 1 else some.limit(0).select("file", "row", "ids")
    drawn = sample.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([*map(pa.array, least(b.column("ids").to_pylist()).T), b.column("file"), b.column("row")], names=["m1", "m2", "m3", "file", "row"]) for b in batches), "m1 long, m2 long, m3 long, file long, row long")
    drawn = sorted(tuple(r) for r in drawn.collect())
    bounds = context.broadcast([drawn[len(drawn) * k // parts] for k in range(1, parts)] if drawn else [])
    keyed = some.mapInArrow(keys, f"file long, row long, doc_id {kind.simpleString()}, n long, ids binary, m1 long, m2 long, m3 long, part long")
    ranged = keyed.repartition(parts, "part").sortWithinPartitions("part", "m1", "m2", "m3", "file", "row")
    return tokens.filter(F.col("n") >= window).select("doc_id", "ids").mapInArrow(whole, ddl).unionByName(ranged.mapInArrow(fill, ddl))


@functools.cache
def _draws(size: int) -> np.ndarray:
    draws = np.stack([mix(np.arange(size, dtype=np.uint64) + np.uint64(seed << 32)) for seed in (1, 2, 3)])
    return -np.log((draws.astype(np.float64) + 1) / 2.0**64)


def costs(idf: np.ndarray) -> np.ndarray:
    """Exponential keys of the tokens for three min-hashes; the rarer a token, the likelier its key is the least."""
    return _draws(len(idf)) / np.maximum(idf, 1e-9)
