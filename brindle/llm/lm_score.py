"""Language-model scoring with a weighted backoff automaton over words.

Tokens are the lower-cased words of a text and one end.  The root of the automaton holds the base distribution,
(count + 0.5) / (N + 0.5 (V + 1)).  Every word pair and triple seen at least ``LEAST`` times in training is an arc, whatever
the size of the corpus, smoothed by absolute discounting: an arc keeps (count - D) / total, the failure arc gets the rest, so
every state's probabilities sum to one.  :class:`BackoffAutomaton` is that automaton in one process.

For a corpus the automaton is a set of tables, as large as the corpus makes them, and it is never gathered:

1. The texts are numbered in chunks of some ``CHUNK`` tokens (:func:`chunks_of`).
2. Each chunk asks for the counts of its distinct triples, then pairs, then words.  The asks are dealt out by the key's leading
   bits, so however frequent an n-gram or its context is, a chunk sends it once.  One chunk leads each key; it alone reports
   the key as an arc to the state that the arc leaves, together with the asks of the next order.
3. Each chunk gets its part of the automaton (states, arcs and failure arcs that its texts pass) and walks it.

Words, pairs and triples are told apart by 64-bit hashes.  Null and empty texts are one end.  A null id is not held out and
takes part in the training.  Repeated rows count and are scored each on its own; there are no ties to break.  Without training
tokens every token has probability one (N = V = 0).  An empty table gives an empty result.  Other columns are not read,
whatever their names.  A text is never cut: a very long one makes a chunk of its own, some 100 bytes a token in a worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import byte_texts, crc_bucket, materialise, mix, small_batches

#: Pairs and triples of fewer occurrences are no arcs.
LEAST = 2
DISCOUNT = 0.5
END = b"\n"


class BackoffAutomaton:
    """States are contexts; ``step`` follows an arc or, while there is none, failure arcs."""

    def __init__(self, unigrams: dict[int, float], longer: dict[tuple[int, ...], float], totals: dict[tuple[int, ...], float]):
        """``unigrams``: log10 probabilities of single symbols.  ``longer``: counts of the n-grams of two symbols and more
        that are kept.  ``totals``: for each context, how often anything followed it."""
        follow: dict[tuple[int, ...], dict[int, float]] = {}
        for gram, n in longer.items():
            follow.setdefault(gram[:-1], {})[gram[-1]] = n
        contexts = sorted(follow, key=len)
        ids = {(): 0} | {c: k for k, c in enumerate(contexts, start=1)}

        def suffix(c: tuple[int, ...]) -> int:
            while c not in ids:
                c = c[1:]
            return ids[c]

        #: The context of each state but the root.
        self.contexts = {k: c for c, k in ids.items() if c}
        self.fail = [0] + [suffix(c[1:]) for c in contexts]
        self.loss = [0.0] * (len(contexts) + 1)
        self.arcs: list[dict[int, tuple[int, float]]] = [{s: (suffix((s,)), p) for s, p in unigrams.items()}]
        for c in contexts:
            total = max(totals[c], sum(follow[c].values()))
            rest = (total - sum(max(n - DISCOUNT, 0) for n in follow[c].values())) / total
            below = self.fail[ids[c]]
            self.loss[ids[c]] = math.log10(rest)
            arcs = {}
            for s, n in follow[c].items():
                p = max(n - DISCOUNT, 0) / total + rest * 10 ** self.weight(below, s)
                arcs[s] = (suffix((*c, s)), math.log10(p))
            self.arcs.append(arcs)

    def weight(self, state: int, symbol: int) -> float:
        lost = 0.0
        while symbol not in self.arcs[state]:
            lost += self.loss[state]
            state = self.fail[state]
        return lost + self.arcs[state][symbol][1]

    def score(self, symbols: Iterable[int]) -> float:
        """log10 probability of a sequence, from the empty context, in one traversal."""
        arcs, fail, loss = self.arcs, self.fail, self.loss
        state, total = 0, 0.0
        for s in symbols:
            arc = arcs[state].get(s)
            while arc is None:
                total += loss[state]
                state = fail[state]
                arc = arcs[state].get(s)
            state = arc[0]
            total += arc[1]
        return total


# ---- the automaton as a table ------------------------------------------------------------------------------------------

#: Tokens of the texts that one task holds at once (a text is never cut), and n-grams that one task counts at once.
CHUNK, BUCKET = 1 << 20, 1 << 20


def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; near-constant high bytes cost next to nothing."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys as differences (modulo 2**64), which are small where they are sorted."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks_of(rows: DataFrame, chunk_tokens: int = CHUNK) -> DataFrame:
    """The texts ``t`` of neighbouring rows as chunks: chunk (a number of its own), doc_id and aside of each text, and packed
    lengths, words (the hash of each distinct word) and seq (the place of each token's word)."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)),
        *T.DataType.fromDDL("aside array<boolean>, tokens long, trained long, lengths binary, words binary, seq binary").fields,
    ])

    def packed(chunk: int, ids: list[pa.Array], aside: list[np.ndarray], lengths: list[int], seq: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
        places, sizes, out = np.concatenate(seq), np.array(lengths, dtype=np.int64), np.concatenate(aside)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) or 1 for w in numbers), dtype=np.uint64, count=len(numbers))
        # Frequent words first, those of like frequency by hash, so that places and differences of hashes are small.
        rough = np.frexp(np.bincount(places, minlength=len(hashes)))[1]
        order = np.lexsort((hashes, -rough))
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(out))]
        numbers_ = [pa.array([x], pa.int64()) for x in (chunk, int(sizes.sum()), int(sizes[~out].sum()))]
        blobs = [pa.array([x], pa.binary()) for x in (_pack(sizes), _pack_keys(hashes[order]), _pack(rank[places]))]
        return pa.RecordBatch.from_arrays([numbers_[0], *lists, *numbers_[1:], *blobs], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, tokens = TaskContext.get().partitionId() << 33, 0
        held: tuple = ([], [], [], [], _Numbers())
        for batch in small_batches(batches, 100):
            ids, aside, lengths, seq, numbers = held
            place = numbers.__getitem__
            for text in byte_texts(batch, "t"):
                words = text.lower().split()
                words.append(END)
                lengths.append(len(words))
                seq.append(np.fromiter(map(place, words), dtype=np.int32, count=len(words)))
                tokens += len(words)
            ids.append(batch.column("doc_id"))
            aside.append(batch.column("aside").to_numpy(zero_copy_only=False).astype(bool))
            if tokens > chunk_tokens:
                yield packed(chunk, *held)
                chunk, tokens, held = chunk + 1, 0, ([], [], [], [], _Numbers())
        if held[2]:
            yield packed(chunk, *held)

    return rows.select("doc_id", "aside", "t").mapInArrow(run, schema)


class _Grams:
    """The distinct n-grams of one order in a chunk: sorted keys, the first token of each, the n-gram of each token (-1 where a
    text has no n-gram of that order yet), and the occurrences in texts not set aside."""

    def __init__(self, order: int, lengths: np.ndarray, words: np.ndarray, seq: np.ndarray, aside: np.ndarray):
        first = np.cumsum(lengths) - lengths
        behind = np.arange(len(seq)) - np.repeat(first, lengths)
        if order == 1:
            by_hash = np.argsort(words)
            rank = np.empty(len(words), dtype=np.int64)
            rank[by_hash] = np.arange(len(words))
            self.keys, self.of = words[by_hash], rank[seq]
        else:
            at = np.flatnonzero(behind >= order - 1)
            found = mix(*(words[seq[at - k]] for k in range(order - 1, -1, -1)))
            self.keys, start, places = np.unique(found, return_index=True, return_inverse=True)
            self.start = at[start]
            self.of = np.full(len(seq), -1, dtype=np.int64)
            self.of[at] = places
        counted = self.of[np.repeat(~aside, lengths) & (self.of >= 0)]
        self.n = np.bincount(counted, minlength=len(self.keys))


def _parts(row: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lengths, words, seq and aside of one chunk."""
    value = lambda c: row.column(c)[0].as_py()
    return _unpack(value("lengths"), np.int64), _unpack_keys(value("words")), _unpack(value("seq"), np.int32), np.array(value("aside"), dtype=bool)


ASKS = "bucket long, chunk long, keys binary, amounts array<binary>"
ANSWERS = "chunk long, bucket long, seen long, totals array<binary>"


def _asks(chunk: int, keys: np.ndarray, amounts: list[np.ndarray], bits: int) -> pa.Table:
    """Sorted keys with amounts of them, dealt out by the leading ``bits`` bits."""
    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b]
    return pa.table({
        "bucket": pa.array([k for k, _, _ in spans], pa.int64()),
        "chunk": pa.array([chunk] * len(spans), pa.int64()),
        "keys": pa.array([_pack_keys(keys[a:b]) for _, a, b in spans], pa.binary()),
        "amounts": pa.array([[_pack(x[a:b]) for x in amounts] for _, a, b in spans], pa.list_(pa.binary())),
    })


def _totals(asks: DataFrame, bits: int, least: int) -> DataFrame:
    """Per chunk and bucket, in the order of the keys asked: the sum of each amount over all chunks, the first one zero where
    below ``least``, and 1 for the one chunk that leads a key.  ``seen``: keys of the bucket whose first sum is above zero."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [_unpack_keys(x) for x in rows.column("keys").to_pylist()]
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        every, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        amounts = [np.concatenate([_unpack(x, np.int64) for x in column]) for column in zip(*rows.column("amounts").to_pylist())]
        sums = [np.bincount(of, weights=x, minlength=len(every)).astype(np.int64) for x in amounts]
        seen = [int((sums[0] > 0).sum())] + [0] * (len(keys) - 1)
        sums[0][sums[0] < least] = 0
        lead = np.zeros(len(of), dtype=np.int64)
        lead[first] = 1
        found = [x[of] for x in sums] + [lead]
        return pa.table({
            "chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "seen": pa.array(seen, pa.int64()),
            "totals": pa.array([[_pack(x[a:b]) for x in found] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.binary())),
        })

    return asks.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(run, ANSWERS)


def _meet(chunks: DataFrame, answers: DataFrame, tasks: int):
    """Each chunk with its answers; there are as many tasks as chunks, so a task's share does not grow with the input."""
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))


def _read(answers: pa.Table, size: int) -> list[np.ndarray]:
    """The totals of one chunk over all buckets; ``size``: how many there are of each key."""
    rows = [x for _, x in sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()), key=lambda x: x[0])]
    return [np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(x[k], np.int64) for x in rows)]) for k in range(size)]


def count_longest(chunks: DataFrame, bits: int) -> DataFrame:
    """Answers for the triples: n, lead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            grams = _Grams(3, *_parts(batch))
            yield from _asks(batch.column("chunk")[0].as_py(), grams.keys, [grams.n], bits).to_batches()

    return _totals(chunks.mapInArrow(run, ASKS), bits, LEAST)


def count_shorter(chunks: DataFrame, order: int, longer: DataFrame, tasks: int, bits: int, least: int) -> DataFrame:
    """Answers for the n-grams of ``order``: n, and of the arcs that leave them as states their occurrences and number, lead.

    ``longer``: the answers for the next order; an arc is reported by the one chunk that leads it.
    """

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        parts = _parts(chunk)
        grams, arcs = _Grams(order, *parts), _Grams(order + 1, *parts)
        found = _read(answers, 2 if order == 2 else 4) if len(arcs.keys) else [np.zeros(0, dtype=np.int64)] * 2
        mine = (found[0] > 0) & (found[-1] == 1)
        n, state = found[0][mine], grams.of[arcs.start[mine] - 1]
        uses = np.bincount(state, weights=n, minlength=len(grams.keys)).astype(np.int64)
        return _asks(chunk.column("chunk")[0].as_py(), grams.keys, [grams.n, uses, np.bincount(state, minlength=len(grams.keys))], bits)

    return _totals(_meet(chunks, longer, tasks).applyInArrow(run, ASKS), bits, least)


def _walk(chunks: DataFrame, answers: DataFrame, tasks: int, floor: float) -> DataFrame:
    """doc_id, aside, n_tokens, n_known, base_score and score of every text; ``answers``: those of all orders (``order``).

    A chunk gets the states, arcs and failure arcs that its texts pass.  A token's weight is that of its arc and of the failure
    arcs before it: from the state of two words to that of one to the root.
    """

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        lengths, words, seq, aside = parts = _parts(chunk)
        orders = np.array(answers.column("order").to_pylist())
        one, two, three = (_Grams(k, *parts) for k in (1, 2, 3))
        n1, uses1, arcs1, _ = _read(answers.filter(pa.array(orders == 1)), 4)
        n2, uses2, arcs2, _ = _read(answers.filter(pa.array(orders == 2)), 4)
        n3, _ = _read(answers.filter(pa.array(orders == 3)), 2)

        def failure(n: np.ndarray, uses: np.ndarray, arcs: np.ndarray) -> np.ndarray:
            return np.where(arcs > 0, 1 - (uses - DISCOUNT * arcs) / np.maximum(n, 1), 1.0)

        root = (n1 + 0.5) / floor
        p = root[one.of]
        for grams, n, lower, total, rest in ((two, n2, one, n1, failure(n1, uses1, arcs1)), (three, n3, two, n2, failure(n2, uses2, arcs2))):
            at = np.flatnonzero(grams.of >= 0)
            state, kept = lower.of[at - 1], n[grams.of[at]]
            p[at] = np.where(kept > 0, kept - DISCOUNT, 0.0) / np.maximum(total[state], 1) + rest[state] * p[at]
        text = np.repeat(np.arange(len(lengths)), lengths)
        sums = [np.bincount(text, weights=x, minlength=len(lengths)) for x in (n1[one.of] > 0, np.log10(root)[one.of], np.log10(p))]
        return pa.table({
            "doc_id": chunk.column("doc_ids").combine_chunks().flatten(), "aside": pa.array(aside), "n_tokens": pa.array(lengths),
            "n_known": pa.array(sums[0].astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
        })

    fields = "aside boolean, n_tokens long, n_known long, base_score double, score double"
    schema = T.StructType([T.StructField("doc_id", chunks.schema["doc_ids"].dataType.elementType), *T.DataType.fromDDL(fields).fields])
    return _meet(chunks, answers, tasks).applyInArrow(run, schema)


def score_texts(docs: DataFrame, held_out_buckets: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK, bucket_grams: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row."""
    aside = F.coalesce(crc_bucket(F.col("doc_id"), held_out_buckets) == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    chunks = materialise(chunks_of(rows.withColumn("aside", aside), chunk_tokens))
    sums = chunks.agg(F.sum("tokens").alias("all"), F.sum("trained").alias("n"), F.count(F.lit(1)).alias("chunks")).first()
    tasks = max(1, sums["chunks"])
    bits = max(1, math.ceil(math.log2(max(sums["all"] or 0, 1) / bucket_grams)))
    triples = materialise(count_longest(chunks, bits))
    pairs = materialise(count_shorter(chunks, 2, triples, tasks, bits, LEAST))
    words = materialise(count_shorter(chunks, 1, pairs, tasks, bits, 1))
    types, tokens = words.agg(F.sum("seen")).first()[0] or 0, sums["n"] or 0
    answers = [x.select("chunk", "bucket", "totals", F.lit(k).alias("order")) for k, x in ((1, words), (2, pairs), (3, triples))]
    whole = _walk(chunks, answers[0].unionByName(answers[1]).unionByName(answers[2]), tasks, tokens + 0.5 * (types + 1))
    return whole.select("doc_id", F.col("aside").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
