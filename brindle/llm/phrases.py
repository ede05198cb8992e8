"""Collocations: phrases of two to five words that occur far more often than their parts would by chance.

PCY/DHP hashing, one pass over the texts for each length k; the first one stores them as chunks of word numbers.  A pass counts the k-grams that may be frequent, exactly, and at the
same time counts all (k+1)-grams made of such by hash buckets.  The buckets that reach the least count become a bitmap, the
frequent k-grams another one; both are broadcast, and the next pass counts a (k+1)-gram only if its bucket and both of its
k-grams (Apriori) have their bits.  A bitmap has one bit for every ``min_count / 4`` words of the corpus, and ``MOST_BITS`` (64 MB) at
most; a fuller one prunes less and changes no result, for what passes it is counted exactly, by its text.

Tasks number their words anew for every chunk of ``CHUNK`` words and sum each phrase within a chunk.  The different phrases of a chunk
are dealt by hash into ``parts``, and each part travels as one packed row; the parts are merged by text, and only frequent phrases leave
as rows.  So a frequent phrase or language is summed before it is shuffled, and the rows are as many as chunks and parts.

Null texts are empty; a null language is ``und`` and the same as that word.  Empty texts and those without words add nothing.  A
repeated row counts as often as it is there.  Ties fall to the smallest cut, and in the ranking to the phrase that comes first in
byte order.  An empty table gives an empty result.  Other columns are not read.  A very long text is worked off in segments that end
at a break.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import byte_texts, materialise, mix, small_batches

#: What parts pieces (fixed), and the texts' clean form: ASCII in lower case, every such sign a full stop.
BREAKS = b".,;:!?\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
CLEAN = bytes.maketrans(BREAKS + UPPER, b"." * len(BREAKS) + UPPER.lower())

#: Words in a chunk, bits of a bitmap at most, and buckets whose counts travel as one row.
CHUNK, MOST_BITS, SLICE = 2_000_000, 1 << 29, 1 << 16
#: Parts of the phrases: a power of two for some 8 MB of text each, between these.
PARTS = 64, 1024
#: Phrases of a part that are held before they are summed.
HELD = 1_000_000

#: One of three kinds of row: a language and its words (lang, n), a part of the phrases (part, packed), bucket counts (slice, packed).
COUNTS = "lang string, n long, part long, slice long, packed binary"
CHUNKS = "ids binary, words binary, lang_of binary, langs array<string>"


def segments(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The clean text in segments of about ``size`` bytes that end at breaks."""
    clean, at = text.translate(CLEAN), 0
    while at < len(clean):
        end = clean.find(b".", at + size)
        end = len(clean) if end < 0 else end
        yield clean[at:end]
        at = end


class Chunk:
    """Texts as one row of word numbers.  0 stands between pieces; one word of two languages has two numbers."""

    def __init__(self):
        self.words, self.lang_of, self.langs = [b""], array("i", [-1]), []
        self.ids = array("i", [0])
        self._of: dict[str, _Numbers] = {}

    def add(self, lang: str, text: bytes) -> None:
        numbers = self._of.get(lang)
        if numbers is None:
            numbers = self._of[lang] = _Numbers(self, len(self.langs))
            self.langs.append(lang)
        for part in segments(text):
            self.ids.extend(map(numbers.__getitem__, part.replace(b".", b" . ").split()))
            self.ids.append(0)

    def packed(self) -> list:
        """The row of :data:`CHUNKS`; no word has a line break."""
        return [self.ids.tobytes(), b"\n".join(self.words), self.lang_of.tobytes(), self.langs]

    @classmethod
    def unpacked(cls, ids: bytes, words: bytes, lang_of: bytes, langs: list[str]) -> Chunk:
        chunk = cls()
        chunk.ids, chunk.words, chunk.lang_of, chunk.langs = np.frombuffer(ids, np.int32), words.split(b"\n"), np.frombuffer(lang_of, np.int32), langs
        return chunk

    def hashes(self) -> np.ndarray:
        seeds = [*map(xxhash.xxh3_64_intdigest, self.langs), 0]
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in zip(self.words, self.lang_of)), np.uint64, len(self.words))


class _Numbers(dict):
    """Word to number, for one language of a chunk."""

    def __init__(self, chunk: Chunk, lang: int):
        super().__init__({b".": 0})
        self.chunk, self.lang = chunk, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.chunk.words)
        self.chunk.words.append(word)
        self.chunk.lang_of.append(self.lang)
        return number


def grams(ids: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k words from every place on, and whether they lie in one piece."""
    h, whole = hashes[ids], ids > 0
    first, inside = h, whole
    for j in range(1, k):
        h, whole = mix(h[:-1], first[j:]), whole[:-1] & inside[j:]
    return h, whole


def has_bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def tally(ids: np.ndarray, h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of each different k-gram among those at ``at``; by hash, and by words where hashes are equal by chance."""
    _, first, which, n = np.unique(h[at], return_index=True, return_inverse=True, return_counts=True)
    example = at[first]
    if not all((ids[at + j] == ids[example[which] + j]).all() for j in range(k)):
        _, first, n = np.unique(np.stack([ids[at + j] for j in range(k)], axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], n


def _phrases(chunk: Chunk, ids: np.ndarray, h: np.ndarray, at: np.ndarray, n: np.ndarray, k: int) -> bytes:
    """Some phrases (lang, phrase, h, n) in Arrow's stream format."""
    word = chunk.words.__getitem__
    texts = [b" ".join(map(word, gram)) for gram in zip(*(ids[at + j].tolist() for j in range(k)))]
    langs = pa.DictionaryArray.from_arrays(pa.array(np.asarray(chunk.lang_of)[ids[at]], pa.int32()), pa.array(chunk.langs, pa.string())).cast(pa.string())
    columns = [langs, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(h[at].view(np.int64)), pa.array(n, pa.int64())]
    batch, sink = pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "h", "n"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(**columns: list) -> list[pa.Array]:
    """Columns of :data:`COUNTS`; those that are not given are null."""
    kinds = {"lang": pa.string(), "n": pa.int64(), "part": pa.int64(), "slice": pa.int64(), "packed": pa.binary()}
    size = len(next(iter(columns.values())))
    return [pa.array(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()]


def _slices(longer: np.ndarray, bits: int, least: int) -> list[tuple[int, bytes]]:
    """The bucket counts of some hashes, packed by slices of buckets."""
    bucket, n = np.unique(longer & np.uint64(bits - 1), return_counts=True)
    n = np.minimum(n, least).astype(np.uint32)  # more does not matter
    slices = bucket >> np.uint64(16)
    low = (bucket & np.uint64(SLICE - 1)).astype(np.uint16)
    starts = np.flatnonzero(np.diff(slices, prepend=np.uint64(bits))).tolist()
    return [(int(slices[a]), low[a:b].tobytes() + n[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(bucket)])]


def count_chunk(chunk: Chunk, k: int, shorter: np.ndarray | None, buckets: np.ndarray | None, bits: int, longest: int, least: int, parts: int = PARTS[0]) -> Iterator[list[pa.Array]]:
    """Columns of :data:`COUNTS`: the k-grams that may be frequent, and the bucket counts of the (k+1)-grams made of them."""
    ids, hashes = np.frombuffer(chunk.ids, np.int32), chunk.hashes()
    if len(ids) < k:
        return
    h, may = grams(ids, hashes, k)
    if k > 1:
        known = has_bit(shorter, grams(ids, hashes, k - 1)[0])
        may = may & known[:-1] & known[1:]
        at = np.flatnonzero(may)
        may[at] = has_bit(buckets, h[at])
        at, n = tally(ids, h, np.flatnonzero(may), k)
    else:  # numbers are words
        n = np.bincount(ids, minlength=len(hashes))[1:]
        at = np.zeros(len(hashes), np.int64)
        at[ids] = np.arange(len(ids))
        at = at[1:]
        words = np.bincount(np.asarray(chunk.lang_of)[1:], weights=n, minlength=len(chunk.langs)).astype(np.int64)
        yield _rows(lang=chunk.langs, n=words)
    of = (h[at] >> np.uint64(65 - parts.bit_length())).astype(np.int64)
    order = np.argsort(of, kind="stable")
    at, n, of = at[order], n[order], of[order]
    for a, b in itertools.pairwise(np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()):
        yield _rows(part=of[a : a + 1], packed=[_phrases(chunk, ids, h, at[a:b], n[a:b], k)])
    if k < longest and len(ids) > k:
        at = np.flatnonzero(may[:-1] & may[1:])
        packed = _slices(mix(h[at], hashes[ids[at + k]]), bits, least)
        for a in range(0, len(packed), 500):
            numbers, counts = zip(*packed[a : a + 500])
            yield _rows(slice=numbers, packed=counts)


NAMES = [part.split()[0] for part in f"{COUNTS}, {CHUNKS}".split(", ")]


def _first_pass(texts: DataFrame, bits: int, longest: int, least: int, parts: int, chunk_words: int) -> DataFrame:
    """Rows of :data:`COUNTS` for single words and buckets of pairs, and the chunks, which the other passes read."""
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]

    def rows(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        for columns in count_chunk(chunk, 1, None, None, bits, longest, least, parts):
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in kinds)], names=NAMES)
        yield pa.RecordBatch.from_arrays([*_rows(packed=[None]), *(pa.array([x], t) for x, t in zip(chunk.packed(), kinds))], names=NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch, "text")):
                chunk.add(lang, text)
                if len(chunk.ids) >= chunk_words:
                    yield from rows(chunk)
                    chunk = Chunk()
        if len(chunk.words) > 1:
            yield from rows(chunk)

    return materialise(texts.mapInArrow(run, f"{COUNTS}, {CHUNKS}"))


def _pass(chunks: DataFrame, k: int, shorter, buckets, bits: int, longest: int, least: int, parts: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast((shorter, buckets))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            chunk = Chunk.unpacked(*(batch.column(c)[0].as_py() for c in ("ids", "words", "lang_of", "langs")))
            for columns in count_chunk(chunk, k, *shared.value, bits, longest, least, parts):
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[:5])

    return materialise(chunks.mapInArrow(run, COUNTS))


def _frequent(counts: DataFrame, least: int, held_rows: int = HELD) -> DataFrame:
    """(lang, phrase, f, h) of the phrases that reach ``least``, summed by text; a task holds the different phrases of one part."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum"), ("h", "max")])  # h is of the phrase
        return sums.select(["lang", "phrase", "h_max", "n_sum"]).rename_columns(["lang", "phrase", "h", "n"])

    def rows(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        sums = summed(tables)
        yield from sums.filter(pc.greater_equal(sums["n"], least)).select(["lang", "phrase", "n", "h"]).rename_columns(["lang", "phrase", "f", "h"]).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, most = None, [], 0, held_rows
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed")):
                if part != now:
                    if held:
                        yield from rows(held)
                    now, held, size, most = part, [], 0, held_rows
                held.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
                size += held[-1].num_rows
                if size > most:
                    held = [summed(held)]
                    size = held[0].num_rows
                    most = max(held_rows, 2 * size)
        if held:
            yield from rows(held)

    parts = counts.filter("part is not null").select("part", "packed").repartition("part").sortWithinPartitions("part")
    return parts.mapInArrow(run, "lang string, phrase string, f long, h long")


def _filled(counts: DataFrame, least: int) -> DataFrame:
    """(slice, bitmap) of the buckets that reach ``least``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SLICE, np.uint64)

        def row() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for s, packed in zip(batch.column("slice").to_pylist(), batch.column("packed").to_pylist()):
                if s != now:
                    if now is not None:
                        yield row()
                    now = s
                    total[:] = 0
                size = len(packed) // 6
                total[np.frombuffer(packed, np.uint16, size)] += np.frombuffer(packed, np.uint32, size, 2 * size)
        if now is not None:
            yield row()

    parts = counts.filter("slice is not null").select("slice", "packed").repartition("slice").sortWithinPartitions("slice")
    return parts.mapInArrow(run, "slice long, bits binary")


def _bitmap(slices: DataFrame, bits: int) -> np.ndarray:
    """The whole bitmap, at most :data:`MOST_BITS`, on the driver; all partitions in one job."""
    out = np.zeros(bits // 8, np.uint8)
    found = slices.toArrow()
    for k, cell in zip(found.column("slice").to_pylist(), found.column("bits")):
        part = np.frombuffer(cell.as_buffer(), np.uint8)
        out[k * len(part) : (k + 1) * len(part)] = part
    return out


def _bits_of(frequent: DataFrame, bits: int) -> DataFrame:
    """(slice, bitmap) of the frequent phrases' hashes; slices of Spark's bitmap functions have 32,768 bits."""
    bit = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    return frequent.groupBy((F.bitmap_bucket_number(bit) - 1).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, chunk_words: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all words and phrases found ``min_count`` times or more, and (lang, n) with all words of a language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 18, 1 << (size * 4 // (6 * min_count)).bit_length()))
    parts = min(PARTS[1], max(PARTS[0], 1 << (size >> 23).bit_length()))
    shorter = buckets = None
    found = []
    counts = _first_pass(texts, bits, longest, min_count, parts, chunk_words)
    totals = counts.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    chunks = counts.filter("ids is not null").select("ids", "words", "lang_of", "langs")
    for k in range(1, longest + 1):
        if k > 1:
            counts = _pass(chunks, k, shorter, buckets, bits, longest, min_count, parts)
        frequent = materialise(_frequent(counts, min_count))
        found.append(frequent.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k < longest:
            shorter, buckets = _bitmap(_bits_of(frequent, bits), bits), _bitmap(_filled(counts, min_count), bits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def weakest_cuts(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n and score of every phrase of two words and more, at its weakest cut."""
    words = F.split("phrase", " ")
    cuts = frequent.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("_w", 1, F.col("cut")), " ").alias("_left"), F.array_join(F.slice("_w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")  # one row a language
    score = F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    best = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_c"))
    return best.select("lang", "phrase", "k", "a", "_c.l", "_c.r", "n", "_c.score")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, chunk_words: int = CHUNK) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out if a longer one around it is found at least ``covered`` percent as often; one word more is enough to look
    at, for what lies between the two is found at least as often as the longer.
    """
    frequent, totals = frequent_phrases(docs, text_col, lang_col, min_count, longest, chunk_words)
    words = F.split("phrase", " ")
    inner = lambda first: F.array_join(F.slice(words, first, F.col("k") - 1), " ")
    around = frequent.filter("k > 2").select("lang", "f", F.explode(F.array(inner(1), inner(2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_around"))
    scored = weakest_cuts(frequent, totals).join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_around") < covered * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = scored.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= top)  # a language's last sort gets 64 x top rows at most
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same for DuckDB.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY 1),
found AS (SELECT * FROM grams WHERE f >= 100),
cuts AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM found WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, c.cut, (1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase, f
  FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM found WHERE k > 2)),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
