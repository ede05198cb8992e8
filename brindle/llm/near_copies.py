"""Near copies by SimHash: texts of a five-word Jaccard similarity of 0.8 or more.

Bits of the SimHashes of two texts of that similarity differ by 15 in 100, far beyond the few bits that
:mod:`brindle.llm.simhash` links at.  So the fingerprints here are ``WORDS`` times 64 bits wide, over the distinct five-word
shingles of the lower-cased text:

1. The bits of each word are grouped into partitions so that correlated bits share one (statistics of all fingerprints).
2. A dynamic programme gives each partition a threshold, 0 (probed by its value) or -1 (not probed), at the least estimated
   number of candidates; the sum is that of the pigeonhole principle for ``PROBED`` - 1 differing bits.  Pairs that differ in
   more bits are found with the probability 1 - (1 - (1 - 0.15)**16)**PROBED, 0.96 at a similarity of 0.8 and 0.99 at 0.85.
3. Candidates whose first 128 bits differ by ``REACH`` or fewer are verified by the Jaccard similarity itself.  Of the
   candidates of a bucket a minimum spanning forest comes first.  A pair of it may fall short where another that it stands for does
   not, so the pairs of a bucket whose texts are still in different classes then are judged too, all of them.  That is done within the
   bucket first: each text that has such a pair gets a sketch, a bitmap of its shingles; the bits that two sketches differ in are never
   more than the shingles that the texts do, so a pair whose sketches differ in too many falls short of the similarity for certain.  Only
   pairs that pass leave the bucket as rows and are verified.
4. Verified links make classes, by connected components; one document of each class stays, that of the smallest id.

Texts of fewer than five words are one shingle, null texts and those without words are alike.  Repeated rows and rows of one id
are rows like any others; of several rows of the smallest id the first in the files stays, null ids come last.  An empty table
gives an empty result.  All columns are kept, whatever their names.  A text is held whole by one task, some 50 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import Hashes, byte_texts, checkpoint, fresh, from_files, materialise, mix, place_of, small_batches, sized_join
from brindle.llm.simhash import allocate_thresholds, components, group_bits

WIDTH, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, bits of a partition, and partitions probed.
WORDS, PART, PROBED = 12, 16, 44
REACH = 34
#: Bits of a sketch, and pairs whose sketches are compared at once.
SKETCH, AT_ONCE = 2048, 50_000
#: Buckets above this many fingerprints are dealt into blocks.
BLOCK_ROWS = 4_000
_SALTS = np.random.default_rng(20240311).integers(0, 2**64, WORDS, dtype=np.uint64)


def shingles(text: bytes, hashes: Hashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    x = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) <= width:
        return mix(*x[:, None])
    return np.unique(mix(*(x[k : len(x) - width + 1 + k] for k in range(width))))


def wide_fingerprint(found: np.ndarray) -> bytes:
    """A bit is 1 where over half of the shingles' hashes have it."""
    ones = np.zeros(WORDS * 64, dtype=np.int64)
    for at in range(0, len(found), 4096):
        h = (found[at : at + 4096, None] ^ _SALTS) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(found)).tobytes()


def with_wide_fingerprints(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep``, ``bits`` (the fingerprint) and ``node`` (its hash)."""
    schema = docs.select(*keep).schema.add("bits", "binary").add("node", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(batches):
            bits = [wide_fingerprint(shingles(t, hashes)) for t in byte_texts(batch, text)]
            nodes = np.array([xxhash.xxh3_64_intdigest(b) for b in bits], dtype=np.uint64).view(np.int64)
            hashes.trim()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bits, pa.binary()), pa.array(nodes)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, WORDS * 8)


def partitions(nodes: DataFrame) -> tuple[list[list[int]], list[float]]:
    """The bits of each partition, and the estimated candidates of probing it by value; each task sends WORDS x 64 x 64 sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((WORDS, 64, 64)), 0
        for batch in small_batches(batches):
            bits = np.unpackbits(_matrix(batch), axis=1).astype(np.float32).reshape(-1, WORDS, 64).transpose(1, 0, 2)
            total += bits.transpose(0, 2, 1) @ bits
            n += batch.num_rows
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    sums = np.zeros(WORDS * 64 * 64 + 1)
    found = nodes.select("bits").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    n = max(sums[-1], 1.0)
    groups, costs = [], []
    for k, both in enumerate(sums[:-1].reshape(WORDS, 64, 64) / n):
        mean = both.diagonal()
        cov = both - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
        corr = np.abs(cov / np.outer(scale, scale))
        for group in group_bits(corr, 64 // PART):
            m = mean[group]
            together = (corr[np.ix_(group, group)] ** 2).sum() - PART
            groups.append([64 * k + b for b in group])
            costs.append(float(n * n / 2 * np.prod(1 - 2 * m * (1 - m)) * (1 + max(together, 0) / 2)))
    return groups, costs


def _probes(nodes: DataFrame, probed: list[tuple[int, list[int]]]) -> DataFrame:
    """key (partition and its value), node, the first 128 bits as x and y, and the further columns of ``nodes``: a row a probed partition."""
    more = [f for f in nodes.schema if f.name not in ("node", "bits")]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "node", "x", "y")] + more)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = _matrix(batch)
            bits, node = np.unpackbits(raw, axis=1), batch.column("node").to_numpy()
            values = [np.ascontiguousarray(np.packbits(bits[:, group], axis=1)).view(">u2").ravel() for _, group in probed]
            keys = [k << PART | v.astype(np.int64) for (k, _), v in zip(probed, values)]
            head = np.ascontiguousarray(raw[:, :16]).view(np.int64)
            columns = [np.concatenate(keys), *(np.tile(x, len(keys)) for x in (node, head[:, 0], head[:, 1]))]
            others = [pa.concat_arrays([batch.column(f.name)] * len(keys)) for f in more]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), *others], names=schema.names)

    return nodes.mapInArrow(run, schema)


def _far(x: np.ndarray, y: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(x[i] ^ x[j]).astype(np.int16) + np.bitwise_count(y[i] ^ y[j])


def spanning_edges(x: np.ndarray, y: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of the fingerprints within ``reach``; the tree grows by the nearest one not yet in it."""
    near = np.zeros(len(x), dtype=bool)
    for at in range(0, len(x), 128):
        some = np.arange(at, min(at + 128, len(x)))
        near[some] = (_far(x, y, some[:, None], np.arange(len(x))[None, :]) <= reach).sum(axis=1) > 1
    left = np.flatnonzero(near)
    edges: list[tuple[int, int]] = []
    while len(left):
        new, left = left[0], left[1:]
        best, of = np.full(len(left), 1 << 14, dtype=np.int16), np.zeros(len(left), dtype=np.int64)
        while len(left):
            d = _far(x, y, left, new)
            closer = d < best
            best[closer], of[closer] = d[closer], new
            k = int(best.argmin())
            if best[k] > reach:
                break
            new = left[k]
            edges.append((int(of[k]), int(new)))
            left, best, of = np.delete(left, k), np.delete(best, k), np.delete(of, k)
    return edges


def _bucket_edges(reach: int, small: int = 48):
    """Spanning edges of the buckets of a partition sorted by bucket; a bucket may run over several batches."""

    def small_ones(keys: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Of all buckets at once: neighbours 1, 2, ... rows apart; then the nearest first (Kruskal)."""
        pairs = []
        for lag in range(1, most):
            i = np.flatnonzero(keys[:-lag] == keys[lag:])
            d = _far(x, y, i, i + lag)
            i, d = i[d <= reach], d[d <= reach]
            pairs += zip(d.tolist(), i.tolist(), (i + lag).tolist())
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        edges = []
        for _, i, j in sorted(pairs):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                edges.append((i, j))
        return edges

    def solve(keys: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(keys)))
        edges = []
        for a, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
            edges += [(a + i, a + j) for i, j in spanning_edges(x[a : a + n], y[a : a + n], reach)]
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
        if len(few):
            edges += [(int(few[i]), int(few[j])) for i, j in small_ones(keys[few], x[few], y[few], int(sizes[sizes <= small].max()))]
        if edges:
            i, j = np.array(edges).T
            a, b = node[i], node[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("bucket", "node", "x", "y")]
            columns[2:] = [c.view(np.uint64) for c in columns[2:]]  # bits are counted of unsigned numbers only
            keys = columns[0]
            if held and keys[-1] == held[-1][0][-1]:
                held.append(columns)
                continue
            # The last bucket of the batch may go on in the next.
            cut = int(np.searchsorted(keys, keys[-1]))
            held.append([c[:cut] for c in columns])
            whole = [np.concatenate(c) for c in zip(*held)]
            if len(whole[0]):
                yield from solve(*whole)
            held = [[c[cut:] for c in columns]]
        if held:
            yield from solve(*(np.concatenate(c) for c in zip(*held)))

    return run


def _by_bucket(names: list[str], work):
    """``work`` on the columns ``names`` of each bucket, of a partition sorted by bucket; a bucket is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("bucket").to_numpy()
            columns = [np.array(batch.column(c).to_pylist(), dtype=f"V{SKETCH // 8}") if c == "sketch" else batch.column(c).to_numpy() for c in names]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if held and keys[start] != last:
                    yield from work(*(np.concatenate(c) for c in zip(*held)))
                    held = []
                held.append([c[start:stop] for c in columns])
                last = keys[start]
        if held:
            yield from work(*(np.concatenate(c) for c in zip(*held)))

    return run


def _between(x: np.ndarray, y: np.ndarray, root: np.ndarray, reach: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of all pairs of a bucket within ``reach`` whose classes differ, for some i at a time."""
    if (root == root[0]).all():
        return
    x, y = x.view(np.uint64), y.view(np.uint64)  # bits are counted of unsigned numbers only
    for at in range(0, len(x), rows):
        some, later = np.arange(at, min(at + rows, len(x))), np.arange(at, len(x))
        open_ones = (later[None, :] > some[:, None]) & (root[some][:, None] != root[later][None, :])
        i, j = np.nonzero(open_ones & (_far(x, y, some[:, None], later[None, :]) <= reach))
        if len(i):
            yield some[i], later[j]


def _open_rows(reach: int):
    """The rows of a bucket that have a pair between classes."""
    names = ["bucket", "node", "x", "y", "root"]

    def work(bucket: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(node), dtype=bool)
        for i, j in _between(x, y, root, reach):
            found[i] = found[j] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (bucket, node, x, y, root)], names=names)

    return _by_bucket(names, work)


def may_be_similar(size: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """False where the sketches (rows of 64-bit words) show that the similarity is not reached."""
    apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
    both = size[i] + size[j]
    most = (both - apart) / 2  # shingles that both can have
    return most + 1e-6 >= similarity * (both - most)


def _bucket_pairs(reach: int, similarity: float):
    """The pairs of a bucket between classes that the sketches do not rule out."""

    def work(node: np.ndarray, x: np.ndarray, y: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = sketch.view(np.uint64).reshape(len(node), -1)
        for i, j in _between(x, y, root, reach):
            for at in range(0, len(i), AT_ONCE):
                p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                may = may_be_similar(size, bits, p, q, similarity)
                a, b = node[p[may]], node[q[may]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_bucket(["node", "x", "y", "root", "size", "sketch"], work)


def sketched(texts: DataFrame) -> DataFrame:
    """node, size (different shingles) and sketch of ``texts`` (node, t)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(batches, 200):
            sizes, bits = [], np.zeros((batch.num_rows, SKETCH), dtype=np.uint8)
            for k, t in enumerate(byte_texts(batch, "t")):
                found = shingles(t, hashes)
                sizes.append(len(found))
                bits[k, (found % np.uint64(SKETCH)).astype(np.int64)] = 1
            hashes.trim()
            sketches = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), sketches], names=["node", "size", "sketch"])

    return texts.mapInArrow(run, "node long, size long, sketch binary")


def chosen_partitions(nodes: DataFrame, probed: int = PROBED) -> list[tuple[int, list[int]]]:
    """The number and the bits of each partition that is probed."""
    groups, costs = partitions(nodes)
    thresholds = allocate_thresholds([[0.0, c] for c in costs], probed - 1)
    return [(k, g) for k, (g, t) in enumerate(zip(groups, thresholds)) if t == 0]


def bucketed(nodes: DataFrame, probed: list[tuple[int, list[int]]]) -> DataFrame:
    """bucket, node, x, y and the further columns of ``nodes``, dealt and sorted by bucket; heavy buckets are dealt into blocks."""
    rows = _probes(nodes, probed)
    heavy = materialise(rows.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).select(F.col("key").alias("heavy"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("g")))
    held = [c for c in rows.columns if c != "key"]
    if heavy.isEmpty():
        rows = rows.withColumnRenamed("key", "bucket")
    else:
        # Deal a heavy bucket into g chunks; every pair of chunks meets in one block.
        rows = sized_join(rows, heavy, F.col("key") == F.col("heavy"), "left").withColumn("g", F.coalesce("g", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.least(o, own) * F.col("g") + F.greatest(o, own))
        rows = rows.select("key", *held, F.explode(blocks).alias("block")).select(F.xxhash64("key", "block").alias("bucket"), *held)
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def candidate_edges(nodes: DataFrame, probed: list[tuple[int, list[int]]], reach: int = REACH) -> DataFrame:
    """Candidate pairs a, b of ``nodes`` (node, bits; distinct, materialised): the spanning forests of all buckets."""
    return bucketed(nodes.select("node", "bits"), probed).mapInArrow(_bucket_edges(reach), "a long, b long").distinct()


def edges_between(nodes: DataFrame, probed: list[tuple[int, list[int]]], classes: DataFrame, texts_of, reach: int = REACH, similarity: float = SIMILARITY) -> DataFrame:
    """All candidate pairs a, b between classes (node, root; materialised; a node that is not there is its own root) that may be similar.

    ``texts_of`` gives the texts (node, t) of some nodes; only nodes that have a candidate in another class are sketched.
    """
    rooted = materialise(sized_join(nodes.select("node", "bits"), classes.select("node", "root"), "node", "left").select("node", "bits", F.coalesce("root", "node").alias("root")))
    rows = materialise(bucketed(rooted, probed).mapInArrow(_open_rows(reach), "bucket long, node long, x long, y long, root long"))
    sketches = materialise(sketched(texts_of(rows.select("node").distinct())))
    dealt = rows.join(sketches, "node").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_bucket_pairs(reach, similarity), "a long, b long").distinct()


def verified(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The edges a, b whose texts (``texts``: node, t) have the Jaccard similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(batches, 200):
            keep = []
            for s, t in zip(byte_texts(batch, "ta"), byte_texts(batch, "tb")):
                p, q = shingles(s, hashes), shingles(t, hashes)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            hashes.trim()
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: texts.select(F.col("node").alias(n), F.col("t").alias(f"t{n}"))
    return edges.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of every class of near copies, with all columns of ``docs``."""
    docs = from_files(docs)
    place, body = fresh(docs, "_place"), fresh(docs, "_text")
    numbered = docs.withColumn(place, place_of(docs))
    texts = numbered.select(F.col(place).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias(body))
    rows = materialise(with_wide_fingerprints(texts, ["row", "id"], body))
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("times"))
    nodes = materialise(nodes)

    def texts_of(some: DataFrame) -> DataFrame:
        """The texts of some nodes: those of the rows that stand for them."""
        named = materialise(some.join(nodes, "node").select("node", F.col("best.row").alias("row")))
        return sized_join(texts.select("row", F.col(body).alias("t")), named, "row").select("node", "t")

    def linked(edges: DataFrame) -> DataFrame:
        """The edges that are verified."""
        some = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        return materialise(verified(edges, materialise(texts_of(some)), similarity))

    def classified(links: DataFrame) -> DataFrame:
        """node, root of the nodes that any link has."""
        found = components(links)
        roots = found.select(F.col("root").alias("node"), "root").distinct()
        return materialise(found.unionByName(roots.select("node", "root")).distinct())

    probed = chosen_partitions(nodes)
    tried = materialise(candidate_edges(nodes, probed))
    links = linked(tried)
    rest = materialise(edges_between(nodes, probed, classified(links), texts_of, similarity=similarity).join(tried, ["a", "b"], "left_anti"))
    classes = classified(links.unionByName(linked(rest)))
    first = materialise(nodes.join(classes, "node").groupBy("root").agg(F.min("best").alias("best")))
    # Rows that go: those of a node that are not its first, and the first ones of nodes that are not their class's first.
    keeps = sized_join(classes, first, "root").select("node", F.col("best.row").alias("keep"))
    last = nodes.join(keeps, "node", "left").filter("times > 1 or keep is not null")
    last = materialise(last.select("node", F.coalesce("keep", "best.row").alias("keep")))
    gone = materialise(sized_join(rows.select("row", "node"), last, "node").filter("row <> keep").select(F.col("row").alias(place)))
    return sized_join(numbered, gone, place, "left_anti").drop(place)
