"""SimHash near-duplicate detection with a generalised pigeonhole search.

Fingerprints: XXH64 (seed 42) of every 4-word shingle of the lower-cased text, a bit set where over half the hashes set
it.  Two fingerprints link at ``distance`` or fewer differing bits; classes are the connected components.

Search: the 64 bits are grouped into partitions so that correlated bits share one; a dynamic programme gives each partition
its own threshold (-1: not probed), at least as strong together as the pigeonhole principle needs, at the least estimated
number of candidates; each partition is then probed by value and the candidates are verified.  Within a bucket only a
spanning forest of the verified links is emitted, never all pairs; buckets above ``block_rows`` are compared in blocks.

Null and empty texts have fingerprint zero and link like any other.  Repeated rows keep their own result row.  Rows with a
null id take part; they never name a component unless all ids of it are null (then the component is null).  An empty table
gives an empty result.  Other columns are not read, whatever their names.  Links have no order, so there are no ties.  A very long
text is one row of a task; its shingles' hashes take eight bytes each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import byte_texts, checkpoint, fresh, let, sized_join, small_batches

BITS = 64


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (named apart from ``fp``) and ``fp``, the fingerprint as a signed long."""
    text = fresh(docs, "_text")
    out = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = pa.array([_signed(fingerprint(t)) for t in byte_texts(batch, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [fps], names=[*keep, "fp"])

    return out.mapInArrow(run, schema)


# ---- partitions and thresholds -------------------------------------------------------------------------------------


def bit_correlations(fps: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations over all fingerprints; each task sends 64 x 64 sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    sums = np.zeros(BITS * BITS + 1)
    for row in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[row["cell"]] = row["n"]
    n = max(sums[-1], 1.0)
    both = sums[:-1].reshape(BITS, BITS) / n
    mean = both.diagonal()
    cov = both - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    return np.abs(cov / np.outer(scale, scale))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Equal groups of bits: the most correlated pair left starts a group, which takes the bits closest to it."""
    left, width, groups = set(range(BITS)), BITS // parts, []
    for k in range(parts):
        if k == parts - 1:
            groups.append(sorted(left))
            break
        _, a, b = max((corr[i, j], -i, -j) for i in left for j in left if i < j)
        group = [-a, -b]
        left -= set(group)
        while len(group) < width:
            best = max(left, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def part_value(fp: Column, bits: list[int]) -> Column:
    """The bits (0: most significant) of ``fp`` as one number."""
    value = F.lit(0)
    for k, bit in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, BITS - 1 - bit).bitwiseAND(F.lit(1)).cast("int"), k))
    return value


def candidate_costs(histogram: np.ndarray, width: int, most: int) -> list[float]:
    """Estimated candidates of a partition for the thresholds -1..``most``, probes counted like candidates."""
    costs, reach = [0.0], histogram.astype(float)
    probes = histogram.sum()
    for t in range(most + 1):
        if t:
            at = np.arange(len(histogram))
            ring = np.zeros_like(reach)
            if t == 1:
                for b in range(width):
                    ring += histogram[at ^ (1 << b)]
                probes += histogram.sum() * width / 2
            else:
                for b in range(width):
                    for c in range(b):
                        ring += histogram[at ^ (1 << b) ^ (1 << c)]
                probes += histogram.sum() * width * (width - 1) / 4
            reach = reach + ring
        costs.append(float((histogram * reach).sum() / 2 + probes))
    return costs


def allocate_thresholds(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t with sum(t + 1) = distance + 1 at the least total cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(options, start=-1):
                key = spent + t + 1
                if key <= distance + 1 and (key not in step or cost + c < step[key][0]):
                    step[key] = (cost + c, [*chosen, t])
        best = step
    return best[distance + 1][1]


# ---- links -----------------------------------------------------------------------------------------------------------


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the fingerprints: a breadth-first search over those not yet reached."""
    edges: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _bucket_forests(distance: int):
    """Forests of the buckets of a partition sorted by (bucket, fp); a bucket may run over several batches."""

    def links(values: np.ndarray) -> list[tuple[int, int]]:
        values = np.unique(values)
        if len(values) == 2:
            return [(int(values[0]), int(values[1]))] if np.bitwise_count(values[0] ^ values[1]) <= distance else []
        return forest(values, distance)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("bucket").to_numpy(zero_copy_only=False)
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            edges: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != held_key:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        edges += links(np.concatenate(held))
                    held_key, held = keys[a], []
                held.append(values[a:b])
            yield from _edge_batches(edges)
        if len(held) > 1 or held and len(held[0]) > 1:
            yield from _edge_batches(links(np.concatenate(held)))

    return run


def _edge_batches(edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if edges:
        pairs = np.array(edges, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def flips(width: int, t: int) -> list[int]:
    """Masks of up to ``t`` bits."""
    masks = [0]
    if t >= 1:
        masks += [1 << b for b in range(width)]
    if t >= 2:
        masks += [1 << b | 1 << c for b in range(width) for c in range(b)]
    if t >= 3:
        raise ValueError("thresholds above 2 are not probed")
    return masks


def probe_loads(histogram: np.ndarray, width: int, t: int) -> np.ndarray:
    """How many fingerprints come to the bucket of each value: its own and those of the smaller values within reach."""
    at = np.arange(len(histogram))
    loads = np.zeros(len(histogram))
    for mask in flips(width, t):
        loads += np.where(at ^ mask <= at, histogram[at ^ mask], 0)
    return loads


def _probes(value: Column, masks: list[int], offset: int) -> Column:
    """Keys of the values within reach; of two values that differ, the smaller probes the larger, so each pair meets."""

    def reach(v: Column) -> Column:
        found = F.filter(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: v.bitwiseXOR(m)), lambda u: u >= v)
        return F.transform(found, lambda u: u + F.lit(offset).cast("long"))

    return let(value, reach)


def find_links(fps: DataFrame, distance: int = 4, parts: int = 4, block_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect exactly the components of the fingerprints ``fp`` (distinct, materialised)."""
    groups = group_bits(bit_correlations(fps), parts)
    width = BITS // parts
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), part_value(F.col("fp"), g).alias("value")) for k, g in enumerate(groups)])).alias("x"))
    histograms = np.zeros((parts, 1 << width))  # bounded: parts x 2**width counts
    for row in values.groupBy("x.part", "x.value").count().collect():
        histograms[row["part"], row["value"]] = row["count"]
    thresholds = allocate_thresholds([candidate_costs(h, width, 2) for h in histograms], distance)

    keyed, heavy = [], {}
    for k, (g, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        keyed.append(_probes(part_value(F.col("fp"), g), flips(width, t), k << width))
        loads = probe_loads(histograms[k], width, t)
        heavy |= {int(k << width | v): -(-int(loads[v]) // block_rows) for v in np.nonzero(loads > block_rows)[0]}

    rows = fps.select("fp", F.explode(F.concat(*keyed)).alias("key"))
    if heavy:
        # Deal a heavy bucket into g chunks; every pair of chunks meets in one block.  The list has a bound: parts x 2**width.
        dealt = F.broadcast(fps.sparkSession.createDataFrame(sorted(heavy.items()), "heavy long, g int"))
        rows = rows.join(dealt, F.col("key") == F.col("heavy"), "left").withColumn("g", F.coalesce("g", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.least(o, F.col("own")) * F.col("g") + F.greatest(o, F.col("own")))
        rows = rows.select("fp", "key", F.explode(blocks).alias("block"))
        rows = rows.select("fp", F.xxhash64("key", "block").alias("bucket"))
    else:
        rows = rows.select("fp", F.col("key").alias("bucket"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_bucket_forests(distance), "a long, b long")


# ---- components --------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component.

    Alternates large-star and small-star until the edges stay as they are.
    """

    def summary(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = summary(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(hung.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        is_ = summary(now)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprint_classes(fps: DataFrame, distance: int = 4, parts: int = 4, block_rows: int = 20_000) -> DataFrame:
    """(fp, root) for each fingerprint that has a link; ``fps`` has distinct fingerprints ``fp``."""
    fps = checkpoint(fps.select("fp"))
    found = components(find_links(fps, distance, parts, block_rows))
    roots = found.select(F.col("root").alias("fp"), "root").distinct()
    return found.select(F.col("node").alias("fp"), "root").unionByName(roots)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, parts: int = 4, block_rows: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    rows = checkpoint(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), ["doc_id"], "_t"))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("times"))
    found = checkpoint(fingerprint_classes(nodes, distance, parts, block_rows))
    # Only linked fingerprints meet by root, and one root may have most of them: the smallest ids come from partial minima, and
    # the tables they are looked up in are narrow, so they are broadcast while their counted rows allow it.
    linked = nodes.join(found, "fp")
    lows = checkpoint(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    named = nodes.join(sized_join(linked.select("fp", "root"), lows, "root").select("fp", "component_id"), "fp", "left")
    # A row that is alone with its fingerprint, which has no link, is its own component and needs no lookup.
    named = checkpoint(named.filter("times > 1 or component_id is not null").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return sized_join(rows, named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
