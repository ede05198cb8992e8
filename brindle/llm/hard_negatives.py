"""Hard negatives: for each anchor and positive, the nearest rows of other labels within a share of the positive's score.

Distributed radix selection.  A (anchor, positive) pair has a window of integer scores.  A pass over all rows counts the scores of
each window by the leading digit of their distance from the window's upper end; the counts locate the bucket of the last score
wanted, and the next pass counts the next digit within that bucket, until one score is left.  Only then are rows gathered: those above that
score, and of those at it the ones with the smallest ids that a task saw, so a task sends as many rows of a window as are wanted at
most.  Counts below a task's own last wanted score cannot matter and are not sent.

Anchors are a stated query set: they go to the tasks in blocks of about ``block`` (4 MB at 64 components), and each block is some passes over
all rows, in batches.  Nothing is joined by label, so a label with a third of all rows is as good as any.

Rows with a null id, label or vector, and those with null or non-finite components, take no part.  Vectors of different lengths are
multiplied as if filled up with zeros; an empty vector scores 0.  Scores are exact; those that do not fit 64 bits stop at the
ends of them.  Rows are told apart by their place in the files, so a repeated row is one more row, also for an anchor: its copy is
another row of its label.  Ties go to the smaller id; rows that tie in both are alike in what is returned.  Anchors without a row of their label, and
positives without a row in the window, return nothing; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import from_files, materialise, place_of

#: Rows of a batch and anchors whose products are held at a time; bits of a digit.
BATCH, TILE, DIGIT = 1024, 1024, 8
#: Beyond the range in which sums of doubles are exact, products are taken one by one in whole numbers.
EXACT = float(1 << 53)

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Rows:
    """A batch: places, ids, labels and the vectors, scaled to whole numbers."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = lambda name: np.asarray(batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy())
        self.file, self.row, self.id, self.label = column("file"), column("row"), column("vec_id"), column("label")
        vectors = batch.column("v").combine_chunks() if isinstance(batch, pa.Table) else batch.column("v")
        if isinstance(vectors, pa.ChunkedArray):
            vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], pa.list_(pa.float64()))
        sizes = np.diff(np.asarray(vectors.offsets))
        values = np.asarray(vectors.flatten(), dtype=np.float64)
        self.v = np.zeros((len(sizes), int(sizes.max(initial=0))))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            self.v[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - first] = np.clip(np.floor(256 * values), -np.finfo(float).max, np.finfo(float).max)

    def __len__(self) -> int:
        return len(self.id)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows of ``a`` with all rows of ``b``."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = np.sqrt(EXACT / max(d, 1))
    big_a, big_b = ((np.abs(x) > most).any(axis=1) for x in (a, b))
    if not (big_a.any() or big_b.any()):
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(~big_a, ~big_b)] = a[~big_a] @ b[~big_b].T
    ends = np.iinfo(np.int64)
    exact = lambda x, y: min(max(sum(int(p) * int(q) for p, q in zip(x, y)), ends.min), ends.max)
    for i in np.flatnonzero(big_a):
        out[i] = [exact(a[i], y) for y in b]
    for j in np.flatnonzero(big_b):
        out[:, j] = [exact(x, b[j]) for x in a]
    return out


def leading(group: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first ``k`` of each group; ``order``: keys, the first one weighs most."""
    at = np.lexsort([*reversed(order), group])
    g = group[at]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    return at[np.arange(len(g)) - np.repeat(first, np.diff(first, append=len(g))) < k]


class Best:
    """The best ``k`` (score, id) of every one of ``n`` groups among those added."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.group = self.score = self.id = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        near = score >= self.least[group]
        if not near.any():
            return
        g, s, i = (np.concatenate(pair) for pair in ((self.group, group[near]), (self.score, score[near]), (self.id, ids[near])))
        at = leading(g, [np.invert(s), i], self.k)  # ~s orders like -s, also at the lower end of 64 bits
        self.group, self.score, self.id = g[at], s[at], i[at]
        size = np.bincount(self.group, minlength=len(self.least))
        last = np.cumsum(size) - 1
        full = size == self.k
        self.least[full] = self.score[last[full]]


class Windows:
    """Score windows of a block of anchors, in the order of the anchors."""

    def __init__(self, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray, low: int, high: int, k: int):
        ends = [(-(-low * int(p) // 100), high * int(p) // 100) for p in score]
        self.anchor, self.positive, self.score = anchor, positive, score
        self.low, self.high = (np.array([e[j] for e in ends], np.int64) for j in (0, 1))
        self.need = np.full(len(score), k)  # rows wanted from the bucket that the digits so far name
        self.prefix = np.zeros(len(score), np.uint64)
        self.open = self.high >= self.low  # not settled: False where the window holds fewer rows than wanted, or none can
        self.least = self.low.copy()  # the last wanted score, once settled

    def of_anchors(self, count: int) -> np.ndarray:
        """By anchor and number, the windows; -1 beyond an anchor's last."""
        number = np.arange(len(self.anchor)) - np.searchsorted(self.anchor, self.anchor)
        out = np.full((count, int(number.max(initial=-1)) + 1), -1)
        out[self.anchor, number] = np.arange(len(self.anchor))
        return out


def _tiles(batches: Iterable[pa.RecordBatch], anchors: Rows) -> Iterator[tuple[int, Rows, np.ndarray, np.ndarray]]:
    """(first anchor, rows, their scores with the tile's anchors, whether labels are the same)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            rows = Rows(batch.slice(at, BATCH))
            for a in range(0, len(anchors), TILE):
                b = slice(a, a + TILE)
                yield a, rows, inner(anchors.v[b], rows.v), anchors.label[b, None] == rows.label


def _in_windows(batches, anchors: Rows, w: Windows, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, scores, ids) of rows of other labels with scores from ``low`` to the windows' ends."""
    of, ends = w.of_anchors(len(anchors)), np.iinfo(np.int64)
    lowest, highest = np.full(len(anchors), ends.max), np.full(len(anchors), ends.min)
    np.minimum.at(lowest, w.anchor, low)
    np.maximum.at(highest, w.anchor, w.high)
    for first, rows, score, same in _tiles(batches, anchors):
        some = ~same & (score >= lowest[first : first + TILE, None]) & (score <= highest[first : first + TILE, None])
        a, r = np.nonzero(some)
        s = score[a, r]
        for column in of.T:
            window = column[a + first]
            held = np.flatnonzero(window >= 0)
            held = held[(s[held] >= low[window[held]]) & (s[held] <= w.high[window[held]])]
            if len(held):
                yield window[held], s[held], rows.id[r[held]]


def _table(columns: dict[str, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _over(rows: DataFrame, task: Callable, shared, ddl: str) -> DataFrame:
    """``task(batches, *shared)`` gives columns by name, once a task."""
    held = rows.sparkSession.sparkContext.broadcast(shared)
    schema = pa.schema([(part.split()[0], pa.int64()) for part in ddl.split(", ")])
    return rows.mapInArrow(lambda batches: _table(task(batches, *held.value), schema), ddl)


def _positives(batches, anchors: Rows, k: int) -> dict[str, np.ndarray]:
    best = Best(len(anchors), k)
    for first, rows, score, same in _tiles(batches, anchors):
        b = slice(first, first + TILE)
        a, r = np.nonzero(same & ((anchors.row[b, None] != rows.row) | (anchors.file[b, None] != rows.file)) & (score >= best.least[b, None]))
        best.add(a + first, score[a, r], rows.id[r])
    return {"anchor": best.group, "score": best.score, "id": best.id}


def _digits(batches, anchors: Rows, w: Windows, shift: int, k: int) -> dict[str, np.ndarray]:
    """Counts of one digit in every open window, by window and bucket; none below the task's own last wanted one."""
    counts = np.zeros((len(w.anchor), 1 << DIGIT), np.int64)
    low = np.where(w.open, w.low, np.iinfo(np.int64).max)
    for window, score, _ in _in_windows(batches, anchors, w, low):
        away = (w.high[window] - score).astype(np.uint64)
        mine = (away >> np.uint64(shift)) >> np.uint64(DIGIT) == w.prefix[window]
        bucket = (away[mine] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
        np.add.at(counts, (window[mine], bucket.astype(np.int64)), 1)
    before = np.cumsum(counts, axis=1) - counts
    window, bucket = np.nonzero((counts > 0) & (before < w.need[:, None]))
    return {"window": window, "need": w.need[window], "bucket": bucket, "n": counts[window, bucket]}


def _gather(batches, anchors: Rows, w: Windows, k: int) -> dict[str, np.ndarray]:
    best = Best(len(w.anchor), k)
    for window, score, ids in _in_windows(batches, anchors, w, np.where(w.high >= w.low, w.least, np.iinfo(np.int64).max)):
        best.add(window, score, ids)
    a = w.anchor[best.group]
    return {"window": best.group, "anchor_id": anchors.id[a], "positive_id": w.positive[best.group], "negative_id": best.id, "positive_score": w.score[best.group], "negative_score": best.score}


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a frame whose size the block bounds."""
    table = df.select(*names).toArrow()
    return [table.column(c).to_numpy() for c in names]


def _block(rows: DataFrame, anchors: Rows, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    found = _over(rows, lambda batches, a: _positives(batches, a, n_positives), (anchors,), "anchor long, score long, id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    anchor, score, ids = _columns(found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n_positives).orderBy("anchor", "_r"), "anchor", "score", "id")
    w = Windows(anchor, ids, score, low, high, n_negatives)
    width = max((int(h) - int(lo) for h, lo, o in zip(w.high, w.low, w.open) if o), default=0)
    for digit in reversed(range(-(-width.bit_length() // DIGIT))):
        shift = digit * DIGIT
        counts = _over(rows, lambda batches, a, w, s: _digits(batches, a, w, s, n_negatives), (anchors, w, shift), "window long, need long, bucket long, n long")
        upto = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))
        last = counts.groupBy("window", "need", "bucket").agg(F.sum("n").alias("n")).withColumn("_upto", upto).filter("_upto >= need and _upto - n < need")
        window, bucket, before = _columns(last.withColumn("_before", F.col("_upto") - F.col("n")), "window", "bucket", "_before")
        w.open = np.zeros(len(w.anchor), bool)  # a window without such a bucket holds fewer rows than wanted: all of them count
        w.open[window] = True
        w.prefix[window] = (w.prefix[window] << np.uint64(DIGIT)) | bucket.astype(np.uint64)
        w.need[window] -= before
    settled = w.open & (width > 0)
    w.least[settled] = w.high[settled] - w.prefix[settled].astype(np.int64)
    out = _over(rows, lambda batches, a, w: _gather(batches, a, w, n_negatives), (anchors, w), "window long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("window").orderBy(F.desc("negative_score"), "negative_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block: int = 8192
) -> DataFrame:
    """For each anchor and each of its first ``n_positives`` rows of the same label: the first ``n_negatives`` rows of other labels
    with ``low`` to ``high`` percent of the positive's score."""
    vectors = from_files(vectors)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    place = place_of(vectors)
    rows = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & finite)
    rows = rows.select(place["file"].alias("file"), place["row"].alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"), is_anchor.alias("is_anchor"))
    anchors = materialise(rows.filter("is_anchor"))
    blocks = -(-anchors.count() // block)
    out = vectors.sparkSession.createDataFrame([], OUT)
    for b in range(blocks):
        held = anchors.filter(F.pmod(F.xxhash64("file", "row"), F.lit(blocks)) == b).drop("is_anchor")
        found = _block(rows.drop("is_anchor"), Rows(held.toArrow()), n_positives, n_negatives, low, high)
        out = found if blocks == 1 else out.unionByName(materialise(found))
    return out


def noisy_label(id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> Column:
    """The label, the next one for ids divisible by ``every``."""
    return F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))


#: The same for DuckDB.
ORACLE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.rid <> b.rid),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, id) <= 5),
neg AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM pos p JOIN s n ON n.arid = p.arid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
