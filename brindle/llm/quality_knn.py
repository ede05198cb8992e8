"""Quality classifier: nearest-neighbour voting among labelled documents in a latent semantic space.

Terms are pairs of character classes of the UTF-8 bytes (letters by case, digits, blanks, line ends, each ASCII mark on its
own, the rest of UTF-8 by lead and trail bytes), and a few counts of shape: words equal to the one before, words seen
before, long and short lines.  A bounded sample of labelled rows (``max_labelled``) gives the inverse document frequencies
and the singular vectors; its latent vectors are broadcast.  Every document is projected, all cosines to the labelled
vectors are computed in blocks, and the ``neighbours`` nearest labels vote with weight max(cosine, 0) ** ``power``.

Null and empty texts, and all scores where no neighbour is similar at all, get the share of label 1.  Labels of rows whose
crc32 bucket is the held-out one are never read; a null id is not held out.  Null labels are ignored.  Repeated documents
get their own rows; repeated labels vote once per label and id.  Without labels the score is 0.5.  Only the id and the
text of a document are read.  Neighbours as near as the last one that votes vote too, so ties need no order; of labelled
documents of one id that of the smallest hash counts, so reruns agree.  An empty table gives an empty result.  A very long text is
one row of a task, some 20 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import byte_texts, crc_bucket, small_batches

MAX_LABELLED = 4000
DIMENSIONS = 64
NEIGHBOURS = 25
POWER = 8
PREDICT_FROM = 0.7


def _classes() -> tuple[np.ndarray, int]:
    """Byte to class, and the number of classes."""
    table = np.zeros(256, dtype=np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b] = 1
        elif b >= 0x80:
            table[b] = 2
        elif c.islower():
            table[b] = 3
        elif c.isupper():
            table[b] = 4
        elif c.isdigit():
            table[b] = 5
        elif c == "\n":
            table[b] = 6
        elif b in marks:
            table[b] = 8 + marks.index(b)
        else:
            table[b] = 7
    return table, 8 + len(marks)


CLASS_OF, CLASSES = _classes()
SHAPES = 6
TERMS = CLASSES * CLASSES + SHAPES


def terms(text: bytes) -> np.ndarray:
    """Damped shares of the terms of one text; zero for an empty one."""
    if not text:
        return np.zeros(TERMS, dtype=np.float32)
    classes = CLASS_OF[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    counts = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
    words = text.lower().split()
    n = max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    shapes = [same / n, (len(words) - len(set(words))) / n, again / max(len(lines), 1), len(words) < 10, sum(len(w) > 20 for w in words) / n, sum(len(w) < 3 for w in words) / n]
    return np.concatenate([np.sqrt(counts / len(text)), np.sqrt(np.array(shapes, dtype=float))]).astype(np.float32)


class Neighbours:
    """Labelled vectors in the latent space and the projection into it."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, power: int = POWER):
        self.labels, self.k, self.power = labels.astype(np.float32), neighbours, power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        n = len(labels)
        seen = (vectors > 0).sum(axis=0) if n else np.zeros(TERMS)
        idf = np.log((n + 1) / (seen + 1)) + 0.2
        weighted = vectors * idf
        _, _, basis = np.linalg.svd(weighted, full_matrices=False) if n else (0, 0, np.zeros((0, TERMS)))
        self.project = (basis[:dimensions].T * idf[:, None]).astype(np.float32)
        self.vectors = self._unit(vectors @ self.project)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        for at in range(0, len(texts), block):
            latent = self._unit(np.stack([terms(t) for t in texts[at : at + block]]) @ self.project)
            cosines = latent @ self.vectors.T
            # All that are as near as the k-th vote, so ties need no order.  Rounded, cosines do not depend on their block.
            cosines = np.round(cosines, 5)
            least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k]
            row, near = np.nonzero(cosines >= least[:, None])
            weights = np.maximum(cosines[row, near].astype(float), 0) ** self.power
            sums = np.bincount(row, weights=weights, minlength=len(latent))
            voted = np.bincount(row, weights=weights * self.labels[near], minlength=len(latent)) / np.maximum(sums, 1e-12)
            out[at : at + block] = np.where(sums > 1e-9, voted, self.prior)
        return np.clip(out, 0.0, 1.0)


def labelled_ids(labels: DataFrame, label_col: str, buckets: int, held_out: int, most: int, id_col: str = "doc_id") -> list[tuple]:
    """At most ``most`` (id, label), the same ones on every run: those whose hashed ids are smallest."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().distinct()
    own = own.filter(crc_bucket(F.col("doc_id"), buckets) != held_out)
    return [(r["doc_id"], r["label"]) for r in own.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "label").limit(most).collect()]


def labelled_rows(docs: DataFrame, chosen: list[tuple], id_type: T.DataType) -> DataFrame:
    """doc_id, label, t of the chosen documents; the list is bounded and broadcast."""
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("label", T.IntegerType())])
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, schema)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", buckets: int = 4, held_out: int = 2, max_labelled: int = MAX_LABELLED, **model) -> Neighbours:
    """``docs``: doc_id, t.  The collected vectors are bounded by ``max_labelled`` (of documents of one id, that of the smallest hash)."""
    chosen = labelled_ids(labels, label_col, buckets, held_out, max_labelled)
    rows = labelled_rows(docs, chosen, labels.schema["doc_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            vectors = [terms(t).astype(np.float16).tobytes() for t in byte_texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(vectors, pa.binary())], names=["label", "v"])

    found = rows.groupBy("doc_id", "label").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).select("label", "t").mapInArrow(run, "label int, v binary").orderBy(F.xxhash64("v")).collect()
    vectors = np.array([np.frombuffer(r["v"], dtype=np.float16) for r in found], dtype=np.float32).reshape(-1, TERMS)
    return Neighbours(vectors, np.array([r["label"] for r in found], dtype=float), **model)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 4, held_out: int = 2, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label_col, buckets, held_out, max_labelled))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = shared.value.scores(byte_texts(batch, "t"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    aside = F.coalesce(crc_bucket(F.col("doc_id"), buckets) == held_out, F.lit(False))
    return scored.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
