import numpy as np
import zlib

from brindle.llm import quality_knn as Q

DOCS = "doc_id long, text string, score string, label int"


def test_cosines_and_votes_against_brute_force():
    rng = np.random.default_rng(0)
    texts = [(" ".join(rng.choice(["aa", "bb", "Cc"], 20)) if k % 3 else " ".join(rng.choice(["A!!", "B%%", "1-"], 20))).encode() for k in range(60)]
    labels = np.array([float(k % 3 > 0) for k in range(60)])
    vectors = np.stack([Q.terms(t) for t in texts])
    model = Q.Neighbours(vectors[:40], labels[:40], dimensions=8, neighbours=5)
    got = model.scores(texts[40:] + [b""], block=7)
    for text, score in zip(texts[40:], got):
        x = Q.terms(text) @ model.project
        cos = np.maximum((model.vectors @ x) / np.linalg.norm(x), 0)
        top = np.argsort(-cos, kind="stable")[:5]
        assert abs(score - (cos[top] ** 8 * labels[top]).sum() / (cos[top] ** 8).sum()) < 0.05
    assert abs(got[-1] - model.prior) < 1e-6
    assert ((got[:-1] >= 0.7) == (labels[40:] == 1)).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = Q.score_quality(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert out.score.between(0, 1).all()
    assert (out.predicted == out.quality).mean() > 0.95
    assert out[out.quality == 1].predicted.mean() > 0.97
    assert out[out.quality == 0].predicted.mean() < 0.25


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = [(1, "good text here", "clash", 1), (1, "good text here", "", 1), (2, "%%% ### %%%", "", 0), (3, None, "", 0), (4, "", "", 0), (None, "good text", "", 0), (5, "long " * 50000, "", 0)]
    got = Q.score_quality(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert Q.score_quality(spark.createDataFrame([], DOCS), labels).count() == 0
    none = Q.score_quality(spark.createDataFrame(rows, DOCS), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
