"""The registered queries on the smallest tables: against DuckDB where SQL can say it, else against brute force."""

import hashlib
import math
import os
from collections import Counter

import duckdb
import pytest
from test_lm_score import held, tokens
from test_secrets import slow_base
from test_simhash import slow_components, slow_fingerprint

from brindle.llm import queries

DIR = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = con.sql(queries.oracle_sql()[name])
    names = list(result.columns)
    want = [tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in result.fetchall()]
    assert sorted(names) == columns and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_simhash_query(spark, texts):
    got = queries.op1_simhash_dedup(spark, DIR).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == slow_components([(i, slow_fingerprint(t)) for i, t in texts.items()])


def test_secret_query(spark, texts):
    for r in queries.op2_secret_scan(spark, DIR).collect():
        want = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))


def test_language_model_query(spark, texts):
    counts = Counter(w for i, t in texts.items() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in queries.op6_lm_score(spark, DIR).collect():
        ws = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


@pytest.mark.parametrize("name", ["op4_quality_knn", "op10_toxicity"])
def test_score_queries_cover_every_row(spark, texts, name):
    got = queries.queries()[name](spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
