import re

import pyarrow.parquet as pq
from test_decontaminate import slow as slow_hits
from test_near_copies import slow_classes
from test_quality_rules import slow as slow_quality
from test_secrets import slow_base

import corpus_pipeline as P


def test_stages_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{d}/benchmark.parquet").to_pylist()]
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) > 0
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert all(not slow_quality(r.text)[-1] for r in rows)
            lost = [r for i, r in before.items() if i not in after]
            assert all(slow_quality(r.text)[-1] or len(re.findall(r"[#*$%&|<>!]", r.text)) > 10 or r.text.upper() == r.text for r in lost)
        if k == 1:
            ids = sorted(before)
            assert set(after) == {ids[k] for k in slow_classes([before[i].text for i in ids])}
        if k == 2:
            for i, r in before.items():
                n, hit, _ = slow_hits(r.text, items)
                if not hit:
                    assert after[i] == r
                elif i in after:
                    assert slow_hits(after[i].text, items)[1] == 0 and after[i].n_chars == len(after[i].text)
                else:
                    assert 2 * hit > n
        if k == 3:
            assert set(after) == set(before)
            for i, r in before.items():
                assert not [s for s in slow_base(after[i].text) if s[3] != "assign"]
                assert slow_base(r.text) or "[SECRET]" in after[i].text or after[i] == r
        if k == 4:
            assert all(r.copies in (1, 2) and r.text == before[i].text for i, r in after.items())
        before = after


def test_run_is_the_chain_of_stages(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert "copies" in out.columns and 0 < out.count() <= 200
