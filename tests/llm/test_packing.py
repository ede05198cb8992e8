import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing
from brindle.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
DDL = "doc_id long, text string, ids string, n int"


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, docs, window):
    """Each id lies in one piece, sequences have no gaps, and only few tokens of padding are needed."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, ids in docs.items():
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, by_sequence


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_parts_give_what_whole_texts_give(spark, tokenizer):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    rng = random.Random(1)
    signs = ["a", "É", "é", " ", "́", "\x1c", "\x85", "\xa0", " ", "\n", "\t", "'s", "'", "Σ", "ΣΣ ", "İ", "1", "٣", "日", "<|endoftext|>", "<|startoftext|> ", "🙂", "‍", "ﬁ", "ẛ̣", "-", "\r\n", "\x0b"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    latin = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x250)]]
    texts += ["".join(rng.choice(latin + [" "] * 40 + ["'s", "'LL"]) for _ in range(40)) for _ in range(3000)]
    encode = packing.Encoder(PATH, packing.width_of(PATH))
    for text in texts:
        if text is not None:
            assert np.frombuffer(encode(text.encode()), np.uint16).tolist() == encoded(tokenizer, text)[:-1], repr(text)


def test_packs_whole_table(spark, tokenizer):
    docs = {r.doc_id: encoded(tokenizer, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    pieces = packing.pack(table(spark, "/root/testdata/sf0.01", "documents"), PATH, with_ids=False).collect()
    padding, sequences = check(pieces, docs, 4096)
    assert padding == 0
    cut = len(pieces) - len(docs)
    assert cut <= sum(len(x) // 4096 for x in docs.values()) + len(sequences) + 12


@pytest.mark.parametrize("shard_tokens", [1 << 20, 300])
def test_odd_rows(spark, tokenizer, shard_tokens):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red", "blue", "Éclair", "fox", "of"]) for _ in range(rng.choice([0, 3, 40, 63, 64, 65, 200]))), "x", 0) for i in range(200)]
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "long " * 5000, None, None), (1003, "x" * 20000, None, None), (None, "no id", None, None)]
    pieces = packing.pack(spark.createDataFrame(rows, DDL).repartition(3), PATH, window=64, shard_tokens=shard_tokens).collect()
    padding, _ = check(pieces, {r[0]: encoded(tokenizer, r[1]) for r in rows}, 64)
    assert padding == 0
    for p in pieces:
        assert len(p.ids) == 2 * p.length


def test_empty_table_and_repeated_rows(spark, tokenizer):
    assert packing.pack(spark.createDataFrame([], DDL), PATH).collect() == []
    pieces = packing.pack(spark.createDataFrame([(1, "red fox", None, None)] * 5, DDL), PATH, window=4).collect()
    assert sum(p.length for p in pieces) == 15 and {p.doc_tokens for p in pieces} == {3}


def test_index_scores_as_by_the_formula_and_neighbours_share_windows():
    rng = np.random.default_rng(3)
    topics = [rng.permutation(400)[:60] for _ in range(6)]
    which = rng.integers(0, 6, 120)
    ids = [rng.choice(topics[t], 40).astype(np.uint16) for t in which]
    idf, mean = rng.random(400), 40.0
    shard = packing.Shard(ids, idf, mean)
    for seed in (0, 7):
        want = []
        for d in ids:
            tf = np.bincount(d, minlength=400)
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.unique(ids[seed])))
        assert np.allclose(shard.scores(seed), want, rtol=1e-5)
    same = [len({which[d] for d, _ in taken}) for taken in shard.windows(160)]
    assert np.mean(same) < 2  # four documents chosen at random lie in three topics


def test_other_vocabularies_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.Encoder(PATH, np.dtype(np.uint16)).by_part and not packing.Encoder(path, np.dtype(np.uint16)).by_part
    rows = [(1, " The red  fox", None, None), (2, None, None, None)]
    other = Tokenizer.from_file(path)
    pieces = packing.pack(spark.createDataFrame(rows, DDL), path, window=16).collect()
    check(pieces, {1: encoded(other, rows[0][1]), 2: [2]}, 16)


def test_powers():
    assert packing.powers(13) == [8, 4, 1] and packing.powers(0) == []
