import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(0, 10_000))
def test_cuts_cover_the_length(n):
    parts = packing.cuts(n)
    assert sum(x for _, x in parts) == n
    assert all(k * x <= packing.CAPACITY for k, x in parts)


@given(st.one_of(st.text(), st.text(st.characters(max_codepoint=255)), st.lists(st.sampled_from(["Word", "word.", "word,", "É", "..", "<|", "endoftext", "|>", " ", "\x1c", "\x85", "\xa0", "\t", "x2", "'s", "ab%%%", "c.,", "#", "_"])).map("".join)))
def test_chunks_encode_like_whole_text(text):
    whole = packing.tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.worker_words(PATH).encode([text])[0], "<u4").tolist() == whole


@pytest.mark.parametrize("text", ["a b\x1cc", "it's <|endoftext|>x  y", "É é\nß 12", "a\x85b c\u3000d", "<|endoftext|>", "<|ENDOFTEXT|> a", "ÀÞ×÷ßÿ ªº µ", "a\xa0b\x1cc\x1fd", "Σας œuf"])
def test_chunks_encode_like_whole_text_cases(text):
    whole = packing.tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.worker_words(PATH).encode([text])[0], "<u4").tolist() == whole


def test_round_trip(spark):
    texts = {0: "one two three " * 5000, 1: "", 2: None, 3: "a b", 4: "a b", 5: "word " * 1500}
    texts |= {i: "x y z " * (i * 7 % 600) for i in range(6, 120)}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(3, "a b", 2)], "doc_id long, text string, length int")
    rows = packing.pack(docs.repartition(5), PATH).collect()
    enc = packing.tokenizer(PATH)
    whole = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert np.frombuffer(r.ids, "<u4").tolist() == whole[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(whole[r.doc_id])
    for i, ids in whole.items():
        assert sum(r.length for r in by_doc[i]) == len(ids) * (2 if i == 3 else 1)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert sorted(seqs) == list(range(len(seqs)))
    # few places are left empty: what is padded is a small share
    assert len(seqs) * packing.CAPACITY <= 1.05 * sum(map(len, whole.values())) + 3 * packing.CAPACITY


def test_digest_and_null_ids(spark):
    from pyspark.sql import functions as F

    texts = [(None, "one two"), (2**53 + 1, "three " * 3000), (2**53 + 3, None), (None, "four")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, PATH, of_ids=F.crc32("ids").alias("ids_crc32")).collect()
    enc = packing.tokenizer(PATH)
    whole = [(i, np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in texts]
    want = {(i, r.start, r.length, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for i, ids in whole for r in rows if r.doc_id == i and r.doc_tokens == len(ids)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert sum(r.doc_id is None for r in rows) >= 2 and all(r.ids_crc32 >= 0 for r in rows)


@given(st.integers(1, packing.CAPACITY))
def test_a_class_is_filled_to_its_slack_unless_the_piece_is_short(n):
    for k, x in packing.cuts(n):
        assert x < packing.SHORT or packing.CAPACITY // k - x <= packing.SLACK * x + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
