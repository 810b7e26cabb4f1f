import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.llm import queries, tokens
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabulary files")

ODD = ["", " ", "  a", "a ", "a  b", "a\n b", "a \n\n  b\t c", "don't  'll", "añ👍🏽 it's 𝒳y", "\x00 a", "a b c", "x\x1c y", "＃ 日本語のテキスト。", "é é", "0.818, 12%", "a" * 3000, " " * 500, "<|endoftext|> b"]


def whole(text):
    e = tokens.encoder()
    return e.tokenizer.encode(text, add_special_tokens=False).ids if text else []


def ids(text):
    return np.frombuffer(tokens.encoder().encode([text])[0], dtype=np.int32).tolist()


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert ids(text) == whole(text)
    assert tokens.encoder().decode(ids(text)) == text


pieces = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Zü", "'s", "12", "!?", "日本", "é", "👍", " ", "\r\n", "don't"]), max_size=20).map("".join)


@given(pieces)
@settings(max_examples=400, deadline=None)
def test_any_mixture_agrees_with_the_library(text):
    assert ids(text) == whole(text)


def test_documents_agree_with_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id] == whole(r.text)


def test_round_trip_query(spark):
    assert queries.p7_roundtrip(spark, SMALL).where("not same").count() == 0


def test_offsets_touch_the_characters_of_each_token():
    enc = tokens.encoder()
    for text in ODD:
        e = enc.tokenizer.encode(text, add_special_tokens=False)
        off = enc.offsets(text, e.ids)
        at = 0
        raw = text.encode()
        for (a, b), i in zip(off, e.ids):
            part = enc.bytes_of[i]
            assert raw[at : at + len(part)] == part
            assert len(text[:a].encode()) <= at and at + len(part) <= len(text[:b].encode())
            at += len(part)


def test_split_characters_are_marked_in_decoding():
    enc = tokens.encoder()
    i = ids("👍🏽")
    assert enc.decode(i[:1]).endswith("�") and enc.decode(i) == "👍🏽"
    assert enc.decode(None) is None and enc.decode([]) == ""


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a b")], "k long, t string")
    for c in ("ids", "key", "text", "n_tokens"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted((r.k, list(r.ids)) for r in tokens.encode_ids(df, "k", "t").collect())
    assert got == [(1, []), (2, []), (2, []), (3, whole("a b"))]
    assert sorted((r.k, r.n_tokens) for r in tokens.count_tokens(df, "k", "t").collect()) == [(1, 0), (2, 0), (2, 0), (3, 2)]
    assert tokens.encode_ids(df.limit(0), "k", "t").count() == 0


def test_the_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    enc = tokens.Encoder()
    rnd = random.Random(1)
    for _ in range(20):
        text = " ".join(str(rnd.random()) for _ in range(30))
        assert np.frombuffer(enc.encode([text])[0], np.int32).tolist() == whole(text)
        assert len(enc.seen) <= 50 + 30


def test_other_splitting_patterns_are_left_to_the_library():
    enc = tokens.Encoder(model="word_bpe_49k")
    texts = ["It's  a Test\n of 3 WORDS", "", None, "日本語 テキスト"]
    got = [np.frombuffer(b, np.int32).tolist() for b in enc.encode(texts)]
    assert got == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts] and not enc.seen
    with pytest.raises(ValueError):
        enc.decode(got[0])
    with pytest.raises(ValueError):
        enc.spans(texts[0], b"")


def test_long_chunks_are_not_remembered(monkeypatch):
    enc = tokens.Encoder()
    rnd = random.Random(2)
    kana = [chr(c) for c in range(0x3041, 0x3090)]
    texts = ["".join(rnd.choices(kana, k=300)) for _ in range(200)] + ["x" * 500 + str(i) for i in range(50)]
    assert [np.frombuffer(b, np.int32).tolist() for b in enc.encode(texts)] == [whole(t) for t in texts]
    assert not enc.seen and all(len(p) <= tokens.SHORT for p in enc.parts)
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000)
    for _ in range(20):
        enc.encode([" ".join(str(rnd.random()) for _ in range(30))])
        assert enc.held <= 20_000 + 30 * 2 * 300
    assert len(enc.seen) < 200


def test_offsets_of_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "k long, t string")
    got = {r.k: r for r in tokens.encode_spans(df, "k", "t").collect()}
    for i, t in enumerate(ODD):
        assert list(got[i].ids) == whole(t) and list(zip(got[i].starts, got[i].ends)) == tokens.encoder().offsets(t, whole(t))
    assert list(got[len(ODD)].starts) == [] and tokens.encode_spans(df.limit(0), "k", "t").count() == 0


def test_memory_on_distinct_texts_without_blanks():
    """A worker's memory stays bounded whatever the number of distinct texts."""
    import subprocess
    import sys

    code = """
import random, resource
from frameloom.llm import tokens
enc = tokens.Encoder(); enc.bytes_of; enc.encode(["warm"])
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rnd = random.Random(1); kana = [chr(c) for c in range(0x3041, 0x3090)]
for _ in range(100):
    enc.encode(["".join(rnd.choices(kana, k=60)) + "x" * 20 for _ in range(300)])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.getcwd(), env=os.environ, check=True)
    assert int(out.stdout) < 200_000  # kB
