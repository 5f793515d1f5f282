import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("json", "tiktoken"))
HARD = ["", " ", "<|endoftext|>", "a b\r\n\t x", "ÉÀ ß 漢字 🙂🙂 é", "1234567 don't WE'RE", "x" * 3000, "\n\n\n  \n a", "​﻿ q"]


@lru_cache
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def reference(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_ranks_give_the_ids_of_the_tokenizers_file(spark):
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, packing.encode(texts, RANKS)):
        assert list(ids) == reference(text)


SPECIAL = ["<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> b", "<|endoftext|> at both ends <|endoftext|>", "wo<|endoftext|>rd don'<|endoftext|>t",
           " <|endoftext|>\n\n<|endoftext|>  x", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "12<|endoftext|>34 é<|endoftext|>漢"]


def test_added_tokens_follow_the_file_with_its_own_settings(spark):
    """Contract ids: the tokenizers file as it is, add_special_tokens=False, no other setting."""
    added, plain = packing.added_tokens(JSON), Tokenizer.from_file(JSON)
    assert added == (("<|endoftext|>", 50256),)
    texts = SPECIAL + HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert want[2] == [64, 220, 50256, 275, 0]
    assert [list(x) for x in packing.encode(texts, RANKS, added)] == want
    assert [list(x) for x in packing.encode(texts, JSON, added)] == want
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(SPECIAL)], "doc_id long, source string, text string")
    got = defaultdict(list)
    for r in packing.pack(rows, RANKS, length=8, with_ids=True, added=added).orderBy("start").collect():
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert [got[i] for i in range(len(SPECIAL))] == want[:len(SPECIAL)]


@pytest.mark.parametrize("shares", [None, {"a": 0.7, None: 0.3}])
def test_pieces_cover_every_id_once_and_windows_keep_the_mixture(spark, shares):
    words = "of the tion and with reading an other thing".split()
    rows = [(i, "ab"[i % 3 % 2] if i % 7 else None, " ".join(words[(i * k) % 9] for k in range(i % 40))) for i in range(400)]
    rows += [(900, "a", None), (900, "a", None), (None, "long", "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("start", F.lit("clash"))
    got = packing.pack(df, RANKS, length=128, window=1024, shares=shares, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for s, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
        assert sum(n for _, n in parts) == 128 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    for i, _, text in rows:
        mine = sorted(docs[i], key=lambda r: (r.start, r.sequence_id))
        want = reference(text)
        if i == 900:
            assert [bytes(r.ids) for r in mine] == [b"\0\0\0\0"] * 2
        else:
            assert list(np.frombuffer(b"".join(r.ids for r in mine), "<u4")) == want and all(r.doc_tokens == len(want) for r in mine)


def test_deficits_are_carried(spark):
    rows = [(i, "a" if i < 600 else "b", 10 + i % 90) for i in range(800)]
    df = spark.createDataFrame(rows, "rid long, source_key string, tokens long")
    got = packing.schedule(df, window=1000).toPandas().merge(df.toPandas(), on="rid").sort_values("place")
    assert list(got.place) == list(np.cumsum([0, *got.tokens])[:-1])
    share = got[got.source_key == "a"].tokens.sum() / got.tokens.sum()
    for w in range(1, int(got.window.max())):
        sent = got[(got.window <= w) & (got.source_key == "a")].tokens.sum()
        assert 0 <= w * 1000 * share - sent + 1e-6 < 100  # behind the target by less than one document


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, source string, text string"), RANKS).count() == 0
