"""The encoder against the tokenizers library, on whole tables and odd texts."""

import hashlib
import struct

import public_tokenizers
from tokenizers import Tokenizer

from noticeflow.llm import bpe
from noticeflow.llm.queries import op1_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "a", "Aa'S it's 12 34!!", "x" * 5000, "ab" * 3000, "<|startoftext|>hi <|endoftext|>", "<|endoftext",
       "ΣΑΣ Σ ΑΣ", "İstanbul", "étude ﬁ", "\x1c\x1d a\x1fb \x85c d e", "漢字かな 😀👩‍👩‍👧", "a\x00b", "  lead", "İΣΣ !?...",
       "don't we'll I'D", "½ ² Ⅳ 1234567890"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_odd_texts_equal_the_library():
    own = bpe.Bpe(PATH)
    for text, (ids, decoded) in zip(ODD, library(ODD)):
        got = own.encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, text
        assert own.decode(got) == decoded, text


def test_whole_table_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: (len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
            for r, (i, x) in zip(rows, library([r[1] for r in rows]))}
    assert {r[0]: tuple(r[1:]) for r in op1_bpe(spark, d).collect()} == want


def test_rows_repeated_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z")], "doc_id long, text string, ids string")
    got = bpe.encode_decode(df, PATH).select("doc_id", "n_tokens", "decoded").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, "a</w> b</w>"), (1, 2, "a</w> b</w>"), (None, 0, "")], key=str)
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0
