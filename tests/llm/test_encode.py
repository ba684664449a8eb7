"""Ids against the library on texts as they are."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseflow.llm import encode, textbuf

PATH = encode.vocabulary()
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True
ENC = encode.Encoder(PATH)


def same(texts):
    data, offsets = textbuf.buffers(pa.array(texts, pa.string()))
    ids, bounds = ENC.encode(data, offsets)
    for i, t in enumerate(texts):
        want = LIB.encode(t or "", add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want, repr(t)


def test_cases():
    same([None, "", " ", "  ", "\n", " \n ", "a", " a", "  a", "\n\na b", "don't I'm we'll you've they're he'd it's 's''s 'S", "x 's", "x\n's", "'sabc'rex'vey", "a'", "'",
          "'l", "'ll", "1'2'3's", "<|endoftext|>", "!!''s", "a b   c", "　x", "日本語 text", "é ü ß́", "٣٤ 12a b", "😀😀 x", " a b\u0085c\x1cd\x1fe", "w" * 5000, "a\t\tb \t c",
          "end  ", "end \n", " ' ", " 't x't", "x''t"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevlmdS 12!?\n\t é́٣​日😀.")), max_size=40), max_size=4))
def test_any_text(texts):
    same(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=3))
def test_any_character(texts):
    same(texts)


def test_tables_and_a_full_cache(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    random.Random(1).shuffle(texts)
    same(texts)
    monkeypatch.setattr(encode, "KEPT", 500)
    monkeypatch.setattr(textbuf, "CHUNK", 20_000)
    same(texts)
    assert ENC.dtype == np.uint16
