import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        return op1_bpe.ForcedBoundaryBpe(f.read()), Tokenizer.from_file(PATH)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_same_as_library(pair, text):
    mine, theirs = pair
    ids = mine.encode(text)
    assert ids == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "a" * 30000, "<|endoftext|> x <|endoftext|>", "ab\u0085\x1c c", "don't WE'LL 's", "\n\n \t x  ", "日本語 ½²", "é‍", "qzxjqzxj" * 500, "0123456789" * 900])
def test_hard_texts(pair, text):
    mine, theirs = pair
    ids = mine.encode(text)
    assert ids == theirs.encode(text, add_special_tokens=False).ids and mine.decode(ids) == text


def test_every_code_point(pair):
    """After a letter, a digit, a mark and a space, as the library reads it."""
    mine, theirs = pair
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["\n".join(f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == want.ids, hex(ord(text[1]))


@pytest.mark.parametrize("setting", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "use_regex": False}}])
def test_other_settings_are_refused(setting):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        op1_bpe.ForcedBoundaryBpe(json.dumps(spec | setting))


def test_prefix_space():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    mine, theirs = op1_bpe.ForcedBoundaryBpe(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    for text in ("word", " word", "\nword", "a<|endoftext|>b"):
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain(pair):
    mine, _ = pair
    pieces = mine.fragments(b"ab\xff\x00qqzj")
    assert b"".join(pieces) == b"ab\xff\x00qqzj" and len(pieces) > 1
    for a, b in zip(pieces, pieces[1:]):
        assert (a[-1], b[0]) not in mine.joinable


def test_table(spark):
    rows = [(1, "the cat", "x"), (2, None, None), (None, "", "y"), (2, None, None)]
    got = op1_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH)
    out = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["n_tokens"] for r in out] == [2, 0, 0, 0] and out[0]["decoded"] == "the cat"
    assert out[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, out[0]["ids"])).encode()).hexdigest()
    assert out[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert op1_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
