"""Byte-level BPE against the library that made the vocabulary."""

import hashlib
import random

import pytest

from lodestar.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    odd = " \t\n\r\x0b\x0c\x00\x1c\x1f\x85\xa0 　'stredvlm09²½Ⅷ一Aé́ß日😀‍_-.,!" + bpe.unknown_letters()[:40]
    out = ["", " ", "  a", "a  ", "'s'S 're", "x<|endoftext|>y <|endoftext|>", "<|endoftext|><|endoftext|>", "a" * 3000, "ab" * 900 + " x", "é" * 300, "!" * 1000]
    out += ["".join(rng.choices(odd, k=rng.randint(0, 40))) for _ in range(3000)]
    return out + ["".join(chr(c) for c in (rng.randint(0, 0x10FFFF) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(300)]


def test_tokens_match_the_library(library):
    enc, all_texts = bpe.Encoder(bpe.default_vocabulary(), bpe.unknown_letters(), remember=500), texts()
    for k in range(0, len(all_texts), 97):  # in batches, with a memory that is given up again and again
        part = all_texts[k : k + 97]
        for t, got, want in zip(part, enc.encoded(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            ids = [int(i) for p in got for i in p[0].split(",")]
            assert ids == want.ids, t
            assert b"".join(p[1] for p in got).decode() == enc.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_matrix_and_heap_agree():
    enc, rng = bpe.Encoder(bpe.default_vocabulary()), random.Random(6)
    words = [bytes(rng.choices(b"aehinrst", k=rng.randint(1, bpe.SHORT))) for _ in range(500)]
    assert enc.merge_words(words) == [enc.long_word(w) for w in words]


def test_known_words_are_not_merged_again(library, monkeypatch):
    enc, merged = bpe.Encoder(bpe.default_vocabulary()), []
    plain = enc.merge_words
    monkeypatch.setattr(enc, "merge_words", lambda words: merged.extend(words) or plain(words))
    enc.encoded([" alpha beta gamma$$$ " + " delta" * 30])
    merged.clear()
    text = " alpha$$$ beta.gamma gamma$$$"  # stretches never met, of which one word is new
    assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert sorted(merged) == [b".", b"gamma"]


def test_incomplete_characters_are_replaced(library):
    enc = bpe.Encoder(bpe.default_vocabulary())
    for ids in ([int(enc.single[0xE6])], [int(enc.single[0xE6]), int(enc.single[0x41])], enc.encode("日本")[:2]):
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, sf, library):
    odd = spark.createDataFrame([(1, None, 7), (1, "", 7), (None, "a b", 7), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_texts(odd, bpe.default_vocabulary(), keep_ids=True)
    empty = hashlib.sha256(b"").hexdigest()
    two = library.encode("a b", add_special_tokens=False).ids
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids) for r in got.collect()) == [(0, 2, two), (1, 0, []), (1, 0, []), (2, 2, two), (2, 2, two)]
    assert {(r.ids_sha256, r.decoded_sha256) for r in got.where("n_tokens = 0").collect()} == {(empty, empty)}
    assert bpe.encode_texts(odd.limit(0), bpe.default_vocabulary()).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    for r in bpe.op12_bpe(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest())
