"""BPE encoding against the tokenizers library, decoding by round trip."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import ledgerops.llm.bpe as B
from conftest import SF_SMALL
from ledgerops.llm.common import read_table
from odd_rows import no_docs, odd_docs  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", " a", "a \n b", "x \n", "x\n ", "x   y", "\n \n", "\r\n \r\n a", "a ", "\t\tx\t y",
       "<|endoftext|>a <|endoftext|>", "a<|endoftext|> b <|endoftext", "I'll we've 'S it's", "a" * 500, "ab " * 300,
       "12½²³ Ⅷ٣ 1a", "日本語 テキスト🙂👍🏽", "á b‍", "\x1c \x1d a\x85b \xa0 c", "a  　b",
       "࢏ Ᲊ Ɤ ՘", "\U0003d000x \U000e0001", "x\x00y\x7f", "ß" * 200 + " " + "é1" * 90]


@pytest.fixture(scope="module")
def vocabulary():
    return B.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def lexicon(vocabulary, words):
    return B.Lexicon(B.compile_lexicon([(w, tuple(B.merge_word(w, vocabulary["byte"], vocabulary["merge"])))
                                        for w in sorted(set(words))]))


def test_lexicon_holds_its_words_and_no_others(vocabulary):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))).encode() for _ in range(800)}
    held, other = set(list(words)[:500]), set(list(words)[500:])
    lex = lexicon(vocabulary, held)
    for w in held:
        assert lex.lookup(w) == B.merge_word(w, vocabulary["byte"], vocabulary["merge"])
    assert all(lex.lookup(w) is None for w in other) and lex.lookup(b"") is None
    # shared suffixes: fewer states than a tree of the words has
    assert len(lex.final_size) < len({w[:i] for w in held for i in range(len(w) + 1)})


def test_texts_match_the_library(vocabulary, library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(" \n\tabé'.,1日") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for lex in (None, lexicon(vocabulary, [b" a", b"ab", " é".encode(), b" abab"])):
        got = B.Encoder(vocabulary, lex).encode(texts)
        for t, ids in zip(texts, got):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want, repr(t)
            assert B.decode_ids(want, vocabulary["tokens"]) == library.decode(want, skip_special_tokens=False)


def test_bulk_merge_equals_word_by_word(vocabulary):
    rng = random.Random(3)
    words = ["".join(rng.choice("aaaabthe r") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)]
    got = B.merge_words(words, np.array(vocabulary["byte"], np.int64), B.merge_tables(vocabulary["merge"]))
    for w, ids in zip(words, got):
        assert np.frombuffer(ids, np.int32).tolist() == B.merge_word(w, vocabulary["byte"], vocabulary["merge"])
    long = b"thethe" * 60
    short_way = B.merge_words([long], np.array(vocabulary["byte"], np.int64), B.merge_tables(vocabulary["merge"]))[0]
    assert np.frombuffer(short_way, np.int32).tolist() == B.merge_word(long, vocabulary["byte"], vocabulary["merge"])


def test_small_cache_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 5)
    encoder = B.Encoder(vocabulary, None)
    for text in ["one two three four five six seven eight", "two nine ten one"] * 2:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_matches_the_library(spark, library):
    got = {r["doc_id"]: r for r in B.op5_bpe_encode_decode(spark, SF_SMALL).collect()}
    for r in read_table(spark, SF_SMALL, "documents").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (
            len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())


def test_encode_decode_round_trip_and_odd_rows(odd_docs, no_docs, library):
    encoded = B.encode_documents(odd_docs, PATH, lexicon_words=50)
    rows = B.decode_documents(encoded, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(
        ((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=key)
    for r in rows:
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids
    assert B.encode_documents(no_docs, PATH).collect() == [] and B.round_trip_digests(no_docs, PATH).collect() == []
