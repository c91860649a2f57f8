"""Byte-level BPE and the compiled token counter against the libraries."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import tokenizers
from llm_cases import EDGES

from plumbline.llm import bpe, token_counts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    r = random.Random(5)
    alphabet = "ab 'st relvmd\n\t.!12é 日<|>endofxt"
    out = [t or "" for t in EDGES]
    out += ["'s", "don't 'tis 're !'s ''s \n's  's", "a  b   c\n\n d  ", "\n \n a", " " * 3000 + "a", "!" * 500 + "'s" + "?" * 400, "'S 'LL they'll've I'd'm"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 900))) for _ in range(100)]
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    return out + ["".join(map(chr, r.choices(points, k=80))) for _ in range(40)]


def test_counts_equal_the_library(library):
    machine = token_counts.Transducer(token_counts.TOKENIZER)
    texts = [*odd_texts(), "<|endoftext|>", "x<|endoftext|><|endoftext|> y", " <|endoftext|>"]
    assert token_counts.count_all(machine, texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_do_not_depend_on_portions_or_chunks(monkeypatch):
    machine = token_counts.Transducer(token_counts.TOKENIZER)
    texts = odd_texts()
    whole = token_counts.count_all(machine, texts)
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 50)
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "MAX_STATES", 100)
    assert token_counts.count_all(machine, texts) == whole


def test_round_trip_and_ids(library):
    codec = bpe.codec(bpe.RANKS)
    for text in odd_texts():
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode()
        assert ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["word " * 30_000, "ab" * 80_000, "1a2b" * 40_000, "\n" * 120_000 + "a b", " " * 60_000 + "x", "é日" * 60_000])
def test_long_texts_have_the_ids_of_the_whole(library, text):
    codec = bpe.codec(bpe.RANKS)
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert token_counts.count_all(token_counts.transducer(token_counts.TOKENIZER), [text]) == [len(ids)]


@pytest.mark.parametrize("seed", range(6))
def test_composed_maps_equal_the_library(library, monkeypatch, seed):
    """Long pieces over many small chunks: periods of all lengths, random letters, and words between them."""
    r = random.Random(seed)
    monkeypatch.setattr(token_counts, "CHUNK", r.choice([3, 7, 16, 33]))
    monkeypatch.setattr(token_counts, "MAPPED", r.choice([5, 64, 16_384]))
    texts = ["".join(r.choices("abcdeABC", k=r.randrange(1, 4))) * r.randrange(1, 400) + r.choice(["", " end", "1"]) for _ in range(30)]
    texts += ["".join(r.choices("etaoinshrdlu", k=1500)), "x" * 1001, "é" * 700 + " ok " + "y" * 300, " " * 400 + "z", "=-" * 500]
    machine = token_counts.Transducer(token_counts.TOKENIZER)
    assert token_counts.count_all(machine, texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_text_without_blanks_takes_linear_time(library):
    r = random.Random(1)
    text = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=300_000))
    begin = time.monotonic()
    assert token_counts.count_all(token_counts.Transducer(token_counts.TOKENIZER), [text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert time.monotonic() - begin < 60


def test_cuts_are_safe(monkeypatch):
    codec = bpe.codec(bpe.RANKS)
    text = "don't stop  at 12ab\n\n the 's end!! " * 40
    whole = codec.encode(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 11)
    assert codec.encode(text) == whole


def test_bytes_that_are_no_text():
    codec = bpe.codec(bpe.RANKS)
    ids = codec.encode("🙂")
    assert len(ids) > 1 and codec.decode(ids[:1]) == "🙂".encode()[: len(codec.decode(ids[:1]))]


def test_frames(spark, edge_docs, no_docs):
    rows = bpe.round_trip(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.restored for r in rows)
    empty = next(r for r in rows if r.doc_id == 0)
    assert empty.n_tokens == 0 and empty.ids_sha256 == empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    tokens = bpe.encode(edge_docs)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(tokens).collect() if r.doc_id is not None}
    assert back == {i: t or "" for i, t in enumerate(EDGES)}
    assert bpe.with_token_ids(edge_docs).columns == [*edge_docs.columns, "token_ids"]
    counted = token_counts.token_counts(edge_docs, limit=2).collect()
    assert {(r.doc_id, r.n_tokens, r.over_limit) for r in counted} == {(r.doc_id, r.n_tokens, r.n_tokens > 2) for r in rows}
    for result in (bpe.round_trip(no_docs), bpe.encode(no_docs), token_counts.token_counts(no_docs), bpe.with_token_ids(no_docs)):
        assert result.count() == 0
