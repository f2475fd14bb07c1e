"""Backtracking BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.bpe import Bpe, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return Bpe(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(codec.encode(text), "<u4")
    assert ids.tolist() == want, text
    assert codec.decode(ids.astype(np.int64)).decode() == library.decode(want, skip_special_tokens=False)


def test_random_texts(codec, library):
    rng = random.Random(2)
    alphabets = ["abcdefghij' st", "thenigro s", "áéí ß ½²\xa0\x85\x1c_-..!!", "日本 語é İIſKÅǅ​﻿😀", "0123 9'S'T'RE've<|>"]
    for _ in range(4000):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        if rng.random() < 0.2:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>x", "<|endoftext"]) + text[:5]
        same(codec, library, text)
    for _ in range(1000):
        same(codec, library, "".join(chr(rng.randrange(1, 0x3000)) for _ in range(20)))


def test_words_of_the_vocabulary_and_long_words(codec, library):
    for token in list(library.get_vocab())[::50]:
        same(codec, library, token.replace("</w>", ""))
    for text in ("", " ", "a" * 5000, "the" * 3000, "ab" * 2000 + " x", "!" * 4000):
        same(codec, library, text)


def test_rows(docs, library):
    rows = [(1, "Hello, World!"), (2, None), (3, ""), (None, "a " * 30_000), (1, "Hello, World!"), (4, "Hello <|endoftext|>")]
    got = encode_documents(docs(rows), PATH, payload="digest").collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    real = encode_documents(docs(rows[:2]), PATH).collect()
    assert real[0].ids == library.encode("Hello, World!", add_special_tokens=False).ids and real[1].ids == []
    assert encode_documents(docs([]), PATH).count() == 0
