"""The encoder of token files against the tokenizer itself, on texts full of unusual white space and characters."""

import random

import numpy as np
import pyarrow as pa

from sitewatch.llm import token_files

SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "​", "　", "﻿"]
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'0123456789.,!?<|>-_"
WHOLE = ["<|endoftext|>", "x<|startoftext|>y", "it's", "we'LL", "İstanbul", "ΣΑΣ", "straße", "ﬁ", "é", "́a", "Ω", "\U0001f469‍\U0001f680", "|||", "plain"]


def any_letter(r):
    return chr(r.choice([r.randrange(0x80, 0x250), r.randrange(0x300, 0x600), r.randrange(0x900, 0xD7FF), r.randrange(0xE000, 0x10000), r.randrange(0x10000, 0x11000), r.randrange(0x1F300, 0x1F700)]))


def text(r):
    out = []
    for _ in range(r.randrange(25)):
        k = r.random()
        if k < 0.5:
            out.append("".join(r.choice(ASCII) for _ in range(r.randrange(1, 12))))
        elif k < 0.7:
            out.append("".join(r.choice(ASCII) if r.random() < 0.6 else any_letter(r) for _ in range(r.randrange(1, 8))))
        else:
            out.append(r.choice(WHOLE if k < 0.8 else SPACES))
        if r.random() < 0.7:
            out.append(" " if r.random() < 0.6 else r.choice(SPACES))
    return "".join(out)


def same(texts, path, tokenizer):
    got = token_files.word_encoder(path)(pa.array(texts, pa.string()), 2)
    want = [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in got] == want


def test_encoder_is_the_tokenizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, r = Tokenizer.from_file(path), random.Random(11)
    plain = [f"some plain word{i} here" for i in range(40)]
    for gap in ("\xa0", "　", " "):
        same([f"{' '.join(plain)} {gap} left{gap}right"] * 3 + plain, path, tokenizer)
    for _ in range(80):
        same([text(r) for _ in range(250)], path, tokenizer)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 100)  # blocks of a few texts
    same([text(r) for _ in range(300)] + [None, "", " \n", "long " * 5000, "x" * 20000, "中" * 3000], path, tokenizer)
    same([], path, tokenizer)


def test_files_of_another_make(tmp_path):
    """A tokenizer whose parts aren't known goes whole, with the same result."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    same(["It's one é two", "", "<|endoftext|>"], path, Tokenizer.from_file(path))
    setup = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    setup["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(setup))
    same(["It's One é Two"], str(other), Tokenizer.from_file(str(other)))
    assert np.array_equal(token_files.word_encoder(str(other))(pa.array([None], pa.string()), 7)[0], [7])
