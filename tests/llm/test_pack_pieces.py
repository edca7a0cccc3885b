"""Packing: plain texts are cut into the tokenizer's own pieces."""

import random

import numpy as np

from hotzone.llm import pack as PK


def test_plain_texts_equal_the_tokenizer():
    from tokenizers import Tokenizer

    enc, tok = PK.Encoder(PK.word_bpe()), Tokenizer.from_file(PK.word_bpe())
    rng = random.Random(7)
    plain = "aAbBzZ019 \n''''ssSTtrRevVElLmMdD.,!?;:-_<|>[]{}/~ÜäžŊ’–…"
    odd = plain + "\t\r\x0b\x1c\x00\x7fΣςİŉſ́中ﬁ½²Ⅷ \u0085​"
    texts = ["".join(rng.choices(a, k=rng.randint(0, 25))) for a in (plain, odd) for _ in range(3000)]
    texts += ["DON'T we'RE 'S''s", "a<|endoftext|>b <|ENDOFTEXT|>", "x <| endoftext|>"]
    for t in texts:
        assert enc.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ascii(t)


def test_a_word_is_kept_once():
    """Punctuation and letters beyond ASCII make no further entry of a word."""
    enc = PK.Encoder(PK.word_bpe())
    enc.encode("straße, straße. straße; house, house! (house) house…")
    assert {w for w in enc.pieces if w.isalpha()} == {"straße", "house"} and not enc.chunks
