"""Tokens and edits in every script, with special strings and odd spaces."""

import random

import pytest

from quillon.llm import token_counts
from quillon.llm.tokenizing import GENERAL, SPECIAL, USUAL, encoder, vocabulary_path

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
SCRIPTS = {
    "cyrillic": "Съешь же ещё этих мягких французских булок, да выпей чаю. ",
    "greek": "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία· 42 φορές! ",
    "cjk": "天地玄黄,宇宙洪荒。日月盈昃,辰宿列張。",
    "arabic": "نص حكيم له سر قاطع وذو شأن عظيم ١٢٣ ",
    "hindi": "ऋषियों को सताने वाले दुष्ट राक्षसों के राजा रावण का। ",
    "emoji": "yes 🎉👩‍👩‍👧 no‍ it's fine 🏳️‍🌈!! ",
    "curly": "“It’s a test” — he’d said… that’s all right. ",
}


def library(text):
    return encoder(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", SCRIPTS)
def test_edits_touch_little_in_every_script(name):
    rng, enc = random.Random(name), encoder(VOCABULARY)
    text = (SCRIPTS[name] * (100_000 // len(SCRIPTS[name]) + 1))[:100_000]
    doc = token_counts.Document(enc, text)
    assert doc.form == GENERAL and doc.tree.n_tokens == len(library(text))
    for ins, cut in (("x", 0), ("", 1), (SCRIPTS["cjk"][:4], 3), (" ’", 0)):
        before, pos = doc.reencoded, rng.randrange(1000, 90_000)
        doc.edit(pos, cut, ins)
        text = text[:pos] + ins + text[pos + cut :]
        assert doc.reencoded - before < 200
        assert doc.text == text
    assert doc.tree.n_tokens == len(library(text)) and doc.tree.n_chars == len(text)


def test_one_curly_quote_keeps_edits_small():
    text = "a plain word here, " * 2600 + "’" + " and a plain word" * 3000
    doc = token_counts.Document(encoder(VOCABULARY), text)
    doc.edit(300, 1, "z")
    assert doc.reencoded < 40 and doc.tree.n_tokens == len(library(doc.text))


def test_random_characters_equal_library():
    rng, enc = random.Random(3), encoder(VOCABULARY)
    odd = [*"\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎     　﻿​ '’aB1²Ⅷ!_\0", *("'s", "'ll", "'S", "  ", " '", "<|endoftext|>", "<|endof", "|>")]
    for n in range(3000):
        pool = [*odd, *(chr(c) for c in (rng.randrange(0x110000) for _ in range(6)) if not 0xD800 <= c < 0xE000)] if n % 2 else odd
        text = "".join(rng.choices(pool, k=rng.randrange(1, 30)))
        assert list(enc.ids(text)) == library(text), ascii(text)


def test_every_character_equals_library():
    """Each assigned code point (and some of the others) beside a letter, a number, a sign and a blank."""
    enc = encoder(VOCABULARY)
    chars = [c for c in (*range(0x32400), *range(0x32400, 0x110000, 61)) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 1500):
        text = "".join(f"a{c}1{c}!{c} {c}\n" for c in map(chr, chars[k : k + 1500]))
        assert [e for _, (_, e) in enc.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [m.end() for m in enc.pattern(GENERAL).finditer(text)], hex(chars[k])


def test_edits_around_special_strings():
    rng, enc = random.Random(5), encoder(VOCABULARY)
    bits = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "word", "’", "日本", "'s", "!", "9"]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 40)))
        doc = token_counts.Document(enc, text)
        for _ in range(6):
            pos, cut, ins = rng.randrange(0, len(text) + 2), rng.choice([0, 1, 3, 9, 30]), rng.choice([*bits, ""])
            doc.edit(pos, cut, ins)
            pos = min(pos, len(text))
            text = text[:pos] + ins + text[pos + cut :]
            assert (doc.text, doc.tree.n_tokens) == (text, len(library(text))), ascii(text)


def test_special_string_far_away_keeps_edits_small():
    text = "some plain words. " * 3000 + "<|endoftext|>" + " and more" * 3000
    doc = token_counts.Document(encoder(VOCABULARY), text)
    assert doc.form == SPECIAL
    doc.edit(500, 2, "q")
    doc.edit(54_010, 3, "<|endoftext|>")
    assert doc.reencoded < 200 and doc.tree.n_tokens == len(library(doc.text))


def test_forms():
    enc = encoder(VOCABULARY)
    assert [enc.form(t) for t in ("", "plain é", "日", "<|endoftext|> x")] == [USUAL, USUAL, GENERAL, SPECIAL]
    text = "it's Ünï 42 ²³ !! \n\n  x "
    assert enc.pattern(USUAL).findall(text) == enc.pattern(GENERAL).findall(text) == enc.pattern(SPECIAL).findall(text)
