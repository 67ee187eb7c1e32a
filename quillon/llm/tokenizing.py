"""Whole-text encoding with a byte-level BPE of the tokenizers library, one pre-token at a time.

A byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row.
Splitting with the published pattern and remembering the ids that the library's model gives each pre-token
yields the same ids as one call on the whole text, faster.

The pattern comes in three forms.  Texts of Latin letters use fixed classes.  All others use classes of
every character, asked from the library's own pre-tokenizer, as regex engines differ in them.  Texts that
hold a special token's string take that string as a pre-token of its own, cut out before the others.  Only a
vocabulary with another pipeline than plain byte-level BPE sends whole texts to the library.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from array import array
from collections.abc import Sequence

#: Letters and numbers among the usual characters, the pre-token pattern of byte-level BPE
#: vocabularies over them, and the vocabularies' printable bytes.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
PRE_TOKEN = rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|{CONTRACTION}| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")
MOST_KEPT = 200_000
MOST_CHARS = 64

#: Forms of the pattern.
USUAL, GENERAL, SPECIAL = range(3)
#: Planes that hold assigned letters, numbers or spaces; everything beyond is none of them.
ASKED = (range(0, 0xD800), range(0xE000, 0x32400), range(0xE0000, 0xE0200))

_encoders: dict[str, Encoder] = {}


def classes(pre_tokenizer) -> dict[str, list[tuple[int, int]]]:
    """Ranges of the characters that the library takes for letters, numbers and spaces.

    Characters are asked for in strings of one kind by Python's tables; the library cuts such a string only
    where its own tables differ, so one probe for each piece is enough.
    """
    guess: dict[str, list[int]] = {"L": [], "N": [], "S": [], "O": []}
    for part in ASKED:
        for c in part:
            own = unicodedata.category(ch := chr(c))[0]
            guess["S" if ch.isspace() else own if own in "LN" else "O"].append(c)
    kind: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for codes in guess.values():
        for _, (a, b) in pre_tokenizer.pre_tokenize_str("".join(map(chr, codes))):
            # a piece is of one kind; a lone apostrophe or blank is told apart from what it may start
            for at in (a, b - 1) if b - a > 1 else (a,):
                ch = chr(codes[at])
                cut = [len(pre_tokenizer.pre_tokenize_str(f"{x}{ch}")) for x in "a1!"]
                found = next((k for k, n in zip("LNO", cut, strict=True) if n == 1), "S")
                if at == a:
                    first = found
            if found != first:
                raise ValueError("a piece of several kinds")
            if first in kind:
                kind[first] += codes[a:b]
    out = {}
    for k, codes in kind.items():
        runs: list[tuple[int, int]] = []
        for c in sorted(codes):
            if runs and runs[-1][1] == c - 1:
                runs[-1] = runs[-1][0], c
            else:
                runs.append((c, c))
        out[k] = runs
    return out


def pattern(kinds: dict[str, list[tuple[int, int]]], special: Sequence[str] = ()) -> re.Pattern:
    """The pre-token pattern over the given classes, with special strings cut out first."""
    letters, numbers, spaces = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LNS")
    if not special:
        return re.compile(rf" ?[{letters}]+| ?[{numbers}]+|{CONTRACTION}| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
    cut = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
    return re.compile(rf"(?:{cut})| ?[{letters}]+| ?[{numbers}]+|{CONTRACTION}| ?(?:(?!{cut})[^{spaces}{letters}{numbers}])+|[{spaces}]+(?:(?![^{spaces}])|(?={cut}))|[{spaces}]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    others = (b for b in range(256) if b not in PRINTABLE)
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class Known(dict):
    """Pre-token -> its ids as little-endian u32 bytes; looks in the generation before, then asks the model."""

    def __init__(self, ask, old: dict):
        self.ask, self.old = ask, old

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.ask(piece)
        if len(piece) <= MOST_CHARS:
            self[piece] = found
        return found


class Encoder:
    """Ids of whole texts; it remembers two generations of at most about MOST_KEPT pre-tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.patterns: dict[int, re.Pattern] = {USUAL: re.compile(PRE_TOKEN)}
        said = json.loads(self.tokenizer.to_str())
        before = said["pre_tokenizer"] or {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.plain = said["normalizer"] is None and said["post_processor"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False and said["model"]["type"] == "BPE"
        # a special string that could start within a word, or that eats blanks, would need more than the pattern
        self.plain = self.plain and all(not (t.lstrip or t.rstrip or t.single_word) and t.content[:1] in "<[{|" and t.content for t in added.values())
        self.reach = max(map(len, self.special), default=0)
        characters, model = byte_characters(), self.tokenizer.model
        packers = [struct.Struct(f"<{n}I").pack for n in range(16)]

        def ask(piece: str) -> bytes:
            if piece in self.special:
                return packers[1](self.special[piece])
            if piece.isascii() and piece.isprintable():
                mapped = piece.replace(" ", characters[32])
            else:
                mapped = piece.encode().decode("latin-1").translate(characters)
            ids = [t.id for t in model.tokenize(mapped)]
            return packers[len(ids)](*ids) if len(ids) < len(packers) else array("I", ids).tobytes()

        self.ask, self.known = ask, Known(ask, {})

    def form(self, text: str) -> int:
        """Which form of the pattern a text needs; a higher one splits the lower ones' texts the same way."""
        if any(s in text for s in self.special):
            return SPECIAL
        return GENERAL if _UNUSUAL.search(text) else USUAL

    def pattern(self, form: int) -> re.Pattern:
        if form not in self.patterns:
            kinds = classes(self.tokenizer.pre_tokenizer)
            self.patterns |= {GENERAL: pattern(kinds), SPECIAL: pattern(kinds, list(self.special))}
        return self.patterns[form]

    def table(self) -> Known:
        """Pre-token -> ids, ready for one more text."""
        if len(self.known) > MOST_KEPT:
            self.known.old = {}
            self.known = Known(self.ask, self.known)
        return self.known

    def trim(self) -> None:
        """Forget the older generation: for the end of a task, as a worker may stay idle for a while."""
        self.known.old = {}

    def counts(self, pieces: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens."""
        return [len(x) // 4 for x in map(self.table().__getitem__, pieces)]

    def ids(self, text: str) -> array:
        """array('I') of the ids of the whole text."""
        if not self.plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        out = array("I")
        out.frombytes(b"".join(map(self.table().__getitem__, self.pattern(self.form(text)).findall(text))))
        return out


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file; workers load each file once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
