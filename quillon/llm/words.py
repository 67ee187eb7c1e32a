"""Words of whole texts: runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return.

``bytes.split()`` splits on exactly these six, where ``str.split()`` would also split on other white space.
"""

from __future__ import annotations

BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to a-z, other ASCII that is not a letter or digit to a blank; bytes of other characters stay.
_PLAIN = bytes(_LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return b"".join((encode(text.lower()),)).translate(_PLAIN).split() if text else []


def plain(text: str | None) -> str:
    """The plain words joined by single blanks."""
    return b" ".join(plain_words(text)).decode("utf-8", "replace")
