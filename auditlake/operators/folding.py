"""Forms of a text as a reader may see it, each with its way back to the places of the text.

A folded text has no invisible characters, white space as single spaces and compatibility forms of the rest. Terminal escape
sequences are consumed, as a terminal does. Where they carry text, where a text has combining marks, or where the head of a
sequence may as well be text, there are further forms with the other reading: ``variants`` gives all of them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

#: Fixed values of the Unicode standard: default ignorable code points that are neither format nor control characters.
_IGNORABLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
_SPACES = frozenset("\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: What may change: characters other than printable ASCII with the spaces around, and repeated spaces.
_ODD = re.compile(r" *[^ -~][^!-~]*|  [^!-~]*")
#: Terminal sequences, by how they start: with parameters and a final character; with a head, data and an end; a character or two.
_INTRODUCERS = frozenset("\x1b\x90\x98\x9b\x9d\x9e\x9f")
_PARAMETERS = re.compile(r"(?:\x1b\[|\x9b(?=[0-?]))[ -?]*[@-~]")
_HEAD = re.compile(r"(?:\x1b\]|\x9d)(?:[0-9;]*;)?|(?:\x1bP|\x90)(?P<device>[ -?]*[@-~]?)|\x1b[X^_]|[\x98\x9e\x9f]")
_SHORT = re.compile(r"\x1b(?![\[\]PX^_])[ -/]*[0-~]")
_END = re.compile("\x07|\x9c|\x1b\\\\")


class Escape(NamedTuple):
    end: int
    data: int | None = None  # where its text begins
    head: int | None = None  # where its head begins, if that may be text
    hides: bool = False  # a character of it may be read as text


class Folded:
    """A folded text and the pieces that it was made of."""

    def __init__(self):
        self.parts: list[str] = []
        self.at: list[int] = []  # of each piece in the folded text
        self.source: list[tuple[int, int, bool]] = []  # its range in the text; is it unchanged?
        self.size = 0
        self.marks = self.escapes = self.heads = False

    def put(self, chunk: str, start: int, end: int, same: bool) -> None:
        if not chunk:
            return
        if same and self.source and self.source[-1][2] and self.source[-1][1] == start:
            self.source[-1] = (self.source[-1][0], end, True)
        else:
            self.at.append(self.size)
            self.source.append((start, end, same))
        self.parts.append(chunk)
        self.size += len(chunk)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The range of the text that a range of the folded text comes from."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, _, same), (c, d, whole) = self.source[i], self.source[j]
        return a + (start - self.at[i] if same else 0), c + end - self.at[j] if whole else d


@lru_cache(maxsize=1 << 16)
def invisible(c: str) -> bool:
    if c < "\x7f":
        return c < " " and c not in _SPACES
    return unicodedata.category(c) in ("Cf", "Cc") or any(a <= ord(c) <= b for a, b in _IGNORABLE)


@lru_cache(maxsize=1 << 16)
def _forms(c: str) -> tuple[str, str, bool]:
    """Compatibility form; the same without marks; has it marks?"""
    apart = unicodedata.normalize("NFKD", c)
    bare = "".join(x for x in apart if unicodedata.category(x) not in ("Mn", "Me"))
    return unicodedata.normalize("NFKC", c), bare, bare != apart


def escape_at(text: str, i: int, ends: list[int]) -> Escape | None:
    """The terminal sequence that starts at i, if a whole one does. ends: where data may end, behind the ending character."""
    if m := _PARAMETERS.match(text, i):
        return Escape(m.end(), hides=" " in m[0])
    if m := _HEAD.match(text, i):
        k = bisect_right(ends, m.end())
        if k == len(ends):
            return None
        device = m["device"]
        return Escape(ends[k], m.end(), m.start("device") if device and re.match("[ 0-9A-Za-z]", device) else None)
    if m := _SHORT.match(text, i):
        return Escape(m.end(), hides=len(m[0]) == 2 or " " in m[0])
    return None


def fold(text: str, drop_marks: bool = False, keep_text: bool = False, keep_heads: bool = False) -> Folded:
    """One folded form. ``keep_text``: text within escape sequences stays; ``keep_heads``: heads that may be text as well."""
    out, at = Folded(), 0
    ends = [m.end() for m in _END.finditer(text)]
    keep_text |= keep_heads

    def skip(i: int) -> tuple[int | None, bool]:
        """Behind the sequence at i, or where its text begins (then True); None where it is none or is to be read as text."""
        e = escape_at(text, i, ends)
        if e is None:
            return None, False
        out.escapes |= e.data is not None or e.hides
        out.heads |= e.head is not None
        if not keep_text or not (e.hides or e.data is not None):
            return e.end, False
        if e.data is None:
            return None, False
        return (e.head if keep_heads and e.head is not None else e.data), True

    while m := _ODD.search(text, at):
        out.put(text[at : m.start()], at, m.start(), True)
        i = m.start()
        while i < m.end():
            c = text[i]
            if c in _INTRODUCERS and (to := skip(i)[0]) is not None:
                i = to
            elif invisible(c):
                i += 1
            elif c in _SPACES:
                j = i
                while j < len(text):
                    d = text[j]
                    to, inside = skip(j) if d in _INTRODUCERS else (None, False)
                    if to is not None:
                        j = to
                        if inside:
                            break
                    elif d in _SPACES or invisible(d):
                        j += 1
                    else:
                        break
                out.put(" ", i, j, text[i:j] == " ")
                i = j
            else:
                composed, bare, marked = _forms(c)
                out.marks |= marked
                chunk = bare if drop_marks else composed
                out.put(chunk, i, i + 1, chunk == c)
                i += 1
        at = i
    out.put(text[at:], at, len(text), True)
    return out


def variants(text: str) -> Iterator[Folded]:
    """The folded text, and each further form that its marks and escape sequences call for."""
    first = fold(text)
    yield first
    marks = (False, True) if first.marks else (False,)
    asked = [(True, False, False)] * first.marks + [(m, True, False) for m in marks if first.escapes] + [(m, True, True) for m in marks if first.heads]
    yield from (fold(text, *a) for a in asked)
