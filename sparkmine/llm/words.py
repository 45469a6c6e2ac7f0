"""Words of a text: NFKC, lower case, invisible characters dropped, runs of letters or digits."""

from __future__ import annotations

import re
import unicodedata

#: Soft hyphen, zero-width space, word joiner, byte-order mark.
INVISIBLE = "\u00ad\u200b\u2060\ufeff"
DROPPED = re.compile(f"[{INVISIBLE}]+")
WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", DROPPED.sub("", text)).lower()


def words(text: str) -> list[str]:
    return WORD.findall(normal(text))


def word_spans(text: str) -> list[tuple[int, int]] | None:
    """Start and end of each word in the original text; None where normalisation can't be followed character by character."""
    if text.isascii():
        return [m.span() for m in WORD.finditer(text.lower())]
    at, n, out, starts, ends = 0, len(text), [], [], []
    while at < n:
        end = at + 1
        while end < n and (unicodedata.combining(text[end]) or text[end] in INVISIBLE):
            end += 1
        piece = normal(text[at:end])
        out.append(piece)
        starts += [at] * len(piece)
        ends += [end] * len(piece)
        at = end
    whole = normal(text)
    if len(whole) != len(starts):
        return None
    return [(starts[m.start()], ends[m.end() - 1]) for m in WORD.finditer(whole)]
