"""Analysis of texts in Python, for workers that build postings and for single queries."""

from __future__ import annotations

import re
import unicodedata

from .profiles import Profile

_LATIN = re.compile(r"[^\W_]+")
# for a script: its runs and other words, what a run begins with, the length of its grams
_SCRIPT = {k: (re.compile(rf"[{c}]+|(?:(?![{c}])[^\W_])+"), re.compile(f"[{c}]"), n) for k, c, n in (("cjk", "぀-ヿ㐀-䶿一-鿿", 2), ("sea", "฀-໿ក-៿", 3))}


_BLANKS = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})
#: A text with more kinds of characters between words than this is matched, not split.
_KINDS = 64


def latin(text: str) -> list[str]:
    """Runs of letters and digits, as _LATIN finds them; splitting takes a third of the time."""
    if text.isascii():
        return text.translate(_BLANKS).split()
    between = [c for c in set(text) if not c.isalnum()]
    if len(between) > _KINDS:
        return _LATIN.findall(text)
    for c in between:
        text = text.replace(c, " ")
    return text.split()


def cut(text: str, segment: str) -> list[str]:
    """Words of a text by a profile's segmentation."""
    if segment == "latin" or text.isascii() or not _SCRIPT[segment][1].search(text):
        return latin(text)
    split, cls, n = _SCRIPT[segment]
    found: list[str] = []
    for run in split.findall(text):
        if cls.match(run):
            found += [run[i : i + n] for i in range(max(1, len(run) - n + 1))]
        else:
            found.append(run)
    return found


def analyze(text: str, profile: Profile, normalise: bool = True) -> list[tuple[str, str]]:
    """(term, literal) of each word that is no stopword, by the rules of ``text.terms``."""
    if normalise:
        text = unicodedata.normalize("NFKC", text)
    lowered = (w.lower() for w in cut(text, profile.segment))
    return [(profile.stem(w) if profile.stem else w, w) for w in lowered if w not in profile.stopwords]


def joined_terms(text: str, profile: Profile, normalise: bool = True) -> str:
    """A text's terms joined by one blank."""
    return " ".join(t for t, _ in analyze(text, profile, normalise))
