"""Language profiles: how a language's text is cut, which words are dropped, how the rest is stemmed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import stemmers, stopwords


@dataclass(frozen=True)
class Profile:
    """``segment`` is latin, cjk (bigrams) or sea (trigrams); ``stem`` None keeps words as they are."""

    code: str
    segment: str
    stopwords: frozenset[str]
    stem: Callable[[str], str] | None = None


PROFILES: dict[str, Profile] = {
    p.code: p
    for p in (
        Profile("en", "latin", stopwords.ENGLISH, stemmers.english),
        Profile("de", "latin", stopwords.GERMAN, stemmers.german),
        Profile("nl", "latin", stopwords.DUTCH, stemmers.dutch),
        Profile("sv", "latin", stopwords.SWEDISH, stemmers.swedish),
        *(Profile(c, "latin", stopwords.NORWEGIAN, stemmers.norwegian) for c in ("nb", "nn", "no")),
        *(Profile(c, "cjk", stopwords.SHORT_ENGLISH) for c in ("zh", "ja")),
        *(Profile(c, "sea", stopwords.SHORT_ENGLISH) for c in ("km", "lo")),
        Profile("th", "sea", stopwords.THAI),
    )
}

#: Words that tell one Latin-script language from the others.
MARKERS: dict[str, frozenset[str]] = {
    code: frozenset(words.split())
    for code, words in {
        "en": "an and are as be by for from have in is of on or that the this to was with",
        "de": "auch auf das dem den der die ein eine einen für im ist mit nicht sich sind und von zu",
        "sv": "att detta inte och också är",
        "nl": "een het niet van wij zijn",
        "nb": "hva hvem hvordan ikke jeg også",
        "nn": "eg ikkje korleis kva kven òg",
    }.items()
}

RTL = ("ar", "ckb", "dv", "fa", "he", "ku", "ps", "sd", "ur", "yi")


def profile(code: str, fallback: bool = False) -> Profile:
    """The profile of an exact code. An unknown one is an error or, with
    ``fallback``, gets Latin words with neither stopwords nor stems."""
    if code in PROFILES:
        return PROFILES[code]
    if fallback:
        return Profile(code, "latin", frozenset())
    raise ValueError(f"no language profile {code!r}; there are {', '.join(sorted(PROFILES))}")


def codes() -> list[str]:
    return list(PROFILES)
