"""Query text to terms and phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.analysis import analyze
from ..functions.profiles import Profile

@dataclass(frozen=True)
class Term:
    term: str
    literal: str
    prefix: bool = False


@dataclass
class Query:
    terms: list[Term] = field(default_factory=list)
    phrases: list[list[Term]] = field(default_factory=list)
    whole: str = ""

    @property
    def empty(self) -> bool:
        return not self.terms and not self.phrases


def parse(text: str, profile: Profile) -> Query:
    """``word``, ``prefix*`` and ``"a phrase"``. A phrase's words are never
    prefixes; a term asked twice counts once."""
    q = Query(whole=" ".join(t for t, _ in analyze(text, profile)))
    for inner in re.findall(r'"([^"]+)"', text):
        words = [Term(t, w) for raw in inner.split() for t, w in analyze(raw, profile)]
        if words:
            q.phrases.append(words)
    seen = set()
    for raw in re.sub(r'"[^"]+"', " ", text).split():
        prefix = len(raw) > 1 and raw.endswith("*")
        for t, w in analyze(raw[:-1] if prefix else raw, profile):
            if (prefix, t) not in seen:
                seen.add((prefix, t))
                q.terms.append(Term(t, w, prefix))
    return q
