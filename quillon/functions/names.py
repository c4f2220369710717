"""What a column's name says about its entities. Names are few: plain Python on the driver, then a small table."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import product
from typing import NamedTuple

from quillon.fixed import AMBIGUOUS, COARSE_PLACES, COLLISIONS, CONTRADICTIONS, EXACT_PLACES, GENERIC_NAMES, MEANS_GENERIC, MEANS_UNKNOWN, NAME_NEGATIVES, NAME_TERMS
from quillon.functions.text import normalize_name

#: Similarity from which two strings count as alike.
ALIKE = 0.72


class NameFacts(NamedTuple):
    scores: dict[str, float]
    negatives: frozenset[str]
    meaning: str
    generic: bool
    coarse_place: bool


def has_phrase(phrase: str, name: str) -> bool:
    return f" {phrase} " in f" {name} "


def _alike(a: str, b: str) -> float:
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= ALIKE else 0.0


def _term_score(name: str, term: str, fuzzy: bool) -> float:
    """How well a term fits a name: as all of it, a phrase in it, a set of its tokens, or by likeness."""
    if name == term:
        return 1.0
    if has_phrase(term, name):
        return 0.90
    tokens, wanted = set(name.split()), set(term.split())
    if wanted <= tokens:
        return 0.72
    if not fuzzy:
        return 0.0
    if whole := _alike(name, term):
        return 0.60 * whole
    return 0.55 * max((_alike(a, b) for a, b in product(tokens, wanted) if min(len(a), len(b)) >= 3), default=0.0)


def name_facts(column: str, fuzzy: bool = True) -> NameFacts:
    name = normalize_name(column)
    doubt = 0.88 if set(name.split()) & set(AMBIGUOUS) else 1.0
    best = {entity: max(_term_score(name, normalize_name(t), fuzzy) for t in terms) for entity, terms in NAME_TERMS.items()}
    scores = {entity: round(score * doubt, 4) for entity, score in best.items() if score}
    negatives = frozenset(e for e, terms in NAME_NEGATIVES.items() if any(has_phrase(normalize_name(t), name) for t in terms))
    generic = name in GENERIC_NAMES
    meaning = MEANS_GENERIC if generic else max(scores, key=scores.__getitem__, default=MEANS_UNKNOWN)
    coarse = any(has_phrase(t, name) for t in COARSE_PLACES) and not any(has_phrase(t, name) for t in EXACT_PLACES)
    return NameFacts(scores, negatives, meaning, generic, coarse)


def rivalry(entity: str, scores: dict[str, float]) -> float:
    """By how much another entity of a collision group fits the name better."""
    others = [scores.get(o, 0.0) for group in COLLISIONS if entity in group for o in group if o != entity]
    return max(0.0, max(others, default=0.0) - scores.get(entity, 0.0))


def contradiction(entity: str, scores: dict[str, float]) -> float:
    """Penalty for a name that speaks for an entity which excludes this one."""
    return max((0.30 * s for e, s in scores.items() if s >= 0.55 and entity in CONTRADICTIONS.get(e, ())), default=0.0)
