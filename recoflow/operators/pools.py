"""What is made of one query's pool within a task: scores, prefilters, ranks, caps, coverage
and metrics, in numpy.  ``CellIndex.fold`` calls these with whole pools, so no pair is
shuffled.  Each is the same rule as the operator on tables of that name.

Pools come in the order of item_id, so stable sorts leave equals in that order.
"""

from __future__ import annotations

import numpy as np

from recoflow.operators.blocks import Held, Terms, rounded  # noqa: F401

UNRATED = 2.5


def ranks(score: np.ndarray) -> np.ndarray:
    """Rank from 1, the highest first, equals by id."""
    out = np.empty(len(score), np.int64)
    out[np.argsort(-score, kind="stable")] = np.arange(1, len(score) + 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def blend(relevance: np.ndarray, rating: np.ndarray, weight: float = 0.5) -> np.ndarray:
    """As ``ranking.blend``; NaN is unrated."""
    return (1 - weight) * relevance + weight * np.where(np.isnan(rating), UNRATED, rating) / 5


def rescaled(x: np.ndarray) -> np.ndarray:
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high > low else np.zeros(len(x))


def relaxed(*ladder: np.ndarray) -> np.ndarray:
    """Flags of what meets the first condition that anything meets, else of all."""
    return next((c for c in ladder if c.any()), np.ones(len(ladder[0]), bool))


def tag_prefilter(shared: np.ndarray, n_tags: int, min_matches: int = 2, matches_from: int = 3) -> np.ndarray:
    return relaxed(shared >= (min_matches if n_tags >= matches_from else 1), shared >= 1)


def policies(shared: np.ndarray, systems: np.ndarray, n_tags: int, first: np.ndarray) -> dict[str, np.ndarray]:
    """What each policy of ``filters.POLICIES`` keeps; first: the place of the highest cosine."""
    same, most = systems >= 1, 2 if n_tags >= 3 else 1
    rules = {"tags1": shared >= 1, "tags1_system": (shared >= 1) & same, "tags2of3": shared >= most, "tags2of3_system": (shared >= most) & same, "tags2": shared >= 2}
    return {name: relaxed(rule, shared >= 1, first) for name, rule in rules.items()}


GAINS = 1 / np.log2(np.arange(2, 1002))
IDEAL = np.concatenate([[0.0], np.cumsum(GAINS)])


def metrics(rank: np.ndarray, hit: np.ndarray, n_rel: int, ks: tuple[int, ...], mrr_at: int | None = None) -> list[float]:
    """recall_k, ndcg_k of each k, then rr, as ``evaluate.query_metrics``."""
    top = np.sort(rank[hit & (rank <= max(*ks, mrr_at or 0))])
    out = []
    for k in ks:
        inside = top[top <= k]
        out += [len(inside) / n_rel, GAINS[inside - 1].sum() / IDEAL[min(n_rel, k)]]
    first = top[top <= (mrr_at or max(ks))]
    return [*out, 1 / first[0] if len(first) else 0.0]


def capped(order: np.ndarray, authors: Terms, most: int, page: int | None = None, off: bool = False) -> np.ndarray:
    """Of places of held items, the best first, flags of those that the author cap leaves
    (``ranking.capped``).

    Authors of at most ``most`` items of the pool can never be full.  One who shares no item
    with another that matters gets its first ``most`` items; only items of the others are
    gone through one by one.
    """
    aside = np.zeros(len(order), bool)
    if not off:
        code, place = authors.of(order)
        code, place = _distinct(code, place)
        _, code, n = np.unique(code, return_inverse=True, return_counts=True)
        heavy = n[code] > most
        code, place = code[heavy], place[heavy]
        together = np.bincount(place, minlength=len(order))[place] > 1
        hangs = np.zeros(len(n), bool)
        hangs[code[together]] = True
        alone = ~hangs[code]
        own, at = code[alone], place[alone]
        by = np.argsort(own, kind="stable")
        nth = np.arange(len(by)) - np.searchsorted(own[by], own[by])
        aside[at[by[nth >= most]]] = True
        full = np.zeros(len(n), np.int64)
        rest, codes = place[~alone], code[~alone]
        edges = np.flatnonzero(np.diff(rest)) + 1
        for p, c in zip(rest[np.concatenate([[0], edges])] if len(rest) else (), np.split(codes, edges), strict=False):
            if (full[c] >= most).any():
                aside[p] = True
            else:
                full[c] += 1
    if page is not None:
        short = page - int((~aside).sum())
        if short > 0:
            aside[np.flatnonzero(aside)[:short]] = False
    return ~aside


def _distinct(code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once each, in the order of places."""
    width = int(code.max(initial=0)) + 1
    both = np.unique(place * width + code)
    return both % width, both // width


def covered(order: np.ndarray, values: Terms, targets: list[int], page: int, place: np.ndarray | None = None) -> np.ndarray:
    """Which of ``order`` (held items, the best first) the page has after the coverage swap
    (``ranking.covered``); targets: codes of ``values`` in alphabetical order; place: that of
    each item, from 0, where it is not its number in ``order``."""
    place = np.arange(len(order)) if place is None else place
    code, which = values.of(order)
    early = place[which] < page
    have = set(code[early].tolist())
    found, at = np.unique(code[~early], return_index=True)
    first = dict(zip(found.tolist(), which[~early][at].tolist(), strict=True))
    swaps, done = [], set()
    for t in targets:
        if t in first and t not in have and t not in done:
            swaps.append(first[t])
            done.update(code[which == first[t]].tolist())
    room = np.flatnonzero(place < page - len(swaps))
    return np.concatenate([room, np.sort(np.array(swaps, np.int64))])


class FacetFilter:
    """Held items that pass a filter set, as ``filters.facet_filter``: columns of the item
    are year, avg_rating, bayesian_avg, review_count, and lists of values by field."""

    FIELDS = (("authors", ("author",)), ("systems", ("system",)), ("genres", ("genre",)), ("languages", ("language",)), ("tags_any", ("tags",)), ("topics", ("genre", "tags")))

    def __init__(self, held: Held):
        self.held, self.made = held, {}

    def __call__(self, spec: dict) -> np.ndarray:
        key = repr(sorted(spec.items()))
        if key not in self.made:
            if len(self.made) >= 256:
                self.made.clear()
            self.made[key] = self._passing(spec)
        return self.made[key]

    def _passing(self, spec: dict) -> np.ndarray:
        held = self.held
        out = np.ones(len(held.ids), bool)
        low, high = spec.get("year_low"), spec.get("year_high")
        if low is not None and high is not None and low <= high:
            year = held.numbers("year")
            out &= (year >= low) & (year <= high)
        for name, fields in self.FIELDS:
            terms = [t.lower() for t in spec.get(name) or () if t is not None and t.strip(" ") != ""]
            if terms:
                inside = np.zeros(len(out), bool)
                for field in fields:
                    lists = held.terms(f"{field}_values")
                    for text in lists.texts:
                        if any(t in text.lower() for t in terms):
                            inside[lists.having(text)] = True
                out &= inside
        if spec.get("min_rating") is not None:
            n, mean = held.numbers("review_count"), held.numbers("avg_rating")
            unknown = held.table.column("avg_rating").is_null().to_numpy(zero_copy_only=False)  # not NaN, which fails
            value = np.where(unknown, held.numbers("bayesian_avg"), mean)
            out &= (n != 0) & (value >= spec["min_rating"])
        if spec.get("min_count") is not None:
            out &= held.numbers("review_count") >= spec["min_count"]
        return out
