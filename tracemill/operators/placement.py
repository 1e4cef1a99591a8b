"""Placing a route on a track of observations: pins, scale, rotation, bending.

A route is one bounded group; observations name the vertex they belong to.
"""

from __future__ import annotations

import math

import numpy as np

from tracemill.operators.grouped import elastic_fuse, robust_center, weighted_median

#: Metres that a placed route's centre may lie from the observed one.
GUARD = 400.0


def track_ends(lat: np.ndarray, lon: np.ndarray, sim: np.ndarray) -> tuple[tuple[float, float], tuple[float, float]]:
    """Robust centres of a track's first and last sixteenth, of five observations at least."""
    k = max(5, len(lat) // 16)
    return robust_center(lat[:k], lon[:k], sim[:k]), robust_center(lat[-k:], lon[-k:], sim[-k:])


def turned(route: np.ndarray, degrees: float) -> np.ndarray:
    """The route turned about its start."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return route[0] + (route - route[0]) @ np.array([[c, s], [-s, c]])


def best_turn(route: np.ndarray, at: np.ndarray, seen: np.ndarray, weight: np.ndarray, least: int = 8, extent: float = 100.0, share: float = 0.75, metres: float = 20.0, explain: float = 300.0) -> tuple[float, float, float] | None:
    """(degrees, median before, median after) of the turn that fits best, or None where a gate fails.

    Two grids: 2 degrees over the circle, then a quarter within 2 degrees of its best.
    """
    if len(at) < least or len(route) < 2 or np.linalg.norm(route - route[0], axis=1).max() < extent:
        return None
    miss = lambda a: weighted_median(np.linalg.norm(turned(route, a)[at] - seen, axis=1), weight)
    coarse = min(np.arange(-180.0, 180.0, 2.0), key=miss)
    angle = min(coarse + np.arange(-2.0, 2.125, 0.25), key=miss)
    before, after = miss(0.0), miss(angle)
    accepted = after < share * before and before - after >= metres and after <= explain
    return (float(angle), before, after) if accepted else None


def place_on_track(route: np.ndarray, at: np.ndarray, seen: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, str, float | None, float] | None:
    """The placed route, how it was placed, its turn and its median miss; None if no pin stays near the centre.

    The route is pinned to the track's start; if that leaves its centre too far
    off, it is scaled to the track's extent first.  A turn then polishes the pin,
    or saves one that failed.  A pinned route is bent towards the observations at
    last.  No step may move the centre beyond the guard.
    """
    near = lambda r: np.linalg.norm(r.mean(axis=0) - center) <= GUARD
    weight = np.maximum(np.asarray(weight, float), 0)
    weight = weight if weight.sum() > 0 else np.ones(len(at))
    pins = [(route + (start - route[0]), "startpin")]
    wanted, own = np.linalg.norm(end - start), np.linalg.norm(route[-1] - route[0])
    if not near(pins[0][0]) and wanted > 200 and own > 1:
        pins.insert(0, ((route - route[0]) * np.clip(wanted / own, 0.5, 2.0) + start, "startpin_scaled"))
    good = [p for p in pins if near(p[0])][:1]
    placed, mode, angle = (*good[0], None) if good else (None, None, None)
    for pin, name in good or pins:
        turn = best_turn(pin, at, seen, weight)
        if turn and near(moved := turned(pin, turn[0])):
            placed, mode, angle = moved, f"{name}+turn", turn[0]
            break
    if placed is None:
        return None
    bent = elastic_fuse(placed, at, seen, weight)
    if bent is not None and near(bent[0]):
        placed, mode = bent[0], f"{mode}+bend"
    return placed, mode, angle, weighted_median(np.linalg.norm(placed[at] - seen, axis=1), weight)


def distinct_places(clusters: list[int], most: int = 5) -> list[tuple[int, int, int]]:
    """(rank, index of the best member, members) of the first clusters of ranked candidates."""
    first: dict[int, int] = {}
    for i, c in enumerate(clusters):
        first.setdefault(c, i)
    ranked = sorted(first.items(), key=lambda x: x[1])[:most]
    return [(rank, i, clusters.count(c)) for rank, (c, i) in enumerate(ranked, 1)]
