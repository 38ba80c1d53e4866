"""The reset-window rules as a scan that can be taken apart and put together.

A rule keeps the times of recent rows. A row drops what is older than the window, joins, and when ``threshold`` times
are held the rule fires and forgets them all.

What a stretch of rows does depends on the held times that enter it, but only up to the first fire, and of the rows before
that only those matter where the stretch's own surviving rows are more than ever before: at such a *mark* with m own
rows the rule fires if ``threshold - m`` of the entering times are still young. From there on everything is fixed. So a
stretch is a small ``Chunk`` of at most ``threshold`` marks, and two neighbouring chunks make one chunk again.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np

#: Stretches below this are summarised by a plain loop; the arrays pay off above.
FEW = 48


class Chunk(NamedTuple):
    """What a stretch of rows does to the held times that enter it.

    ``marks[m - 1]`` is the latest time up to the first row with m own surviving rows; if the rule fires there, ``leaves[m - 1]``
    of ``tail`` are held at the end. ``alone`` is the same for a rule that fires without entering times, else -1. ``tail``
    are the times that survive at the end, ``top`` is the latest time.
    """

    marks: list[int]
    leaves: list[int]
    alone: int
    tail: list[int]
    top: int


def run(held: list[int], times: list[int], window: int, threshold: int) -> tuple[list[int], list[int]]:
    """The places that fire and what is held at the end, given what is held before."""
    fires, held = [], list(held)
    low = min(held, default=0)
    for at, now in enumerate(times):
        if held and now - low > window:
            held = [t for t in held if now - t <= window]
            low = min(held, default=now)
        low = min(low, now) if held else now
        held.append(now)
        if len(held) >= threshold:
            fires.append(at)
            held = []
    return fires, held


def young(held: list[int], top: int, window: int) -> list[int]:
    """Held times that a row of time ``top`` leaves."""
    return [t for t in held if top - t <= window]


def enter(chunk: Chunk, held: list[int], window: int, threshold: int) -> list[int]:
    """The held times after a chunk, given those before it."""
    if held:
        for own, (mark, leaves) in enumerate(zip(chunk.marks, chunk.leaves, strict=True), 1):
            left = young(held, mark, window)
            if len(left) + own >= threshold:
                return chunk.tail[len(chunk.tail) - leaves:]
            if not left:
                break
    if chunk.alone >= 0:
        return chunk.tail[len(chunk.tail) - chunk.alone:]
    return young(held, chunk.top, window) + chunk.tail


def join(a: Chunk, b: Chunk, window: int, threshold: int) -> Chunk:
    """The chunk of two neighbouring stretches."""
    tail = (young(a.tail, b.top, window) + b.tail)[-(threshold - 1):] if threshold > 1 else []
    through = lambda leaves: len(enter(b, a.tail[len(a.tail) - leaves:], window, threshold))
    marks, leaves, alone = list(a.marks), [through(x) for x in a.leaves], -1
    if a.alone >= 0:
        return Chunk(marks, leaves, through(a.alone), tail, max(a.top, b.top))
    for own, (mark, left) in enumerate(zip(b.marks, b.leaves, strict=True), 1):
        both = len(young(a.tail, mark, window)) + own
        if both >= threshold:
            alone = left
            break
        if both > len(marks):  # one more at most than at the mark before
            marks.append(max(a.top, mark))
            leaves.append(left)
    return Chunk(marks, leaves, b.alone if alone < 0 else alone, tail, max(a.top, b.top))


def summarise(times: list[int], window: int, threshold: int) -> Chunk:
    """The chunk of the rows of one stretch, in their order."""
    return _summarise_few(times, window, threshold) if len(times) < FEW else _summarise_many(np.asarray(times, np.int64), window, threshold)


def _summarise_few(times: list[int], window: int, threshold: int) -> Chunk:
    alive, top, marks, at, alone_at = [], times[0], [], [], -1
    for place, now in enumerate(times):
        top = max(top, now)
        alive = [t for t in alive if now - t <= window]
        alive.append(now)
        if alone_at < 0 and len(alive) > len(marks):
            if len(alive) >= threshold:
                alone_at = place
            else:
                marks.append(top)
                at.append(place)
    after = lambda place: len(run([], times[place + 1:], window, threshold)[1])
    tail = alive[-(threshold - 1):] if threshold > 1 else []
    return Chunk(marks, [after(p) for p in at], after(alone_at) if alone_at >= 0 else -1, tail, top)


def _summarise_many(times: np.ndarray, window: int, threshold: int) -> Chunk:
    own, last = survivor_counts(times, window, threshold)
    latest = np.maximum.accumulate(times)
    most = np.maximum.accumulate(own)
    first = np.searchsorted(most, np.arange(1, min(int(most[-1]), threshold) + 1), "left").tolist()
    alone_at = first.pop() if len(first) == threshold else -1
    furthest = np.maximum.accumulate(last).tolist()
    alive = np.flatnonzero(times >= np.maximum.accumulate(times[::-1])[::-1] - window)
    alive = alive[len(alive) - min(len(alive), threshold - 1):]
    ended: dict[int, int] = {}

    def after(place: int) -> int:
        """How many are held at the end by a rule that forgot everything at ``place``."""
        start, passed = place + 1, []
        while start not in ended:
            passed.append(start)
            fire = bisect_left(furthest, start, lo=min(start, len(furthest)))
            if fire == len(furthest):
                ended[start] = int(len(alive) - np.searchsorted(alive, start))
                break
            start = fire + 1
        for p in passed:
            ended[p] = ended[start]
        return ended[start]

    return Chunk(latest[first].tolist(), [after(p) for p in first], after(alone_at) if alone_at >= 0 else -1, times[alive].tolist(), int(latest[-1]))


def survivor_counts(times: np.ndarray, window: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many rows up to it survive (beyond ``threshold`` at least that many), and the place of the
    ``threshold``-th last of them, else -1. A rule that last forgot before place s fires at the first row whose place is at least s."""
    n = len(times)
    last = np.full(n, -1, np.int64)
    if bool((np.diff(times) >= 0).all()):
        own = np.arange(1, n + 1) - np.searchsorted(times, times - window, "left")
        full = np.flatnonzero(own >= threshold)
        last[full] = full - threshold + 1
        return own, last
    own, held, values = np.zeros(n, np.int64), [], times.tolist()
    for place, now in enumerate(values):
        held = [p for p in held if now - values[p] <= window]
        held.append(place)
        own[place] = len(held)
        if len(held) >= threshold:
            last[place] = held[-threshold]
            del held[:len(held) - threshold]  # older ones make no difference any more
    return own, last
