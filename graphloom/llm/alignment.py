"""Cheapest edits that give a sequence of turns the form ``(s?(ua)+)?``, by divide and conquer in linear space.

The form is an automaton of four states: nothing yet, after the system turn, after a user turn, after an assistant turn.  A
*step* consumes one turn, or a whole stretch of turns, and is described by its options: for every state before it a
list of (state after it, cost, tie), where ties of one state before compare as the letters of the edits do.  A step's letters
end with the edit that consumes its last turn, so no letters that consume the same turns are the beginning of others,
and of two ways that part at different states the one with the lower rank stays the lower one.  A vector of four costs
with four ranks is therefore all that a pass needs to keep.

``crossings`` cuts the steps in the middle, lets the costs from the front and those from the back meet there, takes of the
cheapest states the one whose letters so far are least, and goes on with both halves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
#: Codes of turns: the role's initial, and two marks.
INITIALS = {"s": 1, "u": 2, "a": 3}
MUST_GO, CUT_OFF = 4, 8
#: Pairs of initials that may follow each other.
LEGAL = frozenset({(1, 2), (2, 3), (3, 2)})
#: Inserted turns that lead from a state to an accepted end.
TAIL = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Options = tuple[tuple[tuple[int, int, object], ...], ...]
Vector = tuple[tuple[int, ...], tuple[int, ...]]


def after(state: int, letter: str, initial: int = 0) -> int | None:
    """The state that an edit leads to; None where the form forbids it."""
    if letter == "D":
        return state
    if letter == "K":
        if initial == INITIALS["s"]:
            return SYSTEM if state == NOTHING else None
        if initial == INITIALS["u"]:
            return USER if state != USER else None
        return ASSISTANT if initial == INITIALS["a"] and state == USER else None
    return ASSISTANT if state == USER else USER


@cache
def turn_options(code: int) -> Options:
    """The options of one turn: inserted turns, then the edit of the turn itself."""
    initial, kept = code & 3, TRUNCATED if code & CUT_OFF else 0
    out = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        for inserted in range(3):  # more only go round
            state = before
            for _ in range(inserted):
                state = after(state, "I")
            for letter, cost in (("D", DELETE), *(() if code & MUST_GO else (("K", KEEP + kept), ("R", REROLE + kept)))):
                end = after(state, letter, initial)
                if end is not None:
                    way = (inserted * INSERT + cost, "I" * inserted + letter)
                    best[end] = min(best.get(end, way), way)
        out.append(tuple((end, *way) for end, way in best.items()))
    return tuple(out)


def start(state: int) -> Vector:
    return tuple(0 if x == state else NEVER for x in range(4)), (0, 0, 0, 0)


def _advance(vector: Vector, options: Options) -> Vector:
    costs, ranks = vector
    best: dict[int, tuple] = {}
    for before in range(4):
        if costs[before] < NEVER:
            for end, cost, tie in options[before]:
                way = (costs[before] + cost, ranks[before], tie)
                if end not in best or way < best[end]:
                    best[end] = way
    order = sorted(best, key=lambda end: best[end][1:])
    return tuple(best[x][0] if x in best else NEVER for x in range(4)), tuple(order.index(x) if x in best else 0 for x in range(4))


@cache
def _advance_turn(vector: Vector, code: int) -> tuple[int, Vector]:
    """One turn on, from a vector whose least cost is zero: what the least cost grows by, and the vector as before."""
    costs, ranks = _advance(vector, turn_options(code))
    least = min(costs)
    return least, (tuple(c - least if c < NEVER else NEVER for c in costs), ranks)


@cache
def _retreat_turn(costs: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
    costs = _retreat(costs, turn_options(code))
    least = min(costs)
    return least, tuple(c - least if c < NEVER else NEVER for c in costs)


def _retreat(costs: tuple[int, ...], options: Options) -> tuple[int, ...]:
    return tuple(min((cost + costs[end] for end, cost, _ in options[before] if costs[end] < NEVER), default=NEVER) for before in range(4))


class Turns:
    """Single turns as steps: one code (a byte) each."""

    def __init__(self, codes: bytes) -> None:
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def options(self, k: int) -> Options:
        return turn_options(self.codes[k])

    def forward(self, state: int, low: int, high: int) -> Vector:
        total, vector = 0, start(state)
        for k in range(low, high):
            more, vector = _advance_turn(vector, self.codes[k])
            total += more
        return tuple(c + total if c < NEVER else NEVER for c in vector[0]), vector[1]

    def backward(self, state: int, low: int, high: int) -> tuple[int, ...]:
        total, costs = 0, start(state)[0]
        for k in range(high - 1, low - 1, -1):
            more, costs = _retreat_turn(costs, self.codes[k])
            total += more
        return tuple(c + total if c < NEVER else NEVER for c in costs)


class Stretches:
    """Whole stretches of turns as steps, each by its options."""

    def __init__(self, options: Sequence[Options]) -> None:
        self.steps = options

    def __len__(self) -> int:
        return len(self.steps)

    def options(self, k: int) -> Options:
        return self.steps[k]

    def forward(self, state: int, low: int, high: int) -> Vector:
        vector = start(state)
        for k in range(low, high):
            vector = _advance(vector, self.steps[k])
        return vector

    def backward(self, state: int, low: int, high: int) -> tuple[int, ...]:
        costs = start(state)[0]
        for k in range(high - 1, low - 1, -1):
            costs = _retreat(costs, self.steps[k])
        return costs


def crossings(steps: Turns | Stretches, first: int, last: int) -> list[tuple[int, int, object]]:
    """(state before, state after, tie) of every step on the least of the cheapest ways from ``first`` to ``last``."""
    out: list[tuple[int, int, object]] = []

    def go(low: int, high: int, first: int, last: int) -> None:
        if high - low == 1:
            _, tie = min((cost, tie) for end, cost, tie in steps.options(low)[first] if end == last)
            out.append((first, last, tie))
            return
        middle = (low + high) // 2
        costs, ranks = steps.forward(first, low, middle)
        rest = steps.backward(last, middle, high)
        meet = min((x for x in range(4) if costs[x] < NEVER and rest[x] < NEVER), key=lambda x: (costs[x] + rest[x], ranks[x]))
        go(low, middle, first, meet)
        go(middle, high, meet, last)

    if len(steps):
        go(0, len(steps), first, last)
    return out


def finish(steps: Turns | Stretches) -> tuple[int, int]:
    """The least cost of all steps from the start to an accepted end, and the state after the last step."""
    costs, ranks = steps.forward(NOTHING, 0, len(steps))
    end = min((x for x in range(4) if costs[x] < NEVER), key=lambda x: (costs[x] + TAIL[x] * INSERT, ranks[x]))
    return costs[end] + TAIL[end] * INSERT, end
