"""Pure transition function of the hysteresis alert machine, shared by batch and stream.

A machine is a tuple ``(confirmed, candidate, streak, exit_streak)`` of small integers:
``confirmed`` is the confirmed class or -1, ``candidate`` the class whose entry streak is
being counted (entry while healthy, switch while confirmed) or -1. The number of
distinct machines is small, which makes whole blocks composable (see
:func:`transfer`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

NONE = -1
START = (NONE, NONE, 0, 0)


@dataclass(frozen=True)
class Policy:
    entry_probability: float
    entry_persistence: int
    exit_probability: float
    exit_persistence: int


def advance(machine, diagnosis, qualifies, healthy_evidence, valid, policy):
    """Next machine and event: ``None`` or ``(kind, from_class, to_class)`` with -1 for healthy.

    ``diagnosis`` is the argmax class; ``qualifies`` says it is a fault at or above the
    entry probability; ``healthy_evidence`` that p(healthy) reaches the exit probability.
    """
    confirmed, candidate, streak, exits = machine
    if not valid:
        # a gap interrupts an unconfirmed streak and freezes a confirmed machine
        return (START if confirmed == NONE else machine), None
    tracked = qualifies and diagnosis != confirmed
    streak = (streak + 1 if diagnosis == candidate else 1) if tracked else 0
    candidate = diagnosis if tracked else NONE
    if confirmed != NONE:
        exits = exits + 1 if healthy_evidence else 0
        if exits >= policy.exit_persistence:
            return START, ("cleared", confirmed, NONE)
    if tracked and streak >= policy.entry_persistence:
        kind = "new_alert" if confirmed == NONE else "class_change"
        return (candidate, NONE, 0, 0), (kind, confirmed, candidate)
    return (confirmed, candidate, streak, exits), None


def machines(classes: int, healthy: int, policy: Policy):
    """Every machine that can occur at a row border."""
    faults = [c for c in range(classes) if c != healthy]
    counting = range(1, policy.entry_persistence)
    out = [START] + [(NONE, c, n, 0) for c in faults for n in counting]
    for confirmed in faults:
        for exits in range(policy.exit_persistence):
            out.append((confirmed, NONE, 0, exits))
            out += [(confirmed, c, n, exits) for c in faults if c != confirmed for n in counting]
    return out


class Table:
    """The machine of one policy as tables over numbered states and inputs, filled by :func:`advance`.

    An input is a row's diagnosis and its three flags; there are ``8 * classes`` of them, and few states. Stepping through a
    series is one look-up per row, whatever the rules are.
    """

    def __init__(self, classes: int, healthy: int, policy: Policy):
        self.states = machines(classes, healthy, policy)
        self.number = {m: i for i, m in enumerate(self.states)}
        self.following: list[list[int]] = []
        self.events: dict[tuple[int, int], tuple] = {}
        for i, machine in enumerate(self.states):
            row = []
            for symbol in range(8 * classes):
                diagnosis, qualifies, *_ = unpacked(symbol)
                if qualifies and diagnosis == healthy:
                    row.append(NONE)  # no row has this input
                    continue
                after, event = advance(machine, *unpacked(symbol), policy)
                row.append(self.number.setdefault(after, len(self.number)))
                if event is not None:
                    self.events[i, symbol] = event
            self.following.append(row)
        if len(self.number) > len(self.states):
            raise ValueError("a machine is reached that is not among the listed ones")

    def run(self, symbols: Sequence[int], start=START) -> list[int]:
        """Number of the state before each row, and after the last one."""
        following = self.following
        return list(accumulate(symbols, lambda state, symbol: following[state][symbol], initial=self.number[start]))


@lru_cache(maxsize=1_024)
def table_of(classes: int, healthy: int, policy: Policy) -> Table:
    """The table of a policy, made once in a process: a search steps through many series with the same few."""
    return Table(classes, healthy, policy)


def packed(diagnosis, qualifies, healthy_evidence, valid):
    """Number of an input; works on arrays."""
    return diagnosis * 8 + qualifies * 4 + healthy_evidence * 2 + valid * 1


def unpacked(symbol: int) -> tuple[int, bool, bool, bool]:
    return symbol >> 3, bool(symbol & 4), bool(symbol & 2), bool(symbol & 1)


def transfer(symbols: Sequence[int], table: Table) -> dict:
    """End machine for every possible start machine of a block.

    Starts that reach the same machine are advanced together from then on, so the cost
    soon falls to that of a single pass.
    """
    current = {i: [i] for i in range(len(table.states))}
    rest = iter(symbols)
    for symbol in rest:
        merged: dict[int, list[int]] = {}
        for state, starts in current.items():
            merged.setdefault(table.following[state][symbol], []).extend(starts)
        current = merged
        if len(current) == 1:
            break
    ends = {}
    left = list(rest)
    for state, starts in current.items():
        end = table.run(left, table.states[state])[-1]
        ends.update({table.states[start]: table.states[end] for start in starts})
    return ends


def block_transfer(rows, classes: int, healthy: int, policy: Policy) -> dict:
    """:func:`transfer` of rows (diagnosis, qualifies, healthy evidence, valid)."""
    return transfer([packed(*row) for row in rows], table_of(classes, healthy, policy))


def encode(machine) -> str:
    return ",".join(map(str, machine))


def decode(text):
    return START if text is None else tuple(int(part) for part in text.split(","))
