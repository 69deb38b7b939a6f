"""Adaptive trials: a tree-structured Parzen estimator (Bergstra et al., 2011).

Trials come in rounds, so that those of a round share the passes over the data. The best
quarter of the trials so far and the others each give a density over the parameters; of many
points drawn from the first, a round proposes those that it holds far likelier than the
second. Only the table of trials is on the driver, never data.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

GOOD = 0.25        # share of the trials that count as good
POOL = 24          # points drawn for each proposal; more make it greedy
RANDOM = 10        # trials drawn without looking at results


@dataclass(frozen=True)
class Span:
    """A parameter between two ends, both included; ``log`` spreads it by its logarithm, and
    with ``step`` it is a whole number, the low end plus a multiple of the step."""

    low: float
    high: float
    log: bool = False
    step: int | None = None

    def value(self, at: float) -> float | int:
        """The parameter at a share from 0 to 1 of the way."""
        if self.step:
            count = int((self.high - self.low) // self.step) + 1
            return int(self.low) + self.step * min(int(at * count), count - 1)
        if self.log:
            return float(np.exp(np.log(self.low) + at * (np.log(self.high) - np.log(self.low))))
        return float(self.low + at * (self.high - self.low))

    def place(self, value: float) -> float:
        if self.step:
            count = int((self.high - self.low) // self.step) + 1
            return ((value - self.low) / self.step + 0.5) / count
        if self.high == self.low:
            return 0.5
        if self.log:
            return float(np.log(value / self.low) / np.log(self.high / self.low))
        return float((value - self.low) / (self.high - self.low))


Space = Mapping[str, "Span | Sequence"]      # a sequence lists the values of a choice


@dataclass(frozen=True)
class Trial:
    round: int
    values: dict
    goals: tuple[float, ...]      # the less the better


def order_of(goals: Sequence[tuple[float, ...]]) -> np.ndarray:
    """Trials from best to worst. With several goals those that no other beats come first,
    then those that only they beat, and so on; within a front, lonely ones come first."""
    table = np.array(goals, float).reshape(len(goals), -1)
    table = np.where(np.isnan(table), np.inf, table)
    if table.shape[1] == 1:
        return np.argsort(table[:, 0], kind="stable")
    beats = (table[:, None] <= table[None]).all(2) & (table[:, None] < table[None]).any(2)
    out, left = [], np.ones(len(table), bool)
    while left.any():
        front = np.flatnonzero(left & ~beats[left].any(0))
        room = np.zeros(len(front))
        for goal in range(table.shape[1]):
            column = table[front, goal]
            along = np.argsort(column, kind="stable")
            ends = column[along[-1]] - column[along[0]]
            room[along[[0, -1]]] = np.inf
            if len(front) > 2 and np.isfinite(ends) and ends > 0:
                room[along[1:-1]] += (column[along[2:]] - column[along[:-2]]) / ends
        out += front[np.argsort(-room, kind="stable")].tolist()
        left[front] = False
    return np.array(out, int)


class _Density:
    """Of one parameter: normal bumps on the places of trials and a wide one for the rest."""

    def __init__(self, places: np.ndarray):
        near = np.sort(np.r_[places, 0.5])
        left, right = np.diff(np.r_[0.0, near]), np.diff(np.r_[near, 1.0])
        self.middle = near
        self.width = np.clip(np.maximum(left, right), 1 / min(100, len(near) + 1), 1.0)
        self.width[np.searchsorted(near, 0.5)] = 1.0

    def draw(self, rng: np.random.Generator, count: int) -> np.ndarray:
        which = rng.integers(len(self.middle), size=count)
        out = rng.normal(self.middle[which], self.width[which])
        while (bad := (out < 0) | (out > 1)).any():
            out[bad] = rng.normal(self.middle[which[bad]], self.width[which[bad]])
        return out

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.middle) / self.width
        return np.log((np.exp(-0.5 * z * z) / self.width).mean(1) + 1e-300)


def _shares(found: Sequence, options: Sequence) -> np.ndarray:
    count = np.array([1.0 + sum(f == o for f in found) for o in options])
    return count / count.sum()


def random_values(space: Space, rng: np.random.Generator) -> dict:
    return {
        name: span.value(rng.uniform()) if isinstance(span, Span) else span[int(rng.integers(len(span)))]
        for name, span in space.items()}


def propose(space: Space, seen: Sequence[Trial], count: int, rng: np.random.Generator) -> list[dict]:
    """Parameters of the next round. What is proposed counts as not good until it is tried, so
    one round doesn't try one point many times."""
    order = order_of([t.goals for t in seen])
    cut = max(1, int(np.ceil(GOOD * len(seen))))
    good, rest = [seen[i].values for i in order[:cut]], [seen[i].values for i in order[cut:]]
    out = []
    for _ in range(count):
        gain, drawn = np.zeros(POOL), {}
        for name, span in space.items():
            if isinstance(span, Span):
                high, low = (_Density(np.array([span.place(v[name]) for v in some])) for some in (good, rest))
                drawn[name] = high.draw(rng, POOL)
                gain += high.log(drawn[name]) - low.log(drawn[name])
            else:
                high, low = (_shares([v[name] for v in some], span) for some in (good, rest))
                drawn[name] = rng.choice(len(span), POOL, p=high)
                gain += np.log(high[drawn[name]]) - np.log(low[drawn[name]])
        best = int(gain.argmax())
        values = {
            name: span.value(float(drawn[name][best])) if isinstance(span, Span) else span[int(drawn[name][best])]
            for name, span in space.items()}
        out.append(values)
        rest = [*rest, values]
    return out


def search(
    space: Space, evaluate: Callable[[list[dict]], Sequence[tuple[float, ...]]], rounds: int, per_round: int, seed: int,
) -> list[Trial]:
    """Run the rounds. ``evaluate`` gets the parameters of all trials of a round and gives
    their goals, the less the better; a goal that is not a number is the worst."""
    done: list[Trial] = []
    for turn in range(rounds):
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{turn}".encode()))
        free = max(0, min(per_round, RANDOM - len(done)))
        values = [random_values(space, rng) for _ in range(free)]
        if per_round > free:
            values += propose(space, done, per_round - free, rng) if done else [
                random_values(space, rng) for _ in range(per_round - free)]
        goals = evaluate(values)
        done += [Trial(turn, v, tuple(map(float, g))) for v, g in zip(values, goals)]
    return done
