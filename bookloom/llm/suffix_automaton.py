"""Suffix automaton of several token sequences, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """Accepts every run of tokens of the sequences added so far."""

    def __init__(self) -> None:
        self.steps: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, steps: dict, link: int, length: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, token: Hashable, target: int) -> int:
        """A copy of the target that stands for its shorter runs only."""
        copy = self._state(dict(self.steps[target]), self.link[target], self.length[state] + 1)
        while state >= 0 and self.steps[state].get(token) == target:
            self.steps[state][token] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def add(self, tokens: Sequence[Hashable]) -> None:
        last = 0
        for token in tokens:
            target = self.steps[last].get(token)
            if target is not None:
                fits = self.length[target] == self.length[last] + 1
                last = target if fits else self._split(last, token, target)
                continue
            new = self._state({}, 0, self.length[last] + 1)
            state = last
            while state >= 0 and token not in self.steps[state]:
                self.steps[state][token] = new
                state = self.link[state]
            if state >= 0:
                target = self.steps[state][token]
                fits = self.length[target] == self.length[state] + 1
                self.link[new] = target if fits else self._split(state, token, target)
            last = new

    def matches(self, tokens: Sequence[Hashable]) -> list[int]:
        """For each token, the length of the longest run ending there that is accepted."""
        out = []
        state = held = 0
        for token in tokens:
            while state and token not in self.steps[state]:
                state = self.link[state]
                held = self.length[state]
            target = self.steps[state].get(token)
            if target is not None:
                state, held = target, held + 1
            out.append(held)
        return out
