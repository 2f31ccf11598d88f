"""A generalised suffix automaton over word sequences, and the walk that yields matching lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """All factors of some word sequences. States are numbered; state 0 stands for the empty factor.

    ``step[s]`` maps a word to the next state, ``link[s]`` leads to the longest suffix that occurs
    in more places, ``length[s]`` is the longest factor of the state.
    """

    def __init__(self, sequences: Sequence[Sequence[bytes]]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        for words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)

    def _new(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, parent: int, child: int, word: bytes) -> int:
        """The state of the factors of ``child`` no longer than one word more than ``parent``."""
        if self.length[child] == self.length[parent] + 1:
            return child
        short = self._new(dict(self.step[child]), self.link[child], self.length[parent] + 1)
        self.link[child] = short
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = short
            parent = self.link[parent]
        return short

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, self.step[last][word], word)
        new = self._new({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, self.step[at][word], word)
        return new

    def suffixes(self, state: int) -> Iterator[int]:
        """The state and those of its ever shorter suffixes, without the empty one."""
        while state > 0:
            yield state
            state = self.link[state]

    def prefixes(self, words: Sequence[bytes]) -> Iterator[tuple[int, int]]:
        """(number of words, state) after each word of a sequence the automaton was built from."""
        state = 0
        for n, word in enumerate(words, 1):
            state = self.step[state][word]
            yield n, state

    def alarms(self, words: Sequence[bytes], limit: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """Matching statistics of ``words`` where they matter: (index, state, length) of every word at
        which the longest factor ending there has at least ``limit[state]`` words."""
        step, link, longest = self.step, self.link, self.length
        state = length = 0
        for i, word in enumerate(words):
            after = step[state].get(word)
            if after is not None:
                length += 1
                state = after
            else:
                while state:
                    state = link[state]
                    after = step[state].get(word)
                    if after is not None:
                        length = longest[state] + 1
                        state = after
                        break
                else:
                    length = 0
                    continue
            if length >= limit[state]:
                yield i, state, length


NEVER = 1 << 60
