"""Many fixed strings looked for in one pass over a text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick

FEW = 8  # up to so many, a pattern or a plain search each costs less than the automaton


LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Needles:
    """Fixed strings, none of them empty.  Beyond FEW they make one automaton, so a text costs the same for ten and ten thousand."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self.pattern = self.automaton = None  # the pattern is made when it is first wanted
        if len(self.words) > FEW:
            self.automaton = ahocorasick.Automaton()
            for word in self.words:
                self.automaton.add_word(word, word)
            self.automaton.make_automaton()

    def present(self, text: str) -> set[str]:
        """Those that the text has, overlapping ones too."""
        if self.automaton is None:
            return {w for w in self.words if w in text}
        return {word for _, word in self.automaton.iter(text)}

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, word) of every place, overlapping ones too."""
        if self.automaton is not None:
            yield from ((end + 1 - len(word), word) for end, word in self.automaton.iter(text))
            return
        for word in self.words:
            at = text.find(word)
            while at >= 0:
                yield at, word
                at = text.find(word, at + 1)

    def longest(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the leftmost ones that don't overlap, the longest at each place."""
        if len(self.words) == 1:
            return self._only(text, self.words[0])
        if self.automaton is None:
            if self.pattern is None:
                self.pattern = re.compile("|".join(re.escape(w) for w in sorted(self.words, key=len, reverse=True)) or "(?!)")
            return (m.span() for m in self.pattern.finditer(text))
        return self._leftmost(text)

    @staticmethod
    def _only(text: str, word: str) -> Iterator[tuple[int, int]]:
        at = text.find(word)
        while at >= 0:
            yield at, at + len(word)
            at = text.find(word, at + len(word))

    def _leftmost(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for start, back in sorted((end + 1 - len(word), -end - 1) for end, word in self.automaton.iter(text)):
            if start >= at:
                at = -back
                yield start, at


class Terms:
    """A list of terms as a rule has it: of those at one place the first listed; letters A to Z in either case if that is wanted."""

    def __init__(self, terms: Iterable[str], whole_word: bool, ignore_case: bool):
        self.whole_word, self.ignore_case = whole_word, ignore_case
        self.rank: dict[str, int] = {}
        for n, term in enumerate(terms):
            self.rank.setdefault(term.translate(_LOWER) if ignore_case else term, n)
        self.needles = Needles(self.rank)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        seen = text.translate(_LOWER) if self.ignore_case else text
        found, at = [], 0
        for start, word in self.needles.places(seen):
            end = start + len(word)
            if not self.whole_word or not (text[start - 1 : start] in LETTERS or text[end : end + 1] in LETTERS):
                found.append((start, self.rank[word], end))
        for start, _, end in sorted(found):
            if start >= at:
                at = end
                yield start, end
