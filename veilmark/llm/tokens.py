"""Token ids of whole texts by a public tokenizer, word by word with a bounded memo.

The tokenizer of `word_bpe_49k.json` drops white space and never merges across it, so the ids of a text are the ids of
its white-space-separated words in order.  Words repeat, so each worker keeps the ids of words it has met; the memo
saves time only and is emptied when full.  Words of printable Latin-1 characters need no normalisation but lower case, so
they are split into the tokenizer's pieces here and go straight to its merge model; all others take its whole course.
"""

from __future__ import annotations

import os
import re
from array import array

MEMO_WORDS = 600_000
_loaded: dict[str, WordTokens] = {}
_PLAIN = re.compile(r"[!-~\xa1-\xff]+")
# The pieces into which the tokenizer's file splits a lower-cased word, spelled for Latin-1.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def default_path() -> str:
    """The file of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.marks = {bytes([c]): self._piece(chr(c)) for c in b".,;:!?"}

    def _piece(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _letters(self, word: bytes) -> bytes:
        word = word.lower()
        got = self.words.get(word)
        if got is None:
            got = self.words[word] = self._piece(word.decode("ascii"))
        return got

    def _word(self, raw: bytes) -> bytes:
        if raw.isalpha():
            return self._letters(raw)
        if raw[-1:] in self.marks and raw[:-1].isalpha():
            return self._letters(raw[:-1]) + self.marks[raw[-1:]]
        word = raw.decode("utf-8", "replace")
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._piece(p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(_LETTERS)) for p in _PIECE.findall(word.lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        known = self.words
        for w in set(words).difference(known):
            known[w] = self._word(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > MEMO_WORDS:
            known.clear()
        return out


def word_tokens(path: str) -> WordTokens:
    """The encoder of this worker process."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordTokens(path)
    return _loaded[path]
