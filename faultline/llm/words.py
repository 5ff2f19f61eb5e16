"""Encoding by a public tokenizer, a distinct word at a time.

The tokenizer splits at white space and between letters and other characters before anything else, so the
ids of a text are those of its words in order. Words repeat, so each is encoded once per worker; the table of
known words is bounded.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Words a worker remembers; beyond it forgets all and starts anew.
KNOWN_WORDS = 900_000
#: Ends of words that are encoded apart from the letters before them.
ENDS = ".,;:!?*%$&#|"
#: Letters whose lower-casing depends on their neighbours or changes their number.
ODD_LETTERS = ("Σ", "İ")


def byte_letters() -> dict[int, int]:
    """Where byte-level tokenizers put bytes that have no visible Latin-1 letter: at 256 and on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in visible)}


class _Known(dict):
    """Ids of words, as bytes of unsigned 32-bit integers; unknown words are encoded when they are asked for."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(ENDS)
        if stem != word and self.plain(stem):
            found = self[stem] + self[word[len(stem) :]]
        elif self.plain(word):
            shown = word.lower()
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(self.letters)
            found = array("I", [token.id for token in self.tokenize(shown)]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    @staticmethod
    def plain(word: str) -> bool:
        """Letters only, which the tokenizer keeps together and lower-cases one by one."""
        return word.isalpha() and (word.isascii() or simple(word))

    def encode(self, text: str) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
            self[""] = b""
        # Only the space and the line feed: other white space stays inside a word and is left to the tokenizer.
        if "<|" not in text and (text.isascii() or simple(text)):
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), dtype="<u4")


def simple(text: str) -> bool:
    """Whether lower-casing letter by letter commutes with normalisation."""
    return (
        not any(letter in text for letter in ODD_LETTERS)
        and unicodedata.is_normalized("NFC", text)
        and unicodedata.is_normalized("NFC", text.lower())
    )


@lru_cache(maxsize=2)
def word_encoder(path: str, known_words: int = KNOWN_WORDS):
    """Text to uint32 ids by the lower-casing byte-level file at `path`, without special tokens; one for each worker."""
    return _Known(path, known_words).encode
