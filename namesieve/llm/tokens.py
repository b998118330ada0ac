"""Token ids of whole texts by a tokenizer file, with repeated words encoded once per worker.

The pre-tokenizers of the files in use never join characters across a single space or line break between two words,
nor across the edge of a run of letters and a mark that is neither letter, digit nor apostrophe. So a text whose
words are divided by single spaces and line breaks is a row of words whose ids can be looked up one by one; a word
met for the first time goes to the tokenizer. Any other text (double spaces, other white space, a special token's
string) is encoded whole. The tests compare the ids with those of the plain call.
"""

from __future__ import annotations

import gc
import os
import re
from functools import cache

import numpy as np

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WIDE = re.compile("[^\x00-\xff]")
_MARKS = '.,;:!?"()|*#%&$'
_UNSURE = re.compile("[\x1c-\x1f᠎​⁠﻿]")
#: Words that a worker keeps, in two generations; some 300 MB.
KEPT_WORDS = 1_600_000


def tokenizer_path(name: str) -> str:
    """The file ``name`` of the installed vocabulary collection; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Word to packed ids. What is looked up again within a generation lives on, the rest goes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) * 2 >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            base = word.rstrip(_MARKS)
            if len(base) < len(word) and _LETTERS.fullmatch(base):
                found = self[base] + self.encode(word[len(base) :], False)
            else:
                found = self.encode(word, True)
        self[word] = found
        return found


class Encoder:
    """Encodes texts with one tokenizer file; ids fit ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.bytes = _byte_letters()
        #: A lower-casing tokenizer drops white space; the other keeps a space with the word after it.
        self.lower = self.tokenizer.normalizer is not None
        self.first = _Words(self._ids)
        self.spaced = self.first if self.lower else _Words(self._spaced_ids)
        self.line_break = b"" if self.lower else self._packed("\n")

    def _packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _run(self, letters: str) -> bytes:
        """Ids of a run of Latin letters, with or without a space before it: one piece to the model."""
        mapped = letters.encode().decode("latin-1").translate(self.bytes)
        return np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], self.dtype).tobytes()

    def _ids(self, word: str, whole: bool) -> bytes:
        if whole and _LETTERS.fullmatch(word):
            return self._run(word.lower() if self.lower else word)
        return self._packed(word)

    def _spaced_ids(self, word: str, whole: bool) -> bytes:
        if not whole:
            return self.first[word]
        return self._run(f" {word}") if _LETTERS.fullmatch(word) else self._packed(f" {word}")

    def _plain(self, text: str) -> list[str] | None:
        """The words of a text, if single spaces and line breaks divide them and nothing in it is special."""
        words = text.split()
        if (
            len(words) != text.count(" ") + text.count("\n") + 1
            or (self.special and self.special.search(text))
            or _UNSURE.search(text)
        ):
            return None
        return words

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text, without special tokens added; a null text has none."""
        if not text:
            return np.empty(0, self.dtype)
        # Up to U+00FF all lower-casing is alike, and fewer words differ.
        words = self._plain(text.lower() if self.lower and not _WIDE.search(text) else text)
        if words is None:
            return np.frombuffer(self._packed(text), self.dtype)
        if self.lower:
            return np.frombuffer(b"".join(map(self.first.__getitem__, words)), self.dtype)
        lines = []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            lines.append(self.first[head] + b"".join(map(self.spaced.__getitem__, tail)))
        return np.frombuffer(self.line_break.join(lines), self.dtype)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def release() -> None:
    """Forget the words this worker keeps. Workers go on to other jobs' tasks; those that need much memory call this."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its words refer to each other
