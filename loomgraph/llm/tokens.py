"""Exact, cached encoding with a public tokenizer file.

The ``tokenizers`` library encodes one word at a time and most words of a
corpus repeat, so each Python worker keeps the ids of the words it has seen.
Both supported files cut a text into runs of letters, digits, other signs and
white space before they merge anything, hence the ids of a text are the ids of
those runs in order. New runs of Latin letters go straight to the merges of the
library's model, others through all of it. A text with characters that Python and the library class
differently goes to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa

#: Entries that one worker keeps (some 60 MB); past it the cache starts anew.
CACHE_ENTRIES = 400_000
#: Characters encoded at a time.
GROUP_CHARS = 1_000_000

#: The cut that the files make before merging: contractions, letters, digits, the rest, white space.
_SPACED = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^\W\d_]+|\d+|(?:[^\s\w]|_)+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Byte-level files write bytes without a sign as letters from 256 on; line ends stand between words here.
_LETTERS = {c: 256 + i for i, c in enumerate([*range(33), *range(127, 161), 173]) if c != 10}
_ENCODERS: dict[tuple[str, bool], "WordEncoder"] = {}


def _regular(text: str) -> bool:
    """Python's character classes are the tokenizer's for every character here."""
    if _ODD_SPACE.search(text):
        return False
    if text.isascii():
        return True
    return "\u0130" not in text and unicodedata.is_normalized("NFC", text) and all(c.isalpha() or not c.isalnum() or c.isdecimal() for c in set(text))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[list, ...]]:
    """The columns of a few rows at a time, so that no batch is held as Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield tuple(c.slice(i, rows).to_pylist() for c in b.columns)


def encoder(name: str, spaced: bool) -> "WordEncoder":
    """The worker's encoder for one tokenizer file of ``public_tokenizers``.

    ``spaced``: a word's ids depend on the space before it (byte-level files);
    otherwise white space is dropped by the file itself.
    """
    key = (name, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(name, spaced)
    return _ENCODERS[key]


class _Index(dict):
    """Numbers words as they come and lists those that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


def _either(words: list[str], test: list[bool], yes: Callable, no: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of all words, by ``yes`` where the test holds and by ``no`` elsewhere."""
    if all(test) or not any(test):
        return (yes if all(test) else no)(words)
    own = np.array(test)
    (a, na), (b, nb) = yes(list(compress(words, test))), no(list(compress(words, ~own)))
    sizes = np.empty(len(words), np.int64)
    sizes[own], sizes[~own] = na, nb
    of = np.repeat(own, sizes)
    ids = np.empty(len(of), np.uint32)
    ids[of], ids[~of] = a, b
    return ids, sizes


class WordEncoder:
    """``encode(texts)`` gives (ids uint32, offsets int64) of all texts joined."""

    def __init__(self, name: str, spaced: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced = spaced
        self.cut = (_SPACED if spaced else _PLAIN).findall
        self.merge = self.tokenizer.model.tokenize
        # In joined words: the ids that stand between words, or that end a run that the file cuts.
        self.marks = np.zeros(max(self.tokenizer.get_vocab(True).values()) + 1, bool)
        if spaced:
            self.marks[self._library(["\n"])[0]] = True
        else:
            self.marks[[n for w, n in self.tokenizer.get_vocab(True).items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.known = 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words that the file does not cut across: encoded as lines of one text, which is cheaper than one by one."""
        if not any(map(str.isspace, words)):
            ids = np.array(self._library(["\n".join(words)])[0], np.uint32)
            ends = np.flatnonzero(self.marks[ids])
            if self.spaced and len(ends) == len(words) - 1:
                return ids[~self.marks[ids]], np.diff(ends, prepend=-1, append=len(ids)) - 1
            if not self.spaced:
                runs = np.cumsum([len(w) if w[0].isdecimal() else 1 for w in words])  # digits are cut one by one
                if len(ends) == runs[-1] and ends[-1] == len(ids) - 1:
                    return ids, np.diff(ends[runs - 1], prepend=-1)
        encoded = self._library(words)
        sizes = np.fromiter(map(len, encoded), np.int64, len(words))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of plain words: straight to the library's merges, past its cutting, which costs more."""
        text = "\n".join(words)
        if not self.spaced:
            text = text.lower()
        ids, sizes = [], []
        for word in text.encode().decode("latin-1").translate(_LETTERS).split("\n"):
            found = self.merge(word)
            sizes.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:  # white space would join the line ends
            return _either(words, [not w.isspace() for w in words], self._ids, self._ids)
        return self._ids(words)

    def _learn(self, words: list[str]) -> None:
        # Plain: Latin words that the file hands to its merges as one piece.
        if self.spaced:
            plain = [(w.isascii() or max(w) < "\u0100") and not w.isspace() for w in words]
        else:
            plain = [(w.isascii() or max(w) < "\u0100") and not w[0].isdecimal() for w in words]
        ids, sizes = _either(words, plain, self._merged, self._cut)
        n, k = len(ids), self.known
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while k + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.sizes[k : k + len(words)] = sizes
        self.starts[k : k + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + n] = ids
        self.used += n
        self.known += len(words)
        self.index.new = []

    def _words(self, text: str) -> list[str] | None:
        """The text's words; None if the library has to see it whole."""
        return self.cut(text) if _regular(text) else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, sizes = [np.empty(0, np.uint32)], np.zeros(len(texts) + 1, np.int64)
        first = 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + len(texts[last]) <= GROUP_CHARS):
                chars += len(texts[last])
                last += 1
            ids, sizes[first + 1 : last + 1] = self._encode_group(texts[first:last])
            pieces.append(ids)
            first = last
        return np.concatenate(pieces), np.cumsum(sizes)

    def _encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._words(t) for t in texts]
        sizes = np.zeros(len(texts), np.int64)
        words = [w for ws in cut if ws is not None for w in ws]
        ids, word_sizes = self._join(words)
        ends = np.concatenate([[0], np.cumsum(word_sizes)])
        at = np.cumsum([0, *(len(ws or ()) for ws in cut)])
        sizes[:] = ends[at[1:]] - ends[at[:-1]]
        whole = [i for i, ws in enumerate(cut) if ws is None]
        if not whole:
            return ids, sizes
        pieces = np.split(ids, ends[at[1:-1]])
        for i, got in zip(whole, self._library([texts[i] for i in whole])):
            pieces[i], sizes[i] = np.asarray(got, np.uint32), len(got)
        return np.concatenate(pieces), sizes

    def _join(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > self.known:
            self._learn(self.index.new)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        take = np.arange(int(sizes.sum())) + np.repeat(self.starts[at] - ends + sizes, sizes)
        ids = self.flat[take]
        if len(self.index) > CACHE_ENTRIES:
            self._clear()
        return ids, sizes
