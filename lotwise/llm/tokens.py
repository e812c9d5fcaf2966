"""Token ids of whole documents by the tokenizers library, a word at a time.

The tokenizer used here never joins text across ASCII white space (its
pre-tokenizer drops white space and its normaliser only folds it), so a text's
ids are those of its words in order. Each task encodes a word once and looks it
up afterwards; tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from .textkit import SpanNumbers, kept, word_spans

#: Joins words in one call; a word of its own to the pre-tokenizer, and one token.
_MARK = "\x01"
_JOINED = 2000
#: Words kept from earlier batches of the same Python worker.
_KEEP_WORDS = 2_000_000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of rows of words; words seen so far are kept and told apart by their bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.numbers = SpanNumbers(_KEEP_WORDS)
        self._forget()

    def _forget(self) -> None:
        self.numbers.clear()
        self.places = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        plain = self.mark is not None and not any(_MARK in w for w in words)
        if not plain:
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((i for r in rows for i in r), np.uint32), np.array([len(r) for r in rows], np.int64)
        glue = f" {_MARK} "
        texts = [glue.join(words[i : i + _JOINED]) + glue for i in range(0, len(words), _JOINED)]
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(words):
            raise ValueError("the tokenizer doesn't keep words apart")
        return np.delete(ids, marks), np.diff(np.concatenate(([-1], marks))) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row begins (one more entry than rows)."""
        starts, ends, first = word_spans(data, offsets)
        if self.numbers.full(len(starts)):
            self._forget()
        number, new = self.numbers(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            ids, sizes = self.encode_words([raw[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.places = np.concatenate((self.places, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, ids))
        sizes = self.sizes[number]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(begin[-1]) + np.repeat(self.places[number] - begin[:-1], sizes)
        return self.ids[take], begin[first]


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    return kept(f"word tokenizer {path}", lambda: WordTokenizer(path))
