"""Token ids of whole texts, encoded word by word with a bounded cache."""

from __future__ import annotations

import functools
from itertools import chain
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

# White space never joins two tokens of this kind of vocabulary and case is folded, so the ids of a text are those of
# its lower-case words. Any corpus repeats its words: looking them up is many times cheaper than encoding whole texts.
# Two generations: words met again move to the young one, and when that is full the old one goes.
CACHE_WORDS = 120_000
KEPT_WORDS = 40_000  # a task's end leaves at most so many for the next; later tasks learn about as fast as they look up
STEM = re.compile("[a-zß-öø-ÿ]+")
# Marks between a letter and white space are tokens of their own: no token goes from a letter to a mark or over white space.
# Set apart, they leave few different words to learn. A pattern that begins with the mark is searched for fast.
MARKS = re.compile(r"[.,!?;:%#$&*](?<=[a-zß-öø-ÿ].)[.,!?;:%#$&*]*(?!\S)")
END_OF_WORD = "</w>"


class WordTokenizer:
    """``ids`` gives a uint16 array per text, equal to ``encode(text, add_special_tokens=False).ids``.

    With ``plain`` the names of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        # Stems need no normalizer, white space splits them as the long pattern would, and ASCII letters stand for their bytes.
        # Words are encoded once each, so the model's own cache would only fill.
        model = self.tokenizer.model
        model._resize_cache(0)
        self.ascii_stems, self.other_stems = Tokenizer(model), Tokenizer(model)
        self.ascii_stems.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.other_stems.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        assert max(vocabulary.values()) < 1 << 16
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint16).tobytes() for e in encoded]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Letters only: one unit each to the tokenizer, so its last id ends a word and no other does."""
        joined = " ".join(stems)
        of = self.ascii_stems if joined.isascii() else self.other_stems
        encoded = of.encode_batch_fast([joined], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, np.uint16)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(stems):
            return self.encode(stems)
        data = ids.tobytes()
        return [data[2 * a : 2 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, stems: list[str], odd: list[str]) -> None:
        plain = list(filter(str.isascii, stems))
        other = [stem for stem in stems if not stem.isascii()]
        for chosen, encode in ((plain, self._stems), (other, self._stems), (odd, self.encode)):
            if chosen:
                self.known.update(zip(chosen, encode(chosen), strict=True))

    def _all(self, words: set[str]) -> dict[str, bytes]:
        """The cache, holding ids of each of these words; new ones are learnt, stems together and odd words one by one."""
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        missing = words.difference(known)
        if old:
            again = missing.intersection(old)
            known.update((word, old[word]) for word in again)
            missing -= again
        stems = list(filter(STEM.fullmatch, missing))
        self._learn(stems, list(missing.difference(stems)))
        return known

    def ids(self, texts: Iterable[str], slice_chars: int = 1_000_000) -> Iterator[np.ndarray]:
        """Words are learned for a slice of texts at a time; a slice may fill the cache past its size."""
        held: list[str] = []
        chars = 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= slice_chars:
                yield from self._slice(held)
                held, chars = [], 0
        yield from self._slice(held)
        self.old = {}
        if len(self.known) > KEPT_WORDS:
            self.known = {}

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [words_of(text) for text in texts]
        get = self._all(set(chain.from_iterable(words for words in split if words))).__getitem__
        for text, words in zip(texts, split, strict=True):
            data = self.encode([text])[0] if words is None else b"".join(map(get, words))
            yield np.frombuffer(data, np.uint16)


def words_of(text: str) -> list[str] | None:
    """Words and marks to look up; None where ``str.split`` breaks at a character that the tokenizer doesn't break at."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:  # beyond Latin-1 two lower-casings might differ
        pass
    else:
        text = text.lower()
    return MARKS.sub(r" \g<0>", text).split()


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, plain: bool = False) -> WordTokenizer:
    """One tokenizer and cache per worker process."""
    return WordTokenizer(path, plain)
