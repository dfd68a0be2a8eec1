"""Tokenising with a public word-level BPE vocabulary, through a bounded cache of what stands between spaces."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from mnemora.llm.common import hold

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
#: Chunks between spaces whose ids a process keeps, of those that stand twice in a span; beyond it the earliest, among which are the frequent ones, stay.
CACHE_WORDS, CACHE_KEPT = 200_000, 140_000
#: Bytes of the longest chunk that is kept.
LONGEST = 64
#: Characters of text, of one or many, that are split at once, and new words that the vocabulary sees at once: a worker's memory goes with both.
SPAN, LEARN = 1 << 21, 1 << 12
# Characters for which the word split below is the vocabulary's own: printable ASCII, Latin letters
# and marks that have one code point, no other digits or spaces.  Texts with others take the library's path.
SPACE = re.compile(r"\s")
OTHER = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-įıĲ-ɏ]|<\\|")
#: Those of them that are one byte in Latin-1; texts of nothing else are composed already.
PLAIN = "".join(c for c in map(chr, range(256)) if not OTHER.search(c)).encode("latin-1")
PARTS = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+| ")


@dataclass(frozen=True)
class Ragged:
    """Lists of ids end to end, and the size of each."""

    flat: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Ragged:
        return cls(np.concatenate([np.empty(0, "<u4"), *lists]), np.array([len(x) for x in lists], dtype=np.int64))

    def take(self, at: np.ndarray) -> Ragged:
        """The lists at the given places, in that order."""
        size = self.size[at]
        first = (np.cumsum(self.size) - self.size)[at]
        return Ragged(self.flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())], size)


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class WordBpe:
    """The ids that ``tokenizers`` gives with ``add_special_tokens=False``, computed a distinct chunk between spaces at a time."""

    def __init__(self, path: str = DEFAULT):
        self.tok = Tokenizer.from_file(path)
        self.known, self.ids = pa.array([], pa.large_string()), Ragged.of([])  # chunks of earlier texts
        self.learned = Ragged.of([])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cut = Tokenizer(self.tok.model)  # of lower-case words that spaces part already, their bytes written as the vocabulary's characters
        self.cut.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = np.full(256, ord(" "), dtype="<u2")
        for c in map(chr, range(33, 0x800)):
            self.letters[list(c.encode())] = list(map(ord, level.pre_tokenize_str(c)[0][0]))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Leave the ids of distinct words, as the vocabulary gives them, in ``learned``."""
        parts = [self._told(words[at : at + LEARN]) for at in range(0, len(words), LEARN)]
        self.learned = Ragged(np.concatenate([np.empty(0, "<u4"), *(p.flat for p in parts)]), np.concatenate([np.empty(0, np.int64), *(p.size for p in parts)]))

    def _told(self, words: list[str]) -> Ragged:
        """The ids that the vocabulary gives for some words."""
        line = " ".join(words)
        if not line.isascii():
            line = self.letters[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.cut.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words) and (not len(cuts) or cuts[-1] == len(ids)):
            return Ragged(ids, np.diff(cuts, prepend=0))
        return Ragged.of([self.whole(w) for w in words])

    def _found(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The place of each string among the known chunks, those that are not known (-1), and the latter."""
        at = pc.fill_null(pc.index_in(strings, value_set=self.known), -1).to_numpy().copy()
        return at, strings.filter(pa.array(at < 0))

    def _spelt(self, chunks: pa.Array) -> Ragged:
        """The ids of new distinct chunks, by the words that they hold."""
        parts = pa.array(PARTS.findall("".join([c + " " for c in _strings(chunks)])), pa.large_string()).dictionary_encode()
        space = pc.index(parts.dictionary, " ").as_py()
        at, new = self._found(parts.dictionary)
        words = _strings(new.filter(pc.not_equal(new, " ")))
        self._learn(words)
        fresh = np.flatnonzero(at < 0)
        at[fresh[fresh != space]] = len(self.ids.size) + np.arange(len(words))
        size = np.concatenate([self.ids.size, self.learned.size, [0]])
        at[fresh[fresh == space]] = len(size) - 1
        codes = parts.indices.to_numpy()
        spelt = Ragged(np.concatenate([self.ids.flat, self.learned.flat]), size).take(at[codes])
        return Ragged(spelt.flat, np.diff(np.cumsum(spelt.size)[codes == space], prepend=0))

    def _resolve(self, held: list[tuple[list[np.ndarray], str]]) -> None:
        """Append the ids of each lower-case text to the list beside it: Arrow splits and tells chunks apart, the vocabulary sees new ones once."""
        if not held:
            return
        split = pc.ascii_split_whitespace(pa.array([text for _, text in held], pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        codes = chunks.indices.to_numpy()
        at, new = self._found(chunks.dictionary)
        spelt = self._spelt(new)
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.known) + np.arange(len(fresh))
        taken = Ragged(np.concatenate([self.ids.flat, spelt.flat]), np.concatenate([self.ids.size, spelt.size])).take(at[codes])
        cuts = np.concatenate([[0], np.cumsum(taken.size)])[split.offsets.to_numpy()].tolist()
        for (out, _), a, b in zip(held, cuts, cuts[1:], strict=False):
            out.append(taken.flat[a:b])
        again = (np.bincount(codes, minlength=len(at))[fresh] > 1) & (pc.binary_length(new).to_numpy() <= LONGEST)
        some = np.arange(len(self.known) if len(self.known) <= CACHE_WORDS else min(CACHE_KEPT, len(self.known)))
        more = spelt.take(np.flatnonzero(again))
        old = self.ids.take(some)
        self.known = pa.concat_arrays([self.known.slice(0, len(some)), new.filter(pa.array(again))])
        self.ids = Ragged(np.concatenate([old.flat, more.flat]), np.concatenate([old.size, more.size]))

    def _split(self, text: str) -> bool:
        """Whether the word split below is the vocabulary's own for a text."""
        try:
            return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return not OTHER.search(text) and unicodedata.is_normalized("NFC", text)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, however long; what is new to texts that are split together is learned once."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[list[np.ndarray], str]] = []
        size = 0
        for mine, text in zip(out, texts, strict=True):
            if not self._split(text):
                mine.append(self.whole(text))
                continue
            at, text = 0, text.lower()
            while at < len(text):
                end = min(at + SPAN, len(text))
                if end < len(text):
                    cut = SPACE.search(text, end)
                    end = cut.start() if cut else len(text)
                held.append((mine, text[at:end]))
                size, at = size + end - at, end
                if size >= SPAN:
                    self._resolve(held)
                    held, size = [], 0
        self._resolve(held)
        return [mine[0] if len(mine) == 1 else np.concatenate([np.empty(0, "<u4"), *mine]) for mine in out]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_all([text])[0]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str = DEFAULT) -> WordBpe:
    """The process's tokenizer for a vocabulary file."""
    hold("tokens", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
