"""Encoding of a whole corpus with a public byte-level tokenizer: no shuffle, one pass, each task with its own trie."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuebound.llm.bpe import PATTERN, TOKENIZER_DIR, TrieEncoder, load_ranks

#: Cached stretches per task beyond which the cache starts anew (memory stays bounded, results do not change), and
#: characters that are encoded at a time.
CACHE_ENTRIES, SLICE_CHARS = 300_000, 4_000_000

_BEFORE_BLANK = re.compile(r" (?=\s|\Z)")
_BEFORE_WORD = re.compile(r" (?=\S)")


class CorpusEncoder:
    """Encodes lists of texts; what it has encoded once it looks up."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.trie = TrieEncoder(ranks)
        self.find = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    @staticmethod
    def stretches(text: str) -> list[str]:
        """text cut before each blank that a non-blank follows. The tokenizer's pattern never matches across such a place:
        a single blank there begins the next piece. The blank is left out; a first stretch, which has none, is
        marked by one (no other stretch begins with a blank)."""
        parts = _BEFORE_WORD.split(text) if _BEFORE_BLANK.search(text) else text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def _learn(self, new: set[str]) -> None:
        """Encode stretches: their distinct new words in sorted order, as a depth-first walk over the words' trie."""
        cut = {s: self.find(s[1:] if s[0] == " " else " " + s) for s in new}
        fresh = sorted({w.encode() for words in cut.values() for w in words if w not in self.words})
        self.words.update(zip((w.decode() for w in fresh), self.trie.encode_sorted(fresh), strict=True))
        for stretch, words in cut.items():
            self.codes[stretch] = len(self.starts)
            self.starts.append(len(self.flat))
            for word in words:
                self.flat.extend(self.words[word])
            self.sizes.append(len(self.flat) - self.starts[-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; none for a null or empty text."""
        parts: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                parts += self.stretches(text)
            ends.append(len(parts))
        new = set(parts).difference(self.codes)
        if new and len(self.codes) + len(new) > CACHE_ENTRIES:  # start anew with what these texts need
            self._reset()
            new = set(parts)
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, parts), dtype=np.int64, count=len(parts))
        starts, sizes = np.array(self.starts, dtype=np.int64)[codes], np.array(self.sizes, dtype=np.int64)[codes]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(starts - upto[:-1], sizes)
        at += np.arange(upto[-1])
        ids = np.array(self.flat, dtype=np.int32)[at] if len(at) else np.empty(0, np.int32)
        return upto[np.asarray(ends)], ids


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS characters; a longer text is a range of its own."""
    begin = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) of each row of docs: the ids of its whole text by byte_bpe_50k, without special tokens.

    A null and an empty text have the empty list; blank texts are encoded like any other; strings of special tokens are
    ordinary text. Rows that repeat come out as often as they are there. Only the two columns are read.
    """
    path = f"{tokenizer_dir}/byte_bpe_50k.tiktoken"
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or CorpusEncoder(load_ranks(path))
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                offsets, ids = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
