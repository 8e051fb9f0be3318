"""Token ids of whole texts by a public word-end BPE vocabulary.

The vocabulary file lower-cases, drops white space and splits words into
pieces that are encoded one by one, so equal words have equal ids.  A batch of
ASCII and Latin-1 texts is split into words by Arrow; each distinct word is
encoded once and the ids of a text are gathered in numpy.  Any other text goes
to the tokenizer whole.  Both give the tokenizer's own ids; tests compare them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_OF_DOCUMENT = 1
# batches are encoded together up to this many bytes
MERGE_BYTES = 2_000_000
VOCABULARY = "word_bpe_49k.json"
# ids of distinct words kept per Python worker: about this many at most (some
# 290,000 words, 60 MB)
CACHE_IDS = 1_200_000
# characters whose lower case, normal form or class needs the tokenizer itself
_ODD = "[^\x00-\x7fÀ-ÿ]|<\\|(?:startof|endof)text\\|>"
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)"
                     "|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+|\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _Store:
    """Rows of ids, found by a text."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, texts: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        rows = len(self.row) + np.arange(len(texts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(rows) and rows[-1] >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[rows], self.size[rows] = bounds[:-1] + self.used, np.diff(bounds)
        self.used += len(ids)
        self.row.update(zip(texts, rows.tolist()))

    def rows(self, texts: list[str]) -> np.ndarray:
        """The row of each text, -1 for those not held."""
        return np.fromiter(map(self.row.get, texts, repeat(-1)), np.int64, len(texts))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after the other, and where each begins."""
        size = self.size[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[rows] - bounds[:-1], size) + np.arange(bounds[-1])
        return self.ids[at], bounds


class WordTokenizer:
    """Encodes Arrow batches of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        # the same model over pieces that are split and lower-cased already
        self._bare = Tokenizer(self._whole.model)
        self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._whole.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._letters = {b: c for b, c in enumerate(byte_letters()) if b != 32}
        self._words = _Store()
        self.largest_id = max(self._whole.get_vocab().values())

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before, their different pieces in one call."""
        flat = np.array(_PIECES.findall("\n".join(words) + "\n"), object)
        ends = np.flatnonzero(flat == "\n")
        flat = np.delete(flat, ends).tolist()
        row = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        text = " ".join(row).encode("utf-8").decode("latin-1").translate(self._letters)
        ids = np.asarray(self._bare.encode_batch_fast([text])[0].ids, np.uint32)
        stop = np.flatnonzero(self._ends[ids]) + 1
        start = np.concatenate([[0], stop[:-1]])
        at = np.fromiter(map(row.__getitem__, flat), np.int64, len(flat))
        size = (stop - start)[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        last = np.concatenate([[0], ends - np.arange(len(ends))])
        self._words.add(words, ids[np.repeat(start[at] - bounds[:-1], size) + np.arange(bounds[-1])], bounds[last])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self._words.used > CACHE_IDS:
            self._words = _Store()
        rows = self._words.rows(words)
        new = rows < 0
        if new.any():
            rows[new] = len(self._words.row) + np.arange(np.count_nonzero(new))
            self._learn(list(compress(words, new.tolist())))
        ids, bounds = self._words.gather(rows[coded.indices.to_numpy()] if len(words) else rows)
        offsets = lists.offsets.to_numpy()
        return ids, bounds[offsets - offsets[0]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text (no nulls), without the end mark."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, bounds = self._plain(texts.take(pa.array(plain)))
            for k, i in enumerate(plain):
                out[i] = ids[bounds[k]:bounds[k + 1]]
        for i in np.flatnonzero(odd):
            got = self._whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            out[i] = np.asarray(got, np.uint32)
        return out

    def documents(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every document: those of its text, then the end mark."""
        return [np.append(ids, np.uint32(END_OF_DOCUMENT)).astype("<u4")
                for ids in self.encode(texts)]


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a Python worker, with what it has learned so far."""
    return WordTokenizer(path)


def merged(batches):
    """Record batches put together up to ``MERGE_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= MERGE_BYTES:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
