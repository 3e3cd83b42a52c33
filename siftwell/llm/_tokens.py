"""Token ids of whole texts by a tokenizer file whose tokens never span white space, a word at a time.

Each distinct white-space-separated word is encoded once per bounded cache, so a text costs a few array
passes. That is exact for tokenizers that drop white space before they split a text into words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from siftwell.llm._text import Words, slices

#: Bytes that part words here: the commonest white space; any other stays inside a word for the tokenizer to treat.
PARTS = np.ones(256, dtype=bool)
PARTS[[9, 10, 13, 32]] = False


class WordEncoder:
    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.most = most
        self.forget()

    def forget(self) -> None:
        # sorted hashes of words and their numbers; the ids of word n are flat[at[n] : at[n + 1]]
        self.keys, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.flat, self.at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int32)  # slices of text that had word n

    def shrink(self) -> None:
        """Forget the words that one slice of text had since the last time; all, if most are left."""
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > self.most // 2:
            self.forget()
            return
        lengths = np.diff(self.at)[kept]
        total = np.concatenate([[0], np.cumsum(lengths)])
        self.flat = self.flat[np.repeat(self.at[kept] - total[:-1], lengths) + np.arange(total[-1])]
        self.at = total
        new = np.full(len(self.used), -1, dtype=np.int32)
        new[kept] = np.arange(len(kept), dtype=np.int32)
        numbers = new[self.numbers]
        self.keys, self.numbers = self.keys[numbers >= 0], numbers[numbers >= 0]
        self.used = np.ones(len(kept), dtype=np.int32)

    def known(self, data: np.ndarray, words: Words) -> np.ndarray:
        """The cache's number of each word; unknown words are encoded first."""
        keys, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.shrink()
        place = np.searchsorted(self.keys, keys)
        numbers = np.full(len(keys), -1, dtype=np.int64)
        near = np.flatnonzero(place < len(self.keys))
        hit = near[self.keys[place[near]] == keys[near]]
        numbers[hit] = self.numbers[place[hit]]
        new = np.flatnonzero(numbers < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
            got = [x.ids for x in self.encode(texts, add_special_tokens=False)]
            base = len(self.keys)
            numbers[new] = np.arange(base, base + len(new))
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.numbers = np.insert(self.numbers, place[new], numbers[new].astype(np.int32))
            lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            flat = np.fromiter((i for x in got for i in x), dtype=np.uint32, count=int(lengths.sum()))
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int32)])
        self.used[numbers] += 1
        return numbers[back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        out = [np.zeros(0, dtype=np.int64)]
        for i, j in slices(offsets, 1 << 20):
            part = data[offsets[i] : offsets[j]]
            words = Words(part, offsets[i : j + 1] - offsets[i], PARTS, lower=False)
            n = self.known(part, words)
            total = np.concatenate([[0], np.cumsum(self.at[n + 1] - self.at[n])])
            out.append(total[words.bounds[1:]] - total[words.bounds[:-1]])
        return np.concatenate(out)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row."""
        for i, j in slices(offsets, 1 << 20):
            part = data[offsets[i] : offsets[j]]
            words = Words(part, offsets[i : j + 1] - offsets[i], PARTS, lower=False)
            n = self.known(part, words)
            lengths = self.at[n + 1] - self.at[n]
            total = np.concatenate([[0], np.cumsum(lengths)])
            flat = self.flat[np.repeat(self.at[n] - total[:-1], lengths) + np.arange(total[-1])]
            bounds = total[words.bounds]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield flat[a:b]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The file of a public tokenizer, in `folder` or where the package of vocabularies keeps it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
