"""Tokenising with public tokenizers, word by word through a cache.

BPE never merges across the borders of pre-tokens, and no pre-token of these tokenizers holds a space behind another
character. Cutting a text before its spaces and encoding each distinct piece once gives the ids of encoding the text
whole; texts where that does not hold (white space beside a space) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_hashes, bytes_of, offsets_of

#: Stands between joined pieces.
MARK = "\u241e"
_CACHE: dict[tuple, "PieceEncoder"] = {}


class PieceEncoder:
    """Ids of texts as unsigned 32-bit integers.

    spaces: "kept" where spaces are part of the vocabulary, "dropped" where the tokenizer throws white space away.
    limit: distinct pieces kept (about 30 bytes each); the cache is emptied beyond it, so memory stays bounded.
    A piece is known by a 64-bit hash of its bytes.
    """

    def __init__(self, path: str, spaces: str, limit: int = 3_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept, self.limit = spaces == "kept", limit
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self.mark = self.whole(MARK)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has.

        They are encoded as one text. Where spaces are kept, ids that open with one show where each piece begins;
        else a mark between the pieces does. Pieces that disturb this are encoded one by one.
        """
        between = " " if self.kept else f" {MARK} "
        joined = self.tokenizer.encode_batch_fast([" " * self.kept + between.join(pieces)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, np.uint32)
        if self.kept:
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(pieces):
                return ids, np.diff(cuts, append=len(ids))
        else:
            m = len(self.mark)
            found = np.flatnonzero(np.all([ids[k : len(ids) - m + 1 + k] == self.mark[k] for k in range(m)], axis=0))
            if len(found) == len(pieces) - 1 and not any(MARK in p for p in pieces):
                keep = np.ones(len(ids), bool)
                keep[(found[:, None] + np.arange(m)).ravel()] = False
                size = np.diff(np.concatenate([[-m], found, [len(ids)]])) - m
                return ids[keep], size
        coded = self.tokenizer.encode_batch_fast([" " * self.kept + p for p in pieces], add_special_tokens=False)
        each = [c.ids for c in coded]
        return np.array([i for ids in each for i in ids], np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        coded = [self._ids(pieces[k : k + 2000]) for k in range(0, len(pieces), 2000)]
        ids, size = (np.concatenate(x) for x in zip(*coded, strict=True))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.keys = np.concatenate([self.keys, keys])
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.used += len(ids)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at, self.size = self.keys[order], self.at[order], self.size[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's start among them (one more at the end); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts if self.kept else pc.replace_substring(texts, "\n", " "), " ")
        words = lists.values.dictionary_encode()
        first, names, index = np.asarray(lists.offsets, np.int64), words.dictionary, np.asarray(words.indices, np.int64)
        data, off = bytes_of(names)
        keys, n = byte_hashes(data, off), np.diff(off)
        if len(self.keys) > self.limit:
            self._clear()
        if self.kept:  # a space is a safe cut unless more white space lies beside it
            odd = n == 0
            odd[~odd] |= (data[off[:-1][~odd]] <= 0x20) | (data[off[1:][~odd] - 1] <= 0x20)
            odd |= np.asarray(pc.not_equal(pc.utf8_trim_whitespace(names), names))
        else:
            odd = n == 0
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known & ~odd)
        if len(new):
            self._learn(keys[new], names.take(pa.array(new)).to_pylist())
            at = np.searchsorted(self.keys, keys)
        at = np.minimum(at, max(len(self.keys) - 1, 0))
        size = np.where(odd, 0, self.size[at]) if len(self.keys) else np.zeros(len(keys), np.int64)
        base = self.at[at] if len(self.keys) else np.zeros(len(keys), np.int64)
        pool = self.pool[: self.used]
        if self.kept:  # a text's first piece has no space before it
            heads = names.take(pa.array(index[first[:-1]])).to_pylist()
            inner = odd[index]
            inner[first[:-1]] = [bool(p) and p[-1].isspace() for p in heads]
            spoilt = np.flatnonzero(np.add.reduceat(inner, first[:-1]) > 0) if heads else []
            index[first[:-1]] = np.arange(len(heads)) + len(names)
            own = [c.ids for c in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]
            for r in spoilt:  # encoded whole: its pieces but the first count for nothing
                own[r] = self.whole(texts[int(r)].as_py())
                index[first[r] + 1 : first[r + 1]] = len(names) + len(heads)
            n_own = np.fromiter(map(len, [*own, ()]), np.int64, len(own) + 1)
            base = np.concatenate([base, len(pool) + np.cumsum(n_own) - n_own])
            size = np.concatenate([size, n_own])
            pool = np.concatenate([pool, *(np.asarray(i, np.uint32) for i in own)])
        count = size[index]
        end = np.cumsum(count)
        total = int(end[-1]) if len(end) else 0
        ids = pool[np.repeat(base[index] - (end - count), count) + np.arange(total)].astype(np.uint32)
        return ids, np.concatenate([[0], end])[first]


def encoder(path: str, spaces: str) -> PieceEncoder:
    """One encoder for each worker process; tasks reuse its cache."""
    if (path, spaces) not in _CACHE:
        _CACHE[path, spaces] = PieceEncoder(path, spaces)
    return _CACHE[path, spaces]


def text_bytes(column: pa.Array) -> int:
    off = offsets_of(column)
    return int(off[-1] - off[0])
