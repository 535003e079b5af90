"""The tokenizers library behind a memo of words of bounded size: most words of a corpus come again and again."""

from __future__ import annotations

import json
import os
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Longer words aren't kept.
LONG = 64


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordMemoEncoder:
    """One for each Python worker: the memo serves all tasks of this kind that the worker runs."""
    return common.held(("encoder", path), lambda: WordMemoEncoder(path))


class Memo(dict):
    """At most twice `limit` entries: when full, it becomes the old half, from which entries in use return."""

    def __init__(self, limit: int):
        self.limit, self.old = limit, {}

    def put(self, key, value) -> None:
        self.put_all({key: value})

    def put_all(self, more: dict) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self.update(more)


class WordTable:
    """Ids of words by two 64-bit hashes of the word, in flat arrays: some 35 bytes a word, at most `limit` words.

    When full, the half that was asked for longest ago goes."""

    def __init__(self, limit: int):
        self.limit, self.clock = limit, 0
        self.keys, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.size, self.used = np.empty(0, np.int32), np.empty(0, np.uint16), np.empty(0, np.int32)
        self.data = np.empty(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.check, self.start, self.size, self.used, self.data))

    def find(self, keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place, and whether it is there."""
        self.clock += 1
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (self.check[at] == check)
        self.used[at[hit]] = self.clock
        return at, hit

    def add(self, keys: np.ndarray, check: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        """Words that aren't there yet, with the stretches of `data` that are theirs."""
        keys, first = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, keys)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
            keys, first, at = keys[new], first[new], at[new]
        own = (len(self.data) + start[first]).astype(np.int32)
        self.data = np.concatenate([self.data, data.astype(self.data.dtype)])
        self.keys, self.check = np.insert(self.keys, at, keys), np.insert(self.check, at, check[first])
        self.start, self.size = np.insert(self.start, at, own), np.insert(self.size, at, size[first].astype(np.uint16))
        self.used = np.insert(self.used, at, self.clock)
        if len(self.keys) > self.limit:
            keep = np.sort(np.argpartition(-self.used, self.limit // 2)[: self.limit // 2])
            self.keys, self.check, self.used = self.keys[keep], self.check[keep], self.used[keep]
            start, self.size = self.start[keep], self.size[keep]
            self.data, ends = stretches(self.data, start, self.size)
            self.start = np.concatenate([[0], ends[:-1]]).astype(np.int32)


def stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated stretches data[start : start + size], and where each ends."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class ArrayBpe:
    """Byte-pair merges of many short pieces at once: each round applies to every piece its merge of the lowest rank, leftmost first."""

    NONE = np.int32(1 << 30)

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: dict[int, str]):
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first = self.ranks(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (none empty), one after the other, and how many each has."""
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        ids, rank = self.byte[raw], np.full(len(raw), self.NONE, np.int32)
        rank[:-1] = np.where(piece[1:] == piece[:-1], self.first[raw[:-1] << 8 | raw[1:]], self.NONE)
        done = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            own = np.repeat(least, np.diff(np.append(starts, len(ids))))
            live = own < self.NONE
            if not live.all():
                done.append((piece[~live], ids[~live]))
                ids, rank, piece, own = ids[live], rank[live], piece[live], own[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == own)
            at = at[np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])]
            ids[at] = self.merged[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank, piece = ids[stay], rank[stay], piece[stay]
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                joined = (right > left) & (piece[left] == piece[right])
                rank[left] = np.where(joined, self.ranks(ids[left], ids[right]), self.NONE)
        if not done:
            return np.empty(0, np.uint32), np.zeros(len(pieces), np.int64)
        piece, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces))


def byte_letters() -> dict[int, str]:
    """Printable letters for all bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordMemoEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    The byte-level pre-tokenizer never joins what stands before a space with that space and a following non-space, so texts fall
    apart there. A block of texts is cut at spaces and its distinct words looked up once. Of words that the memo lacks, those of
    letters and a tail of signs are merged together in arrays; others are encoded as one text by the library, in which a word's
    first token is the only one that begins with a space."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.safe = regex.compile(r"(?= \S)")
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")  # the alphabet's letter for a space
        self.memo = WordTable(limit)
        spec = json.load(open(path, encoding="utf-8"))  # a file of the installed library
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.arrays = ArrayBpe(spec["model"]["vocab"], merges, byte_letters())
        #: The file's pre-tokenizer makes one piece of a space and the letters after it, and one of the signs that follow them.
        self.simple = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}']*)").fullmatch

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with a space before it, one after the other, and how many each has."""
        simple, pieces, tailed = np.zeros(len(words), bool), [], []
        for i, w in enumerate(words):
            if len(w) <= LONG and (m := self.simple(w)) is not None:
                simple[i] = True
                pieces.append(b" " + m[1].encode())
                if m[2]:
                    tailed.append(len(pieces))
                    pieces.append(m[2].encode())
        ids, of_piece = self.arrays.encode(pieces)
        start = np.ones(len(pieces), bool)
        start[tailed] = False
        size = np.zeros(len(words), np.int64)
        size[simple] = np.add.reduceat(of_piece, np.flatnonzero(start)) if len(pieces) else 0
        if simple.all():
            return ids, size
        other, size[~simple] = self._learn_others([w for w, s in zip(words, simple.tolist(), strict=True) if not s])
        own = np.repeat(simple, size)
        out = np.empty(len(own), np.uint32)
        out[own], out[~own] = ids, other
        return out, size

    def _learn_others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for i in range(0, len(words), 4096):
            group = words[i : i + 4096]
            text = f" {' '.join(group)}"
            if not any(x in text for x in self.special):
                joined = self._ids([text])[0]
                starts = np.flatnonzero(self.begins[joined])
                if len(starts) == len(group):
                    ids.append(joined)
                    sizes.append(np.diff(np.append(starts, len(joined))))
                    continue
            parts = self._ids([f" {w}" for w in group])
            ids += parts
            sizes.append(np.array([len(x) for x in parts], np.int64))
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate(sizes) if sizes else np.empty(0, np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by the end id if there is one, and where each begins (one more entry)."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = parts.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary
        objects = names.to_numpy(zero_copy_only=False)
        keys, check = (pd.util.hash_array(objects, hash_key=k, categorize=False) if len(objects) else np.empty(0, np.uint64) for k in ("0123456789abcdef", "fedcba9876543210"))
        place, hit = self.memo.find(keys, check)
        start, size = np.zeros(len(objects), np.int64), np.zeros(len(objects), np.int64)
        start[hit], size[hit] = self.memo.start[place[hit]], self.memo.size[place[hit]]
        pool = [self.memo.data]
        filled = len(self.memo.data)

        def pooled(ids: np.ndarray) -> int:
            nonlocal filled
            pool.append(ids)
            filled += len(ids)
            return filled - len(ids)

        # words that only begin texts are encoded as such below; one that is empty or begins with white space isn't cut off from the one before it
        inner = np.zeros(len(objects), bool)
        heads = at[:-1]
        is_head = np.zeros(len(code), bool)
        is_head[heads] = True
        inner[code[~is_head]] = True
        odd = np.zeros(len(objects), bool)
        missing = np.flatnonzero(inner & ~hit)
        odd[missing] = [not w or w[0].isspace() for w in objects[missing]]
        missing = missing[~odd[missing]]
        ids, sizes = self._learn(objects[missing].tolist())
        ends = np.cumsum(sizes)
        start[missing], size[missing] = pooled(ids) + ends - sizes, sizes
        short = [len(w) <= LONG for w in objects[missing]]

        start, size = start[code], size[code]
        slow = np.unique(np.searchsorted(at, np.flatnonzero(odd[code] & ~is_head), "right") - 1)
        first = self._ids([objects[c] for c in code[heads].tolist()])
        for row in slow.tolist():
            first[row] = np.concatenate(self._ids(self.safe.split(texts[row].as_py())))
            size[at[row] : at[row + 1]] = 0
        size[heads] = own = np.array([len(x) for x in first], np.int64)
        start[heads] = pooled(np.concatenate([*first, np.empty(0, np.uint32)])) + np.cumsum(own) - own
        if end_id is not None:
            start, size = np.insert(start, at[1:], pooled(np.array([end_id], np.uint32))), np.insert(size, at[1:], 1)
            at = at + np.arange(len(at))
        out, done = stretches(np.concatenate(pool), start, size)
        if any(short):
            self.memo.add(keys[missing][short], check[missing][short], (ends - sizes)[short], sizes[short], ids)
        return out, np.concatenate([[0], done])[at]
