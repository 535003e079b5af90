"""Byte-pair encoding from the vocabulary file alone: a priority queue of merge ranks over a doubly linked list of symbols.

Results equal those of the library that defines the file format, for files with an NFC + white space + lower-case normaliser,
a byte-level alphabet and an end-of-word suffix; decoding joins the vocabulary's strings.

Defined cases: a null text counts as empty and has no ids; rows may repeat; an empty table gives no rows; columns other than
the id and the text are ignored. The strings of special tokens in a text become their ids, as the file asks."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .bpe_cache import LONG, Memo, byte_letters, vocabulary_path


class WordBpe:
    """Encoder and decoder of one vocabulary file; memoises at most twice `limit` words and as many stretches."""

    def __init__(self, path: str, limit: int = 200_000):
        import regex

        spec = json.load(open(path, encoding="utf-8"))  # a file of the installed library
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: White space of the file's regular expressions; Python's own set has four more characters (U+001C to U+001F).
        self.spaces = regex.compile("[\t-\r \x85\xa0  -     　]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.letters = byte_letters()
        self.words, self.stretches = Memo(limit), Memo(limit)

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the lowest-ranked merge, leftmost first, until none is left."""
        n = len(symbols)
        left, right, ranks = list(range(-1, n - 1)), list(range(1, n + 1)), self.ranks
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:  # stale: one of the two has been merged since
                continue
            symbols[i], symbols[j] = a + b, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def word(self, word: str) -> tuple[int, str, str]:
        found = self.words.get(word) or self.words.old.get(word)
        if found is None:
            symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            symbols = self.merge(symbols)
            found = (len(symbols), " ".join([str(self.vocab[s]) for s in symbols]), " ".join(symbols))
        if len(word) <= LONG and word not in self.words:
            self.words.put(word, found)
        return found

    def plain(self, text: str) -> list[tuple[int, str, str]]:
        """What a text without special tokens has for each of its words."""
        if text.isascii():
            return [self.word(w) for w in self.pattern.findall(text.lower())]
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        return [self.word(w) for w in self.pattern.findall("".join([c.lower() for c in text]))]

    def stretch(self, text: str) -> tuple[int, str, str]:
        """Count, ids and strings of a stretch between white space; no merge or composition crosses white space."""
        found = []
        for part in self.specials.split(text) if "<|" in text else [text]:
            found += [(1, str(self.special[part]), part)] if part in self.special else self.plain(part)
        if len(found) == 1:
            return found[0]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    def encode_and_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by a space, and the decoded text."""
        parts = [p for p in self.spaces.split(text) if p] if self.odd.search(text) else text.split()
        if not parts:
            return 0, "", ""
        found = list(map(self.stretches.get, parts))
        if None in found:
            for i, p in enumerate(parts):
                if found[i] is None:
                    x = found[i] = self.stretches.get(p) or self.stretches.old.get(p) or self.stretch(p)
                    if len(p) <= LONG and p not in self.stretches:
                        self.stretches.put(p, x)
        counts, ids, strings = zip(*found, strict=True)
        return sum(counts), " ".join(ids), " ".join(strings)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_and_decode(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


def codec(path: str) -> WordBpe:
    """One for each Python worker: its memos serve all tasks of this kind that the worker runs."""
    return common.held(("codec", path), lambda: WordBpe(path))


def encode_table(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (decimals joined by a space), decoded; with outputs=False their SHA-256 digests only."""
    path = vocabulary_path(vocabulary)

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in common.slices(batches):
            rows = [bpe.encode_and_decode(t) for t in common.texts_of(batch)]
            ids, decoded = [r[1] for r in rows], [r[2] for r in rows]
            columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64())]
            if outputs:
                columns += [pa.array(ids), pa.array(decoded)]
            columns += [pa.array([sha(x) for x in ids]), pa.array([sha(x) for x in decoded])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *["ids", "decoded"] * outputs, "ids_sha256", "decoded_sha256"])

    full = "ids string, decoded string, " if outputs else ""
    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {full}ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(common.documents(spark, sf_dir), outputs=False)
