"""Cross-tokenizer alignment by a group dictionary: byte offsets where tokens of both vocabularies end cut a text into groups; each
distinct group of A-ids and B-ids is interned, its links are expanded once, counted by the group's frequency, and what follows from
the counts joins back to the documents by group.

Texts are encoded in blocks of BLOCK bytes. A block interns its groups: documents keep numbers of groups and how often each occurs,
and one dictionary row for each group of the block goes into the shuffle, so that what moves grows with the blocks' vocabularies and
not with the text. Dictionary rows add up to one row for each group of the corpus; links are expanded, counted by id pair and judged
there. Groups that most blocks hold, and pairs that most groups end in, meet their figures by broadcast (`common.met`), so no task
gets a hot key. Answers and documents of a block, both bounded, meet in one task.

Neither tokenizer joins what stands before a space with it, if the character before is no space itself and one after it is no white
space: A's pieces begin there and no entry of B holds such a place inside. Texts are therefore encoded by units cut there, which a
worker remembers up to a bound; a unit whose tokens don't give its bytes sends its text to be encoded whole.

Defined cases: texts that are null, empty, or not equal to their joined tokens have no tokens, zeros and an empty string; repeated rows
count each; null ids stay; an empty table gives no rows; columns other than the id and the text are ignored. Special tokens' strings
are plain text."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .bpe_cache import Memo, byte_letters, stretches, vocabulary_path

BLOCK = 1 << 25
#: Characters of text cut into units at a time, units that a worker remembers (twice as many at most), and the longest of them.
SLICE, REMEMBERED, LONG = 1 << 20, 100_000, 64
CUT = re.compile(r"(?<=[^ ])(?= \S)")


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the groups of units as text: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_letters().items()}
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [added[i] if i in added else bytes(byte_of[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.names = [str(i) for i in range(max(self.a.get_vocab_size(), self.b.get_piece_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second vocabulary has entries that go on beyond a space; units can't be cut there")
        self.memo = Memo(REMEMBERED)

    def groups(self, a: list[int], b: list[int], raw: bytes) -> str | None:
        """The groups of a text's tokens; None if the tokens of either don't give its bytes."""
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in a_parts]).tolist(), np.cumsum([len(x) for x in b_parts]).tolist()
        return self.cut(a, b, ends_a, ends_b)

    @staticmethod
    def cut(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> str:
        out, i, j = [], 0, 0
        places = {e: n for n, e in enumerate(ends_b, 1)}
        for n, e in enumerate(ends_a, 1):
            if e in places:
                out.append(f"{','.join(map(str, a[i:n]))}|{','.join(map(str, b[j : places[e]]))}")
                i, j = n, places[e]
        return ";".join(out)

    def learn(self, units: list[str]) -> list[str | None]:
        """The groups of each unit, for all units at once in arrays."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        raw = [u.encode() for u in units]
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        ends = np.cumsum([len(r) for r in raw])
        whole = b"".join(raw)
        same = b"".join([self.a_bytes[i] for i in flat_a]) == whole == b"".join([self.b_bytes[i] for i in flat_b])
        if not (same and np.array_equal(ends, ends_a[np.cumsum([len(x) for x in a]) - 1]) and np.array_equal(ends, ends_b[np.cumsum([len(x) for x in b]) - 1])):
            fit = [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)]
            if all(fit):
                return [self.groups(x, y, r) for x, y, r in zip(a, b, raw, strict=True)]
            found = iter(self.learn([u for u, f in zip(units, fit, strict=True) if f]) if any(fit) else ())
            return [next(found) if f else None for f in fit]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = (np.searchsorted(shared_in, shared) + 1 for shared_in in (ends_a, ends_b))
        names_a, names_b = [self.names[i] for i in flat_a], [self.names[i] for i in flat_b]
        groups, i, j = [], 0, 0
        for n, m in zip(to_a.tolist(), to_b.tolist(), strict=True):
            groups.append(f"{names_a[i] if n == i + 1 else ','.join(names_a[i:n])}|{names_b[j] if m == j + 1 else ','.join(names_b[j:m])}")
            i, j = n, m
        to = (np.searchsorted(shared, ends) + 1).tolist()
        return [groups[x] if y == x + 1 else ";".join(groups[x:y]) for x, y in zip([0, *to], to, strict=False)]

    def whole(self, text: str) -> str | None:
        return self.groups(self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text), f" {text}".encode()) if text else None

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a space and the text, some at a time."""
        text, at = f" {text}", 0
        while at < len(text):
            cut = CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            to = cut.start() if cut else len(text)
            yield CUT.split(text[at:to])
            at = to


class Block:
    """Interns the units and groups of a block of texts."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.unit: dict[str, int] = {}
        self.frags: list[str | None] = []
        self.codes: list[np.ndarray] = []
        self.number: dict[str, int] = {}

    def add(self, units: list[str]) -> None:
        codes, distinct = pd.factorize(np.array(units, object))
        self.codes.append(self.known(distinct.tolist())[codes])

    def known(self, distinct: list[str]) -> np.ndarray:
        """The units' numbers in the block. Units of several slices are remembered for the blocks to come."""
        memo, unit, frags, fresh, again = self.aligner.memo, self.unit, self.frags, [], {}
        codes, old = np.empty(len(distinct), np.int32), memo.old
        for i, u in enumerate(distinct):
            code = unit.get(u)
            if code is None:
                unit[u] = code = len(frags)
                frag = memo.get(u) or old.get(u)
                frags.append(frag)
                if frag is None:
                    fresh.append(u)
            elif len(u) <= LONG:
                again[u] = frags[code]
            codes[i] = code
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            for u, frag in zip(part, self.aligner.learn(part), strict=True):
                frags[unit[u]] = frag
        memo.put_all({u: f for u, f in again.items() if f is not None and u not in memo})
        return codes

    def numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all units' groups, one unit after the other, where each unit's begin, and how many it has."""
        number, flat, size = self.number, [], []
        for f in self.frags:
            own = f.split(";") if f else ()
            flat += [number.setdefault(g, len(number)) for g in own]
            size.append(len(own))
        size = np.array(size, np.int64)
        return np.array(flat, np.int32), np.cumsum(size) - size, size


def interner(path_a: str, path_b: str, block_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        aligner = common.held(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        base = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(common.blocks(batches, block_bytes)):
            yield from interned(aligner, batch, base + n)
            common.trim()

    return run


DOC = {"block": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "numbers": pa.binary(), "counts": pa.binary()}
ENTRY = {"number": pa.int32(), "group": pa.string(), "occurrences": pa.int64(), "documents": pa.int64()}
INTERNED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, numbers binary, counts binary, number int, group string, occurrences long, documents long"


def interned(aligner: Aligner, batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the numbers of its groups (rising, as differences) and how often it holds each, then a row for each
    group of the block (number, group, occurrences, documents)."""
    made, n = Block(aligner), batch.num_rows
    ends, waiting, held, at = np.zeros(n + 1, np.int64), [], 0, 0
    for i, value in enumerate(batch.column("text")):
        text = value.as_py()
        for part in aligner.units(text) if text else ():
            waiting += part
            at += len(part)
            held += sum(map(len, part))
            if held > SLICE:
                made.add(waiting)
                waiting, held = [], 0
        ends[i + 1] = at
    made.add(waiting)
    codes = np.concatenate(made.codes)
    frags, odd = np.array([*made.frags, None], object)[:-1], np.array([f is None for f in made.frags], bool)
    names, shas = [], []
    for i in range(n):
        own = codes[ends[i] : ends[i + 1]]
        if len(own) and odd[own].any():
            frag = aligner.whole(batch.column("text")[i].as_py())
            own = np.array([len(made.frags)] if frag else [], np.int32)
            if frag:
                made.frags.append(frag)
            joined = frag or ""
        else:
            joined = ";".join(frags[own].tolist())
        names.append(own)
        shas.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
    flat, start, size = made.numbers()
    names_of, width = list(made.number), len(made.number)
    n_a, n_b = (np.array([g.split("|")[k].count(",") + 1 for g in names_of] + [0], np.int64) for k in (0, 1))
    occurrences, documents = np.zeros(width, np.int64), np.zeros(width, np.int64)
    rows = []
    for i, own in enumerate(names):
        groups = stretches(flat, start[own], size[own])[0]
        distinct, counts = np.unique(groups, return_counts=True)
        occurrences[distinct] += counts
        documents[distinct] += 1
        steps = np.diff(distinct, prepend=0).astype("<u4")
        rows.append((block, batch.column("doc_id")[i].as_py(), int((n_a[distinct] * counts).sum()), int((n_b[distinct] * counts).sum()), len(groups), shas[i], steps.tobytes(), counts.astype("<u4").tobytes()))
        if len(rows) == common.ARROW_ROWS or i == n - 1:
            yield filled(dict(zip(DOC, zip(*rows, strict=True), strict=True)), len(rows))
            rows = []
    present = np.flatnonzero(occurrences)  # units of texts that were encoded whole may be in no text
    for i in range(0, len(present), 1 << 16):
        own = present[i : i + (1 << 16)]
        yield filled({"block": np.full(len(own), block), "number": own, "group": [names_of[k] for k in own.tolist()], "occurrences": occurrences[own], "documents": documents[own]}, len(own))


def filled(columns: dict, n: int) -> pa.RecordBatch:
    kinds = DOC | ENTRY
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def expander(path_a: str, path_b: str):
    """The links of each group: pairs of its tokens that end at the same byte."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        aligner = common.held(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            row, pairs = [], []
            for i, group in enumerate(batch.column("group").to_pylist()):
                a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
                ends: dict[int, list[int]] = {}
                at = 0
                for y in b:
                    at += len(aligner.b_bytes[y])
                    ends.setdefault(at, []).append(y)
                at = 0
                for x in a:
                    at += len(aligner.a_bytes[x])
                    for y in ends.get(at, ()):
                        row.append(i)
                        pairs.append(x << 32 | y)
            yield pa.RecordBatch.from_arrays([batch.column("group").take(pa.array(row, pa.int64())), batch.column("weight").take(pa.array(row, pa.int64())), pa.array(pairs, pa.int64())], names=["group", "weight", "pair"])

    return run


class Alignment:
    """The aligned documents: what `documents`, `pairs` and `groups` derive from. counted: "links" weighs a group by its occurrences,
    "documents" by the number of documents that hold it."""

    def __init__(self, docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", counted: str = "links", block: int = BLOCK):
        paths = vocabulary_path(vocabulary_a), vocabulary_path(vocabulary_b)
        self.rows = common.staged(common.id_and_text(docs, id_col, text_col).mapInArrow(interner(*paths, block), INTERNED))
        self.entries = self.rows.filter("number is not null").select("block", "number", "group", "occurrences", "documents")
        sums = self.entries.groupBy("group").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"), F.count("*").alias("blocks"))
        #: One row for each distinct group: group, occurrences, documents, blocks.
        self.groups = common.staged(sums)
        weight = {"links": "occurrences", "documents": "documents"}[counted]
        self.links = common.staged(self.groups.select("group", F.col(weight).alias("weight")).mapInArrow(expander(*paths), "group string, weight long, pair long"))

    def pairs(self) -> DataFrame:
        """a, b, count and whether no other A-id is linked with the B-id more often; `links` counts the distinct groups' links."""
        sums = common.staged(self.links.groupBy("pair").agg(F.sum("weight").alias("count"), F.count("*").alias("links")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
        most = sums.groupBy("b").agg(F.max("count").alias("most"))  # a row for each B-id: bounded by the vocabulary
        return sums.join(F.broadcast(most), "b").select("pair", F.shiftright("pair", 32).alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best"), "links")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document."""
        pairs = common.staged(self.pairs().select("pair", "count", "best", "links"))
        judged = common.met(self.links.select("group", "pair"), pairs, "pair", "links")
        answers = judged.groupBy("group").agg(F.count("*").alias("links"), F.sum(F.col("best").cast("long")).alias("best"), F.sum("count").alias("total"))
        answers = common.staged(answers.join(self.groups.select("group", "blocks"), "group"))
        found = common.met(self.entries.select("block", "number", "group"), answers, "group", "blocks").select("block", "number", "links", "best", "total")
        docs = self.rows.filter("number is null").select(F.col("block").alias("home"), *list(DOC)[1:])
        return found.groupBy("block").cogroup(docs.groupBy("home")).applyInArrow(answered, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def answered(found: pa.Table, docs: pa.Table) -> pa.Table:
    """A block's documents with the sums over their groups."""
    number = found.column("number").to_numpy()
    answers = np.zeros((3, number.max(initial=-1) + 1), np.int64)
    for k, c in enumerate(("links", "best", "total")):
        answers[k, number] = found.column(c).to_numpy()
    sums = np.zeros((3, docs.num_rows), np.int64)
    for i, (steps, counts) in enumerate(zip(docs.column("numbers"), docs.column("counts"), strict=True)):
        own = np.cumsum(np.frombuffer(steps.as_py(), "<u4"), dtype=np.int64)
        sums[:, i] = answers[:, own] @ np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    for name, column in zip(("n_links", "n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(column))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(common.documents(spark, sf_dir)).documents()
