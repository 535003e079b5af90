"""Benchmark decontamination: the n-grams of all benchmark items, normalised, as a broadcast hash set that one pass over the documents
looks each window of words up in; hits are verified word by word, and the spans they cover or the documents that hold them go.

Words are the runs of 0-9, a-z and characters beyond ASCII after lower-casing A-Z. A window is `width` consecutive words of an item, or
the whole item where it has fewer. A broadcast set holds windows of at most SET_BYTES; a benchmark with more is scanned for in several
passes, each with a set of its own, the documents' findings being written between them. So neither a driver nor a worker ever holds
more than one set, and no window is left out. (A single window of more bytes is a set by itself.)

Hashes are polynomials over the bytes of a word and over the words of a window, taken for a block of texts at once in arrays. They
only select: a hit counts where the bytes of its words are those of the window.

Defined cases: a null text and one without words hold nothing and stay; items without words, null items among them, have no window; items
that share a window are all found with it, and rows that repeat an item id are one item; null item ids are left out of the lists; repeated
documents are scanned each; an empty table gives no rows, an empty benchmark no hits; columns other than those named are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WIDTH = 10
#: Bytes of windows and ids in one broadcast set, 32 for each row that holds them among them.
SET_BYTES = 1 << 25
#: Bytes of text whose words are hashed at a time.
SLICE = 1 << 22
U = np.uint64
BYTE, WORD = U(0x100000001B3), U(0x9E3779B97F4A7C15)
#: What each byte becomes: a space (0 in arrays) between words, small letters for A-Z.
TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
LETTER = np.frombuffer(TABLE.replace(b" ", b"\0"), np.uint8)
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in `raw`, text i from at[i] to at[i + 1]: hash, begin and end of each word, and where each
    text's words begin (one more entry)."""
    letters = LETTER[raw]
    inside = letters != 0
    fresh = np.ones(len(raw) + 1, bool)  # a word begins here, if a letter does
    fresh[1:-1] = ~inside[:-1]
    fresh[at[at < len(raw)]] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    shut = np.ones(len(raw), bool)
    shut[:-1] = ~inside[1:] | fresh[1:-1]
    ends = np.flatnonzero(inside & shut) + 1
    hashes = np.empty(len(starts), U)
    k = 0
    while k < len(starts):  # whole words, SLICE bytes at a time
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + SLICE)))
        a, b = starts[k], ends[to - 1]
        own, size = starts[k:to] - a, ends[k:to] - starts[k:to]
        with np.errstate(over="ignore"):
            place = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))  # in its word; past its end letters are 0
            terms = letters[a:b].astype(U) * powers(BYTE, int(place.max()) + 1)[place]
            hashes[k:to] = np.add.reduceat(terms, own) * (size.astype(U) | U(1))
        k = to
    return mixed(hashes), starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each `width` consecutive words, in order."""
    out = np.zeros(max(0, len(hashes) - width + 1), U)
    with np.errstate(over="ignore"):
        for i, p in enumerate(powers(WORD, width) if len(out) else ()):
            out += hashes[i : i + len(out)] * p
    return mixed(out)


class WindowSet:
    """Windows by hash, in a sorted array behind a bitmap. Several windows may share a hash."""

    def __init__(self, windows: list[bytes], items: list[list[str]]):
        self.windows, self.items, self.by_width = windows, items, {}
        raw = np.frombuffer(b" ".join(windows), np.uint8)
        at = np.cumsum([0, *(len(w) + 1 for w in windows)])
        hashes, _, _, word = words_of(raw, np.minimum(at, len(raw)))
        widths = np.diff(word)
        for k in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == k)
            with np.errstate(over="ignore"):
                sums = mixed((hashes[word[mine][:, None] + np.arange(k)] * powers(WORD, k)).sum(1, dtype=U))
            order = np.argsort(sums, kind="stable")
            bits = np.zeros(1 << max(10, len(mine).bit_length()), U)  # 64 bits a window at least
            np.bitwise_or.at(bits, ((sums & U(len(bits) * 64 - 1)) >> U(6)).astype(np.int64), U(1) << (sums & U(63)))
            self.by_width[k] = bits, sums[order], mine[order]

    def found(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of a window, number of a window of the set with its hash), for all such pairs."""
        bits, sums, names = self.by_width[width]
        at = np.flatnonzero(common.in_bitmap(bits, hashes))
        lo, hi = np.searchsorted(sums, hashes[at], "left"), np.searchsorted(sums, hashes[at], "right")
        n = hi - lo
        return np.repeat(at, n), names[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value begins in them (one more entry); null counts as empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def batch_hits(raw: np.ndarray, at: np.ndarray, known: WindowSet) -> tuple:
    """Begins and ends of words, where each text's words begin, which words are hit, and the (text, window) pairs found."""
    hashes, starts, ends, word = words_of(raw, at)
    edge = np.zeros(len(hashes) + 1, np.int64)
    texts, names = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for width in known.by_width:
        place, name = known.found(windows_of(hashes, width), width)
        text = np.searchsorted(word, place, "right") - 1
        inside = place + width <= word[text + 1]
        place, name, text = place[inside], name[inside], text[inside]
        stretches = zip(starts[place].tolist(), ends[place + width - 1].tolist(), name.tolist(), strict=True)
        same = np.fromiter((b" ".join(raw[s:e].tobytes().translate(TABLE).split()) == known.windows[w] for s, e, w in stretches), bool, len(place))
        np.add.at(edge, place[same], 1)
        np.add.at(edge, place[same] + width, -1)
        texts.append(text[same])
        names.append(name[same])
    return starts, ends, word, np.cumsum(edge[:-1]) > 0, np.concatenate(texts), np.concatenate(names)


#: What is known of a text: its words, those of them that are hit, begins and ends (in bytes, in turn) of the runs of hit words, the items found.
FOUND = {"words": "long", "hits": "long", "spans": "array<long>", "items": "array<string>"}


def scanner(known, p: str):
    """Adds what the set finds to what the sets before it found."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            common.release()
            windows: WindowSet = known.value
            raw, at = string_parts(batch.column(f"{p}text"))
            starts, ends, word, hit, text, name = batch_hits(raw, at, windows)
            items: dict[int, set[str]] = {}
            for i, w in set(zip(text.tolist(), name.tolist(), strict=True)):
                items.setdefault(i, set()).update(windows.items[w])
            before = {i: (s, x) for i, (s, x) in enumerate(zip(batch.column(f"{p}spans").to_pylist(), batch.column(f"{p}items").to_pylist(), strict=True)) if s}
            hits, spans, names = np.zeros(batch.num_rows, np.int64), [()] * batch.num_rows, [()] * batch.num_rows
            for i in sorted(set(text.tolist()) | set(before)):
                own = slice(int(word[i]), int(word[i + 1]))
                mine, (old, old_items) = hit[own].copy(), before.get(i, ((), ()))
                for s, e in zip(old[::2], old[1::2], strict=True):
                    mine |= (starts[own] - at[i] >= s) & (ends[own] - at[i] <= e)
                change = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
                hits[i], spans[i] = mine.sum(), np.stack([starts[own][first], ends[own][last]], 1).ravel() - at[i]
                names[i] = sorted({*old_items, *items.get(i, ())})
            made = {f"{p}words": pa.array(np.diff(word), pa.int64()), f"{p}hits": pa.array(hits), f"{p}spans": pa.array(spans, pa.list_(pa.int64())), f"{p}items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return run


def benchmark_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, gram: each distinct window of each item, its words joined by one space."""
    named = items.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORDS), F.lit(0)).alias("w"))
    many = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.array_join(F.slice("w", i, width), " "))
    grams = F.when(F.size("w") > width, many).otherwise(F.array(F.array_join("w", " ")))
    return named.filter(F.size("w") > 0).select("item", F.explode(grams).alias("gram")).distinct()


def sets(items: DataFrame, width: int = WIDTH, limit: int = SET_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[WindowSet]:
    """The benchmark's windows in sets of at most `limit` bytes each, one at a time."""
    rows = benchmark_windows(items, width, id_col, text_col).withColumn("bytes", F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)) + 32)
    dealt = common.staged(common.running_total(rows, "bytes", "before", order="gram").withColumn("part", F.floor(F.col("before") / limit)))
    for (part,) in dealt.select("part").distinct().orderBy("part").collect():
        table = dealt.filter(F.col("part") == part).groupBy("gram").agg(F.collect_set("item").alias("items")).toArrow()
        yield WindowSet([g.encode() for g in table.column("gram").to_pylist()], table.column("items").to_pylist())


def scanned(docs: DataFrame, items: DataFrame, width: int = WIDTH, limit: int = SET_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, str]:
    """The documents with the columns of FOUND and their text, and the prefix of these columns' names, which no other column has."""
    p = common.free_prefix(docs)
    out = docs.select(*docs.columns, F.col(text_col).cast("string").alias(f"{p}text"), *(F.lit(None).cast(kind).alias(f"{p}{n}") for n, kind in FOUND.items()))
    schema, passes = out.schema, 0
    for known in sets(items, width, limit, item_col, item_text):
        out = common.staged(out) if passes else out
        out, passes = out.mapInArrow(scanner(common.broadcast_value(docs, known), p), schema), passes + 1
    if not passes:  # no window at all; words are still counted
        out = out.mapInArrow(scanner(common.broadcast_value(docs, WindowSet([], [])), p), schema)
    return out, p


def without_spans(p: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = []
            for t, s in zip(batch.column(f"{p}text").to_pylist(), batch.column(f"{p}spans").to_pylist(), strict=True):
                raw = t.encode() if s else b""
                texts.append(b"".join(raw[a:b] for a, b in zip([0, *s[1::2]], [*s[::2], len(raw)], strict=True)).decode() if s else t)
            yield batch.set_column(batch.schema.get_field_index(f"{p}text"), f"{p}text", pa.array(texts, pa.string()))

    return run


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """The documents, with the columns they had, without the spans that windows of the benchmark cover, or without the documents
    that hold any. remove: "spans" or "documents"."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove}")
    out, p = scanned(docs, items, text_col=text_col, **options)
    if remove == "documents":
        return out.filter(F.col(f"{p}hits") == 0).select(*docs.columns)
    out = out.mapInArrow(without_spans(p), out.schema)
    return out.withColumn(text_col, F.col(f"{p}text")).select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    out, p = scanned(common.id_and_text(docs, id_col, text_col), items, **options)
    names = F.col(f"{p}items")
    return out.select("doc_id", F.col(f"{p}words").alias("n_words"), F.col(f"{p}hits").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col(f"{p}hits") > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
with d as (select row_number() over () as r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
g as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
k as (select distinct k from g),
x as (select r, k, i, array_to_string(w[i : i + k - 1], ' ') as gram
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, k where len(w) >= k)),
h as (select r, i, g.k, item_id from x join g on x.k = g.k and x.gram = g.gram),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from h) group by r),
m as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join m using (r)
"""
