"""Content-addressed token store: rolling hashes cut id streams into chunks, each unique chunk is stored once, recipes and
Merkle roots rebuild and verify every document.

Layout of a store (all Parquet, zstd):
  chunks/   pack long, hashes binary (16 bytes each), sizes binary (u4 each, ids), payload binary (zstd of the ids, 2 or 4 bytes each)
  recipes/  doc_id long ascending over the files, n_tokens long, start long, hashes binary (16 bytes each, in order), root binary
A chunk's address is the BLAKE2b-128 of its ids as unsigned 32-bit integers; a document's root is the Merkle root over its chunk addresses.

Defined cases: a null text counts as empty and still has its end id; null ids come first; rows that repeat a doc_id are documents
of their own, in the order of a hash; an empty table gives an empty store; columns other than the id and the text are ignored."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .bpe_cache import encoder, vocabulary_path

#: Cut where the low bits of the rolling hash are 0; window and least and most ids of a chunk.
MASK, WINDOW, LEAST, MOST = np.uint64(0xFF), 16, 128, 2048
PACK_IDS = 65_536
#: Addresses that a task remembers.
SEEN = 200_000


def gear() -> np.ndarray:
    """A random 64-bit value for each of 2**16 residues of an id."""
    return np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 1 << 16, np.uint64)


def cut_points(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> list[list[int]]:
    """Chunk ends (relative) of each document in the concatenated ids; starts has one more entry than documents.

    The hash of a position covers the WINDOW ids up to it; no cut comes before LEAST ids, so no window crosses a document's start."""
    h, width = table[ids & 0xFFFF], 1
    while width < WINDOW:  # a power of 2: two windows of half the width make one
        before = h[:-width] << np.uint64(width)
        h[width:] += before
        width *= 2
    marks = np.flatnonzero((h >> np.uint64(WINDOW)) & MASK == 0) + 1
    lo = np.searchsorted(marks, starts[:-1] + LEAST)
    hi = np.searchsorted(marks, starts[1:])
    out = []
    for s, e, a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
        ends, at = [], s
        for m in marks[a:b].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at - s)
            if m - at >= LEAST:
                at = m
                ends.append(at - s)
        while e - at > MOST:
            at += MOST
            ends.append(at - s)
        if e > at:
            ends.append(e - s)
        out.append(ends)
    return out


def merkle_root(addresses: bytes) -> bytes:
    level = [addresses[i : i + 16] for i in range(0, len(addresses), 16)] or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


STAGE = "kind int, doc_id long, n_tokens long, pack long, hashes binary, sizes binary, payload binary, root binary"


def chunker(path: str, end_id: int, wide: bool) -> Callable:
    """Rows of kind 0 are recipes, of kind 1 packs of chunks that this task hasn't packed before."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, table, press = encoder(path), gear(), zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        waiting: list[tuple[bytes, np.ndarray]] = []
        count, pack = 0, TaskContext.get().partitionId() << 24

        def packed():
            ids = np.concatenate([x for _, x in waiting])
            return (1, None, None, pack, b"".join(a for a, _ in waiting), np.array([len(x) for _, x in waiting], "<u4").tobytes(), press.compress((ids if wide else ids.astype("<u2")).tobytes()), None)

        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("pack", pa.int64()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("payload", pa.binary()), ("root", pa.binary())])
        for batch in common.blocks(batches):
            rows = []
            ids, starts = coder.encode(batch.column("text"), end_id)
            ids = ids.astype("<u4", copy=False)
            raw = memoryview(ids).cast("B")
            for doc, start, ends in zip(batch.column("doc_id").to_pylist(), starts.tolist(), cut_points(ids, starts, table), strict=False):
                addresses, at = [], 0
                for end in ends:
                    addresses.append(a := hashlib.blake2b(raw[4 * (start + at) : 4 * (start + end)], digest_size=16).digest())
                    if a not in seen:
                        if len(seen) >= SEEN:  # forgetting only costs a second copy in the staged packs
                            seen.clear()
                        seen.add(a)
                        waiting.append((a, ids[start + at : start + end]))
                        count += end - at
                        if count >= PACK_IDS:
                            rows.append(packed())
                            waiting, count, pack = [], 0, pack + 1
                    at = end
                rows.append((0, doc, at, None, joined := b"".join(addresses), None, None, merkle_root(joined)))
            waiting = [(a, x.copy()) for a, x in waiting]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(packed(), schema.types, strict=True)], schema=schema)

    return run


def keep_owned(batches) -> Iterator[pa.RecordBatch]:
    """Packs without the chunks that another pack owns."""
    import zstandard

    press, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for pack, hashes, sizes, payload, drop in zip(*(batch.column(c).to_pylist() for c in ("pack", "hashes", "sizes", "payload", "drop")), strict=True):
            if drop:
                gone = set(drop)
                n, names = np.frombuffer(sizes, "<u4"), [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
                raw = expand.decompress(payload)
                ends = np.cumsum(n.astype(np.int64)) * (len(raw) // max(1, int(n.sum())))
                kept = [i for i, a in enumerate(names) if a not in gone]
                raw = b"".join(raw[(ends[i - 1] if i else 0) : ends[i]] for i in kept)
                hashes, sizes, payload = b"".join(names[i] for i in kept), n[kept].tobytes(), press.compress(raw)
            if hashes:
                out.append((pack, hashes, sizes, payload))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["pack", "hashes", "sizes", "payload"])


def split16(column: str):
    """The 16-byte addresses in a binary column, in order."""
    return F.expr(f"transform(sequence(0, cast(octet_length({column}) / 16 as int) - 1), i -> struct(i as seq, substring({column}, i * 16 + 1, 16) as hash))")


def write_store(docs: DataFrame, store: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, cuts and stores it. wide: 4 bytes an id, for vocabularies of more than 65,536 entries."""
    source = common.id_and_text(docs, id_col, text_col)
    stage = common.staged(source.mapInArrow(chunker(vocabulary_path(vocabulary), end_id, wide), STAGE))
    packs = stage.filter("kind = 1").select("pack", "hashes", "sizes", "payload")
    index = packs.select("pack", F.explode(split16("hashes")).alias("x")).select("pack", F.col("x.hash").alias("hash"))
    owners = index.groupBy("hash").agg(F.min("pack").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    drops = index.join(owners, "hash").filter("pack <> owner").groupBy("pack").agg(F.collect_list("hash").alias("drop"))
    packs.join(drops, "pack", "left").select("pack", "hashes", "sizes", "payload", "drop").mapInArrow(keep_owned, "pack long, hashes binary, sizes binary, payload binary").write.option("compression", "none").parquet(f"{store}/chunks")
    recipes = stage.filter("kind = 0").select("doc_id", "n_tokens", "hashes", "root")
    lengths = common.running_total(recipes, "n_tokens", "start").select("doc_id", "n_tokens", "start", "hashes", "root")
    lengths.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{store}/recipes")


# ---------------------------------------------------------------- reading back


def verified_chunks(batches) -> Iterator[pa.RecordBatch]:
    """Unpacks chunks, holds each against its address, and gives its size and the crc32 of its ids as 32-bit integers."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for hashes, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("hashes", "sizes", "payload")), strict=True):
            n, raw, at, out = np.frombuffer(sizes, "<u4"), expand.decompress(payload), 0, []
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(n.sum()) else "<u4").astype("<u4")
            for i, size in enumerate(n.tolist()):
                part = ids[at : at + size].tobytes()
                at += size
                if hashlib.blake2b(part, digest_size=16).digest() != hashes[16 * i : 16 * i + 16]:
                    raise ValueError("a chunk doesn't match its address")
                out.append((hashes[16 * i : 16 * i + 16], size, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["hash", "size", "crc"])


def times(a, b):
    """Product of polynomials modulo the CRC-32 polynomial, bit-reflected, elementwise."""
    a, b, out = np.uint32(a), np.array(b, np.uint32), np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0)).astype(np.uint32)
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0)).astype(np.uint32)
    return out


def powers(step: int, count: int) -> np.ndarray:
    """x**(32 step n) modulo the polynomial for n = 0 .. count - 1: what step n more 32-bit ids multiply a crc by."""
    unit = np.array([0x80000000], np.uint32)
    base = unit
    for bit in bin(32 * step)[2:]:
        base = times(base, base)
        if bit == "1":
            base = times(base, np.array([0x40000000], np.uint32))
    out, power = unit, base
    while len(out) < count:
        out = np.concatenate([out, times(out, power)])
        power = times(power, power)
    return out[:count]


def crc_of_parts(starts: np.ndarray, sizes: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """crc32 of each row's concatenated parts; starts: each row's first part; sizes in ids. No row is without parts.

    The crc is linear: it is the sum of the parts' crcs, each moved on by the number of ids that follow it in its row."""
    if not len(starts):
        return np.empty(0, np.uint32)
    ends = np.cumsum(sizes)
    last = np.append(starts[1:], len(sizes)) - 1
    after = np.repeat(ends[last], last - starts + 1) - ends
    low, high = powers(1, 4096), powers(4096, int(after.max() >> 12) + 1)
    moved = times(high[after >> 12], times(low[after & 4095], crcs.astype(np.uint32)))
    return np.bitwise_xor.reduceat(moved, starts)


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and ids_crc32. Chunks are checked against their addresses, recipes against
    their Merkle roots and sizes; any mismatch raises."""
    chunks = spark.read.parquet(f"{store}/chunks").mapInArrow(verified_chunks, "hash binary, size long, crc long")
    recipes = spark.read.parquet(f"{store}/recipes")
    named = recipes.groupBy("root", "hashes").agg(F.count("*").alias("copies"))
    distinct = named.select("root", "hashes")
    parts = distinct.select("root", F.explode(split16("hashes")).alias("x")).select("root", "x.seq", "x.hash").join(chunks, "hash", "left")
    lists = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "hash", "size", "crc"))).alias("p"))

    def combined(batches):
        for batch in batches:
            p = batch.column("p")
            starts = (p.offsets.to_numpy()[:-1] - p.offsets[0].as_py()).astype(np.int64)
            parts = p.flatten()
            if parts.field("size").null_count:
                raise ValueError("a recipe lacks a chunk")
            names, sizes = b"".join(parts.field("hash").to_pylist()), parts.field("size").to_numpy()
            for root, a, b in zip(batch.column("root").to_pylist(), starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True):
                if merkle_root(names[16 * a : 16 * b]) != root:
                    raise ValueError("a recipe doesn't match its Merkle root")
            crc = crc_of_parts(starts, sizes, parts.field("crc").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(np.add.reduceat(sizes, starts) if len(starts) else sizes), pa.array(crc.astype(np.int64))], names=["root", "stored", "ids_crc32"])

    digests = lists.mapInArrow(combined, "root binary, stored long, ids_crc32 long")
    checked = F.when(F.col("stored") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe and its chunks differ in size")).cast("long"))
    groups = digests.join(named.select("root", "copies"), "root")
    return common.met(recipes.select("doc_id", "start", "n_tokens", "root"), common.staged(groups), "root", "copies").select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32", F.hex("root").alias("merkle_root"))


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, ids array<long>) rebuilt from recipes and chunks; for uses that need the streams themselves."""

    def chunks(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for hashes, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("hashes", "sizes", "payload")), strict=True):
                n, raw = np.frombuffer(sizes, "<u4"), expand.decompress(payload)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(n.sum()) else "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([hashes[i : i + 16] for i in range(0, len(hashes), 16)], pa.binary()), pa.array(np.split(ids, np.cumsum(n)[:-1]), pa.list_(pa.int64()))], names=["hash", "ids"])

    parts = spark.read.parquet(f"{store}/recipes").select("doc_id", "start", F.explode(split16("hashes")).alias("x"))
    parts = parts.select("doc_id", "start", "x.seq", "x.hash").join(spark.read.parquet(f"{store}/chunks").mapInArrow(chunks, "hash binary, ids array<long>"), "hash")
    return parts.groupBy("doc_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids")).select("doc_id", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    store = common.scratch(spark)
    write_store(docs, store)
    return read_digests(spark, store)
