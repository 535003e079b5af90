"""Threshold-scaled sketches: of a text's word shingles, every one whose hash lies below a fixed fraction of the range is kept.

Sketches merge by union and estimate Jaccard similarity and containment without bias, however unequal the texts are. The fraction is
an eighth (SCALE) for texts of more than 4 SMALL shingles, a quarter from 2 SMALL on, half from SMALL on; shorter texts keep all, so
that short near copies are found too. Two sketches compare and merge at the coarser of their scales. A fingerprint is `scale:shingle count:text digest:hashes`; the digest tells equal word sequences from texts whose
sketches are alike.

Likeness: 1 for an equal digest; otherwise the Jaccard estimate of the sketches, 0 where both are empty.

Defined cases: a null text counts as empty; a text of fewer than k words is one shingle, and a blank one none; the first document
follows the last; null ids come last, and rows that repeat an id follow each other in the order of a hash of the text; an empty table
gives no rows; columns other than the id and the text are ignored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import common
from .words import shingles, word_hashes

SCALE, SMALL, K = 8, 64, 5
#: A sketch with the digest of its word sequence: (digest, scale, hashes).
Sketch = tuple[bytes, int, np.ndarray]


def below(kept: np.ndarray, scale: int) -> np.ndarray:
    """The hashes (upper 48 bits, sorted) that a sketch of this scale keeps."""
    return kept[: np.searchsorted(kept, np.uint64(2**48 // scale))]


def sketch(words: np.ndarray, scale: int = SCALE, k: int = K, small: int = SMALL) -> tuple[int, int, np.ndarray]:
    """Number of distinct shingles, the scale, and the kept hashes (upper 48 bits), sorted."""
    s = np.unique(shingles(words, k))
    while scale > 1 and len(s) <= small * scale // 2:
        scale //= 2
    return len(s), scale, below(s >> np.uint64(16), scale)


def printed(words: np.ndarray, scale: int = SCALE, k: int = K) -> tuple[str, Sketch]:
    """The fingerprint and its sketch."""
    n, scale, kept = sketch(words, scale, k)
    d = hashlib.blake2b(words.tobytes(), digest_size=9).digest()
    body = np.ascontiguousarray(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
    return f"{scale}:{n}:{base64.b64encode(d).decode()}:{base64.b64encode(body).decode()}", (d, scale, kept)


def parsed(fingerprint: str) -> tuple[int, Sketch]:
    """The shingle count and the sketch."""
    scale, n, d, body = fingerprint.split(":")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    return int(n), (base64.b64decode(d), int(scale), np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64))


def common_scale(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both at the coarser of their scales."""
    scale = max(a[1], b[1])
    return below(a[2], scale), below(b[2], scale)


def likeness(a: Sketch, b: Sketch) -> float:
    if a[0] == b[0]:
        return 1.0
    x, y = common_scale(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def contained(a: str, b: str) -> float:
    """Estimated share of a's shingles that b has too; 1 for an equal digest, 0 where a's sketch is empty."""
    p, q = parsed(a)[1], parsed(b)[1]
    x, y = common_scale(p, q)
    return 1.0 if p[0] == q[0] else len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 0.0


def merged(a: str, b: str) -> tuple[int, np.ndarray]:
    """The scale and the hashes of the sketch of both texts' shingles together."""
    p, q = parsed(a)[1], parsed(b)[1]
    return max(p[1], q[1]), np.union1d(*common_scale(p, q))


def fingerprints(docs: DataFrame, scale: int = SCALE, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words, at = word_hashes(common.texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([printed(words[a:b], scale, k)[0] for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], names=["doc_id", "fingerprint"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def edited(own: str, following: str) -> str:
    """The last half of the text (rounded down, in code points) replaced by the first as many of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def prints_of(texts: list[str], scale: int, k: int) -> list[tuple[str, Sketch]]:
    words, at = word_hashes(texts)
    return [printed(words[a:b], scale, k) for a, b in zip(at[:-1], at[1:], strict=True)]


def results(todo: list, scale: int, k: int) -> list[pa.Array]:
    """The columns of RESULT for pairs of (doc_id, text, print) and what follows it."""
    changed = [edited(x[1], y[1]) for x, y in todo]
    prints = prints_of(changed, scale, k)
    return [
        pa.array([x[0] for x, _ in todo], pa.int64()),
        pa.array([len(x[1]) for x, _ in todo], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array([x[2][0] for x, _ in todo], pa.string()),
        pa.array([p[0] for p in prints], pa.string()),
        pa.array([likeness(x[2][1], p[1]) for (x, _), p in zip(todo, prints, strict=True)], pa.float64()),
        pa.array([likeness(x[2][1], y[2][1]) for x, y in todo], pa.float64()),
    ]


def pressed(batches) -> Iterator[pa.RecordBatch]:
    """Texts as zstd, in which they move."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for batch in common.slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array([press(t or b"") for t in texts], pa.binary())], names=["doc_id", "tie", "text"])


def compare_in_order(scale: int, k: int):
    """Compares each row with the one after it; a task's first and last row come out with their texts, edge 1 and 2."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in common.slices(batches):
            texts = [expand(t).decode() for t in batch.column("text").to_pylist()]
            todo = []
            for row in zip(batch.column("doc_id").to_pylist(), texts, prints_of(texts, scale, k), strict=True):
                first = first or row
                if held is not None:
                    todo.append((held, row))
                held = row
            if todo:
                n = len(todo)
                yield pa.RecordBatch.from_arrays([*results(todo, scale, k), pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=[*names, "part", "edge", "text"])
        if held is not None:
            ends = [pa.array([first[0], held[0]], pa.int64()), *[pa.nulls(2, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
            yield pa.RecordBatch.from_arrays([*ends, pa.array([part] * 2, pa.int32()), pa.array([1, 2], pa.int32()), pa.array([first[1], held[1]], pa.string())], names=[*names, "part", "edge", "text"])

    return run


def compare_pairs(scale: int, k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            own, after = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "next"))
            todo = [((i, x, p), (None, y, q)) for i, x, p, y, q in zip(batch.column("doc_id").to_pylist(), own, prints_of(own, scale, k), after, prints_of(after, scale, k), strict=True)]
            yield pa.RecordBatch.from_arrays(results(todo, scale, k), names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def with_edited(docs: DataFrame, scale: int = SCALE, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compares each text with its edited text and with the next one in descending order of ids (null ids come last).

    Texts are dealt by ranges of ids, drawn from what the table holds, and move once, compressed; a range's last text meets the first one of the
    next range afterwards."""
    docs = common.id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    order = (F.desc_nulls_last("doc_id"), F.asc("tie"))
    docs = docs.mapInArrow(pressed, "doc_id long, tie long, text binary")
    every = common.staged(docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare_in_order(scale, k), f"{RESULT}, part int, edge int, text string"))
    edges = every.filter("edge > 0")
    firsts, lasts = edges.filter("edge = 1").select(F.col("part").alias("to"), F.col("text").alias("next")), edges.filter("edge = 2").select("part", "doc_id", "text")
    after = Window.orderBy("part")  # a row for each range
    parts = lasts.select("part").withColumn("to", F.coalesce(F.lead("part").over(after), F.first("part").over(after)))
    seams = lasts.join(parts, "part").join(firsts, "to").select("doc_id", "text", "next").mapInArrow(compare_pairs(scale, k), RESULT)
    return every.filter("edge = 0").drop("part", "edge", "text").unionByName(seams)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(common.documents(spark, sf_dir))
