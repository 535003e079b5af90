"""Fill-in-the-middle texts from a distinct-text index: identical texts are grouped by verified content, the byte offsets of their
code points are kept once as an Elias-Fano list, documents join back to it, and each document's seeded cuts are selected in the list.

Index: a key of 128 bits names a text. Keys that occur once need no grouping, since equal texts have equal keys: their rows stay where
they are, and only texts whose key a bitmap of bounded size knows as repeated move. Those are grouped by key and whole text, so that
groups hold equal bytes; were two texts to share a key, the rows of that key would be indexed one by one. Documents join the index by
key alone. A group of more than COPY_ROWS rows and a share of 1 / HEAVY of all repeated rows is dealt over several copies of its index row,
so no task gets more of one text than that.

Defined cases: a null text counts as empty; an empty text, and one that holds a marker, stays plain; the seed of a null id is that of
an empty id; repeated rows are cut alike; an empty table gives no rows; columns other than the id and the text are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: At most so many groups are dealt over several copies of their index row; a row of their list is broadcast.
HEAVY = 4096
#: Rows for which one copy of an index row is enough at any size.
COPY_ROWS = 1024
MARKERS = ("<P>", "<S>", "<M>")
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)
#: Bytes of the high part between two entries of the directory.
STEP = 256
LIST = "n long, shift int, high binary, low binary, ranks binary"


@dataclass(frozen=True)
class EliasFano:
    """A rising list of offsets. The high part holds in unary by how much offset >> shift rises from entry to entry, the low part the
    `shift` bits below, `ranks` how many entries begin before each STEP bytes of the high part."""

    n: int
    shift: int
    high: np.ndarray
    low: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, offsets: np.ndarray) -> EliasFano:
        n, end = len(offsets), int(offsets[-1])
        shift = max(0, (end // n).bit_length() - 1)
        ones = (offsets >> shift) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        low = np.packbits((offsets[:, None] >> np.arange(shift) & 1).astype(np.uint8), bitorder="little")
        return cls(n, shift, high, low, np.concatenate([[0], np.cumsum(np.add.reduceat(ONES[high], np.arange(0, len(high), STEP), dtype=np.int64))[:-1]]))

    def select(self, i: int) -> int:
        """Entry i, from one stretch of the high part and `shift` bits of the low part."""
        k = int(np.searchsorted(self.ranks, i, "right")) - 1
        part = self.high[k * STEP : (k + 1) * STEP]
        where = np.flatnonzero(np.unpackbits(part, bitorder="little"))[i - int(self.ranks[k])]
        value = k * STEP * 8 + int(where) - i
        if self.shift:
            at = np.arange(i * self.shift, (i + 1) * self.shift)
            value = value << self.shift | int(((self.low[at >> 3] >> (at & 7) & 1).astype(np.int64) << np.arange(self.shift)).sum())
        return value

    def columns(self) -> tuple:
        return self.n, self.shift, self.high.tobytes(), self.low.tobytes(), self.ranks.astype("<u4").tobytes()

    @classmethod
    def read(cls, n: int, shift: int, high: bytes, low: bytes, ranks: bytes) -> EliasFano:
        return cls(n, shift, np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8), np.frombuffer(ranks, "<u4"))


def boundaries(raw: bytes) -> np.ndarray:
    """Where each code point of a UTF-8 text begins, and the end."""
    return np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))


def index_batches(batches) -> Iterator[pa.RecordBatch]:
    """Adds the list of each row's text, whose n entries are one more than the text has code points."""
    common.release()
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    for batch in common.slices(batches):
        made = [EliasFano.of(boundaries(t.encode())).columns() for t in common.texts_of(batch)]
        columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n", "shift", "high", "low", "ranks"])


@dataclass(frozen=True)
class Rule:
    """How cuts and forms are drawn; of 100 texts `plain` stay as they are on average, and of the others `spm` in 100 put the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20

    def draws(self, doc_id: int | None) -> list[int]:
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4)]

    def apply(self, doc_id: int | None, raw: bytes, points: EliasFano) -> tuple:
        n = points.n - 1
        a, b, c, d = self.draws(doc_id)
        if not n or any(m.encode() in raw for m in MARKERS) or c % 100 >= 100 - self.plain:
            return n, "plain", None, None, raw
        first, second = sorted((a % (n + 1), b % (n + 1)))
        x, y = points.select(first), points.select(second)
        p, s, m = (k.encode() for k in MARKERS)
        prefix, middle, suffix = raw[:x], raw[x:y], raw[y:]
        if d % 100 < self.spm:
            return n, "spm", first, second - first, b"".join([s, suffix, p, prefix, m, middle])
        return n, "psm", first, second - first, b"".join([p, prefix, s, suffix, m, middle])


def cutter(rule: Rule):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            lists = zip(*(batch.column(c).to_pylist() for c in ("n", "shift", "high", "low", "ranks")), strict=True)
            rows = [rule.apply(i, t.encode(), EliasFano.read(*x)) for i, t, x in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), lists, strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else [()] * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = common.id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is indexed where they are, rows joined to the index of repeated texts): doc_id, text and its list."""
    rows = keyed(docs, id_col, text_col)
    counts = rows.groupBy("k1", "k2").count()
    repeated = common.staged(counts.filter("count > 1"))
    single, maybe = common.split_by(rows, F.xxhash64("k1", "k2"), repeated.select(F.xxhash64("k1", "k2").alias("key")))
    texts = common.staged(maybe.groupBy("k1", "k2", "text").agg(F.count("*").alias("rows")))
    clashing = common.staged(texts.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2"))
    if not clashing.isEmpty():
        single = single.unionByName(maybe.join(clashing, ["k1", "k2"], "left_semi").select(*single.columns))
        maybe, texts = maybe.join(clashing, ["k1", "k2"], "left_anti"), texts.join(clashing, ["k1", "k2"], "left_anti")
    # a further copy for each `most` rows: since repeated rows are shared out by it, at most `heavy` groups have several
    most = max(COPY_ROWS, -(-(repeated.agg(F.sum("count")).first()[0] or 0) // heavy))
    sized = texts.withColumn("copies", F.ceil(F.col("rows") / most).cast("int"))
    large = sized.filter("copies > 1").select("k1", "k2", F.col("copies").alias("of"))
    index = sized.mapInArrow(index_batches, f"k1 long, k2 long, text string, rows long, copies int, {LIST}").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = maybe.select("doc_id", "k1", "k2").join(F.broadcast(large), ["k1", "k2"], "left")
    dealt = dealt.withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.coalesce("of", F.lit(1))).cast("int"))
    columns = ["doc_id", "text", "n", "shift", "high", "low", "ranks"]
    here = single.select("doc_id", "text").mapInArrow(index_batches, f"doc_id long, text string, {LIST}")
    return here.select(*columns), dealt.join(index, ["k1", "k2", "copy"]).select(*columns)


def transformed(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and the output text of every document."""
    here, joined = indexed(docs, id_col, text_col)
    return here.mapInArrow(cutter(rule), MADE).unionByName(joined.mapInArrow(cutter(rule), MADE))


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made of. Its parts hold no marker, so the first one found of each kind is the one put there."""
    p, s, m = MARKERS
    body, size = F.substring(F.col(output), 4, 2**31 - 1), F.length
    first = F.when(F.col(form) == "spm", F.substring_index(body, p, 1)).otherwise(F.substring_index(body, s, 1))
    rest = F.substr(body, size(first) + 4)
    second = F.substring_index(rest, m, 1)
    middle = F.substr(rest, size(second) + 4)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(common.documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents),
u as (select doc_id, t, length(t) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
  ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, left(t, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a::bigint end as prefix_chars,
  case when form <> 'plain' then (b - a)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
