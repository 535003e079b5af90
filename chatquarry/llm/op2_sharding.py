"""Hierarchical weighted hash tree: a row descends from region to rack to shard; on each level every child draws -ln(u) / weight, u a
hash of the row's id and the child's name, and the smallest draw wins. DataFrame functions only.

A child wins with a probability in proportion to its weight. Where a weight changes, or a child comes, rows move only into or out of
that child; all others stay, so movement is confined to the subtrees whose weights change. A tree is a list of
(region, [(rack, [(shard, weight), ...]), ...]); a rack weighs as much as its shards, a region as its racks.

`grown` adds each further shard as a region of its own: no weight on any other path changes, so it takes rows only into itself.

Defined cases: a null text has size 1 and the crc32 of no bytes; null ids hash alike and come first in their shard; rows that repeat an
id share their shard and follow each other there in the order of a hash; an empty table gives no rows; columns other than the id and the text are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

Tree = list[tuple[str, list[tuple[str, list[tuple[int, float]]]]]]


def tree_of(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8) -> Tree:
    """Equal weights; the first `base` shards in regions of `racks` racks of `per_rack` shards, each further one in its own region."""
    regions: Tree = []
    per_region = racks * per_rack
    for start in range(0, min(shards, base), per_region):
        own = range(start, min(start + per_region, shards, base))
        regions.append((f"region{start // per_region}", [(f"rack{r}", [(s, 1.0) for s in own if (s - start) // per_rack == r]) for r in range(racks) if any((s - start) // per_rack == r for s in own)]))
    return regions + [(f"grown{s}", [("rack0", [(s, 1.0)])]) for s in range(base, shards)]


def draw(key: str, name: str, weight: float) -> F.Column:
    """Exponential with rate `weight`: smaller wins. 53 bits of the hash make a number above 0 and at most 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), F.col(key)), 11).cast("double") + 1) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def winner(key: str, path: str, children: list[tuple[str, float, F.Column]]) -> F.Column:
    """The value of the child (name, weight, value) with the smallest draw, the first of equal ones."""
    live = [c for c in children if c[1] > 0]
    if len(live) == 1:
        return live[0][2]
    draws = [F.struct(draw(key, f"{path}/{name}", weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(live)]
    chosen = F.least(*draws)["i"]
    return F.element_at(F.array(*[v for _, _, v in live]), chosen + 1) if len(live) > 8 else F.coalesce(*[F.when(chosen == i, v) for i, (_, _, v) in enumerate(live)])


def shard_of(key: str, tree: Tree) -> F.Column:
    """The shard of a row, by its key and the tree alone."""
    weigh = lambda rack: sum(w for _, w in rack[1])
    regions = []
    for region, racks in tree:
        choices = [(rack[0], weigh(rack), winner(key, f"{region}/{rack[0]}", [(f"shard{s}", w, F.lit(s)) for s, w in rack[1]])) for rack in racks if weigh(rack) > 0]
        if choices:
            regions.append((region, sum(c[1] for c in choices), winner(key, region, choices)))
    return winner(key, "", regions)


def assigned(docs: DataFrame, shards: int = 8, tree: Tree | None = None, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Slots count from 0 in each shard, in ascending order of ids."""
    docs = common.id_and_text(docs, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of("doc_id", tree or tree_of(shards)).cast("int")).withColumn("grown_shard", shard_of("doc_id", grown or tree_of(shards + 1)).cast("int"))
    rows = common.staged(rows.withColumn("one", F.lit(1)))
    slots = common.running_total(rows, "one", "slot", ("shard",))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(common.documents(spark, sf_dir))
