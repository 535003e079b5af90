"""Exact Jaccard self-join on word shingles by set-relation skipping, and the groups its links form.

Index: each set's prefix under a global order goes into inverted lists, with the set's size, the shingle's position and a parity
signature. Shingles of rare words come first in the order, shingles found common in the corpus last, so that few lists hold sets
that don't resemble each other. A posting goes at once where its list has no size or position to link it with. Lists are cut into
blocks by size and position; two blocks whose sizes, least positions or distances exclude a link are skipped whole, and so are
postings within them.
Answers: equal sets are one class and share their answers. Every list first compares its sets to one pivot. A set's further answers
are derived from the pivot's: two sets whose distances to a pivot add up to no more than linked sets may differ in are linked without
being compared, and two whose distances differ by more aren't. Only pairs that neither bound settles are compared.

`links` returns all links between classes. `grouped` asks only what links lead to: there a pivot's answers are one component, so
pairs within it need no comparison. What pivots leave apart is joined by neighbours first: each set of a list is compared to the next
one in two orders, so that a group of near copies is one component, or nearly, before pairs are made of the sets that are still apart.

Defined cases: a null or blank text has an empty set, n_shingles 0, and is linked with nothing; a text of fewer than k words is
one shingle; equal texts share a component (unless empty); null ids stay rows of their own, are the smallest id of nothing but a
component that has no other, and rows that repeat an id with other texts stay apart; an empty table gives no rows; columns other than
the id and the text are ignored. Shingles are 64-bit hashes; a class is named by a 128-bit digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import common
from .words import shingle_lists, word_hashes

#: At most so many common shingles go last in the order, and so many common words count in it; the order decides the cost, never the result.
COMMON, COMMON_WORDS, BITMAP_BITS, BLOCK, WIDE = 200_000, 1 << 17, 26, 256, 4096
#: Signatures of so many longs go with the sets whose pairs are left.
FOLDED = 8
#: Lists go by so many bits of a shingle. Sets that meet without sharing the whole of it are compared like others.
TOKEN_BITS = 40
TOKEN = (1 << TOKEN_BITS) - 1
#: From so many sets on that several of a task's sets held a shingle, its list is dealt out before its neighbours are compared.
HOT = 4096
#: Shingles, and words, gathered in a task before the common ones among them are counted.
GATHERED = 2_000_000
#: Digests that a task remembers.
SEEN = 200_000


def unique_sets(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles."""
    out = []
    for s in shingle_lists(words, at, k):
        s = np.sort(s)
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 parity bits: two sets' signatures differ in at most as many bits as the sets in elements."""
    bits = np.bincount(((s >> np.uint64(7)) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return tuple(int(x) for x in np.packbits(bits.astype(np.uint8)).view("<i8"))


def least_shared(n, m, t: int) -> int:
    """Fewest common elements of linked sets of n and m: 100 i >= t (n + m - i)."""
    return -(-t * (n + m) // (100 + t))


def profile(k: int):
    """kind 0: a document's set size, digest and text key; kind 1: shingles that several of this task's distinct sets hold; kind 2:
    words that come often in this task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        seen: set[bytes] = set()

        def counted(kind: int, least: int):
            h, c = np.unique(np.concatenate(held[kind]), return_counts=True)
            held[kind] = []
            h, c = h[c > least], c[c > least]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(h), pa.binary()), pa.nulls(len(h), pa.int64())], names=["kind", "id", "n", "digest", "key"])

        for batch in common.slices(batches):
            words, at = word_hashes(common.texts_of(batch))
            sets = unique_sets(words, at, k)
            names = [digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), batch.column("key")], names=["kind", "id", "n", "digest", "key"])
            held[2].append(words)
            for s, d in zip(sets, names, strict=True):
                if d is not None and d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    held[1].append(s)
            for kind, least in ((1, 2), (2, 7)):
                if sum(map(len, held[kind])) > GATHERED:
                    yield counted(kind, least)
        for kind, least in ((1, 2), (2, 7)):
            if held[kind]:
                yield counted(kind, least)

    return run


def prefix(s: np.ndarray, weight: np.ndarray, common_hashes: np.ndarray, common_rank: np.ndarray, t: int) -> np.ndarray:
    """The set's first elements under the order: any set linked with it holds one of them among its own first elements."""
    n = len(s)
    take = n - -(-t * n // 100) + 1
    if len(common_hashes):
        at = np.minimum(np.searchsorted(common_hashes, s), len(common_hashes) - 1)
        weight = np.where(common_hashes[at] == s, common_rank[at] + 10_000, weight)
    return s[np.lexsort((s, weight))[:take]]


def levels(words: np.ndarray, common_words: np.ndarray, common_level: np.ndarray) -> np.ndarray:
    """The binary order of magnitude of each word's count, 0 for words that aren't common."""
    if not len(common_words):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(common_words, words), len(common_words) - 1)
    return np.where(common_words[at] == words, common_level[at], 0)


def prefixes(k: int, t: int, order):
    """A row for each distinct set of a task: its digest, size, signature and prefix."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes, rank, common_words, common_level = order.value
        seen: set[bytes] = set()
        for batch in common.slices(batches):
            rows = []
            words, at = word_hashes(common.texts_of(batch))
            sums = np.concatenate([[0], np.cumsum(levels(words, common_words, common_level))])
            for s, a, b in zip(shingle_lists(words, at, k), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if not len(s):
                    continue
                s, first = np.unique(s, return_index=True)
                if (d := digest(s)) in seen:
                    continue
                if len(seen) >= SEEN:  # forgetting only costs a second copy of a row
                    seen.clear()
                seen.add(d)
                weight = sums[np.minimum(a + first + k, b)] - sums[a + first]
                rows.append((d, len(s), *signature(s), prefix(s, weight, hashes, rank, t).view(np.int64) & TOKEN))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["digest", "size", "s1", "s2", "prefix"])

    return run


def once_each(sets: DataFrame) -> DataFrame:
    """One row of those that different tasks made of the same set; only rows that a bitmap of bounded size takes for copies move."""
    least = F.min("number").over(Window.partitionBy("digest"))
    copies = common.staged(sets.select("digest", "number").withColumn("least", least).filter("number <> least").select(F.col("number").alias("key")))
    sure, maybe = common.split_by(sets, F.col("number"), copies)
    return sure.unionByName(maybe.join(copies.withColumnRenamed("key", "number"), "number", "left_anti").select(*sure.columns))


def postings(sets: DataFrame, hot: DataFrame, t: int) -> DataFrame:
    """token, number, size, pos, hot: the prefix elements that another set may be linked by, as far as sizes and positions tell.

    A list sorted by size tells by each posting's neighbours whether any set fits, and its least position whether both positions leave
    a chance. `hot` names the tokens of long lists: these are dealt out by a salt in the key's upper bits, and kept whole."""
    rows = sets.select("number", "size", F.posexplode("prefix").alias("pos", "token")).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "token", "left")
    salt = F.when(F.col("hot"), F.pmod("number", F.lit(BLOCK)) + 1).otherwise(0)
    rows = rows.select("number", "size", "pos", (F.col("token") + F.shiftleft(salt.cast("long"), TOKEN_BITS)).alias("key"))
    by_size = Window.partitionBy("key").orderBy("size")
    rows = rows.withColumn("less", F.lag("size").over(by_size)).withColumn("more", F.lead("size").over(by_size))
    rows = rows.withColumn("first", F.min("pos").over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    fits = f"(less * 100 >= size * {t} or size * 100 >= more * {t}) and pos + first <= {most_apart('size', t)}"
    hot_key = F.col("key") >= 1 << TOKEN_BITS
    return rows.filter(hot_key | F.expr(fits)).select(F.col("key").bitwiseAND(F.lit(TOKEN)).alias("token"), "number", "size", "pos", hot_key.alias("hot"))


def most_apart(size: str, t: int) -> str:
    """The most elements that may be in one only of a set of this size and any set linked with it, and a few more."""
    return f"{size} * {(1 + 100 / t) * (1 - 2 * t / (100 + t))} + 2"


def fetched(docs: DataFrame, classes: DataFrame, names: DataFrame, k: int, column: str, of_set) -> DataFrame:
    """(id, `column`): what `of_set` makes of the set of each class in names.id. Only documents that stand for such a class are cut
    into shingles, found through bitmaps of bounded size."""
    spark = docs.sparkSession
    wanted = common.staged(classes.join(names.select(F.col("id").alias("digest")), "digest", "left_semi").select(F.xxhash64(F.col("rep")).alias("h"), first_half("digest").alias("d")))
    rep_bits, bits = (spark.sparkContext.broadcast(common.bitmap(wanted, c, BITMAP_BITS)) for c in ("h", "d"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in common.slices(batches):
            batch = batch.filter(pa.array(common.in_bitmap(rep_bits.value, batch.column("h").to_numpy().view(np.uint64))))
            if not batch.num_rows:
                continue
            sets = [s for s in unique_sets(*word_hashes(common.texts_of(batch)), k) if len(s)]
            named = [digest(s) for s in sets]
            hit = common.in_bitmap(bits.value, np.array([int.from_bytes(d[:8], "big") for d in named], np.uint64)).tolist() if sets else []
            rows = []
            for s, d, h in zip(sets, named, hit, strict=True):
                if h and d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    rows.append((d, of_set(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["id", column])

    rows = docs.select("text", F.xxhash64(F.col("doc_id")).alias("h")).mapInArrow(run, f"id binary, {column} array<long>")
    return common.staged(rows).dropDuplicates(["id"])


def first_half(digest: str) -> F.Column:
    """The first 8 bytes of a digest as a long."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def apart(x: str, y: str) -> F.Column:
    """Bits in which two postings' signatures differ: at most the number of elements in one of the sets only."""
    return sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in (1, 2)), F.lit(0))


def may_link(x: str, y: str, t: int) -> F.Column:
    """Whether size, position in the list's order and signature leave two postings of one list a chance to be linked.

    n + m - 2 least_shared elements may be in one of the sets only; all before the shared element are, if it's the first shared, and
    what is left from there on in either set must do for least_shared."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    shared = F.ceil((n + m) * t / F.lit(100.0 + t) - 1e-9)
    left = (n - F.col(f"{x}.pos") >= shared) & (m - F.col(f"{y}.pos") >= shared)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * t) & left & (apart(x, y) <= n + m - 2 * shared)


def wide_signature(s: np.ndarray) -> np.ndarray:
    """WIDE parity bits of a set."""
    return np.packbits((np.bincount((s & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)).view("<i8")


def near_enough(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, t: int, sigs: DataFrame | None = None) -> DataFrame:
    """Pairs whose wide signatures differ in no more bits than linked sets may differ in elements: no link is lost, and few others
    are left whose whole sets must move. sigs: id, sig, where they are known."""
    if sigs is None:
        sigs = fetched(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k, "sig", wide_signature)
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, c: n + c)
    spare = (F.col("na") + F.col("nb")) - 2 * F.ceil((F.col("na") + F.col("nb")) * t / F.lit(100.0 + t) - 1e-9)
    return both.filter(differ <= spare).select("a", "b", "na", "nb").distinct()


def compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, t: int, sigs: DataFrame | None = None) -> DataFrame:
    """a, b, na, nb, shared, linked for pairs (a, b, na, nb) of classes, from their whole sets.

    Pairs meet at the member that has more of them; each of its partners' sets goes there, in parts of BLOCK pairs."""
    pairs = common.staged(near_enough(pairs, docs, classes, k, t, sigs))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("w"))
    ends = common.staged(ends)
    sets = fetched(docs, classes, ends.select("id"), k, "set", lambda s: s.view(np.int64))
    wa, wb = ends.select(F.col("id").alias("a"), F.col("w").alias("wa")), ends.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    at_a = (F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b")))
    hubs = pairs.join(wa, "a").join(wb, "b").withColumn("at_a", at_a)
    hubs = hubs.withColumn("hub", F.when(F.col("at_a"), F.col("a")).otherwise(F.col("b"))).withColumn("id", F.when(F.col("at_a"), F.col("b")).otherwise(F.col("a"))).withColumn("w", F.greatest("wa", "wb"))
    hubs = hubs.withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("w") / BLOCK))).cast("int"))
    hubs = common.staged(hubs.select("hub", "salt", "id", "a", "b", "na", "nb"))
    own = hubs.select("hub", "salt").distinct().withColumn("id", F.col("hub"))
    asked = hubs.unionByName(own, allowMissingColumns=True).join(sets, "id")
    run = asked.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("a").isNotNull()).mapInArrow(intersected, "a binary, b binary, na int, nb int, shared int").dropDuplicates(["a", "b"])
    return run.select("a", "b", "na", "nb", "shared", (F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * t).alias("linked"))


def intersected(batches) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub, the hub's own set first; each other set is intersected with it."""
    hub, mine = None, None
    for batch in batches:
        sets, offsets = batch.column("set").flatten().to_numpy(), batch.column("set").offsets.to_numpy()
        offsets = offsets - offsets[0]
        keep, shared = [], []
        for i, (h, a) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("a").to_pylist(), strict=True)):
            s = sets[offsets[i] : offsets[i + 1]]
            if a is None:
                hub, mine = h, s.copy()
            elif h == hub:
                keep.append(i)
                shared.append(len(np.intersect1d(mine, s, assume_unique=True)))
        if keep:
            rows = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("a", "b", "na", "nb")], pa.array(shared, pa.int32())], names=["a", "b", "na", "nb", "shared"])


def may_differ(n: str, m: str, t: int) -> F.Column:
    """The most elements that may be in one only of two linked sets of these sizes."""
    both = F.col(n) + F.col(m)
    return both - 2 * F.ceil(both * t / F.lit(100.0 + t) - 1e-9)


def derived(spokes: DataFrame, t: int) -> DataFrame:
    """a, b for pairs of sets near enough to one pivot to be linked with each other. spokes: pivot, id, size, far.

    A pivot's sets are dealt in blocks; each two blocks meet in a cell of their own."""
    spokes = spokes.filter(f"far <= {most_apart('size', t)}")
    salts = F.greatest(F.lit(1), F.ceil(F.col("w") / BLOCK)).cast("int")
    rows = spokes.join(spokes.groupBy("pivot").agg(F.count("*").alias("w")).filter("w > 1"), "pivot").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), salts - 1))).select("pivot", "id", "size", "far", "salt", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"))
    x, y = rows.filter("salt = lo").alias("x"), rows.filter("salt = hi").alias("y")
    met = x.join(y, F.expr("x.pivot = y.pivot and x.lo = y.lo and x.hi = y.hi and (x.lo < x.hi or x.id < y.id)")).filter(F.col("x.far") + F.col("y.far") <= may_differ("x.size", "y.size", t))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def link_counts(members: DataFrame, found: DataFrame) -> DataFrame:
    """id, n_links for each document: the other documents linked with it, those with an equal set among them (0 for empty sets)."""
    size = members.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("size"))
    both = found.select(F.col("a").alias("digest"), F.col("b").alias("to")).unionByName(found.select(F.col("b").alias("digest"), F.col("a").alias("to")))
    linked = both.join(size.select(F.col("digest").alias("to"), F.col("size").alias("m")), "to").groupBy("digest").agg(F.sum("m").alias("linked"))
    counts = size.join(linked, "digest", "left").select("digest", "size", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    named = common.met(members.select("id", "digest"), common.staged(counts), "digest", "size").select("id", "n_links")
    return named.unionByName(members.filter("digest is null").select("id", F.lit(0).cast("long").alias("n_links")))


def found_pairs(x: str, y: str) -> list[F.Column]:
    """a, b, na, nb of two postings, the smaller name first."""
    less = F.expr(f"{x}.id < {y}.id")
    return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b"), F.when(less, F.col(f"{x}.size")).otherwise(F.col(f"{y}.size")).alias("na"), F.when(less, F.col(f"{y}.size")).otherwise(F.col(f"{x}.size")).alias("nb")]


def folded() -> list[F.Column]:
    """w0, w1, ...: a wide signature's parity bits added up to FOLDED longs."""
    return [F.expr(f"aggregate(filter(sig, (x, i) -> i % {FOLDED} = {j}), 0L, (a, x) -> a ^ x)").alias(f"w{j}") for j in range(FOLDED)]


def still_apart(lists: DataFrame, linked: DataFrame) -> DataFrame:
    """The lists (token, id and more) whose sets the links (a, b) haven't joined to one component, with each set's component as root."""
    roots = common.components(linked).select(F.col("node").alias("id"), "root")
    rows = common.staged(lists.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    return rows.join(rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token"), "token", "left_semi")


def neighbours(lists: DataFrame, spare: str, t: int) -> DataFrame:
    """a, b, na, nb: each set of a list and the next one, in an order by chance and in one by likeness, where they may be linked and
    aren't joined yet: at most two pairs for a set of a list. Long lists are dealt in parts of about HOT sets."""
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("w") / HOT)))
    rows = lists.select("token", part.alias("part"), F.xxhash64("id", "token").alias("chance"), F.struct("id", "size", "pos", "s1", "s2", "root").alias("x"))
    for y, order in (("y", "chance"), ("z", "x.s1")):
        rows = rows.withColumn(y, F.lag("x").over(Window.partitionBy("token", "part").orderBy(order, "x.id")))
    rows = rows.select("x", F.explode(F.array("y", "z")).alias("y"))
    return rows.filter(F.expr(f"x.root <> y.root and x.pos + y.pos <= {spare}") & may_link("x", "y", t)).select(*found_pairs("x", "y")).distinct()


def links(docs: DataFrame, k: int = 3, t: int = 90, id_col: str = "doc_id", text_col: str = "text", within: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links). members: id, n, digest, key for each document (digest: its class, null for empty sets; key: xxhash64
    of the text). classes: digest, rep (the smallest id), size. links: a, b, shared for all pairs of classes whose Jaccard similarity
    is at least t / 100; shared is null where the link was derived, not measured. within=False leaves out links between classes
    that other links join already."""
    docs = common.id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    profiles = common.staged(docs.withColumn("key", F.xxhash64("text")).mapInArrow(profile(k), "kind int, id long, n long, digest binary, key long"))
    often = [profiles.filter(F.col("kind") == kind).groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(most).toArrow() for kind, most in ((1, COMMON), (2, COMMON_WORDS))]
    hashes, words = (x.column("id").to_numpy().view(np.uint64) for x in often)
    by_hash, by_word = np.argsort(hashes), np.argsort(words)
    level = np.floor(np.log2(often[1].column("n").to_numpy().astype(np.float64))).astype(np.int64)
    order = spark.sparkContext.broadcast((hashes[by_hash], (len(hashes) - by_hash).astype(np.int64), words[by_word], level[by_word]))  # the most common comes last

    members = profiles.filter("kind = 0").select("id", "n", "digest", "key")
    classes = common.staged(members.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")))

    made = docs.mapInArrow(prefixes(k, t, order), "digest binary, size int, s1 long, s2 long, prefix array<long>")
    sets = once_each(common.staged(made.withColumn("number", F.monotonically_increasing_id())))
    held_often = pa.table({"token": often[0].column("id").filter(pc.greater_equal(often[0].column("n"), HOT))})
    hot = spark.createDataFrame(held_often, "token long").select(F.col("token").bitwiseAND(F.lit(TOKEN)).alias("token")).distinct()
    shared = common.staged(postings(sets, hot, t))
    weights = shared.groupBy("number").agg(F.count("*").cast("int").alias("weight"))
    named = sets.select("number", F.col("digest").alias("id"), "s1", "s2").join(weights, "number")
    found = common.staged(shared.join(named, "number").select("token", "hot", F.struct("weight", "id", "size", "pos", "s1", "s2").alias("x")))

    # each list's pivot: the set with the most elements that others may share; x: a set of the list, y: its pivot
    by_token = Window.partitionBy("token")
    many = {"y": F.max("x"), "w": F.count("*"), "h": F.bit_xor(F.xxhash64("x.id")), "g": F.bit_xor(F.xxhash64(F.lit(1), "x.id"))}
    short = found.filter("not hot").withColumns({c: f.over(by_token) for c, f in many.items()})
    long = found.filter("hot")
    long = long.join(long.groupBy("token").agg(*(f.alias(c) for c, f in many.items())), "token")
    # where the shared element is the first that two linked sets share, those before it are in one of the sets only
    spare = f"(x.size + y.size) * (1 - 2 * {t} / (100.0 + {t})) + 2"
    lists = short.unionByName(long).filter("x.id <> y.id").withColumn("star", F.expr(f"x.pos + y.pos <= {spare}") & may_link("x", "y", t))
    # a list of two has no sets but its pivot's pair
    lists = common.staged(lists.filter("star or w > 2").select(F.xxhash64("y.id", "w", "h", "g").alias("token"), "w", "star", F.col("x").dropFields("weight").alias("x"), F.struct("y.id", "y.size").alias("y")))
    stars = common.staged(lists.filter("star").select(*found_pairs("x", "y")).distinct())

    first = common.staged(compared(stars, docs, classes, k, t))

    # distances to pivots, from both sides of a measured pair
    far = (F.col("na") + F.col("nb") - 2 * F.col("shared")).alias("far")
    either = first.select(F.col("a").alias("id"), F.col("na").alias("size"), F.col("b").alias("pivot"), far).unionByName(first.select(F.col("b").alias("id"), F.col("nb").alias("size"), F.col("a").alias("pivot"), far))
    # lists of the same sets are one, in which a set has its least position: what positions allow in any of them is allowed there
    open_ = lists.filter("w > 2").select("token", "w", "x.*", F.col("y.id").alias("pivot")).groupBy("token", "id", "pivot").agg(*(F.min(c).alias(c) for c in ("w", "size", "pos", "s1", "s2")))
    open_ = open_.join(either.drop("size"), ["id", "pivot"], "left")
    tested = stars.select("a", "b")
    if within:
        near_pivot = common.staged(derived(either.join(lists.select(F.col("y.id").alias("pivot")).distinct(), "pivot"), t))
        open_ = common.staged(open_.withColumn("root", F.col("id")))
    else:
        open_ = common.staged(still_apart(open_, first.filter("linked")))
    sigs = fetched(docs, classes, open_.select("id").distinct(), k, "sig", wide_signature)
    if not within:
        pairs = common.staged(neighbours(open_, spare, t).join(tested, ["a", "b"], "left_anti"))
        first = common.staged(first.unionByName(compared(pairs, docs, classes, k, t, sigs)))
        tested = tested.unionByName(pairs.select("a", "b"))
        open_ = still_apart(open_, first.filter("linked"))

    # what the pivots left open, in blocks of neighbouring sizes and positions
    salts = F.greatest(F.lit(1), F.ceil(F.col("w") / BLOCK)).cast("int")
    open_ = common.staged(open_.join(sigs.select("id", *folded()), "id").select("token", "id", "size", "pos", "s1", "s2", *(f"w{j}" for j in range(FOLDED)), "far", "root", F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / t)))).alias("size_block"), F.floor(F.log2((F.col("pos") + 1).cast("double"))).alias("pos_block"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt")))
    blocks = open_.groupBy("token", "size_block", "pos_block", "salt").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("pos").alias("pos"), F.max(F.coalesce("far", F.lit(1 << 29))).alias("far"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    b, c = blocks.alias("b"), blocks.alias("c")
    met = b.join(c, F.expr("b.token = c.token and (b.size_block < c.size_block and c.size_block - b.size_block <= 2 or b.size_block = c.size_block and (b.pos_block < c.pos_block or b.pos_block = c.pos_block and b.salt <= c.salt))"))
    met = met.filter(F.expr(f"b.most * 100 >= c.least * {t} and c.most * 100 >= b.least * {t}"))
    met = met.filter(F.expr("b.pos + c.pos") <= F.expr(f"(b.most + c.most) * (1 - 2 * {t} / (100.0 + {t})) + 2"))
    least = f"(b.least + c.least) * {t} / (100.0 + {t}) - 1"
    met = met.filter(F.expr(f"b.most - b.pos >= {least} and c.most - c.pos >= {least}"))
    same = "(m.sb = m.sc and m.bp = m.cp and m.bs = m.cs)"
    if within:  # blocks all of whose pairs are derived
        met = met.filter(F.expr(f"b.far + c.far > (b.least + c.least) * (1 - 2 * {t} / (100.0 + {t})) - 2"))
        settled = F.coalesce(F.col("x.far") + F.col("y.far") <= may_differ("x.size", "y.size", t), F.lit(False))
    else:  # blocks all of whose sets are joined
        met = met.filter("not (b.low = b.high and c.low = c.high and b.low = c.low)")
        settled = F.col("x.root") == F.col("y.root")
    met = met.filter("not (b.size_block = c.size_block and b.pos_block = c.pos_block and b.salt = c.salt and b.n = 1)")
    met = met.select(F.col("b.token").alias("token"), F.col("b.size_block").alias("sb"), F.col("b.pos_block").alias("bp"), F.col("b.salt").alias("bs"), F.col("c.size_block").alias("sc"), F.col("c.pos_block").alias("cp"), F.col("c.salt").alias("cs"))
    one = open_.alias("x").join(met.alias("m"), F.expr("x.token = m.token and x.size_block = m.sb and x.pos_block = m.bp and x.salt = m.bs"))
    near = f"(x.far is null or y.far is null or abs(x.far - y.far) <= (x.size + y.size) * (1 - 2 * {t} / (100.0 + {t})) + 2)"
    differ = sum((F.bit_count(F.col(f"x.w{j}").bitwiseXOR(F.col(f"y.w{j}"))) for j in range(FOLDED)), F.lit(0))
    two = one.join(open_.alias("y"), F.expr(f"y.token = m.token and y.size_block = m.sc and y.pos_block = m.cp and y.salt = m.cs and x.id <> y.id and (not {same} or x.id < y.id) and {near} and x.pos + y.pos <= {spare}") & may_link("x", "y", t) & ~settled & (differ <= may_differ("x.size", "y.size", t)))
    rest = two.select(*found_pairs("x", "y")).distinct()
    rest = rest.join(tested, ["a", "b"], "left_anti")
    if within:
        rest = rest.join(near_pivot, ["a", "b"], "left_anti")
    second = compared(common.staged(rest), docs, classes, k, t, sigs)
    measured = first.unionByName(second).filter("linked").select("a", "b", "shared")
    if within:  # a derived pair may have been measured as some list's pivot pair
        new = near_pivot.join(stars.select("a", "b"), ["a", "b"], "left_anti").withColumn("shared", F.lit(None).cast("int"))
        measured = measured.unionByName(new.select("a", "b", "shared"))
    return members, classes, common.staged(measured)


def grouped(docs: DataFrame, k: int = 3, t: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to), class_id (the smallest id with an equal set), component
    (a name for the component that is there for null ids too, null for empty sets), key (xxhash64 of the text)."""
    members, classes, found = links(docs, k, t, id_col, text_col, within=False)
    roots = common.components(found).select(F.col("node").alias("digest"), F.col("root").alias("component"))
    every = classes.join(roots, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = every.groupBy("component").agg(F.min("rep").alias("component_id"))
    every = common.staged(every.join(least, "component"))
    named = common.met(members, every, "digest", "size").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("rep").alias("class_id"), "component", "key")
    empty = members.filter("digest is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("id").alias("class_id"), F.lit(None).cast("binary").alias("component"), "key")
    return named.unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, ee.b FROM r JOIN ee ON r.b = ee.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
