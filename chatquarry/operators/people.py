"""Chats, their members and contacts: search by name, display names, listings, entity resolution, contact profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..staging import staged
from . import likeness

NAMED = ("chat_id", "contact_name", "chat_title", "is_private")


def find_chats(chats: DataFrame, members: DataFrame, contacts: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Chats whose title, or a member's name or username, begins like the name asked for in any script.

    queries: asked (string), a table of questions. Gives asked, rank, chat_id, contact_name (the greatest name of the members that
    matched, else the title), chat_title, is_private: private chats first (unknown before them), then by title, titles that lack last.
    Names meet prefixes by their first letters, so questions don't multiply the contacts."""
    asked = queries.select("asked", F.explode(names.prefixes(F.col("asked"))).alias("prefix")).withColumn("size", F.length("prefix"))
    sizes = F.sequence(F.lit(1), F.lit(names.PREFIX))

    def hits(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
        """asked and the key of rows of which a column begins with a prefix."""
        starts = rows.select(key, F.explode(F.array(*[F.lower(F.col(c)) for c in columns])).alias("n")).filter("n is not null")
        starts = starts.select(key, F.explode(sizes).alias("size"), "n").select(key, "size", F.expr("substring(n, 1, size)").alias("prefix")).distinct()
        return starts.join(asked, ["prefix", "size"]).select("asked", key).distinct()

    by_contact = hits(contacts, ["name", "username"], "user_id").join(members, "user_id").select("asked", "chat_id", "user_id")
    by_title = hits(chats, ["title"], "chat_id").join(members, "chat_id", "left").select("asked", "chat_id", "user_id")
    rows = by_contact.unionByName(by_title).distinct().join(contacts.select("user_id", F.coalesce("name", "username").alias("n")), "user_id", "left")
    found = rows.groupBy("asked", "chat_id").agg(F.max("n").alias("n")).join(chats, "chat_id")
    order = Window.partitionBy("asked").orderBy(F.desc_nulls_first("is_private"), F.asc_nulls_last("title"), "chat_id")
    shown = found.select("asked", "chat_id", F.coalesce("n", "title", F.lit("")).alias("contact_name"), F.coalesce("title", F.lit("")).alias("chat_title"), F.coalesce("is_private", F.lit(False)).alias("is_private"), F.row_number().over(order).alias("rank"))
    return shown.filter(F.col("rank") <= limit)


def members_of(members: DataFrame, contacts: DataFrame) -> DataFrame:
    """Members with a name to show; in order of names per chat when sorted by chat and position."""
    joined = members.join(contacts, "user_id").withColumn("display_name", F.coalesce("name", "username", F.lit("Unknown")))
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.asc_nulls_last("name"), "user_id"))
    return joined.select("chat_id", "user_id", "display_name", "username", place.alias("position"))


def resolved(mentions: DataFrame, chats: DataFrame, members: DataFrame, contacts: DataFrame, least: float = 75.0) -> DataFrame:
    """Mentions (text_id, raw, confidence) with the chat they mean: by name, by its lookup spelling, else by the likest name that shares
    the first three letters. `primary_person`: the surest mention of a text, one that was found before others.

    The nominative is the word with a capital: there is no dictionary of word forms."""
    lemma = F.initcap(F.lower(F.col("raw")))
    rows = mentions.withColumn("lemma", lemma).withColumn("spelling", names.lookup_spelling(lemma))
    asked = rows.select(F.explode(F.filter(F.array("lemma", "spelling"), lambda n: n.isNotNull())).alias("asked")).distinct()
    first = find_chats(chats, members, contacts, asked, 1).select("asked", F.col("chat_id").alias("_chat"), F.col("contact_name").alias("_name"))
    one, two = (first.select(F.col("asked").alias(c), F.col("_chat").alias(f"chat_{c}"), F.col("_name").alias(f"name_{c}")) for c in ("lemma", "spelling"))
    rows = rows.join(one, "lemma", "left").join(two, "spelling", "left")
    open_ = rows.filter("chat_lemma is null and chat_spelling is null").select("lemma", F.substring("lemma", 1, 3).alias("asked")).distinct()
    near = open_.join(find_chats(chats, members, contacts, open_.select("asked").distinct(), 50), "asked").withColumn("like", names.likeness(F.col("lemma"), F.col("contact_name"))).filter(F.col("like") >= least)
    best = near.groupBy("lemma").agg(F.max_by(F.struct("chat_id", "contact_name"), F.struct("like", -F.col("rank"))).alias("fuzzy"))
    found = rows.join(best, "lemma", "left")
    how = F.when(F.col("chat_lemma").isNotNull() | F.col("chat_spelling").isNotNull(), "prefix").when(F.col("fuzzy").isNotNull(), "fuzzy")
    found = found.select("text_id", "raw", "lemma", "confidence", F.coalesce("chat_lemma", "chat_spelling", "fuzzy.chat_id").alias("chat_id"), F.coalesce("name_lemma", "name_spelling", "fuzzy.contact_name").alias("display_name"), how.alias("how"))
    surest = Window.partitionBy("text_id").orderBy(F.col("chat_id").isNull(), F.desc("confidence"), "raw")
    return found.withColumn("primary_person", F.row_number().over(surest) == 1)


#: Names with one trigram that a task compares, and pairs of names up to which all that share half of the trigrams are scored.
POSTED, FEW = 2048, 20_000_000
#: Names that share the most marks with one asked for, whose likeness sets the bound for all others.
SEEDS = 32


def likest(asked: DataFrame, named: DataFrame, least: float = 75.0, n: int = 1) -> DataFrame:
    """asked, id, score, rank: the n likest names (id, name) of each name asked for (asked) by weighted likeness, from `least` on, among those
    that share at least half of its trigrams.

    Of many names, those that share the most marks are scored first; the nth likest of them is a bound, and of all names only those are
    scored whose marks allow as much (`likeness.near`). Few names, and names asked for of which half of the trigrams may lie between
    words, meet by their trigrams."""
    theirs = names.trigrams(F.col("asked"))
    wanted = asked.select("asked").distinct().select(F.monotonically_increasing_id().alias("q"), "asked", names.parts(F.col("asked")).alias("a"), theirs.alias("theirs"), F.ceil(F.size(theirs) / 2).alias("need")).filter(F.size("theirs") > 0)
    # the columns of names are made on all cores, however few files hold them
    grams = named.repartition(named.sparkSession.sparkContext.defaultParallelism).select(F.monotonically_increasing_id().alias("no"), "id", names.parts(F.col("name")).alias("b"), names.trigrams(F.col("name")).alias("own"))
    wanted, grams = staged(wanted), staged(grams)
    if wanted.count() * grams.count() <= FEW:
        scored = [by_trigrams(wanted, grams).filter(F.col("score") >= least)]
    else:
        scored = by_marks(wanted, grams, least, n)
    together = reduce(DataFrame.unionByName, [x.select("asked", "id", "score") for x in scored])
    ranked = together.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= n)


def by_marks(wanted: DataFrame, grams: DataFrame, least: float, n: int) -> list[DataFrame]:
    """Scored pairs from `least` on, among them the n likest of each name asked for."""
    own = likeness.marks(F.col("a.words"))
    between = F.size(F.array_except("theirs", own))
    wanted = staged(wanted.select("*", F.length("a.low").alias("size"), *likeness.marked(own), (F.col("need") - between).cast("int").alias("base")))
    named = staged(grams.filter(F.size("own") > 0).select("no", F.length("b.low").alias("size"), *likeness.marked(likeness.marks(F.col("b.words")))))
    odd, left = wanted.filter("base <= 0"), wanted.filter("base > 0")
    kept = ["q", "size", "n_marks", "marks", "base"]

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(left.select("q", "asked", "a", "theirs", "need"), "q").join(grams, "no").filter(F.size(F.array_intersect("own", "theirs")) >= F.col("need"))
        return met.select("q", "asked", "id", score_of_pair().alias("score")).filter(F.col("score") >= least)

    most = Window.partitionBy("q").orderBy(F.desc("shared"), "no")
    seeds = likeness.near(left.select(*kept, F.lit(None).cast("double").alias("least")), named).withColumn("place", F.row_number().over(most)).filter(F.col("place") <= max(SEEDS, 2 * n))
    nth = scored(seeds).groupBy("q").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), n - 1).alias("nth"))
    bound = staged(left.join(nth, "q", "left").select(*kept, F.greatest(F.lit(float(least)), "nth").alias("least")))
    return [by_trigrams(odd, grams).filter(F.col("score") >= least), scored(likeness.near(bound, named))]


def score_of_pair() -> Column:
    return F.round(names.likeness_of_parts(F.col("a"), F.col("b")), 4)


def by_trigrams(wanted: DataFrame, grams: DataFrame) -> DataFrame:
    """asked, id, score of all pairs that share at least half of the trigrams of the name asked for.

    Names that do so share one of its rarest: of g trigrams the g - ceil(g / 2) + 1 rarest are looked up, so common ones match nobody.
    Two names are compared where they meet by the first of these that they share, and there alone, so pairs aren't shuffled; the names
    of a common trigram are dealt into blocks."""
    counts = grams.select(F.explode("own").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    each = wanted.select("asked", (F.size("theirs") - F.col("need") + 1).alias("most"), F.explode("theirs").alias("gram")).join(counts, "gram", "left")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    rare = staged(each.withColumn("place", place).filter(F.col("place") <= F.col("most")).filter("n is not null").withColumn("blocks", F.ceil(F.col("n") / POSTED).cast("int")).select("asked", "gram", "place", "blocks"))
    firsts = rare.groupBy("asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("rarest"))
    lookups = rare.join(wanted.join(firsts, "asked"), "asked").select("asked", "a", "theirs", "need", "rarest", "gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    posted = grams.select("*", F.explode("own").alias("gram")).join(rare.select("gram", "blocks").distinct(), "gram").select("id", "b", "own", "gram", dealt)
    key = ["gram", "block"]
    pairs = lookups.repartition(*key).join(posted.repartition(*key), key)
    pairs = pairs.filter((F.array_intersect("rarest", "own")[0] == F.col("gram")) & (F.size(F.array_intersect("own", "theirs")) >= F.col("need")))
    return pairs.select("asked", "id", score_of_pair().alias("score"))


def most_common(rows: DataFrame, keys: list[str], label: str, n: int) -> DataFrame:
    """The n commonest labels of each key, with their counts and ranks; of equal counts the first by name."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), label))).filter(F.col("rank") <= n)


def contact_profiles(contacts: DataFrame, segments: DataFrame, top: int = 8) -> DataFrame:
    """A profile of each contact (contact_id, display_name) from the segments that name it, by id or name.

    segments: segment_id, people (array of struct(source_id, display_name)), topics and interests (arrays of strings),
    relations (array of struct(from_person, to_person, relation_type, weight)). Without segments: confidence 0.2, relation `unknown`."""
    people = segments.select("segment_id", F.explode("people").alias("p")).select("segment_id", "p.source_id", "p.display_name")
    by_id = people.join(contacts, people.source_id == contacts.contact_id).select("segment_id", "contact_id", contacts.display_name)
    by_name = people.join(contacts, people.display_name == contacts.display_name).select("segment_id", "contact_id", contacts.display_name)
    seen = by_id.unionByName(by_name).distinct().join(segments.drop("people"), "segment_id")

    def list_of(column: str) -> DataFrame:
        best = most_common(seen.select("contact_id", F.explode(column).alias("label")), ["contact_id"], "label", top)
        return best.groupBy("contact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias(column))

    signals = seen.select("contact_id", "display_name", F.explode("relations").alias("r")).filter("display_name in (r.from_person, r.to_person)")
    votes = signals.groupBy("contact_id", "r.relation_type").agg(F.sum("r.weight").alias("w"))
    relation = votes.groupBy("contact_id").agg(F.min_by("relation_type", F.struct(-F.col("w"), F.col("relation_type"))).alias("relation"))
    rows = contacts.join(list_of("topics"), "contact_id", "left").join(list_of("interests"), "contact_id", "left").join(relation, "contact_id", "left")
    none = F.array().cast("array<string>")
    topics, interests = F.coalesce("topics", none), F.coalesce("interests", none)
    part = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(F.slice(x, 1, 5), ", "), F.lit(".")))
    told = F.concat_ws(" ", part("Теми спілкування: ", topics), part("Інтереси: ", interests))
    return rows.select("contact_id", "display_name", F.when(told == "", "Недостатньо даних для профілю.").otherwise(told).alias("description"), topics.alias("topics"), interests.alias("interests"), F.coalesce("relation", F.lit("unknown")).alias("relation"), F.when((F.size(topics) > 0) | (F.size(interests) > 0), 0.6).otherwise(0.2).alias("confidence"))
