"""Secret scan: three base patterns, and strings of high local entropy. DataFrame functions only.

Entropy spans: candidate strings are unbroken runs of one character class; a window of WINDOW characters slides over each, its Shannon
entropy kept up to date from the counts of the one character that comes and the one that goes. A candidate whose best window
reaches the class's threshold is a finding, unless an allow-list rule takes it for something harmless. Base spans are cut out of a
candidate first, then placeholders; each part left of WINDOW characters or more is a candidate of its own. Other rules hold for whole parts.
Spans are kind:start:end in code points of the whole text, the end exclusive; kinds sort as assign, access, hex, entropy.

Defined cases: a null text counts as empty and has no spans (the digest of an empty string); rows may repeat; an empty table gives no
rows; columns other than the id and the text are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Equal to the maximal runs of HEX with 32 characters at least: a run is taken whole or not at all.
HEX_LONG = r"[0-9a-f]{32,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"

WINDOW = 20
#: Matches whose spans are gathered at a time.
CHUNK = 256
#: Candidates by class: (name, pattern, alphabet, bits). Base64 and identifiers must mix letters with digits.
CLASSES = (
    ("base64", r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
    ("hexadecimal", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 3.0),
)
#: Harmless as a whole: UUIDs, dates and times, dotted or slashed names, plain words joined by - or _.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9:_T+-]*$",
    r"^[A-Za-z]+([-_/+=][A-Za-z]+)*[-_/+=]*$",
    r"^[-_/+=A-Za-z]*[0-9]{0,4}$",
)
#: Placeholders, which are cut out: what joins them to the rest of a run isn't part of either.
PLACEHOLDER = r"(?i)[-_/+=]*(?:example|placeholder|x{4,}|0123456789|abcdefghij)[-_/+=]*"


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often `use` names it, inside inner functions too."""
    return F.transform(F.array(value), use)[0]


def in_chunks(steps: Column, empty: Column, start: Column, advance, parts) -> Column:
    """The parts that `parts(chunk, at)` gives for chunks of CHUNK steps in turn, `at` being `start`, moved on by `advance(at, chunk)` for
    each chunk before; so appending to a list costs no more in a text of many matches."""
    cut = lambda st: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(st) - 1, F.lit(0)) / CHUNK).cast("int")), lambda i: F.slice(st, i * CHUNK + 1, CHUNK))
    zero = F.struct(start.alias("at"), F.array(empty).alias("parts"))
    step = lambda acc, chunk: F.struct(advance(acc["at"], chunk).alias("at"), F.concat(acc["parts"], F.array(parts(chunk, acc["at"]))).alias("parts"))
    return bound(steps, lambda st: F.aggregate(cut(st), zero, step, lambda acc: F.flatten(acc["parts"])))


def lengths(length):
    """Moves on by the lengths of a chunk's steps."""
    return lambda at, chunk: F.aggregate(chunk, at, lambda n, s: n + length(s))


def found(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches, as an array of struct(start, kind, end, value); matches whose group is shorter than least go.

    Matches and the stretches between them alternate, so their lengths add up to positions."""
    p = F.lit(pattern)
    whole, part, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))), part, lambda s, v: F.struct(s["gap"].alias("gap"), s["m"].alias("m"), v.alias("v")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())

    def spans(chunk: Column, at: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            end = start + F.length(s["m"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["m"].alias("value"))
            return F.struct(end.alias("at"), F.when(F.length(s["v"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(chunk, F.struct(at.alias("at"), none().alias("spans")), step, lambda acc: acc["spans"])

    return in_chunks(steps, none(), F.lit(0), lengths(lambda s: s["gap"] + F.length(s["m"])), spans)


NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


def none() -> Column:
    return F.array().cast(NONE)


def best_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of a window of the string, from incremental counts.

    H = log2 w - (sum of c log2 c) / w; a character that comes or goes changes one term of the sum. The string is split into codes once;
    each step gets the code that comes and the one that went in a window ago (0: none), so the time is linear in the length."""
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)
    places = F.create_map(*[F.lit(x) for i, c in enumerate(alphabet) for x in (c, i + 1)])
    codes = F.transform(F.filter(F.split(value, "", -1), lambda c: c != ""), lambda c: F.coalesce(places[c], F.lit(len(alphabet) + 1)))
    steps = bound(codes, lambda x: F.zip_with(x, F.slice(F.concat(F.array_repeat(F.lit(0), window), x), 1, F.size(x)), lambda j, gone: F.struct(j.alias("j"), gone.alias("gone"))))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(float("inf")).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        j, gone = x["j"], x["gone"]
        c = F.element_at(acc["n"], j)
        n = F.transform(acc["n"], lambda v, k: v + F.when(k + 1 == j, 1).otherwise(0) - F.when(k + 1 == gone, 1).otherwise(0))
        d = F.when(gone > 0, F.element_at(acc["n"], F.greatest(gone, F.lit(1))) + F.when(gone == j, 1).otherwise(0)).otherwise(1)
        s = acc["s"] + term(c + 1) - term(c) + F.when(gone > 0, term(d - 1) - term(d)).otherwise(0.0)
        i = acc["i"] + 1
        return bound(s, lambda v: F.struct(n.alias("n"), v.alias("s"), i.alias("i"), F.when(i >= window, F.least(acc["best"], v)).otherwise(acc["best"]).alias("best")))

    lowest = F.aggregate(steps, zero, step, lambda acc: acc["best"])
    return F.log2(F.lit(float(window))) - lowest / window


def overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))


def without(s: Column, others: Column) -> Column:
    """The parts of a span that no span of the others (sorted by start) covers."""
    met = F.filter(others, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    part = lambda start, end: F.struct(start.alias("start"), s["kind"].alias("kind"), end.alias("end"), F.substr(s["value"], start - s["start"] + 1, F.greatest(end - start, F.lit(0))).alias("value"))
    zero = F.struct(s["start"].alias("at"), none().alias("parts"))

    def step(acc: Column, t: Column) -> Column:
        return F.struct(F.greatest(acc["at"], t["end"]).alias("at"), F.when(t["start"] > acc["at"], F.concat(acc["parts"], F.array(part(acc["at"], t["start"])))).otherwise(acc["parts"]).alias("parts"))

    cut = F.aggregate(met, zero, step, lambda acc: F.when(acc["at"] < s["end"], F.concat(acc["parts"], F.array(part(acc["at"], s["end"])))).otherwise(acc["parts"]))
    return F.when(F.size(met) > 0, cut).otherwise(F.array(s))


def without_placeholders(s: Column) -> Column:
    """The parts of a span between placeholders."""
    # matches and the stretches between them alternate, so their lengths add up to positions
    whole = F.regexp_extract_all(s["value"], F.lit(PLACEHOLDER), F.lit(0))
    steps = F.zip_with(F.split(s["value"], PLACEHOLDER, -1), whole, lambda g, m: F.struct(g.alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))

    def parts(chunk: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x["g"])
            one = F.struct(acc["at"].alias("start"), s["kind"].alias("kind"), end.alias("end"), x["g"].alias("value"))
            return F.struct((end + x["m"]).alias("at"), F.concat(acc["parts"], F.array(one)).alias("parts"))

        return F.aggregate(chunk, F.struct(at.alias("at"), none().alias("parts")), step, lambda acc: acc["parts"])

    return F.when(s["value"].rlike(PLACEHOLDER), in_chunks(steps, none(), s["start"], lengths(lambda x: F.length(x["g"]) + x["m"]), parts)).otherwise(F.array(s))


def class_spans(text: str, others: Column, pattern: str, alphabet: str, bits: float) -> Column:
    """One class's candidates, without what the others (sorted) cover and without placeholders, that have WINDOW characters, mix
    letters with digits, pass the allow-list and reach the entropy."""
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    long_enough = lambda s: F.length(s["value"]) >= WINDOW

    def keep(s: Column) -> Column:
        v = s["value"]
        return F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(allowed), best_entropy(v, alphabet) >= bits).otherwise(False)

    mixed = F.filter(found(text, pattern, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    apart = F.filter(F.flatten(F.transform(mixed, lambda s: without(s, others))), long_enough)
    return F.filter(F.filter(F.flatten(F.transform(apart, without_placeholders)), long_enough), keep)


def entropy_spans(text: str, base: Column) -> Column:
    one = class_spans(text, base, *CLASSES[0][1:])
    two = class_spans(text, base, *CLASSES[1][1:])
    return F.concat(one, F.filter(two, lambda s: ~overlaps(s, one)))


def scanned(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The table with `{prefix}base` and `{prefix}all`: arrays of struct(start, kind, end, value), sorted. No shuffle.

    Cheap tests for a literal or a pattern come first; positions are worked out for the few texts that pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = f"{prefix}scanned_text"
    rows = docs.withColumn(t, text)
    low = F.lower(F.col(t))
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key") | low.contains("ſ") | low.contains("K")
    assign = F.when(word, found(t, ASSIGN, 0, 2, 8)).otherwise(none())
    access = F.when(F.col(t).contains("AKIA"), found(t, ACCESS_LONG, 1)).otherwise(none())
    hexed = F.when(F.col(t).rlike(HEX_LONG), found(t, HEX_LONG, 2)).otherwise(none())
    rows = rows.withColumn(f"{prefix}base", F.array_sort(F.concat(assign, access, hexed)))
    base = F.col(f"{prefix}base")
    # a finding has 20 characters in a row, letters and digits among them
    likely = F.col(t).rlike(r"[A-Za-z+/_=-][0-9]|[0-9][A-Za-z+/_=-]") & F.col(t).rlike(r"[A-Za-z0-9+/_=-]{20}")
    return rows.withColumn(f"{prefix}all", F.when(likely, F.array_sort(F.concat(base, entropy_spans(t, base)))).otherwise(base)).drop(t)


KINDS = ("assign", "access", "hex", "entropy")


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The table with the spans found in a text replaced by a mark; overlapping spans by one. Null texts stay null."""
    own = common.free_prefix(docs)
    rows = scanned(docs, text_col, own)
    text, spans = F.col(text_col), F.col(f"{own}all")
    texts = F.array().cast("array<string>")

    def pieces(chunk: Column, at: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            before = F.concat(F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(before))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), texts.alias("out")), step, lambda acc: acc["out"])

    head = F.array_join(in_chunks(spans, texts, F.lit(0), lambda at, chunk: F.aggregate(chunk, at, lambda n, s: F.greatest(n, s["end"])), pieces), "")
    tail = F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, F.concat(head, tail)).otherwise(text)).select(*docs.columns)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    rows = scanned(common.id_and_text(docs, id_col, text_col))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_entropy"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
