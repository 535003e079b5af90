"""What a question asks for, and how to search for it. Functions of columns, so that whole logs of questions can be planned."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import any_of

# Kinds of questions in the order in which they are tried, their patterns, and the words that are searched for too.
KINDS = (
    ("assignment", (r"\bчто\s+(?:задал(?:а|и)?|задав(?:ал|ала)?|нужно|надо|делать)\b", r"\bзадание\b", r"\bдомашк(?:а|у|и|ой)\b", r"\bhomework\b", r"\bassign(?:ed)?\b"),
     ("задание", "домашка", "упражнение", "прочитай", "напиши", "решите", "выполни", "параграф", "задача")),
    ("link", (r"\bссылк(?:а|у|и|е|ой)\b", r"\blink\b", r"\bhttps?://\S+", r"\bwww\.", r"\bкинул(?:а)?\s+ссылк"), ("ссылка", "http", "https", "link", "www")),
    ("file", (r"\bфайл\b", r"\bдокумент\b", r"\bpdf\b", r"\bdocx?\b", r"\bприслал(?:а)?\s+файл\b", r"\bкинул(?:а)?\s+файл\b"), ("файл", "документ", "pdf", "doc", "прикрепила", "отправила")),
    ("meeting", (r"\bо\s+ч[её]м\s+говорили\b", r"\bобсуждали\b", r"\bдоговорились\b", r"\bчто\s+решили\b", r"\bчто\s+обсудили\b"), ("встреча", "встретимся", "обсудим", "договорились", "созвон")),
)
# Words by which a question asks for the newest or oldest messages, or for a task.
NEWEST, OLDEST = ("last", "recent", "последн", "останн"), ("first", "beginning", "первы", "початк")
TASK = ("?", "homework", "task", "assignment", "exercise", "завдання", "домашка", "задача", "задание", "зроби", "напиши", "виконай", "прочитай", "please", "write", "read", "send", "check", "надішли", "перевір", "подивись")


def asked(question: Column) -> Column:
    """The question in lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"(?U)\s+", " "))


def words(question: Column) -> Column:
    return F.size(F.filter(F.split(asked(question), " "), lambda w: w != ""))


def kind(question: Column) -> Column:
    """`assignment`, `link`, `file`, `meeting` or `generic`."""
    q, out = asked(question), F.lit("generic")
    for name, patterns, _ in reversed(KINDS):
        out = F.when(q.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)), name).otherwise(out)
    return out


def expanded(question: Column) -> Column:
    """The words of the question's kind and the question: what is searched for."""
    more = F.create_map(*[x for name, _, terms in KINDS for x in (F.lit(name), F.lit(" ".join(terms)))])
    return F.concat_ws(" ", more[kind(question)], asked(question))


def terms(question: Column) -> Column:
    """What a text must contain one of: the words of the question's kind, or of a question of no kind its own."""
    more = F.create_map(*[x for name, _, words_ in KINDS for x in (F.lit(name), F.array(*map(F.lit, words_)))])
    own = F.filter(F.split(F.regexp_replace(asked(question), r"(?U)[^\p{L}\p{N}_ ]", ""), " "), lambda w: w != "")
    return F.coalesce(more[kind(question)], own)


def policy(question: Column, limit: Column) -> Column:
    """struct(mode, limit, window, top_k): questions of a kind search both ways and widely, short ones less so, others by vectors."""
    known, short = kind(question) != "generic", words(question) <= 3
    row = lambda mode, n, top: F.struct(F.lit(mode).alias("mode"), n.cast("int").alias("limit"), F.lit(1).alias("window"), F.lit(top).alias("top_k"))
    return F.when(known, row("hybrid", F.greatest(limit, F.lit(120)), 12)).when(short, row("hybrid", F.greatest(limit, F.lit(80)), 8)).otherwise(row("vector", limit, 8))


def modes(question: Column) -> Column:
    """The ways to search, in order: the newest or oldest messages, both ways for tasks and short questions, else by vectors."""
    q = F.lower(F.coalesce(question, F.lit("")))
    newest, oldest = any_of(q, NEWEST), any_of(q, OLDEST)
    both = any_of(q, TASK) | (words(question) <= 3)
    some = F.filter(F.array(F.when(newest, "select_tail"), F.when(oldest, "select_head"), F.when(both, "hybrid"), F.when(~both & ~newest & ~oldest, "vector")), lambda m: m.isNotNull())
    return some
