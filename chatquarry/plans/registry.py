"""The search tools by name, with the arguments each takes; and the table functions of SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..operators import mentions
from . import tools


@dataclass(frozen=True)
class Argument:
    """A tool's argument: its type, its value where none is given, and the least and greatest value of a number."""

    kind: type
    default: object = None
    least: int | None = None
    most: int | None = None

    def checked(self, name: str, value):
        if value is None:
            return self.default
        if not isinstance(value, self.kind) or isinstance(value, bool) != (self.kind is bool):
            raise ValueError(f"{name}: {self.kind.__name__} expected")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise ValueError(f"{name}: from {self.least} to {self.most}")
        return value


def limit(default: int) -> Argument:
    return Argument(int, default, 1, 500)


TABLE = Argument(DataFrame)
TOOLS: dict[str, tuple[Callable[..., DataFrame], dict[str, Argument]]] = {
    "last_messages": (tools.newest, {"since": Argument(int), "limit": limit(50)}),
    "search_history": (tools.asked, {"question": Argument(str, ""), "vector": Argument(list), "limit": limit(20)}),
    "search_from_person": (tools.asked_of_person, {"chats": TABLE, "members": TABLE, "contacts": TABLE, "name": Argument(str, ""), "question": Argument(str, ""), "vector": Argument(list), "limit": limit(20)}),
    "search_media": (tools.with_media, {"needle": Argument(str, ""), "limit": limit(20)}),
    "search_words": (tools.lexical, {"needle": Argument(str, ""), "limit": limit(20)}),
    "unread": (tools.unread, {"now": Argument(int, 0), "days": Argument(int, 7, 1, 365), "limit": limit(50)}),
}


def call(tool: str, messages: DataFrame, /, **given) -> DataFrame:
    """Runs a tool; unknown tools and arguments, and values out of bounds, raise."""
    if tool not in TOOLS:
        raise ValueError(f"no tool of the name {tool}")
    run, arguments = TOOLS[tool]
    if unknown := set(given) - set(arguments):
        raise ValueError(f"{tool} takes no {', '.join(sorted(unknown))}")
    return run(messages, **{k: a.checked(k, given.get(k)) for k, a in arguments.items()})


@udtf(returnType="kind string, raw string, start int, end int, confidence double, context string")
class Mentions:
    """A row for each mention in a text."""

    def eval(self, text: str):
        yield from mentions.found(text or "")


def register(spark: SparkSession) -> None:
    """Makes `mentions(text)` a table function of SQL, for use with LATERAL."""
    spark.udtf.register("mentions", Mentions)
