"""Table functions that are called from SQL with a table partitioned and ordered by its columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="conv_id long, turn long, place long, chars_before long, same_role_run long, last_of_role long")
class DialogueState:
    """For each turn what went before it in its conversation.

    Takes ``TABLE (...) PARTITION BY conv_id ORDER BY turn`` with columns ``conv_id, turn, role, text``.  The state, a few numbers and one turn a role, begins
    anew with every conversation; turns stream through it.  Null roles and texts count as empty.
    """

    def __init__(self) -> None:
        self.place, self.chars, self.run, self.role, self.seen = 0, 0, 0, None, {}

    def eval(self, row: Row) -> Iterator[tuple]:
        role, text = row["role"] or "", row["text"] or ""
        self.run = self.run + 1 if role == self.role else 1
        yield row["conv_id"], row["turn"], self.place, self.chars, self.run, self.seen.get(role)
        self.role, self.place, self.chars, self.seen[role] = role, self.place + 1, self.chars + len(text), row["turn"]


@udtf(returnType="conv_id long, turns long, chars long, longest long, roles string")
class DialogueSummary:
    """One row a conversation, when its last turn has been seen: turns, characters, the longest turn, and the order of roles by their first letters."""

    def __init__(self) -> None:
        self.conv, self.turns, self.chars, self.longest, self.roles = None, 0, 0, 0, []

    def eval(self, row: Row) -> None:
        text, role = row["text"] or "", row["role"] or "-"
        self.conv, self.turns, self.chars, self.longest = row["conv_id"], self.turns + 1, self.chars + len(text), max(self.longest, len(text))
        if not self.roles or self.roles[-1] != role[0]:
            self.roles = [*self.roles[-15:], role[0]]

    def terminate(self) -> Iterator[tuple]:
        if self.turns:
            yield self.conv, self.turns, self.chars, self.longest, "".join(self.roles)


def register(spark: SparkSession) -> None:
    spark.udtf.register("dialogue_state", DialogueState)
    spark.udtf.register("dialogue_summary", DialogueSummary)
