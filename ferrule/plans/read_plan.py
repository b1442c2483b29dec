"""Read plans: a list of dependent reads written as text, turned into one DataFrame graph.

Steps are separated by ``;`` and their fields by ``:``.

    R:table:key...                 the row of a key
    S:table:start...[:E:end...]    rows from start (a prefix, if there is no end) to before end, in key order
    SI:table:index:start...[:E:end...]   the same over a secondary index
    FE:table:binding...            for each distinct source key: its row, or the rows it is a prefix of

followed by ``limit=n`` and ``reverse=1`` where wanted.  A key part is a constant or a binding to an earlier step:
``B<step>.K[.n]`` its n-th key part, ``B<step>.CI<n>[+d|-d]`` its n-th column plus d, and with ``M`` before the K or CI the
same of the step's middle row rather than its first.  Bindings to bytes of packed rows have no meaning over
typed columns and are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.typed import Refused
from ferrule.operators import access

_BINDING = re.compile(r"B(\d+)\.(M?)(K|CI)(?:\.)?(\d*)([+-]\d+)?$")


@dataclass(frozen=True)
class Table:
    """A table with its primary key and its secondary indexes."""

    rows: DataFrame
    key: list[str]
    indexes: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Binding:
    step: int
    middle: bool
    from_key: bool
    column: int
    delta: int


@dataclass
class Step:
    kind: str
    table: str
    index: str = ""
    start: list = field(default_factory=list)
    end: list = field(default_factory=list)
    limit: int | None = None
    reverse: bool = False


def _part(token: str) -> str | Binding:
    if not re.match(r"B\d+\.", token):
        return token
    m = _BINDING.match(token)
    if not m:
        raise Refused(f"binding {token}")
    return Binding(int(m[1]), bool(m[2]), m[3] == "K", int(m[4] or 0), int(m[5] or 0))


def parse(text: str) -> list[Step]:
    steps = []
    for line in filter(None, text.split(";")):
        kind, *tokens = line.split(":")
        if kind not in ("R", "S", "SI", "FE") or not tokens or (kind == "SI" and len(tokens) < 2):
            raise Refused(f"step {line}")
        step = Step(kind, tokens.pop(0), tokens.pop(0) if kind == "SI" else "")
        into = step.start
        for token in filter(None, tokens):
            if token == "E":
                into = step.end
            elif token.startswith("limit="):
                step.limit = int(token[6:]) or None
            elif token.startswith("reverse="):
                step.reverse = token[8:] == "1"
            else:
                into.append(_part(token))
        steps.append(step)
    return steps


def _typed(value: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        value = value.rstrip("tsil") if re.fullmatch(r"-?\d+[tsil]", value) else value
    return F.lit(value).cast(kind)


class ReadPlan:
    """Runs a plan's steps over named tables; each step is a lazy DataFrame."""

    def __init__(self, tables: dict[str, Table]):
        self.tables = tables

    def run(self, text: str) -> list[DataFrame]:
        steps, results = parse(text), []
        for step in steps:
            if step.table not in self.tables:
                raise Refused(f"table {step.table}")
            results.append(self._run(step, steps, results))
        return results

    def _order(self, step: Step) -> list[str]:
        table = self.tables[step.table]
        if not step.index:
            return table.key
        if step.index not in table.indexes:
            raise Refused(f"index {step.index}")
        return table.indexes[step.index]

    def _source(self, b: Binding, steps: list[Step], results: list[DataFrame], name: str) -> tuple[DataFrame, Column]:
        """The bound value of every row of its source, under ``name``."""
        if b.step >= len(results):
            raise Refused(f"a binding to step {b.step}, which comes later")
        rows = results[b.step]
        column = self.tables[steps[b.step].table].key[b.column] if b.from_key else rows.columns[b.column]
        value = F.col(column) + b.delta if b.delta else F.col(column)
        return rows, value.alias(name)

    def _one(self, b: Binding, steps: list[Step], results: list[DataFrame], name: str) -> DataFrame:
        """The bound value of the first or the middle row, as a table of one row or none."""
        rows, value = self._source(b, steps, results, name)
        key = self._order(steps[b.step])
        rows = rows.orderBy(*[F.col(c).desc() if steps[b.step].reverse else F.col(c) for c in key])
        if b.middle:
            rows = rows.offset(max(0, (rows.count() - 1) // 2))
        return rows.limit(1).select(value)

    def _run(self, step: Step, steps: list[Step], results: list[DataFrame]) -> DataFrame:
        table, order = self.tables[step.table], self._order(step)
        rows, columns = table.rows, table.rows.columns
        if step.kind == "FE":
            bound = [(c, p) for c, p in zip(order, step.start) if isinstance(p, Binding)]
            if not bound or len({p.step for _, p in bound}) > 1:
                raise Refused("a for-each step is bound to one earlier step")
            source, _ = self._source(bound[0][1], steps, results, "x")
            keys = source.select(*[self._source(p, steps, results, f"__{c}")[1] for c, p in bound]).distinct()
            fixed = [rows[c] == _typed(p, rows.schema[c].dataType) for c, p in zip(order, step.start) if not isinstance(p, Binding)]
            met = rows.join(keys, reduce(lambda a, b: a & b, [rows[c] == F.col(f"__{c}") for c, _ in bound] + fixed))
            return met.select(*columns)
        for side, parts in (("s", step.start), ("e", step.end)):
            for i, p in enumerate(parts):
                if isinstance(p, Binding):  # one row: the plan's scalar
                    rows = rows.crossJoin(F.broadcast(self._one(p, steps, results, f"__{side}{i}")))
        value = lambda side, i, p, c: F.col(f"__{side}{i}") if isinstance(p, Binding) else _typed(p, table.rows.schema[c].dataType)
        start = [(F.col(c), value("s", i, p, c)) for i, (c, p) in enumerate(zip(order, step.start))]
        end = [(F.col(c), value("e", i, p, c)) for i, (c, p) in enumerate(zip(order, step.end))]
        if step.kind == "R" or not end:
            rows = rows.where(reduce(lambda a, b: a & b, [c == v for c, v in start], F.lit(True)))
        else:
            if start:
                rows = rows.where(_bound(start, up=True))
            rows = rows.where(_bound(end, up=False))
        rows = rows.select(*columns)
        if step.kind == "R" and step.limit is None and not step.reverse:
            return rows
        by = order if not step.index else [*order, *table.key]
        return access.bounded(rows.orderBy(*[F.col(c).desc() if step.reverse else F.col(c) for c in by]), step.limit)


def _bound(parts: list[tuple[Column, Column]], up: bool) -> Column:
    """Column by column: (a, b) >= (x, y), or < if not ``up``."""
    c, v = parts[0]
    if len(parts) == 1:
        return c >= v if up else c < v
    return (c >= v if up else c <= v) & ((c > v if up else c < v) | _bound(parts[1:], up))
