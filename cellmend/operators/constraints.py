"""Denial constraints: a small language, and conditions made of it.

A line is parts joined by '&'; EQ(t1.A,t2.B) and IQ(t1.A,t2.B) are predicates, t1 and t2 alone declare tuples. A constraint's id is its
line number; blank lines and '#' lines count. An operand without an attribute and an unknown predicate are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cellmend.operators.cells import quoted

_CALL = re.compile(r"^(\w+)\((.*)\)$")


@dataclass(frozen=True)
class Predicate:
    """EQ or IQ of the first tuple's attribute `left` and the second's `right`."""

    op: str
    left: str
    right: str

    def holds(self, first: Column, second: Column) -> Column:
        """Three-valued: unknown where a value is missing, and so no violation."""
        return first == second if self.op == "EQ" else first != second


@dataclass(frozen=True)
class Constraint:
    id: int
    predicates: tuple[Predicate, ...]

    @property
    def equal(self) -> list[Predicate]:
        return [p for p in self.predicates if p.op == "EQ"]

    @property
    def unequal(self) -> list[Predicate]:
        return [p for p in self.predicates if p.op == "IQ"]

    @property
    def symmetric(self) -> bool:
        return all(p.left == p.right for p in self.predicates)

    @property
    def attributes(self) -> list[str]:
        return sorted({a for p in self.predicates for a in (p.left, p.right)})

    @property
    def fd(self) -> tuple[str, str] | None:
        """(key, target) if the constraint is a functional dependency of one attribute on one."""
        if len(self.equal) == len(self.unequal) == 1 and self.symmetric:
            return self.equal[0].left, self.unequal[0].left
        return None

    @property
    def block_form(self) -> tuple[list[str], str] | None:
        """(keys, target) if counts per block decide it: equal keys and one unequal attribute, the same on both sides."""
        if self.equal and len(self.unequal) == 1 and self.symmetric:
            return sorted({p.left for p in self.equal}), self.unequal[0].left
        return None

    def condition(self, first: str, second: str) -> Column:
        """All predicates, between two aliased tables."""
        return reduce(and_, [p.holds(F.col(f"{first}.`{p.left}`"), F.col(f"{second}.`{p.right}`")) for p in self.predicates], F.lit(True))


def _operand(text: str, line: int) -> str:
    name, dot, attr = text.strip().partition(".")
    if not dot or not attr or not name:
        raise ValueError(f"line {line}: {text.strip()!r} is no attribute of a tuple")
    return attr.split(".")[0].strip()


def parse(text: str) -> list[Constraint]:
    out = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        found = []
        for part in (p.strip() for p in line.split("&")):
            m = _CALL.match(part)
            if m is None:
                if not re.fullmatch(r"\w+", part):
                    raise ValueError(f"line {number}: {part!r} is neither a tuple nor a predicate")
                continue
            sides = m[2].split(",")
            if m[1] not in ("EQ", "IQ") or len(sides) != 2:
                raise ValueError(f"line {number}: unknown predicate {part!r}")
            found.append(Predicate(m[1], _operand(sides[0], number), _operand(sides[1], number)))
        out.append(Constraint(number, tuple(found)))
    return out


def read(spark: SparkSession, path: str) -> list[Constraint]:
    """Constraints of a small text file, wherever Spark can read it."""
    rows = spark.read.text(path, wholetext=True).collect()
    return parse("\n".join(r.value for r in rows))


__all__ = ["Constraint", "Predicate", "parse", "quoted", "read"]
