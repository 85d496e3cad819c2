"""Table contracts: declared columns, keys and row rules, checked in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """All violations of a table, in one message."""


@dataclass(frozen=True)
class Col:
    """A column: Spark type name, nullability, inclusive range, allowed values, whole-match pattern.

    ``ordered`` gives the values of an ordered category, which sort by place.
    """

    name: str
    type: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    values: Sequence[str] | None = None
    pattern: str | None = None
    ordered: bool = False

    def field(self) -> T.StructField:
        return T.StructField(self.name, T._parse_datatype_string(self.type), self.nullable)

    def faults(self) -> dict[str, Column]:
        """Conditions that hold for rows that break the rules; ranges of doubles tolerate 1e-9."""
        c, slack = F.col(self.name), 1e-9 if self.type in ("double", "float") else 0
        out = {}
        if not self.nullable:
            out["null"] = c.isNull()
        if self.low is not None:
            out[f"below {self.low}"] = c < self.low - slack
        if self.high is not None:
            out[f"above {self.high}"] = c > self.high + slack
        if self.values is not None:
            out["not allowed"] = ~c.isin(list(self.values))
        if self.pattern is not None:
            out["no match"] = ~c.rlike(f"^(?:{self.pattern})$")
        if self.type in ("double", "float"):
            out["nan"] = F.isnan(c)
        return out

    def order(self) -> Column:
        return F.array_position(F.array(*[F.lit(v) for v in self.values or ()]), F.col(self.name)) if self.ordered else F.col(self.name)


@dataclass(frozen=True)
class Contract:
    name: str
    columns: Sequence[Col]
    key: Sequence[str]
    checks: dict[str, str] = field(default_factory=dict)
    extra_allowed: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def coerce(self, df: DataFrame) -> DataFrame:
        """Declared columns cast to their types; a value that can't be cast raises."""
        extra = [c for c in df.columns if c not in {x.name for x in self.columns}] if self.extra_allowed else []
        return df.select(*[F.col(c.name).cast(c.type).alias(c.name) for c in self.columns], *extra)

    def report(self, df: DataFrame) -> DataFrame:
        """``rule, n``: how many rows break each rule, from one aggregation; all declared columns must be there."""
        rules = {f"{c.name}: {k}": f for c in self.columns for k, f in c.faults().items()} | {f"rule {k}": ~F.coalesce(F.expr(e), F.lit(False)) for k, e in self.checks.items()}
        counts = df.agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(f"_{i}") for i, f in enumerate(rules.values())])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"_{i}").alias("n")) for i, k in enumerate(rules)])))

    def violations(self, df: DataFrame) -> list[str]:
        """Every violation with its count: one aggregation over rows, one over keys."""
        found = []
        have = dict(df.dtypes)
        for c in self.columns:
            if c.name not in have:
                found.append(f"{c.name}: missing")
            elif have[c.name] != T._parse_datatype_string(c.type).simpleString():
                found.append(f"{c.name}: {have[c.name]} instead of {c.type}")
        if not self.extra_allowed and (extra := sorted(set(have) - {c.name for c in self.columns})):
            found.append(f"unexpected columns: {', '.join(extra)}")
        known = [c for c in self.columns if c.name in have]
        rules = {f"{c.name}: {k}": f for c in known for k, f in c.faults().items()}
        if all(c.name in have for c in self.columns):
            rules |= {f"rule {k}": ~F.coalesce(F.expr(e), F.lit(False)) for k, e in self.checks.items()}
        if rules:
            row = df.agg(*[F.count_if(f).alias(f"_{i}") for i, f in enumerate(rules.values())]).first()
            found += [f"{k} in {row[i]} rows" for i, k in enumerate(rules) if row[i]]
        if self.key and all(k in have for k in self.key):
            twice = df.groupBy(*self.key).count().filter("count > 1").agg(F.count(F.lit(1))).first()[0]
            if twice:
                found.append(f"key {', '.join(self.key)}: {twice} values repeat")
        return found

    def validate(self, df: DataFrame) -> DataFrame:
        """The declared columns in order, or an error that lists all violations."""
        if found := self.violations(df):
            raise ContractError(f"{self.name}: " + "; ".join(found))
        names = [c.name for c in self.columns]
        return df.select(*names, *[c for c in df.columns if c not in names])
