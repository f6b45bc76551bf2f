"""Declarative data tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    parent: str | None = None
    parent_column: str | None = None

    @property
    def row_wise(self) -> bool:
        return self.kind in ("not_null", "accepted_values", "accepted_range")


def not_null(*columns: str) -> list[Rule]:
    return [Rule("not_null", (c,)) for c in columns]


def unique(column: str) -> Rule:
    """No value twice; NULLs are not compared."""
    return Rule("unique", (column,))


def unique_combination(*columns: str) -> Rule:
    """No combination twice; NULL counts as a value."""
    return Rule("unique_combination", columns)


def accepted_values(column: str, *values) -> Rule:
    return Rule("accepted_values", (column,), values=values)


def accepted_range(column: str, low: float = 0, high: float = 1) -> Rule:
    """Both ends included."""
    return Rule("accepted_range", (column,), low=low, high=high)


def relationship(column: str, parent: str, parent_column: str) -> Rule:
    """Every value occurs in the parent table."""
    return Rule("relationships", (column,), parent=parent, parent_column=parent_column)


def _breaks(rule: Rule) -> Column:
    """Row condition of a failure. NULL passes every rule but ``not_null``."""
    col = F.col(rule.columns[0])
    if rule.kind == "not_null":
        return col.isNull()
    if rule.kind == "accepted_values":
        return ~col.isin(*rule.values)
    return (col < rule.low) | (col > rule.high)


_NUMBERS = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "date": "date", "boolean": "boolean"}
_KEY = ("first", "second", "texts")


def _kinds(df: DataFrame, columns: Sequence[str]) -> list[str | None]:
    types = dict(df.dtypes)
    return [_NUMBERS.get(types[c]) for c in columns]


def _as_number(column: str, kind: str) -> Column:
    return F.unix_date(column).cast("bigint") if kind == "date" else F.col(column).cast("bigint")


def _key(df: DataFrame, columns: Sequence[str], numbers: bool) -> list[Column]:
    """The values in columns that keys of different types share; -0.0 is 0.0, as in a grouping.

    Up to two whole numbers, days or truth values stay numbers, all else is text.
    """
    if numbers:
        own = [_as_number(c, k) for c, k in zip(columns, _kinds(df, columns), strict=True)]
        return [*own, *[F.lit(None).cast("bigint")] * (2 - len(own)), F.lit(None).cast("array<string>")]
    floats = {name for name, kind in df.dtypes if kind in ("float", "double")}
    texts = F.array(*[(F.col(c) + F.lit(0.0) if c in floats else F.col(c)).cast("string") for c in columns])
    return [*[F.lit(None).cast("bigint")] * 2, texts]


def _numbers(df: DataFrame, rule: Rule, parents: Mapping[str, DataFrame]) -> bool:
    """Whether a rule's keys are numbers, of one kind in the table and the parent."""
    kinds = _kinds(df, rule.columns)
    if rule.kind == "relationships" and kinds != _kinds(parents[rule.parent], [rule.parent_column]):
        return False
    return len(kinds) <= 2 and None not in kinds


def _entry(rule: int, key: Sequence[Column]) -> Column:
    return F.struct(F.lit(rule).alias("rule"), *[c.alias(name) for c, name in zip(key, _KEY, strict=True)])


def _entries(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key) for each row and rule that has to see it; broken row conditions have no key."""
    entries = []
    none = [F.lit(None).cast(kind) for kind in ("bigint", "bigint", "array<string>")]
    for i, rule in enumerate(rules):
        if rule.row_wise:
            entries.append(F.when(_breaks(rule), _entry(i, none)))
            continue
        entry = _entry(i, _key(df, rule.columns, _numbers(df, rule, parents)))
        entries.append(entry if rule.kind == "unique_combination" else F.when(F.col(rule.columns[0]).isNotNull(), entry))
    # filtered after the explode, which stays in generated code
    spread = df.select(F.explode(F.array(*entries)).alias("e")).filter("e is not null")
    return spread.select("e.*", F.lit(1).alias("own"))


def _failures(i: int, rule: Rule) -> Column:
    """Over keys with their number of rows and of parent rows."""
    mine = F.col("rule") == i
    if rule.kind in ("unique", "unique_combination"):  # keys that occur more than once
        count = F.count_if(mine & (F.col("n") > 1))
    elif rule.kind == "relationships":  # rows whose value is missing in the parent
        count = F.sum(F.when(mine & (F.col("known") == 0), F.col("n")))
    else:
        count = F.sum(F.when(mine, F.col("n")))
    return F.coalesce(count, F.lit(0)).cast("bigint").alias(f"r{i}")


def check(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(rule, columns, failures), one row per rule; zero failures is a pass.

    One scan of the table and one exchange by (rule, key) whatever the number of rules. Rows combine before it: a
    value held by many rows and a broken row condition travel once a task. Parents' keys join the same exchange,
    marked, so that a value without a parent is a key without a mark.
    """
    if not rules:
        raise ValueError("no rules given")
    parents = parents or {}
    sides = [_entries(df, rules, parents)]
    for i, rule in enumerate(rules):
        if rule.kind == "relationships":
            parent = parents[rule.parent].filter(F.col(rule.parent_column).isNotNull())
            key = _key(parent, [rule.parent_column], _numbers(df, rule, parents))
            sides.append(parent.select(_entry(i, key).alias("e")).select("e.*", F.lit(0).alias("own")))
    keys = reduce(DataFrame.unionByName, sides).groupBy("rule", *_KEY)
    counted = keys.agg(F.sum("own").alias("n"), F.count_if(F.col("own") == 0).alias("known"))
    whole = counted.agg(*[_failures(i, rule) for i, rule in enumerate(rules)])
    results = [
        F.struct(F.lit(r.kind).alias("rule"), F.lit(",".join(r.columns)).alias("columns"), F.col(f"r{i}").alias("failures"))
        for i, r in enumerate(rules)
    ]
    return whole.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def check_tables(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """All rules of all tables: (table, rule, columns, failures)."""
    parts = [
        check(tables[name], table_rules, tables).select(F.lit(name).alias("table"), "rule", "columns", "failures")
        for name, table_rules in rules.items()
    ]
    return reduce(DataFrame.unionByName, parts)
