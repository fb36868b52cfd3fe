"""Verification across tables: declared rules, the rows that break them, and a gate for releases."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rule on a table.

    unique: no two rows have the same key, and no part of it is null. refers: the key occurs among the
    columns to of the table of. holds: the condition (SQL) is true for every row. filled: the table has
    least rows or more.
    """

    name: str
    table: str
    kind: str
    key: tuple[str, ...] = ()
    condition: str = ""
    of: str = ""
    to: tuple[str, ...] = field(default=())
    least: int = 0


class VerificationError(ValueError):
    """Rules are broken; counts has the number of violations of each."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("; ".join(f"{name}: {n}" for name, n in sorted(counts.items())))
        self.counts = counts


def _key(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def _shaped(rows: DataFrame, name: Column | str, table: str, key: Column, found: Column) -> DataFrame:
    return rows.select((F.lit(name) if isinstance(name, str) else name).alias("rule"), F.lit(table).alias("table_name"), key.alias("key"), found.cast("long").alias("found"))


def violations(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """rule, table_name, key and found: what breaks the rules.

    All conditions on a table are read in one scan of the columns that they name; unique keys and
    references are aggregated before they are shuffled, and references are anti joins of distinct keys.
    found is the number of rows with the key (of the table, for filled).
    """
    parts, conditions = [], defaultdict(list)
    for rule in rules:
        rows = tables[rule.table]
        if rule.kind == "holds":
            conditions[rule.table, rule.key].append(rule)
        elif rule.kind == "filled":
            parts.append(_shaped(rows.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < rule.least), rule.name, rule.table, F.lit(""), F.col("n")))
        elif rule.kind == "unique":
            null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule.key])
            counted = rows.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | null)
            parts.append(_shaped(counted, rule.name, rule.table, _key(rule.key), F.col("n")))
        elif rule.kind == "refers":
            counted = rows.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n")).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.key]))
            known = tables[rule.of].select(*[F.col(c).alias(f"known_{i}") for i, c in enumerate(rule.to or rule.key)]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"known_{i}") for i, c in enumerate(rule.key)])
            parts.append(_shaped(counted.join(known, same, "left_anti"), rule.name, rule.table, _key(rule.key), F.col("n")))
        else:
            raise ValueError(f"no kind of rule is named {rule.kind}")
    for (table, key), some in conditions.items():
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r.condition), F.lit(False)), r.name) for r in some]))
        rows = tables[table].select(_key(key).alias("key"), F.explode(broken).alias("rule"))
        parts.append(_shaped(rows, F.col("rule"), table, F.col("key"), F.lit(1)))
    return reduce(DataFrame.unionByName, parts)


def gate(broken: DataFrame, allow_partial: bool = False) -> dict[str, int]:
    """Violations of each rule that is broken; an error unless there are none or partial results are allowed."""
    counts = {r["rule"]: r["n"] for r in broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each rule
    if counts and not allow_partial:
        raise VerificationError(counts)
    return counts
