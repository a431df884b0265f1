"""INSERT, UPDATE, DELETE and MERGE as DataFrames: what becomes of each row of a table.

Each function gives the rows that a statement looks at, with the table's columns as they become, and ACTION (INSERT,
UPDATE, DELETE, or null where the statement leaves a row alone), STAYS (whether the row is in the table afterwards) and
OLD (the row as it was, null for one that is new). Nothing runs here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.results import quoted

ACTION, STAYS, OLD = "__action", "__stays", "__old"
ROW, STEP, NEXT, NTH = "__row", "__step", "__next", "__nth"


def image(table: DataFrame, prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + quoted(c)).alias(c) for c in table.columns))


def nothing(table: DataFrame) -> Column:
    return F.lit(None).cast(table.schema)


def told(rows: DataFrame, table: DataFrame, action: Column, stays: Column, old: Column, new: Mapping[str, Column]) -> DataFrame:
    return rows.select(*(new[c].alias(c) for c in table.columns), action.alias(ACTION), stays.alias(STAYS), old.alias(OLD))


def insert(table: DataFrame, new: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of new, whose columns go to those named, in order; other columns are null."""
    by_name = dict(zip([c.lower() for c in columns or table.columns], new.columns))
    values = {f.name: (F.col(quoted(by_name[f.name.lower()])) if f.name.lower() in by_name else F.lit(None)).cast(f.dataType) for f in table.schema.fields}
    return told(new, table, F.lit("INSERT"), F.lit(True), nothing(table), values)


def update(table: DataFrame, condition: Column, new: Mapping[str, Column]) -> DataFrame:
    """Rows that the condition is true for get new values (names in lower case)."""
    hit = F.coalesce(condition, F.lit(False))
    values = {f.name: F.when(hit, new[f.name.lower()].cast(f.dataType)).otherwise(F.col(quoted(f.name))) if f.name.lower() in new else F.col(quoted(f.name)) for f in table.schema.fields}
    return told(table, table, F.when(hit, "UPDATE"), F.lit(True), image(table), values)


def delete(table: DataFrame, condition: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return told(table, table, F.when(hit, "DELETE"), ~hit, image(table), {c: F.col(quoted(c)) for c in table.columns})


@dataclass(frozen=True)
class Clause:
    """One WHEN of a MERGE. action: UPDATE, DELETE or INSERT; when: its further condition; values: what columns become, by
    name in lower case, None for the source's columns of the same names."""

    action: str
    when: Column | None = None
    values: Mapping[str, Column] | None = None


def merge(table: DataFrame, source: DataFrame, on: Column, matched: list[Clause], missing: list[Clause], by_source: list[Clause], names: tuple[str, str] = ("target", "source"), keys: tuple[str, ...] = ()) -> DataFrame:
    """MERGE of source into table: matched, missing (NOT MATCHED) and by_source (NOT MATCHED BY SOURCE) clauses, of each
    the first whose condition holds. Conditions and values name columns by the aliases ``names``.

    A row of the table comes out once, however many rows of the source match it: as the clause makes it that takes one
    of these pairs, unchanged if none does; if clauses take several, the statement fails. Each row of the source that
    matches nothing is inserted, repeated ones too.

    Three joins, united: the pairs, which alone pass a window; the table's rows without a match; the source's rows
    without one. A small source is sent to the tasks, and then nothing but the pairs is shuffled. keys: columns of the
    table that ``on`` compares for equality; pairs are already dealt out by these where the join shuffled them. source is
    read up to three times, so it must be the same each time: write it out first if it isn't a table.
    """
    mine, theirs = names
    target, incoming = table.alias(mine), source.alias(theirs)
    prefix = quoted(mine) + "."

    def step_of(clauses: list[Clause]) -> Column:
        step = F.when(F.lit(False), 0)
        for k, c in enumerate(clauses):
            step = step.when(F.coalesce(c.when, F.lit(False)) if c.when is not None else F.lit(True), k)
        return step

    def become(clauses: list[Clause], was: bool) -> dict[str, Column]:
        out = {}
        for f in table.schema.fields:
            before = F.col(prefix + quoted(f.name)) if was else F.lit(None).cast(f.dataType)
            value = F.when(F.lit(False), before)
            for k, c in enumerate(clauses):
                if c.action != "DELETE":
                    new = F.col(f"{quoted(theirs)}.{quoted(f.name)}") if c.values is None else c.values.get(f.name.lower())
                    value = value.when(F.col(STEP) == k, before if new is None else new.cast(f.dataType))
            out[f.name] = value.otherwise(before)
        return out

    def out(rows: DataFrame, clauses: list[Clause], was: bool) -> DataFrame:
        action = F.when(F.lit(False), "")
        for k, c in enumerate(clauses):
            action = action.when(F.col(STEP) == k, c.action)
        gone = [k for k, c in enumerate(clauses) if c.action == "DELETE"]
        stays = F.coalesce(~F.col(STEP).isin(gone), F.lit(True)) if gone else F.lit(True)
        return told(rows, table, action, stays, image(table, prefix) if was else nothing(table), become(clauses, was))

    parts = []
    if matched:
        window = Window.partitionBy(*(prefix + quoted(k) for k in keys), ROW).orderBy(F.col(STEP).asc_nulls_last())
        pairs = table.withColumn(ROW, F.monotonically_increasing_id()).alias(mine).join(incoming, on).withColumn(STEP, step_of(matched))
        pairs = pairs.withColumn(NTH, F.row_number().over(window)).withColumn(NEXT, F.lead(STEP).over(window)).where(F.col(NTH) == 1)
        refusal = F.raise_error(F.lit("The MERGE statement attempted to UPDATE or DELETE the same row more than once.")).cast("int")
        parts.append(out(pairs.withColumn(STEP, F.when(F.col(NEXT).isNotNull(), refusal).otherwise(F.col(STEP))), matched, True))
    elif by_source:
        parts.append(out(target.join(incoming, on, "left_semi").withColumn(STEP, step_of([])), [], True))
    rest = target.join(incoming, on, "left_anti") if matched or by_source else target
    parts.append(out(rest.withColumn(STEP, step_of(by_source)), by_source, True))
    if missing:
        alone = incoming.join(target, on, "left_anti").withColumn(STEP, step_of(missing)).where(F.col(STEP).isNotNull())
        parts.append(out(alone, missing, False))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@dataclass
class Change:
    """A statement, ready to run: the table's name and columns, what becomes of the rows it looks at, whether it only
    adds rows, and the version of the table that it was made for (None: the one shown when it runs)."""

    table: str
    columns: list[str]
    taken: DataFrame
    append: bool = False
    version: int | None = None

    @property
    def rows(self) -> DataFrame:
        """The table's new rows; those that are added, where it only grows."""
        return self.taken.where(STAYS).select(*map(quoted, self.columns))

    @property
    def affected(self) -> DataFrame:
        """One row: how many rows the statement touches."""
        return self.taken.agg(F.count(ACTION).alias("rows_affected"))

    def images(self, *more: str) -> DataFrame:
        """(inserted, deleted, __action, ...) of each row that the statement touches: the row as it becomes and as it was,
        null where there is none."""
        now = F.struct(*map(F.col, map(quoted, self.columns)))
        touched = self.taken.where(F.col(ACTION).isNotNull())
        return touched.select(F.when(F.col(ACTION) != "DELETE", now).alias("inserted"), F.col(OLD).alias("deleted"), ACTION, *more)


Keep = Callable[[DataFrame], DataFrame]
