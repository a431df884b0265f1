"""Written statements: what Spark's parser makes of them, as changes of DataFrames, and the versions of tables they make."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.operators import changes
from sluice.operators.changes import ACTION, OLD, STAYS, Change, Clause, Keep
from sluice.operators.results import PLACE
from sluice.plans.guard import GuardError

#: Where a version's rows are, and the rows that a statement touched, in the folder of its run.
NOW, TOUCHED = "now", "touched"


def frame(spark: SparkSession, plan: JavaObject) -> DataFrame:
    """The DataFrame of a parsed plan."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def items(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(k) for k in range(seq.size())]


def kind_of(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def named(node: JavaObject) -> tuple[str, str | None]:
    """(table, alias) of a statement's target."""
    alias = None
    while kind_of(node) == "SubqueryAlias":
        alias, node = node.identifier().name(), node.child()
    if kind_of(node) != "UnresolvedRelation":
        raise GuardError(f"A write needs a table by name, not {kind_of(node)}.")
    return node.multipartIdentifier().last(), alias


def text_of(expression: JavaObject) -> str:
    return expression.sql()


def assignments(seq: JavaObject) -> dict[str, str]:
    return {a.key().name().split(".")[-1].strip("`"): text_of(a.value()) for a in items(seq)}


def insert(spark: SparkSession, node: JavaObject) -> Change:
    table, _ = named(node.table())
    target, new = spark.table(table), frame(spark, node.query())
    columns = items(node.userSpecifiedCols()) or target.columns
    if len(columns) != len(new.columns):
        raise GuardError(f"INSERT names {len(columns)} columns and gives {len(new.columns)}.")
    return Change(table, target.columns, changes.insert(target, new, columns), append=True)


def update(spark: SparkSession, node: JavaObject) -> Change:
    table, alias = named(node.table())
    target = spark.table(table).alias(alias or table)
    new = {k.lower(): F.expr(v) for k, v in assignments(node.assignments()).items()}
    if unknown := set(new) - {c.lower() for c in target.columns}:
        raise GuardError(f"{table} has no column {', '.join(sorted(unknown))}.")
    condition = F.expr(text_of(node.condition().get())) if node.condition().isDefined() else F.lit(True)
    return Change(table, target.columns, changes.update(target, condition, new))


def delete(spark: SparkSession, node: JavaObject) -> Change:
    table, alias = named(node.table())
    target = spark.table(table).alias(alias or table)
    return Change(table, target.columns, changes.delete(target, F.expr(text_of(node.condition()))))


def merge(spark: SparkSession, node: JavaObject, keep: Keep) -> Change:
    table, alias = named(node.targetTable())
    target, source, name = spark.table(table), node.sourceTable(), None
    if kind_of(source) == "SubqueryAlias":
        name, source = source.identifier().name(), source.child()
    elif kind_of(source) == "UnresolvedRelation":
        name = source.multipartIdentifier().last()

    def clause(action: JavaObject) -> Clause:
        kind = next(k for k in ("UPDATE", "DELETE", "INSERT") if kind_of(action).upper().startswith(k))
        when: Column | None = F.expr(text_of(action.condition().get())) if action.condition().isDefined() else None
        star = "Star" in kind_of(action)
        values = None if star else {} if kind == "DELETE" else {k.lower(): F.expr(v) for k, v in assignments(action.assignments()).items()}
        return Clause(kind, when, values)

    on = text_of(node.mergeCondition())
    keys = tuple(c for c in target.columns if re.search(rf"(?i)(?<!\w){re.escape(c)}(?!\w)", on))
    clauses = ([clause(a) for a in items(seq)] for seq in (node.matchedActions(), node.notMatchedActions(), node.notMatchedBySourceActions()))
    return Change(table, target.columns, changes.merge(target, keep(frame(spark, source)), F.expr(on), *clauses, (alias or table, name or "source"), keys))


def change(spark: SparkSession, node: JavaObject, keep: Keep = lambda df: df) -> Change:
    """keep: writes a MERGE's source out, so that it is evaluated once."""
    if kind_of(node) == "MergeIntoTable":
        return merge(spark, node, keep)
    return {"InsertIntoStatement": insert, "UpdateTable": update, "DeleteFromTable": delete}[kind_of(node)](spark, node)


class LostUpdate(RuntimeError):
    """Another writer changed the table meanwhile."""


@dataclass
class Store:
    """Where a target's tables live: the view of each reads its current version, which a write replaces as a whole.

    folder: for each table ``<table>/log/<n>.json`` names the paths of its version n. A version is made by one writer
    alone (see storage.take_place), so of two that began at the same version the later fails; other sessions and later
    processes that are given the folder see the newest version once they refresh() it. An entry without content, as
    a writer of another make may leave it, takes its place and changes nothing.
    """

    spark: SparkSession
    folder: str
    paths: dict[str, list[str]] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)

    def open(self, name: str, path: str) -> None:
        """Shows the newest version of a table, or, before any write, what is at its path."""
        self.paths.setdefault(name.lower(), [path])
        self.spark.read.parquet(path).createOrReplaceTempView(name)
        self.refresh(name)

    def refresh(self, name: str) -> None:
        if not self.folder:
            return
        found = storage.places(self.spark, f"{self.folder}/{name.lower()}/log")
        newest = int(found[-1].split(".")[0]) if found else 0
        if newest == self.versions.get(name.lower(), 0):
            return
        for entry in reversed(found):
            if int(entry.split(".")[0]) <= self.versions.get(name.lower(), 0):
                break
            row = self.spark.read.schema("paths array<string>").json(f"{self.folder}/{name.lower()}/log/{entry}").first()
            if row and row.paths:
                self._show(name, row.paths, newest)
                return
        self.versions[name.lower()] = newest

    def _show(self, name: str, paths: list[str], version: int) -> None:
        schema = self.spark.table(name).schema
        self.paths[name.lower()], self.versions[name.lower()] = paths, version
        self.spark.read.schema(schema).parquet(*paths).createOrReplaceTempView(name)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df, written out once."""
        path = f"{self.folder}/sources/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, what: Change, images: bool = False) -> tuple[int, DataFrame | None]:
        """Writes the new version and shows it; tells how many rows the statement touched and, with images, these rows
        as they were and became (see Change.images()). The statement runs once: a row that is in the new version and
        was touched is written twice by the same task."""
        name = what.table.lower()
        run = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        seen = Observation()
        taken = what.taken.observe(seen, F.count(ACTION).alias("rows_affected"))
        path = f"{run}/__part={NOW}" if images else run
        if images:
            parts = F.array_compact(F.array(F.when(F.col(STAYS), NOW), F.when(F.col(ACTION).isNotNull(), TOUCHED)))
            both = taken.withColumn(PLACE, F.monotonically_increasing_id()).withColumn("__part", F.explode(parts))
            both.drop(STAYS).withColumn(OLD, F.when(F.col("__part") == TOUCHED, F.col(OLD))).write.partitionBy("__part").parquet(run)
            store, now = storage.files(self.spark, path)
            store.mkdirs(now)
        else:
            Change(what.table, what.columns, taken, what.append).rows.write.parquet(run)
        known = self.paths.get(name, [])
        if what.append and not known:  # a table that isn't a folder is written out with its first rows
            base = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            self.spark.table(what.table).write.parquet(base)
            known = [base]
        paths, version = [*known, path] if what.append else [path], (self.versions.get(name, 0) if what.version is None else what.version) + 1
        if not storage.take_place(self.spark, f"{self.folder}/{name}/log/{version:09d}.json", json.dumps({"paths": paths})):
            raise LostUpdate(f"{what.table} was changed by another writer; run the statement again.")
        schema = what.taken.schema
        self._show(what.table, paths, version)
        if not images:
            return seen.get["rows_affected"], None
        store, touched = storage.files(self.spark, f"{run}/__part={TOUCHED}")
        store.mkdirs(touched)
        rows = self.spark.read.schema(schema.add(PLACE, "long")).parquet(f"{run}/__part={TOUCHED}").withColumn(STAYS, F.lit(True))
        return seen.get["rows_affected"], Change(what.table, what.columns, rows).images(PLACE)
