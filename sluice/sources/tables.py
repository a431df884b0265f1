"""Where a target's tables come from: folders of Parquet, or queries of a remote database."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.settings import Settings


def parquet(folder: str, names: Iterable[str]) -> dict[str, str]:
    """The paths of ``<folder>/<name>.parquet``, as Engine takes them."""
    return {name: f"{folder.rstrip('/')}/{name}.parquet" for name in names}


def ranges(spark: SparkSession, settings: Settings, url: str, sql: str, column: str, parts: int, bins: int = 256) -> list[str]:
    """Conditions that deal a remote query's rows out by a whole-number column, about equally many each: the database counts
    the rows in ``bins`` equal steps between the least and the largest value, and steps are put together until a part has
    its share. A value that has more than that is a part by itself. The first part has the nulls."""
    one = lambda text: spark.read.format("jdbc").options(**settings.jdbc_options(url, text)).load()
    low, high = one(f"SELECT min({column}) AS low, max({column}) AS high FROM ({sql}) t").first()
    if low is None:
        return ["1 = 1"]
    low, high = int(low), int(high)
    step = max(1, -(-(high - low + 1) // bins))
    counted = one(f"SELECT b, count(*) AS n FROM (SELECT ({column} - {low}) / {step} AS b FROM ({sql}) t WHERE {column} IS NOT NULL) u GROUP BY b")
    counts = sorted((int(b), int(n)) for b, n in counted.collect())
    share, edges, held = -(-sum(n for _, n in counts) // max(1, parts)), [], 0
    for b, n in counts:
        if held and held + n > share and len(edges) < parts - 1:
            edges.append(low + b * step)
            held = 0
        held += n
    if not edges:
        return ["1 = 1"]
    return [f"{column} < {edges[0]} OR {column} IS NULL", *(f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])), f"{column} >= {edges[-1]}"]


def remote(spark: SparkSession, settings: Settings, url: str, sql: str, column: str, parts: int = 8) -> DataFrame:
    """jdbc() in parts whose bounds the database tells, see ranges(); a connection each, at most as many as the pool allows."""
    options = {k: v for k, v in settings.jdbc_options(url, sql).items() if k != "query"}
    predicates = ranges(spark, settings, url, sql, column, max(1, min(parts, settings.pool_max)))
    return spark.read.jdbc(url, f"({sql}) t", predicates=predicates, properties={k: str(v) for k, v in options.items() if k != "url"})


def jdbc(spark: SparkSession, settings: Settings, url: str, sql: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A remote query as a DataFrame; filters and columns are pushed to the database. With column it is read in
    ``parts`` ranges of it, a connection each, at most as many as the settings' pool allows."""
    options = settings.jdbc_options(url, sql)
    if column:
        options = {k: v for k, v in options.items() if k != "query"} | {"dbtable": f"({sql}) t", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(max(1, min(parts, settings.pool_max)))}
    return spark.read.format("jdbc").options(**options).load()
