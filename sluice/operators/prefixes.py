"""The first rows of an ordered table of any size: by number, by share, or by bytes.

Rows get a place: which task has them, and where in it. Counts or bytes by task come to the driver, one number each;
a task then knows how much comes before it. No task sees more than its own rows, and no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.results import PLACE, json_bytes
from sluice.storage import cut

#: The bits of a place that tell a row's position within its task.
BITS = 33
PART, SIZE, SUM = "__part", "__size", "__sum"


def placed(df: DataFrame, *keys: Column) -> DataFrame:
    """The rows in the order of keys, or else as they come, with their PLACE, written out: ranges of the keys are
    sorted by themselves. Rows of equal keys are in one range."""
    if keys:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(df.withColumn(PLACE, F.monotonically_increasing_id()))


def part() -> Column:
    return F.shiftright(PLACE, BITS)


def starts(rows: DataFrame, amount: Column, most: int | None = None) -> tuple[dict[int, int], int]:
    """How much of amount comes before each task that has rows, up to the task where it passes ``most``; and the sum of all."""
    before, total = {}, 0
    for r in sorted(rows.groupBy(part().alias("p")).agg(F.sum(amount).alias("n")).collect(), key=lambda r: r.p):
        if most is None or total <= most:
            before[r.p] = total
        total += r.n
    return before, total


def after(before: dict[int, int]) -> Column:
    """What comes before a row's task."""
    return F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col(PART))


def running(rows: DataFrame, before: dict[int, int], amount: Column) -> DataFrame:
    """The rows of the tasks that begin within the limit, with the SUM of amount up to each: of the whole table, though each
    task adds up its own."""
    own = rows.withColumn(PART, part()).where(F.col(PART).isin(list(before)))
    order = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn(SUM, F.sum(amount).over(order) + after(before)).drop(PART)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by PLACE."""
    before, _ = starts(rows, F.lit(1).cast("long"), n - 1)
    return running(rows, before, F.lit(1).cast("long")).where(F.col(SUM) <= n).drop(SUM) if before and n > 0 else rows.limit(0)


def top_percent(df: DataFrame, percent: float, keys: list[Column], ties: bool = False, names: list[str] | None = None) -> DataFrame:
    """The first ``percent`` of the rows in the order of keys, rounded up; with ties also those equal in the columns
    ``names``, which the keys order by, to the last of them. Without keys any rows."""
    rows = placed(df, *keys)
    _, total = starts(rows, F.lit(1).cast("long"))
    n = -int(-total * percent // 100)
    first = first_rows(rows, n)
    if ties and names and 0 < n < total:
        last = first.orderBy(F.desc(PLACE)).limit(1).select(*(F.col(c).alias(f"__last_{c}") for c in names))
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"__last_{c}"))
        # the last row's equals, before and behind it
        first = rows.join(F.broadcast(last), same, "left_semi").union(first.join(F.broadcast(last), same, "left_anti"))
    return first.orderBy(PLACE).drop(PLACE)


def within_bytes(rows: DataFrame, most: int, lenient_first: bool = True) -> DataFrame:
    """The longest prefix by PLACE whose JSON array fits into ``most`` bytes, as results.bounded() has it, for tables of
    any size. result_bytes: up to each row."""
    sized = rows.withColumn(SIZE, json_bytes(rows).cast("long"))
    before, _ = starts(sized, F.col(SIZE) + 1, most)
    if not before:
        return rows.limit(0).withColumn("result_bytes", F.lit(0).cast("long"))
    summed = running(sized, before, F.col(SIZE) + 1).withColumn(SUM, F.col(SUM) + 1)  # a bracket before, and a comma or bracket behind each
    fits = F.col(SUM) <= most
    if lenient_first:
        alone = F.col(SUM) == F.col(SIZE) + 2
        fits = F.when(alone, F.col(SIZE) <= most).otherwise(fits)
    # sums grow, so what fits is a prefix, but for a first row that alone is too large
    kept = summed.where(fits).withColumnRenamed(SUM, "result_bytes").drop(SIZE)
    first = sized.where(part() == min(before)).orderBy(PLACE).limit(1).select(SIZE).first()[SIZE]
    return kept if first <= most - (0 if lenient_first else 2) else kept.limit(0)
