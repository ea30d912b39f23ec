"""All pairs within groups, without gathering a group: hashed blocks of bounded size, one key per pair of blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written

BLOCK = 256
HOT_ROWS = 10_000
HOT_SHARE = 1000


def hot_and_rest(rows: DataFrame, facts: DataFrame, key: list[str], weight: str) -> list[DataFrame]:
    """The inner join of ``rows`` with ``facts`` in parts that hold each row once, none of which gathers a key in a task.

    ``facts`` has one row per key, ``weight`` being the number of the key's rows; both are written tables. A key is hot if
    it holds more than ``HOT_ROWS`` rows and more than 1 in ``HOT_SHARE`` of all: fewer than ``HOT_SHARE`` keys, which is
    the bound of what is broadcast. Their rows stay where they are; those of other keys are shuffled. Without a hot key
    there is one part."""
    total, most = facts.agg(F.sum(weight), F.max(weight)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return [rows.join(facts, key)]
    hot = F.broadcast(facts.where(F.col(weight) > limit))
    rest = facts.where(F.col(weight) <= limit)
    return [rows.join(hot, key), rows.join(hot.select(*key), key, "left_anti").join(rest, key)]


def attached(rows: DataFrame, facts: DataFrame, key: list[str], weight: str) -> DataFrame:
    """:func:`hot_and_rest` in one table."""
    first, *more = hot_and_rest(rows, facts, key, weight)
    for part in more:
        first = first.unionByName(part)
    return first


def group_sizes(rows: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """``(group, _n)``, written: the number of rows of each group that has ``least`` or more, combined map-side."""
    return written(rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least))


def with_group_sizes(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows of a written table that share their group with another, with the group's number of rows as ``_n``."""
    return attached(rows, group_sizes(rows, group), group, "_n")


def pairs_within(rows: DataFrame, group: list[str], item: str, carried: list[str], pair: Callable[[Column, Column], Column], wanted: Callable[[Column, Column], Column] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns of ``pair(x, y)`` for every two rows of a group with x's ``item`` before y's.

    ``rows`` holds ``group``, ``item`` (unique within a group) and ``carried``; x and y are structs of the latter two.
    ``wanted(x, y)``, which must not depend on the order of the two, filters before anything is built. The rows are written
    once, as they are counted and then joined: groups of up to ``block`` rows with themselves, larger ones cut by a hash of
    the item, with a key for every two blocks. So no key of a join has more than about ``block`` rows on a side."""
    rows = written(rows.select(*dict.fromkeys([*group, item, *carried])))
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    x, y = F.col("_x"), F.col("_y")
    fit = wanted(x, y) if wanted is not None else F.lit(True)
    out = []
    for part in hot_and_rest(rows, group_sizes(rows, group), group, "_n"):
        part = part.select(*keys, "_n", F.struct(item, *carried).alias("_x"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
        small = part.where("_blocks = 1").select(*names, "_x")
        out.append(small.join(small.withColumnRenamed("_x", "_y"), names).where((x[item] < y[item]) & fit).select(pair(x, y).alias("_p")))
        cut = part.where("_blocks > 1").withColumn("_block", F.pmod(F.xxhash64(x[item]), F.col("_blocks")).cast("int"))
        left = cut.select(*names, "_x", F.col("_block").alias("_left"), F.explode(F.expr("sequence(_block, _blocks - 1)")).alias("_right"))
        right = cut.select(*names, F.col("_x").alias("_y"), F.explode(F.expr("sequence(0, _block)")).alias("_left"), F.col("_block").alias("_right"))
        met = left.join(right, [*names, "_left", "_right"]).where(((F.col("_left") < F.col("_right")) | (x[item] < y[item])) & fit)
        out.append(met.select(F.when(x[item] < y[item], pair(x, y)).otherwise(pair(y, x)).alias("_p")))
    made = out[0]
    for more in out[1:]:
        made = made.unionAll(more)
    return made.select("_p.*")


MOST_ASIDE = 62


def largest_aside(rows: DataFrame, group: str, min_count: int) -> tuple[list, Column]:
    """The ``min_count - 1`` largest groups, by number of rows, and the bit of a row's group among them (0 for the rest)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    # At most MOST_ASIDE rows come to the driver.
    aside = [r[0] for r in sizes.orderBy(F.desc("n"), group).limit(min(max(min_count - 1, 0), MOST_ASIDE)).collect()]
    mask = F.lit(0).cast("bigint")
    for k, key in enumerate(aside):
        mask = mask + F.when(F.col(group) == key, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return aside, mask


def shared_counts(rows: DataFrame, group: str, member: str, min_count: int, wanted_members: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(a, b, together)`` of the members that share at least ``min_count`` groups, and the members kept, ``(member, n)``.

    ``rows`` is a written table of distinct ``(group, member)`` without nulls. Members in fewer than ``min_count`` groups,
    or refused by ``wanted_members(n)``, emit nothing. Nor do the ``min_count - 1`` largest groups: two members with
    ``min_count`` groups in common meet in another one as well, and what the large groups add is read off a bit mask per
    member. A group with a third of all rows thus costs one bit per member, not its square."""
    aside, mask = largest_aside(rows, group, min_count)
    members = rows.groupBy(member).agg(F.count("*").alias("n"), F.sum(mask).alias("mask")).where(F.col("n") >= min_count)
    members = written(members if wanted_members is None else members.where(wanted_members(F.col("n"))))
    light = rows.where(~F.col(group).isin(aside)) if aside else rows
    light = light.join(members.select(member, "mask"), member)
    emitted = pairs_within(
        light, [group], member, ["mask"],
        lambda x, y: F.struct(x[member].alias("a"), y[member].alias("b"), F.bit_count(x["mask"].bitwiseAND(y["mask"])).alias("aside")),
    )
    counted = emitted.groupBy("a", "b", "aside").agg(F.count("*").alias("n")).select("a", "b", (F.col("n") + F.col("aside")).alias("together"))
    return counted.where(F.col("together") >= min_count), members.select(member, "n")
