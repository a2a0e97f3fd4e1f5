"""Running values along an order, in two levels.

A plain window puts all rows of a key in one task. Here the order is cut into
buckets: rows meet only their own bucket, each bucket leaves one summary row, and
the summaries alone run along the whole key. A key with a third of all rows is
then spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKS_PER_BUCKET = 4096
#: Neighbouring buckets whose summaries are put together at once, and how often that is done below a whole key.
FAN, LEVELS = 1024, 2
#: The bucket of rows without a place: before all others.
NOWHERE = -(1 << 60)


def tick_bucket(tick: str = "tick", size: int = TICKS_PER_BUCKET) -> Column:
    return F.floor(F.col(tick) / size)


def time_bucket(ts: str = "ts", seconds: int = 3600) -> Column:
    """Bucket of a timestamp. Choose ``seconds`` so that a stream has a few thousand rows in one."""
    return F.floor(F.unix_micros(F.col(ts)) / (seconds * 1_000_000))


def solid(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The table with key columns that are never null, and their names.

    Where null equals null in a join, rows have to be dealt out anew, since the join is one of expressions. Windows,
    groups and plain joins over these columns all share one dealing. ``__nulls`` tells which keys are null.
    """
    marks = [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)]
    made = {f"__key{i}": F.coalesce(F.col(k), _filler(df.schema[k].dataType)) for i, k in enumerate(keys)}
    return df.withColumns({**made, "__nulls": sum(marks, F.lit(0))}), [*made, "__nulls"]


def _filler(kind: T.DataType) -> Column:
    """Any value of a type, to stand where a key is null."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.from_json(F.lit("[]" if isinstance(kind, T.ArrayType) else "{}"), kind)
    return F.lit("0").cast(kind)


def restored(keys: list[str]) -> list[Column]:
    """The keys as they were, from the columns of ``solid``."""
    return [F.when(F.col("__nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(f"__key{i}")).alias(k) for i, k in enumerate(keys)]


def entries(
    summaries: DataFrame,
    keys: list[str],
    slot: str,
    does: str,
    compose: Callable[[Column, Column], Column],
    enter: Callable[[Column, Column], Column],
    start: Column,
) -> DataFrame:
    """``(keys, slot, __entry)``: with what each bucket of a key is entered, by a parallel prefix.

    A summary's ``does`` column tells what a bucket does to what enters it. Summaries of ``FAN`` neighbouring buckets are
    composed into one (``compose(first, second)``), those again, ``LEVELS`` times; from the whole key down, each is
    entered with what the one before it leaves (``enter(entry, does)``). No list holds more than ``FAN`` summaries, but
    for the last of a key with more than ``FAN ** (LEVELS + 1)`` buckets, and nothing runs along a key row by row.
    """
    tree = []
    now = summaries.select(*keys, F.col(slot).alias("__at"), F.col(does).alias("__does"))
    for level in range(LEVELS + 1):
        above = F.floor(F.col("__at") / FAN).cast("bigint") if level < LEVELS else F.lit(0).cast("bigint")
        linked = now.groupBy(*keys, above.alias("__up")).agg(F.sort_array(F.collect_list(F.struct("__at", "__does"))).alias("__links"))
        tree.append(linked)
        whole = F.reduce(F.slice("__links", 2, FAN), F.get("__links", F.lit(0))["__does"], lambda x, link: compose(x, link["__does"]))
        now = linked.select(*keys, F.col("__up").alias("__at"), whole.alias("__does"))
    kind = f"array<struct<at:bigint,entry:{summaries.select(start).schema[0].dataType.simpleString()}>>"
    entry = None
    for level in range(LEVELS, -1, -1):
        linked = tree[level].withColumn("__entry", start) if entry is None else tree[level].join(entry, [*keys, "__up"])
        walked = F.reduce(
            "__links",
            F.struct(F.col("__entry").alias("now"), F.array().cast(kind).alias("out")),
            lambda s, link: F.struct(
                enter(s["now"], link["__does"]).alias("now"),
                F.array_append(s["out"], F.struct(link["__at"].alias("at"), s["now"].alias("entry"))).alias("out"),
            ),
            lambda s: s["out"],
        )
        down = linked.select(*keys, F.explode(walked).alias("e"))
        entry = down.select(*keys, F.col("e.at").alias("__up" if level else slot), F.col("e.entry").alias("__entry"))
    return entry


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    steps: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add one running column per step, up to and including each row.

    A step is ``(kind, value)``; kinds are ``previous`` (value of the row before),
    ``total`` (running sum), ``highest`` (running maximum), ``latest`` (last value
    that is not null) and ``following`` (first such value at or after the row).
    ``order`` must be a total order inside a key and ``bucket`` must not decrease
    along it.
    """
    slot = "__bucket"
    src, solid_keys = solid(df.withColumn(slot, F.coalesce(bucket.cast("bigint"), F.lit(NOWHERE))), keys)
    for i, (_, value) in enumerate(steps.values()):
        src = src.withColumn(f"__v{i}", value)
    local_keys = [*solid_keys, slot]
    here = W.partitionBy(*local_keys).orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*solid_keys).orderBy(slot)
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    onward = here.rowsBetween(W.currentRow, W.unboundedFollowing)
    later = before.rowsBetween(1, W.unboundedFollowing)
    position = F.struct(*order)

    local, summary, carried, joined = {}, [], {}, {}
    for i, (name, (kind, _)) in enumerate(steps.items()):
        value, mine, end, carry = F.col(f"__v{i}"), f"__l{i}", f"__s{i}", f"__c{i}"
        if kind == "previous":
            local[mine] = F.lag(value).over(here)
            local["__first"] = F.row_number().over(here) == 1
            summary.append(F.max_by(F.struct(value.alias("v")), position).alias(end))
            carried[carry] = F.lag(F.col(end)).over(before)
            joined[name] = F.when(F.col("__first"), F.col(carry)["v"]).otherwise(F.col(mine))
        elif kind == "total":
            local[mine] = F.sum(value).over(upto)
            summary.append(F.sum(value).alias(end))
            carried[carry] = F.sum(end).over(earlier)
            joined[name] = F.coalesce(F.col(mine), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
        elif kind == "highest":
            local[mine] = F.max(value).over(upto)
            summary.append(F.max(value).alias(end))
            carried[carry] = F.max(end).over(earlier)
            joined[name] = F.greatest(F.col(mine), F.col(carry))
        elif kind == "latest":
            local[mine] = F.last(value, ignorenulls=True).over(upto)
            summary.append(
                F.max_by(value, F.when(value.isNotNull(), position)).alias(end)
            )
            carried[carry] = F.last(end, ignorenulls=True).over(earlier)
            joined[name] = F.coalesce(F.col(mine), F.col(carry))
        elif kind == "following":
            local[mine] = F.first(value, ignorenulls=True).over(onward)
            summary.append(F.min_by(value, F.when(value.isNotNull(), position)).alias(end))
            carried[carry] = F.first(end, ignorenulls=True).over(later)
            joined[name] = F.coalesce(F.col(mine), F.col(carry))
        else:
            raise ValueError(f"unknown step {kind!r}")

    rows = src.withColumns(local)
    ends = src.groupBy(*local_keys).agg(*summary).withColumns(carried).select(*local_keys, *carried)
    return rows.join(ends, local_keys).select(
        *[F.col(c) for c in df.columns], *[c.alias(n) for n, c in joined.items()]
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "position"
) -> DataFrame:
    """Row number from 1 inside each key, in two levels."""
    return scan(df, keys, order, bucket, {name: ("total", F.lit(1).cast("bigint"))})


def with_halo(df: DataFrame, tick: str, size: int, reach: int, name: str = "__bucket") -> DataFrame:
    """Rows in buckets of ``size`` ticks, the last ``reach`` ticks of each also in the next.

    What looks back at most ``reach`` ticks can then be computed inside a bucket.
    ``__own`` is false for the rows that only lend their past.
    """
    at = F.col(tick)
    own = F.floor(at / size)
    reached = F.sequence(own, F.floor((at + reach) / size))
    return df.withColumn(name, F.explode(reached)).withColumn("__own", F.col(name) == own)


def fold_states(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    states: list[str],
    step: Callable[[Column, Column], Column],
    columns: list[str],
    name: str = "state",
) -> DataFrame:
    """State after each row of a machine with few states, in two levels.

    Every bucket is run once from each possible state, which gives its table of
    "enter here, leave there". Tables are composed as maps of states (``entries``), and
    each bucket is replayed from the state it is really entered with. The first state
    is the start. ``step(state, row)`` gives the next state.
    """
    slot = "__bucket"
    fields = list(dict.fromkeys([*order, *columns]))
    rows, solid_keys = solid(df.withColumn(slot, F.coalesce(bucket.cast("bigint"), F.lit(NOWHERE))), keys)
    grouped = rows.groupBy(*solid_keys, slot).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__rows"))
    names = F.array(*map(F.lit, states))

    def number(state: Column) -> Column:
        return (F.array_position(names, state) - 1).cast("int")

    table = F.array(*(number(F.reduce("__rows", F.lit(state), step)) for state in states))
    entered = entries(
        grouped.select(*solid_keys, slot, table.alias("__table")),
        solid_keys,
        slot,
        "__table",
        lambda first, second: F.transform(first, lambda state: F.get(second, state)),
        lambda state, does: F.get(does, state),
        F.lit(0),
    )
    replay = F.reduce(
        "__rows",
        F.struct(
            F.get(names, F.col("__entry")).alias("now"),
            F.array().cast("array<string>").alias("out"),
        ),
        lambda acc, row: F.struct(
            step(acc["now"], row).alias("now"),
            F.array_append(acc["out"], step(acc["now"], row)).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    done = grouped.join(entered, [*solid_keys, slot]).select(
        *solid_keys, F.explode(F.arrays_zip(F.col("__rows").alias("row"), replay.alias("state"))).alias("z")
    )
    return done.select(
        *restored(keys), *[F.col(f"z.row.{f}").alias(f) for f in fields], F.col("z.state").alias(name)
    )
