"""Sliding-window measures per entity at every event.

A contribution made at time s is visible at t when t-W < s <= t. The measures at each event time
come from one running sum of changes (+n at s, -n at s+W), which costs one sort however many rows
a window holds; a RANGE frame with a moving lower edge would re-read the window for every row.

An entity may own a large share of all rows, so its timeline is cut into slices of SLICE windows.
Each slice also receives the contributions still visible when it starts, which makes slices
independent: the shuffle key is (rule, entity, slice), never the entity alone. Rows that agree on
(rule, entity, time, value) are summed before that shuffle.
"""

from __future__ import annotations

import bisect
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import spread

SLICE = 4  # slice length in windows; a contribution is copied to at most one further slice

KEYS = ["rule_id", "entity", "slice"]


def contributions(events: DataFrame, parts: list[Column], keep: list[str] | None = None) -> DataFrame:
    """One row per (event, rule) it matters to; `parts` are null-able structs, one per rule."""
    cols = list(keep or [])
    hits = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return events.select(*cols, F.inline(hits))


def part(
    applies: Column, rule_id: str, seconds: int, entity: Column, us: Column,
    value: Column | None = None, n: Column | int = 1, amount: Column | int = 0,
) -> Column:
    """The struct an event adds to rule `rule_id`; n = 0 measures the window without adding."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    value = F.lit(None) if value is None else F.when(n > 0, value)
    return F.when(
        applies,
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(seconds * 1_000_000).cast("bigint").alias("w_us"),
            entity.cast("string").alias("entity"),
            us.alias("us"),
            value.cast("string").alias("value"),
            n.alias("n"),
            (F.lit(amount) if isinstance(amount, int) else amount).cast("bigint").alias("amount"),
        ),
    )


def _sliced(parts: DataFrame) -> DataFrame:
    """Sum equal rows, then place each row in its own slice and, if still visible, the next."""
    summed = parts.groupBy("rule_id", "w_us", "entity", "us", "value").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount")
    )
    length = F.col("w_us") * SLICE
    start = F.col("us") - F.pmod(F.col("us"), length)
    following = start + length
    carried = (F.col("n") > 0) & (F.col("us") + F.col("w_us") > following)
    slices = F.when(carried, F.array(start, following)).otherwise(F.array(start))
    return spread(summed.withColumn("slice", F.explode(slices)).withColumn("own", F.col("slice") <= F.col("us")), *KEYS)


def _changes(sliced: DataFrame, distinct: bool) -> DataFrame:
    """Turn slice rows into the timed changes whose running sums are the measures."""
    adds = F.col("n") > 0
    end = F.col("us") + F.col("w_us")
    # the wider window comes first: its shuffle also serves the one that adds `value`
    df = sliced.withColumn("rest", F.expr(
        "lead(if(n > 0, us, null)) ignore nulls over (partition by rule_id, entity, slice order by us)"
    ))
    if distinct:
        same = W.partitionBy(*KEYS, "value").orderBy("us")
        df = df.withColumn("again", F.lead(F.when(adds, F.col("us"))).over(same))

    def change(t: Column, n: Column, amount: Column, d: Column | int, rest: Column, point: Column) -> Column:
        return F.struct(
            t.alias("t"), n.alias("dn"), amount.alias("da"),
            (F.lit(d) if isinstance(d, int) else d).cast("bigint").alias("dd"),
            rest.cast("bigint").alias("rest"), point.alias("point"),
        )

    none = F.lit(None).cast("bigint")
    no = F.lit(False)
    counted = adds & F.col("value").isNotNull()
    rows = [
        change(F.col("us"), F.col("n"), F.col("amount"), F.when(counted, 1).otherwise(0), none, F.col("own")),
        F.when(adds, change(end, -F.col("n"), -F.col("amount"), 0, F.col("rest"), no)),
    ]
    if distinct:
        # a value stops being counted W after its last sighting; at an earlier repeat the
        # -1 and the repeat's own +1 cancel
        gone = F.least(end, F.coalesce(F.col("again"), end))
        rows.append(F.when(counted, change(gone, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), -1, none, no)))
    rows_col = F.filter(F.array(*rows), lambda c: c.isNotNull())
    return df.select(
        *KEYS, "w_us", "us", "n", "value", F.inline(rows_col)
    ).filter(F.col("t") < F.col("slice") + F.col("w_us") * SLICE)


def sweep(parts: DataFrame, distinct: bool = True) -> DataFrame:
    """Measures at every contribution and probe time, plus the change rows they came from.

    Columns: rule_id, entity, slice, t, point, count, amount, n_distinct, oldest (first
    contribution still visible), and us/n/value of the originating row. Measures are valid
    where `point`; rows sharing a time see each other.
    """
    run = W.partitionBy(*KEYS).orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    first = F.min(F.when(F.col("dn") > 0, F.col("us"))).over(run)
    return _changes(_sliced(parts), distinct).select(
        *KEYS, "w_us", "t", "point", "us", "n", "value", "dn",
        F.sum("dn").over(run).alias("count"),
        F.sum("da").over(run).alias("amount"),
        F.sum("dd").over(run).alias("n_distinct"),
        F.coalesce(F.max("rest").over(run), first, F.col("t")).alias("oldest"),
    )


def sliding(df: DataFrame, entity: Column, seconds: int, *, us: Column, value: Column | None = None,
            amount: Column | None = None, contributes: Column | None = None) -> DataFrame:
    """Measures at each distinct (entity, us): count, amount, n_distinct, oldest (µs)."""
    n = F.lit(1) if contributes is None else F.when(contributes, 1).otherwise(0)
    one = part(F.lit(True), "-", seconds, entity, us, value, n, F.lit(0) if amount is None else amount)
    out = sweep(contributions(df, [one]), distinct=value is not None).filter("point")
    return out.select("entity", F.col("t").alias("us"), "count", "amount", "n_distinct", "oldest").distinct()


MEMBER_SCHEMA = (
    "rule_id string, entity string, us bigint, count bigint, amount bigint, n_distinct bigint, "
    "oldest bigint, members array<string>"
)


def firing_members(swept: DataFrame, fires: Column, limits: dict[str, int]) -> DataFrame:
    """For each (entity, time) where `fires` holds, the smallest `limits[rule]` visible values.

    Only slices with a firing reach Python. Their rows arrive sorted by time, a partition at a
    time in Arrow batches; the state is the set of values visible in one window.
    """
    whole = W.partitionBy(*KEYS)
    hit = F.col("point") & fires
    live = swept.withColumn("fire", hit).withColumn("any_fire", F.max("fire").over(whole)).filter("any_fire")
    needed = live.filter((F.col("dn") > 0) | F.col("fire")).select(
        *KEYS, "w_us", "t", "fire", F.when(F.col("dn") > 0, F.col("value")).alias("value"),
        "count", "amount", "n_distinct", "oldest",
    ).sortWithinPartitions(*KEYS, "t", "fire")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        waiting: list[tuple] = []  # firings at the current time, emitted once all its adds are in
        for pdf in batches:
            out: list[tuple] = []
            rows = zip(
                pdf["rule_id"], pdf["entity"], pdf["slice"], pdf["w_us"], pdf["t"], pdf["fire"],
                pdf["value"], pdf["count"], pdf["amount"], pdf["n_distinct"], pdf["oldest"],
                strict=True,
            )
            for rule, ent, sl, w_us, t, fire, value, cnt, amt, dst, old in rows:
                if key is None or key[0] != rule or key[1] != ent or key[2] != sl or now != t:
                    out.extend(w + (ordered[: limits.get(w[0], 0)],) for w in waiting[:1])
                    waiting = []
                    if key != (rule, ent, sl):
                        key = (rule, ent, sl)
                        seen: Counter = Counter()
                        ordered: list[str] = []
                        alive: deque = deque()
                    now = t
                    while alive and alive[0][0] <= t - w_us:
                        _, old_value = alive.popleft()
                        seen[old_value] -= 1
                        if not seen[old_value]:
                            del seen[old_value]
                            ordered.pop(bisect.bisect_left(ordered, old_value))
                if value is not None:
                    alive.append((t, value))
                    if not seen[value]:
                        bisect.insort(ordered, value)
                    seen[value] += 1
                if fire:
                    waiting.append((rule, ent, t, cnt, amt, dst, old))
            if out:
                yield _frame(out)
        if waiting:
            yield _frame([waiting[0] + (ordered[: limits.get(waiting[0][0], 0)],)])

    return needed.mapInPandas(walk, MEMBER_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["rule_id", "entity", "us", "count", "amount", "n_distinct", "oldest", "members"]
    return pd.DataFrame(rows, columns=names)
