"""Merging a log of instructions from many writers into objects.

The log has columns table, key, op, field, value, delta, time, origin, default, seen. Ops are in ``OPS``; any other one is an error of the
running job. The rules of objects, registers and sets are aggregates by object and field, so they combine before a shuffle
and don't depend on the order in which instructions arrive:

* a table is there if it was last added, not erased, and so is a column; what hangs on an erased one is gone;
* an erase at or after an object's last create removes it with all its fields, and a create of an existing object does nothing;
* the last update of a field wins by (not default, time, origin);
* additions after that update all count, wrapping at 64 bits; those before it are gone unless it was a default;
* the last of inserting and erasing an element of a set wins; a clear discards what came before it.

Lists are merged by transforming positions: all replicas apply a list's instructions in the order of (time, origin), and the position in each is
shifted by those before it that its writer hadn't seen (``seen``: the time up to which it had; null: all before its own).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import wrap

SCHEMA = "table string, key string, op string, field string, value string, delta long, time long, origin long, default boolean"
#: Instructions on lists have the position in ``delta``; a move has the new position in ``value``.
OPS = ("add_table", "erase_table", "add_column", "erase_column", "create", "erase", "update", "add", "list_insert", "list_set", "list_move", "list_erase", "clear", "set_insert", "set_erase")


def schema(log: DataFrame) -> DataFrame:
    """(table, field, type) of columns that are there, of tables that are there; a table without columns has one row with a null field."""
    stamp = F.struct("time", "origin")

    def kept(made: str, gone: str, *by: str) -> DataFrame:
        both = log.where(F.col("op").isin(made, gone)).groupBy(*by).agg(F.max_by(F.struct("op", "value"), stamp).alias("last"))
        return both.where(F.col("last.op") == made).select(*by, F.col("last.value").alias("type"))

    columns = kept("add_column", "erase_column", "table", "field")
    return kept("add_table", "erase_table", "table").drop("type").join(columns, "table", "left")


def standing(log: DataFrame) -> DataFrame:
    """The instructions on tables and columns that weren't erased since. Tables that no instruction adds or erases stand."""
    stamp = F.struct("time", "origin")
    tables = log.where(F.col("op") == "erase_table").groupBy("table").agg(F.max(stamp).alias("__t"))
    columns = log.where(F.col("op") == "erase_column").groupBy("table", "field").agg(F.max(stamp).alias("__c"))
    out = log.join(F.broadcast(tables), "table", "left").join(columns, ["table", "field"], "left")
    late = lambda c: F.col(c).isNull() | (stamp > F.col(c))
    return out.where(late("__t") & late("__c") & ~F.col("op").isin("add_table", "erase_table", "add_column", "erase_column")).select(*log.columns)


def alive(log: DataFrame) -> DataFrame:
    """(table, key, since) of objects that exist: created, and not erased at or after."""
    stamp = F.struct("time", "origin")
    o = log.where(F.col("op").isin("create", "erase")).groupBy("table", "key").agg(F.max(F.when(F.col("op") == "create", stamp)).alias("made"), F.max(F.when(F.col("op") == "erase", stamp)).alias("gone"))
    return o.where(F.col("made").isNotNull() & (F.col("gone").isNull() | (F.col("made.time") > F.col("gone.time")))).select("table", "key", F.col("gone").alias("since"))


def _live(log: DataFrame) -> DataFrame:
    """Instructions on fields of objects that exist, without those from before an erase."""
    known = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("Unknown instruction "), F.coalesce("op", F.lit("null")))).cast("string"))
    on = log.withColumn("op", known).where(~F.col("op").isin("create", "erase")).join(alive(log), ["table", "key"])
    return on.where(F.col("since").isNull() | (F.col("time") > F.col("since.time"))).drop("since")


def registers(log: DataFrame) -> DataFrame:
    """(table, key, field, value): last updates, with what was added since."""
    live = _live(log).where(F.col("op").isin("update", "add"))
    rank = F.struct(~F.coalesce(F.col("default"), F.lit(False)), "time", "origin")
    last = live.where("op = 'update'").groupBy("table", "key", "field").agg(F.max_by(F.struct("value", "time", "origin", "default"), rank).alias("u"))
    adds = live.where("op = 'add'").join(last, ["table", "key", "field"], "left")
    counted = F.col("u").isNull() | F.coalesce(F.col("u.default"), F.lit(False)) | (F.struct(adds["time"], adds["origin"]) > F.struct(F.col("u.time"), F.col("u.origin")))
    plus = adds.where(counted).groupBy("table", "key", "field").agg(F.sum(F.col("delta").cast("decimal(28,0)")).alias("plus"))
    both = last.join(plus, ["table", "key", "field"], "full")
    number = F.coalesce(F.col("u.value").try_cast("bigint"), F.lit(0).cast("bigint")).cast("decimal(28,0)")
    return both.select("table", "key", "field", F.when(F.col("plus").isNull(), F.col("u.value")).otherwise(wrap(number + F.col("plus")).cast("string")).alias("value"))


def sets(log: DataFrame) -> DataFrame:
    """(table, key, field, elements): sets after all inserts, erases and clears, sorted."""
    live = _live(log).where(F.col("op").isin("set_insert", "set_erase", "clear"))
    cleared = live.where("op = 'clear'").groupBy("table", "key", "field").agg(F.max(F.struct("time", "origin")).alias("c"))
    own = live.where("op <> 'clear'").join(cleared, ["table", "key", "field"], "left").where(F.col("c").isNull() | (F.struct("time", "origin") > F.col("c")))
    last = own.groupBy("table", "key", "field", "value").agg(F.max_by("op", F.struct("time", "origin")).alias("op")).where("op = 'set_insert'")
    return last.groupBy("table", "key", "field").agg(F.array_sort(F.collect_list("value")).alias("elements"))


def replay(ops: list[tuple]) -> list[str | None]:
    """A list after instructions (op, position, value, time, origin, seen) in order of (time, origin)."""
    out: list[str | None] = []
    done: list[tuple] = []  # (op as applied, position, new position, time, origin)
    for op, at, value, time, origin, seen in ops:
        to = int(value) if op == "list_move" else None
        lost = False
        for kind, p, r, t, who in done:
            if who == origin or seen is None or t <= seen:
                continue
            if kind == "clear":
                lost = True
            elif kind == "list_insert":
                at += p < at or p == at
                to = to + (p <= to) if to is not None else None
            elif kind == "list_erase":
                if p == at and op != "list_insert":
                    lost = True
                at -= p < at
                to = to - (p < to) if to is not None else None
            elif kind == "list_move" and op != "list_insert":
                # The element that was moved keeps its instruction; others close the gap and make room.
                at = r if p == at else at - (p < at) + (r <= at - (p < at))
            elif kind == "list_move":
                at = at - (p < at) + (r < at - (p < at))
        if op == "clear":
            out, done = [], [*done, ("clear", 0, 0, time, origin)]
            continue
        if lost:
            continue
        at = max(0, min(at, len(out) if op == "list_insert" else len(out) - 1))
        if op == "list_insert":
            out.insert(at, value)
        elif not out:
            continue
        elif op == "list_set":
            out[at] = value
        elif op == "list_erase":
            del out[at]
        else:
            to = max(0, min(to, len(out) - 1))
            out.insert(to, out.pop(at))
        done.append((op, at, to, time, origin))
    return out


def lists(log: DataFrame) -> DataFrame:
    """(table, key, field, elements): lists after all instructions on them. One list's instructions are replayed together; lists are independent."""
    own = _live(log if "seen" in log.columns else log.withColumn("seen", F.lit(None).cast("long"))).where(F.col("op").startswith("list_") | (F.col("op") == "clear"))
    touched = own.where(F.col("op").startswith("list_")).select("table", "key", "field").distinct()

    def one(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time", "origin"], kind="stable")
        seen = [None if pd.isna(s) else int(s) for s in rows["seen"]]
        ops = list(zip(rows["op"], rows["delta"].fillna(0).astype(int), rows["value"], rows["time"], rows["origin"], seen))
        return pd.DataFrame([(*name, replay(ops))], columns=["table", "key", "field", "elements"])

    return own.join(touched, ["table", "key", "field"], "left_semi").groupBy("table", "key", "field").applyInPandas(one, "table string, key string, field string, elements array<string>")
