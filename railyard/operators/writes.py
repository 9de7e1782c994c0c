"""Write-path rules as set-based transforms.

The reference applies defaults, timestamps, upserts, link-backs and delete
actions one entity at a time inside a database.  Here each is a DataFrame
transform producing the next snapshot of a table; nothing is updated in place
(Parquet has no MERGE), and every "now" is a ``batch_ts`` argument so a
retried job writes the same values.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard import schemas
from railyard.operators.joins import left_join_spread_nulls
from railyard.session import checkpoint_dir
from railyard.schemas import CASCADE, NOW, RESTRICT, SET_NULL


def apply_defaults(df: DataFrame, table: str, batch_ts: dt.datetime) -> DataFrame:
    """Fill NULLs with the declared column defaults; ``now()`` defaults and the
    set-if-null audit timestamps take ``batch_ts``."""
    out = df
    for c, v in schemas.defaults(table).items():
        if c not in df.columns:
            continue
        fill = F.lit(batch_ts).cast("timestamp") if v == NOW else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), fill.cast(df.schema[c].dataType)))
    return out


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None,
           touch: str | None = None, batch_ts: dt.datetime | None = None) -> DataFrame:
    """Insert new keys, replace existing ones (``saveAll``): the next snapshot.

    ``base`` is keyed (unique ``key``, as its primary key guarantees).  Within
    the update batch the greatest ``order`` value wins per key, remaining ties
    broken by the row itself so the result is deterministic.  Only the batch is
    aggregated; the base is filtered with an anti join against the batch's
    keys, so the (large) base table is neither shuffled nor sorted when the
    key set is small enough to broadcast.  ``touch`` names a column set to
    ``batch_ts`` on every written row of the batch, even if a value was given
    (the ``updated_at`` rule).
    """
    cols = base.columns
    u = updates.select(*cols, (F.col(order) if order else F.lit(None).cast("string")).alias("__ord"))
    if touch:
        u = u.withColumn(touch, F.lit(batch_ts).cast(base.schema[touch].dataType))
    orderable = [c for c in cols if _orderable(base.schema[c].dataType)]
    rank = F.struct("__ord", *[F.col(c) for c in orderable])
    row = F.struct(*[F.col(c) for c in cols])
    latest = u.groupBy(key).agg(F.max_by(row, rank).alias("__r")).select("__r.*")
    keys = latest.select(F.col(key).alias("__k"))
    kept = base.join(keys, base[key] == keys["__k"], "left_anti")
    return kept.unionByName(latest)


def upsert_into(stored, updates: DataFrame, order: str | None = None, touch: str | None = None,
                batch_ts: dt.datetime | None = None, batch: int = -1) -> list[int]:
    """``upsert`` in place on a ``RangedTable``: only the key ranges that ``updates`` falls into are rewritten.

    Returns those ranges.  The same rules hold: within the batch the greatest
    ``order`` wins, ties by the row itself; a written row replaces the stored one.
    """
    empty = stored.spark.createDataFrame([], stored.schema)
    latest = upsert(empty, updates, stored.key, order, touch, batch_ts)
    return stored.upsert(latest, F.lit(0), batch)


def link_reservations_into(stored, tickets: DataFrame, batch: int = -1) -> list[int]:
    """``link_reservations`` in place: only reservations that get a ticket are written."""
    before = stored.read()
    linked = link_reservations(before.filter(F.col("ticket_id").isNull()), tickets)
    return stored.upsert(linked.filter(F.col("ticket_id").isNotNull()), F.lit(0), batch)


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, (T.MapType, T.VariantType)):
        return False
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return True


def link_reservations(reservations: DataFrame, tickets: DataFrame) -> DataFrame:
    """Fill a reservation's missing ticket from the ticket holding the same
    (trip, seat, booking).  Several tickets may hold one seat (the partial
    unique index is not enforced here), so the lowest ticket id is taken —
    one row per business key, aggregated before the join, so no reservation
    is duplicated."""
    t = (tickets.filter(F.col("seat_id").isNotNull())
         .groupBy("trip_id", "seat_id", "booking_id").agg(F.min("id").alias("__tid"))
         .select(F.col("trip_id").alias("__trip"), F.col("seat_id").alias("__seat"),
                 F.col("booking_id").alias("__bk"), "__tid"))
    r = reservations
    j = r.join(t, (r.trip_id == t.__trip) & (r.seat_id == t.__seat)
               & r.reserved_by_booking.eqNullSafe(t.__bk), "left")
    return j.select(*[F.coalesce(F.col("ticket_id"), F.col("__tid")).alias("ticket_id")
                      if c == "ticket_id" else F.col(c) for c in r.columns])


class RestrictViolation(Exception):
    pass


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("__del_id"))


def plan_delete(tables, table: str, doomed: DataFrame):
    """Propagate a delete of ``doomed`` rows (a DataFrame with ``id``) of ``table``
    through the foreign-key graph.

    Returns ``(new_tables, blocking)``: ``new_tables[name]`` is the next
    snapshot of every affected table (cascaded rows removed, SET NULL
    references cleared), ``blocking`` a DataFrame of RESTRICT references that
    forbid the delete (table_name, column_name, child_id, parent_id).

    The walk is over the schema graph (a handful of edges), done on the
    driver; each step is a semi join of a child table against the deleted keys
    of its parent, whose ids are checkpointed, so that a later step does not
    derive them again.  A reference to clear is joined with its NULLs spread
    over all partitions.
    """
    checkpoint_dir(doomed.sparkSession)
    steps: dict[str, list[DataFrame]] = defaultdict(list)
    frontier = [(table, _ids(doomed).checkpoint())]
    while frontier:
        parent, ids = frontier.pop(0)
        steps[parent].append(ids)
        for fk in schemas.children_of(parent):
            if fk.on_delete == CASCADE:
                child = tables[fk.child]
                hit = child.join(ids, child[fk.column] == ids.__del_id, "left_semi")
                frontier.append((fk.child, _ids(hit).checkpoint()))

    gone = {t: reduce(DataFrame.unionByName, ids).distinct() for t, ids in steps.items()}
    new: dict[str, DataFrame] = {}
    blocking = []
    for t in schemas.TABLES:
        refs = [fk for fk in schemas.FOREIGN_KEYS if fk.child == t and fk.parent in gone]
        if t not in gone and not refs:
            continue
        df = tables[t]
        if t in gone:
            df = df.join(gone[t], df.id == gone[t].__del_id, "left_anti")
        for fk in refs:
            pid = gone[fk.parent]
            if fk.on_delete == SET_NULL:
                marked = left_join_spread_nulls(df, pid, fk.column, "__del_id", F.col("id"))
                kept = F.when(F.col("__del_id").isNull(), F.col(fk.column)).alias(fk.column)
                df = marked.select(*[kept if c == fk.column else F.col(c) for c in df.columns])
            elif fk.on_delete == RESTRICT:
                blocking.append(df.join(pid, df[fk.column] == pid.__del_id).select(
                    F.lit(t).alias("table_name"), F.lit(fk.column).alias("column_name"),
                    F.col("id").alias("child_id"), F.col(fk.column).alias("parent_id")))
        new[t] = df
    return new, reduce(DataFrame.unionByName, blocking) if blocking else None


def delete_rows(tables, table: str, doomed: DataFrame):
    """Apply a delete: raise on any RESTRICT reference, else return the view
    of the tables after the delete."""
    new, block = plan_delete(tables, table, doomed)
    if block is not None and not block.isEmpty():
        raise RestrictViolation(f"delete from {table} is restricted by existing references")
    return tables.with_overrides(**new)
