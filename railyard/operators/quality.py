"""Data-quality rules generated from the declared model.

The database enforced keys, references, NOT NULL, enum domains and numeric
precision on every insert; Spark does not, so they are validated set-wise.
Each rule family returns one DataFrame; every check is a whole-table
aggregate (partial aggregation before any shuffle), an anti join, or a
single-pass ``count_if`` profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard import schemas
from railyard.schemas import ENUMS


def _union(frames: list[DataFrame]) -> DataFrame:
    """Union many same-shaped frames as a balanced tree: each ``unionByName``
    re-checks its whole input plan, so a left-deep chain costs quadratic
    driver time in the number of frames; a balanced tree costs n log n."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i]
                  for i in range(0, len(frames), 2)]
    return frames[0]


def _key_text(cols) -> F.Column:
    # a JSON text, so that no value can look like two
    return F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))


def duplicate_keys(df: DataFrame, table: str, cols, where: str | None = None) -> DataFrame:
    """Keys occurring more than once (rows with a NULL key part are exempt, as in SQL)."""
    d = df
    if where:
        d = d.filter(where)
    for c in cols:
        d = d.filter(F.col(c).isNotNull())
    return (d.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
             .filter(F.col("n_rows") > 1)
             .select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
                     _key_text(cols).alias("key_value"), "n_rows"))


def duplicate_keys_sets(df: DataFrame, table: str, key_sets: list[tuple[str, ...]]) -> DataFrame:
    """All unique keys of one table checked in one aggregation.

    ``GROUPING SETS`` expands each row once per key and aggregates them
    together: one scan and one shuffle per table instead of one per key.  A
    group with a NULL part is dropped afterwards — within its own grouping
    set such a group can only come from rows whose key really is NULL, which
    SQL uniqueness exempts.  The per-set choice is one CASE over
    ``grouping_id`` (not one filtered branch per set, which the optimizer
    would push below the aggregate and so re-scan the table per key).
    """
    if len(key_sets) == 1:
        return duplicate_keys(df, table, key_sets[0])
    cols = sorted({c for ks in key_sets for c in ks})

    def gid_of(ks):  # grouping_id bit is 1 for each column aggregated away (leftmost = highest bit)
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in ks)

    def case(values):  # SQL text: one expression per table, built without JVM round-trips
        return "CASE " + " ".join(f"WHEN __gid = {gid_of(ks)} THEN {v}" for ks, v in zip(key_sets, values)) + " END"

    present = case([" AND ".join(f"`{c}` IS NOT NULL" for c in ks) for ks in key_sets])
    names = case([f"'{','.join(ks)}'" for ks in key_sets])
    text = case(["to_json(array(" + ", ".join(f"CAST(`{c}` AS STRING)" for c in ks) + "))" for ks in key_sets])
    agg = (df.groupingSets([list(ks) for ks in key_sets], *cols)
             .agg(F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("__gid")))
    return agg.filter(f"n_rows > 1 AND ({present})").selectExpr(
        f"'{table}' AS table_name", f"{names} AS key_columns", f"{text} AS key_value", "n_rows")


def unique_violations(tables, names=None) -> DataFrame:
    """Primary keys and UNIQUE constraints of every table (H1)."""
    return _union([duplicate_keys_sets(tables[t], t, [("id",)] + schemas.UNIQUE.get(t, []))
                   for t in names or schemas.TABLES])


def partial_unique_violations(tables) -> DataFrame:
    """Partial unique indexes, e.g. (trip, seat) where a seat is given (H2)."""
    return _union([duplicate_keys(tables[t], t, cols, where)
                   for t, cols, where in schemas.PARTIAL_UNIQUE])


def orphans(tables, fk: schemas.ForeignKey) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row (H3, detail)."""
    child, parent = tables[fk.child], tables[fk.parent].select(F.col("id").alias("__pid"))
    c = child.filter(F.col(fk.column).isNotNull())
    return c.join(parent, c[fk.column] == parent["__pid"], "left_anti")


def reference_summary(tables) -> DataFrame:
    """Per foreign key: non-NULL references checked and orphans found (H3).

    Each column is read once, by tasks of its own: ids that others refer to, and
    references.  Ids and references to one (parent, value) meet in a single
    aggregation whose counts are partial before the exchange, so a parent that
    a third of all rows refer to is one row a task on the wire, and a task holds
    the values of one column.  A reference that nothing uses has a row too.
    """
    slot, slots = {}, 0
    for fk in schemas.FOREIGN_KEYS:
        slot[fk] = sum(other.parent == fk.parent for other in slot)
        slots = max(slots, slot[fk] + 1)
    columns = [(t, "id", t, -1) for t in schemas.TABLES if schemas.children_of(t)]
    columns += [(fk.child, fk.column, fk.parent, i) for fk, i in slot.items()]
    whole = all(isinstance(tables[t].schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for t, c, _, _ in columns)
    frames = [tables[t].filter(F.col(c).isNotNull()).select(F.lit(p).alias("parent"), F.col(c).cast("long" if whole else "string").alias("value"),
                                                            F.lit(i).alias("slot")) for t, c, p, i in columns]
    met = _union(frames).groupBy("parent", "value").agg(
        F.max(F.col("slot") == -1).alias("there"), *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(slots)])
    sums = met.groupBy("parent").agg(*[F.sum(F.col(f"n{i}")).alias(f"n{i}") for i in range(slots)],
                                     *[F.sum(F.when(~F.col("there"), F.col(f"n{i}"))).alias(f"o{i}") for i in range(slots)])
    declared = F.array(*[F.struct(F.lit(fk.child).alias("table_name"), F.lit(fk.column).alias("column_name"),
                                  F.lit(fk.parent).alias("parent_table"), F.lit(i).alias("slot")) for fk, i in slot.items()])
    keys = tables.spark.range(1).select(F.inline(declared))

    def of_slot(kind):
        return F.coalesce(F.get(F.array(*[F.col(f"{kind}{i}") for i in range(slots)]), F.col("slot")), F.lit(0)).cast("long")

    return keys.join(sums, keys.parent_table == sums.parent, "left").select(
        "table_name", "column_name", "parent_table", of_slot("n").alias("n_refs"), of_slot("o").alias("n_orphans"))


def null_profile(tables, names=None) -> DataFrame:
    """NULL counts of every NOT NULL column, one pass per table, stacked (H4);
    a column that the table lacks is NULL in every row."""
    frames = []
    for t in names or schemas.TABLES:
        cols, there = schemas.not_null_columns(t), tables[t].columns
        agg = tables[t].agg(*[F.count_if(F.col(c).isNull() if c in there else F.lit(True)).alias(c) for c in cols])
        stack = "stack({n}, {pairs}) AS (column_name, n_null)".format(
            n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
        frames.append(agg.selectExpr(f"'{t}' AS table_name", stack))
    return _union(frames)


def domain_profile(tables, names=None) -> DataFrame:
    """Values outside their enum domain, and char(n) values of another length (H5);
    ``n_bad`` is NULL for a column that the table lacks."""
    frames = []
    for t in names or schemas.TABLES:
        df = tables[t]
        checks = []
        for c in schemas.TABLES[t]:
            x = F.col(c.name)
            if c.enum:
                checks.append((c.name, f"enum:{c.enum}", F.count_if(x.isNotNull() & ~x.isin(ENUMS[c.enum]))
                               if c.name in df.columns else F.lit(None).cast("long")))
            if c.char_len:
                checks.append((c.name, f"char({c.char_len})", F.count_if(x.isNotNull() & (F.length(x) != c.char_len))
                               if c.name in df.columns else F.lit(None).cast("long")))
        if not checks:
            continue
        agg = df.agg(*[n.alias(f"c{i}") for i, (_, _, n) in enumerate(checks)])
        stack = "stack({n}, {rows}) AS (column_name, rule, n_bad)".format(
            n=len(checks), rows=", ".join(f"'{n}', '{r}', c{i}" for i, (n, r, _) in enumerate(checks)))
        frames.append(agg.selectExpr(f"'{t}' AS table_name", stack))
    return _union(frames)


def enum_violations(df: DataFrame, column: str, enum: str) -> DataFrame:
    """Rows whose enum column holds a value outside the domain (text → enum is an error)."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(ENUMS[enum]))


def decimal_fit(df: DataFrame, table: str, column: str, precision: int, scale: int) -> DataFrame:
    """Values that do not fit ``numeric(precision, scale)`` (H6): one row summary."""
    target = f"decimal({precision},{scale})"
    x = F.col(column)
    return df.agg(
        F.count(x).alias("n_values"),
        F.count_if(x.isNotNull() & F.expr(f"try_cast(`{column}` AS {target})").isNull()).alias("n_overflow"),
    ).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
             F.lit(target).alias("target_type"), "n_values", "n_overflow")


def decimal_profile(tables, names=None) -> DataFrame:
    """``decimal_fit`` of every declared numeric column; one that the table lacks has no values."""
    return _union([decimal_fit(tables[t] if c.name in tables[t].columns else tables[t].withColumn(c.name, F.lit(None).cast(c.dtype)),
                               t, c.name, c.dtype.precision, c.dtype.scale)
                   for t in names or schemas.TABLES for c in schemas.decimal_columns(t)])


def seat_train_mismatch(tables) -> DataFrame:
    """Tickets whose seat's carriage belongs to another train than the trip's (H7).

    Not a database rule, but the report shows both paths side by side.
    """
    t = tables["tickets"].filter(F.col("seat_id").isNotNull()).select("ticket_ref", "trip_id", "seat_id")
    trips = tables["trips"].select(F.col("id").alias("tr_id"), F.col("train_id").alias("trip_train_id"))
    seats = tables["seats"].select(F.col("id").alias("s_id"), F.col("carriage_id"))
    car = tables["carriages"].select(F.col("id").alias("c_id"), F.col("train_id").alias("seat_train_id"))
    j = (t.join(trips, t.trip_id == trips.tr_id, "inner")
          .join(seats, t.seat_id == seats.s_id, "inner")
          .join(car, F.col("carriage_id") == car.c_id, "left"))
    return j.filter(~F.col("seat_train_id").eqNullSafe(F.col("trip_train_id"))).select(
        "ticket_ref", "seat_train_id", "trip_train_id")
