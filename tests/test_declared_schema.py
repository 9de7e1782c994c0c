"""The plans run on the declared domain model: string (uuid-style) keys, declared types."""

import datetime as dt

from pyspark.sql import functions as F

from railyard import schemas
from railyard.operators import quality as DQ
from railyard.plans import report as R
from railyard.plans.window import Window
from railyard.sources.tables import ParquetDomain, write_domain


def _as_declared(df, table):
    cols = []
    for c in schemas.TABLES[table]:
        if c.name in df.columns:
            e = F.col(c.name)
            if c.dtype == schemas.S and dict(df.dtypes)[c.name] != "string":
                e = F.concat(F.lit(f"{table[:3]}-"), e.cast("string")) if c.name == "id" else e
            cols.append(e.cast(c.dtype).alias(c.name))
    return df.select(*cols)


def _uuidish(df, table):
    # foreign keys must carry the parent's key format
    out = _as_declared(df, table)
    for fk in schemas.FOREIGN_KEYS:
        if fk.child == table and fk.column in out.columns:
            out = out.withColumn(fk.column, F.when(F.col(fk.column).isNotNull(),
                                                   F.concat(F.lit(f"{fk.parent[:3]}-"), F.col(fk.column))))
    return out


def test_report_on_declared_schema(spark, seed, tmp_path):
    root = str(tmp_path / "domain")
    conv = seed.with_overrides(**{t: _uuidish(seed[t], t) for t in schemas.TABLES})
    write_domain(conv, root)
    pq = ParquetDomain(spark, root, declared_schema=True)
    assert dict(pq["tickets"].dtypes)["id"] == "string"
    assert pq["tickets"].first()["booking_id"].startswith("boo-")
    rep = R.ticket_report(pq, Window(dt.date(2024, 5, 10), dt.date(2024, 5, 10))).collect()
    assert len(rep) == 20 and sum(r.paid_amount for r in rep) == 2900
    assert DQ.seat_train_mismatch(pq).count() == 16
    assert all(r.n_orphans == 0 for r in DQ.reference_summary(pq).collect())
