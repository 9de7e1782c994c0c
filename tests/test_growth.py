"""What the findings of round 3 asked of growth: calls to the state store, and what exchanges and tasks carry."""

import datetime as dt
from types import SimpleNamespace as Row

import pytest
from pyspark.sql import functions as F

from railyard.operators import quality as DQ
from railyard.plans.report import ticket_report
from railyard.sources import stored
from railyard.sources.adapter import StarAdapter
from railyard.sources.ranged import RangedTable
from railyard.streaming.job_feed import _Gap, _Monitor


class Handle:
    """A state store that counts its calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _call(self):
        self.calls += 1

    def exists(self):
        self._call()
        return self.value is not None

    def get(self):
        self._call()
        return self.value

    def update(self, value):
        self._call()
        self.value = tuple(value)

    def updateValue(self, *_):
        self._call()

    def clear(self):
        self._call()
        self.value = None

    def registerTimer(self, at):
        self._call()
        self.timers.append(at)


def _run(processor, rows, key=("j",)):
    handle = Handle()
    processor.init(handle)
    return list(processor.handleInputRows(key, iter(rows), None)), handle


def test_a_job_costs_no_call_per_poll():
    def poll(hour, seen, ended=False):
        return Row(at_us=hour * 3_600_000_000 - 1, seen=seen, event_id=hour if seen else None, status="Running" if seen else None, ended=ended)
    hours = [poll(h, 10 <= h < 200) for h in range(1, 220)]
    out, handle = _run(_Gap(86400), hours[::-1])
    assert [(r.job_name, r.missing_at_us, r.event_id) for r in out] == [("j", 200 * 3_600_000_000 - 1, 199)]
    assert handle.calls <= 3 and len(handle.timers) == 1
    # ended: no longer watched; and again after the tombstone, within one trigger
    out, handle = _run(_Gap(86400), [poll(1, True, True), poll(2, False), poll(20, True), poll(21, False), poll(30, True), poll(31, False)])
    assert [r.event_id for r in out] == [30]
    assert handle.value[2] == (31 * 3_600_000_000 - 1) // 1000 + 86_400_000


def test_an_unchanged_job_costs_one_call():
    def point(ts, status="Running"):
        return Row(ts_us=ts, event_id=ts, status=status, active=1, succeeded=0, failed=0, completion_us=None)
    processor = _Monitor(30, 86400)
    out, handle = _run(processor, [point(1), point(2)])
    assert len(out) == 1 and handle.calls == 2
    assert list(processor.handleInputRows(("j",), iter([point(3)]), None)) == [] and handle.calls == 3
    assert len(list(processor.handleInputRows(("j",), iter([point(4, "Succeeded")]), None))) == 2
    assert list(processor.handleExpiredTimer(("j",), None, None)) == [] and handle.value[:7] == (None,) * 7
    assert list(processor.handleInputRows(("j",), iter([point(5)]), None)) == []
    list(processor.handleExpiredTimer(("j",), None, None))
    assert handle.value is None


@pytest.fixture
def lines(spark, tmp_path):
    """Line items of which some pairs of order and line repeat, and customers."""
    day = dt.datetime(1998, 1, 1)
    rows = [(o, o * 3 + n, o % 7, n, 10.5 * n + k, day + dt.timedelta(days=o % 90)) for o in range(1, 80) for n in range(1, 8) for k in range(1 + (o % 5 == 0))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz") \
         .write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(11).write.parquet(str(tmp_path / "customer.parquet"))
    return StarAdapter(spark, str(tmp_path))


def test_tickets_are_put_in_order_before_their_columns_are_made(spark, lines, tmp_path, monkeypatch):
    rows, columns, tasks = lines.narrow("tickets")
    assert len(rows.columns) == 7 and tasks == () and lines.narrow("bookings") is None
    plain = lines["tickets"]
    kept = stored.StoredDomain(lines, str(tmp_path / "dom"))["tickets"]
    assert kept.columns == [*plain.columns, "issue_month"] and kept.count() == 79 * 7
    assert sorted(map(repr, kept.drop("issue_month").collect())) == sorted(map(repr, plain.collect()))
    assert kept.filter(F.date_format("issued_at", "yyyy-MM") != F.col("issue_month")).count() == 0
    # one exchange of the line items: their pairs are not gathered in a map before it
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    # a table of more rows than the session's tasks should hold gets more
    monkeypatch.setattr("railyard.sources.tables.ROWS_A_TASK", 10)
    assert lines.narrow("tickets")[2] == (66,)
    again = stored.StoredDomain(lines, str(tmp_path / "more"))["tickets"]
    assert sorted(map(repr, again.collect())) == sorted(map(repr, kept.collect()))


def test_an_upsert_derives_its_changes_once(spark, tmp_path):
    stored_rows = RangedTable(spark, str(tmp_path / "t"), spark.range(0).selectExpr("id", "0 as v").schema, "id", ranges=8)
    stored_rows.create(spark.range(200).selectExpr("id", "0 as v"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    changes = spark.range(100, 300).selectExpr("id", "1 as v").mapInArrow(count, "id long, v int")
    assert stored_rows.upsert(changes, F.lit(0)) == list(range(8))
    assert seen.value == 200
    assert sorted((r.id, r.v) for r in stored_rows.read().collect()) == [(i, int(i >= 100)) for i in range(300)]


def test_tickets_are_joined_with_large_sides_before_small_ones_widen_them(spark, seed):
    plan = ticket_report(seed)._jdf.queryExecution().analyzed().toString().splitlines()
    at = {key: next(i for i, line in enumerate(plan) if "Join " in line and f"= {key}#" in line) for key in ("tr_id", "f_id", "s_id", "p_id", "b_id")}
    # an outer join stands above an inner one in the plan's text
    assert at["tr_id"] < min(at["f_id"], at["s_id"], at["p_id"], at["b_id"])


def test_a_task_of_the_reference_summary_holds_one_column(spark, seed):
    plan = DQ.reference_summary(seed)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate inline") == 1          # the declared keys


def test_a_carried_text_goes_to_the_task_once(spark):
    L = pytest.importorskip("railyard.llm.langid")
    words = {"en": "the house and the garden of this man", "de": "das haus und der garten von diesem mann"}
    rows = [(i, f"{words[lang]} {i}", lang) for i in range(40) for lang in words] + [(90, None, None), (91, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    carried = L.identify(docs, model, carry=docs.columns)
    assert carried._jdf.queryExecution().analyzed().child().output().size() == 3
    got = sorted((r.doc_id, r.carried.text or "", r.held_out, r.lang_pred, r.score) for r in carried.collect())
    plain = sorted((r.doc_id, r.carried.text or "", r.held_out, r.lang_pred, r.score) for r in L.identify(docs, model, carry=["lang", "text"]).collect())
    assert got == plain and sorted((d, h, p, s) for d, _, h, p, s in got) == sorted(
        (r.doc_id, r.held_out, r.lang_pred, r.score) for r in L.identify(docs, model).collect())


def test_a_carried_text_is_exchanged_once_for_the_suffix_order(spark):
    X = pytest.importorskip("railyard.llm.suffix_dedup")
    passage = "a passage that stands in several of the documents and is longer than a hundred bytes, \u00e9 included, to its very end "
    rows = [(i, f"{i} {passage}{i * 7919}", "s") for i in range(12)] + [(3, f"3 {passage}{3 * 7919}", "t"), (50, None, "s"), (51, "", None), (None, passage, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    carried = X.suffix_array_dedup(docs, carry=docs.columns, whole_characters=True)
    assert " AS text#" not in carried._jdf.queryExecution().analyzed().toString()

    def found(df):
        return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept, r.document) for r in df.collect()), key=str)
    got = found(carried)
    assert got == found(X.suffix_array_dedup(docs, whole_characters=True)) and len(got) == len(rows) and sum(r[2] for r in got) > 1000
    assert sorted(((r.carried.doc_id, r.carried.text, r.carried.source) for r in carried.collect()), key=str) == sorted(rows, key=str)
