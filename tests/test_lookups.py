"""All declared finders, run as batch lookups over the sample data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from railyard.operators.lookups import FINDERS, children, find_by, run_finder


def _keys(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_unique_finders(spark, seed):
    assert run_finder(seed, "BookingRepository.findByBookingRef",
                      _keys(spark, "k string", [("BKG-00000003",), ("BKG-99999999",)])).count() == 1
    assert run_finder(seed, "FareRepository.findByCode", _keys(spark, "k string", [("FIRST-PRM",)])).count() == 1
    assert run_finder(seed, "TicketRepository.findByTicketRef",
                      _keys(spark, "k string", [("TKT-00000019",)])).count() == 1
    assert run_finder(seed, "TrainRepository.findByRegistration",
                      _keys(spark, "k string", [("TRAIN-5",), ("TRAIN-5",)])).count() == 1


@pytest.mark.parametrize("finder,key,n", [
    ("RouteRepository.findByCodeIgnoreCase", "route-2", 1),
    ("StationRepository.findByCodeIgnoreCase", "rOm", 1),
    ("UserAccountRepository.findByEmailIgnoreCase", "USER7@EXAMPLE.ORG", 1),
])
def test_ignore_case(spark, seed, finder, key, n):
    assert run_finder(seed, finder, _keys(spark, "k string", [(key,)])).count() == n


def test_composite(spark, seed):
    assert run_finder(seed, "SeatRepository.findByCarriageIdAndSeatNumber",
                      _keys(spark, "c long, s string", [(0, "1B"), (0, "2A"), (0, "2B")])).count() == 2
    assert run_finder(seed, "SeatReservationRepository.findByTripIdAndSeatId",
                      _keys(spark, "t long, s long", [(1, 1), (1, 2)])).count() == 1
    assert run_finder(seed, "TripRepository.findByRouteIdAndServiceDate",
                      _keys(spark, "r long, d date", [(0, dt.date(2024, 5, 10))])).count() == 1


def test_between_and_status(seed):
    assert run_finder(seed, "TripRepository.findByServiceDateBetween",
                      low=dt.date(2024, 5, 11), high=dt.date(2024, 5, 12)).count() == 2
    assert run_finder(seed, "BookingRepository.findByStatus", value="pending").count() == 4
    assert run_finder(seed, "PaymentRepository.findByStatus", value="completed").count() == 16
    assert run_finder(seed, "TicketRepository.findByStatus", value="reserved").count() == 4


def test_children(spark, seed):
    car = run_finder(seed, "CarriageRepository.findByTrainIdOrderByCarriageNumber",
                     _keys(spark, "id long", [(2,), (0,)])).collect()
    assert [(r.train_id, r.carriage_number) for r in car] == [(0, 1), (0, 2), (0, 3), (0, 4),
                                                                (2, 1), (2, 2), (2, 3), (2, 4)]
    one = _keys(spark, "id long", [(1,)])
    assert run_finder(seed, "PassengerRepository.findByUserId", one).count() == 1
    assert run_finder(seed, "PaymentRepository.findByBookingId", one).count() == 1
    assert run_finder(seed, "SeatRepository.findByCarriageId", one).count() == 20
    assert run_finder(seed, "SeatReservationRepository.findByTripId", one).count() == 4
    assert run_finder(seed, "TicketRepository.findByTripId", one).count() == 4
    assert run_finder(seed, "TicketRefundRepository.findByTicketId", one).count() == 0
    assert run_finder(seed, "AuditLogRepository.findByActorId", one).count() == 0
    assert run_finder(seed, "RouteStopRepository.findByRouteIdOrderByStopSequence", one).count() == 0


def test_finder_table_complete():
    assert len(FINDERS) == 23


def test_repeated_keys_do_not_duplicate_rows(spark, seed):
    keys = _keys(spark, "id long", [(1,)] * 50)
    assert find_by(seed["trips"], keys, ["id"]).count() == 1
    assert children(seed["tickets"], "trip_id", keys).count() == 4
