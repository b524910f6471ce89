"""Queries whose reference sites return every row give every row, in the reference's order."""

import datetime

import pytest

from veladura.plans.catalogue import QUERIES

N = 300
PRIORITIES = ["3-MEDIUM", "1-URGENT", None, "2-HIGH"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    day = lambda i: None if i % 7 == 0 else datetime.datetime(1997, 1, 1) + datetime.timedelta(days=i * 37 % 90)
    orders = [(i, "O", PRIORITIES[i % 4], day(i)) for i in range(N)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp").repartition(3).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(N)], "c_custkey long").repartition(3).write.parquet(f"{at}/customer.parquet")
    spent = [(i, "purchase", float(i * 31 % 50)) for i in range(0, N, 2)] + [(1, "login", 5.0), (2, "purchase", 1.5)]
    events = [(*r, datetime.datetime(1998, 1, 1)) for r in spent]
    spark.createDataFrame(events, "user_id long, event_type string, value double, ts timestamp").write.parquet(f"{at}/events.parquet")
    return at, orders, spent


def test_filter_in(spark, small):
    at, orders, _ = small
    got = QUERIES["filter_in_whole"](spark, at).collect()
    assert sorted(r.o_orderkey for r in got) == [k for k, _, p, _ in orders if p in ("1-URGENT", "2-HIGH")]


def test_left_join_balance(spark, small):
    at, _, spent = small
    balance = {}
    for user, kind, value in spent:
        if kind == "purchase":
            balance[user] = balance.get(user, 0) + value
    want = sorted(range(N), key=lambda i: (i not in balance, -balance.get(i, 0), i))
    assert [(r.c_custkey, r.balance) for r in QUERIES["left_join_balance_whole"](spark, at).collect()] == [(i, balance.get(i)) for i in want]


def test_case_rank_order(spark, small):
    at, orders, _ = small
    rank = {"1-URGENT": 0, "2-HIGH": 1}
    want = sorted(orders, key=lambda o: (rank.get(o[2], 2), o[3] is None, o[3] or datetime.datetime.min, o[0]))
    assert [r.o_orderkey for r in QUERIES["case_rank_order_whole"](spark, at).collect()] == [o[0] for o in want]


def test_unusual_ip_holds_the_whole_history(spark, tmp_path):
    """An address seen before 20 others of the user isn't unusual; failures and the row itself don't count."""
    kinds = ["first", *(f"ip{i}" for i in range(20)), "first", "error", "error", "new"]
    rows = [(i, 1, k, datetime.datetime(1998, 1, 1, i)) for i, k in enumerate(kinds[:24])] + [(24, 1, "new", datetime.datetime(1998, 1, 2))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.unusual for r in QUERIES["unusual_ip"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in (0, 1, 20, 21, 22, 24)] == [False, True, True, False, True, True]
