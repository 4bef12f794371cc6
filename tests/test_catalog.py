"""Every ledger query against its SQL, at the smallest scale."""

import __spark_entry__ as entry
import pytest
from compare import compare

from tidemark.plans import catalog
from tidemark.sources import adapters

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    good, said = compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], TABLES)
    assert good, said


def removed_greedily(spark) -> set:
    rows = sorted((r["txn_id"], r["txn_date"], r["amount"], r["statement"]) for r in adapters.events(spark, TABLES).collect())
    gone: set = set()
    for n, (i, day, amount, account) in enumerate(rows):
        for j, other_day, other, other_account in rows[n + 1 :]:
            if i not in gone and j not in gone and amount == other and amount > 0 and account != other_account and abs((day - other_day).days) <= 2:
                gone |= {i, j}
    return {(i, account) for i, _, _, account in rows if i not in gone}


def reconciled_within_cents(spark) -> list:
    rows = sorted((r["txn_id"], str(r["txn_date"]), r["amount"], r["place"]) for r in adapters.orders(spark, TABLES).collect())
    free, out = [x for x in rows if x[0] % 4], []
    for i, day, amount, place in rows:
        if i % 3:
            hit = next((y for y in free if y[1] == day and abs(y[2] - amount) * 100 <= 1), None)
            if hit:
                free.remove(hit)
            out.append((day, float(amount), "A+B" if hit else "A only"))
    return sorted(out + [(day, float(amount), "B only") for _, day, amount, _ in free])


def test_greedy_queries_agree_with_brute_force(spark):
    run = catalog.queries()
    assert set(run) == set(catalog.oracle_sql())
    assert {(r["txn_id"], r["statement"]) for r in run["transfers_removed_greedy"](spark, TABLES).collect()} == removed_greedily(spark)
    assert sorted((r["txn_date"], r["amount"], r["extraction_method"]) for r in run["reconcile_within_cents"](spark, TABLES).collect()) == reconciled_within_cents(spark)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chrono_sort_all_places_every_order(spark):
    places = [r["place_in_order"] for r in catalog.queries()["chrono_sort_all"](spark, TABLES).collect()]
    assert len(places) > 500 and sorted(places) == list(range(1, spark.read.parquet(f"{TABLES}/orders.parquet").count() + 1))
