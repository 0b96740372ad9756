import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import riskloom.operators.selection as S
from riskloom.operators.quantiles import exact_medians
from riskloom.operators.split import allocate, split_rates, stratified_split


def test_draw_matches_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(S, "_FETCH_AT_MOST", 3)
    df = spark.range(2000).withColumn("g", (F.col("id") % 3).cast("int"))
    out = S.draw(df, {0: 100, 1: 0, 2: 5000}, group="g", seed=7, key="id", flag="f").collect()
    assert len(out) == 2000
    order = sorted(range(0, 2000, 3), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    assert {r["id"] for r in out if r["g"] == 0 and r["f"]} == set(order[:100])
    assert not any(r["f"] for r in out if r["g"] == 1)
    assert all(r["f"] for r in out if r["g"] == 2)


@pytest.mark.parametrize("wanted", [1, 150, 299, 300, 301, 650])
def test_draw_through_a_heap_of_copies(spark, monkeypatch, wanted):
    """One key holds most rows, some of them full copies of each other."""
    monkeypatch.setattr(S, "_COPIES_PER_STEP", 64)
    rows = [(1, "same")] * 300 + [(1, f"v{i}") for i in range(300)] + [(i, "x") for i in range(2, 102)]
    df = spark.createDataFrame(rows, "TransactionID int, what string")
    out = S.draw(df, {0: wanted}, group=None, seed=42, key="TransactionID", flag="f").collect()
    assert Counter((r[0], r[1]) for r in out) == Counter(rows)
    assert sum(r["f"] for r in out) == wanted
    assert S.smallest_by_hash(df, wanted, seed=42, key="TransactionID").count() == wanted


def test_allocation():
    assert allocate({0: 80, 1: 20}, 0.2) == {0: 16, 1: 4}
    assert sum(allocate({0: 83, 1: 7}, 0.3).values()) == 27
    assert allocate({0: 10, 1: 10}, 0.25) == {0: 2, 1: 3} or sum(allocate({0: 10, 1: 10}, 0.25).values()) == 5


def test_split_checks_and_rates(spark):
    rows = [(str(i), float(i), int(i % 10 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "TransactionID string, TransactionAmt double, isFraud int")
    for wrong in (0.0, 1.0):
        with pytest.raises(ValueError):
            stratified_split(df, test_fraction=wrong)
    with pytest.raises(ValueError, match="isFraud"):
        stratified_split(df.drop("isFraud"))
    with pytest.raises(ValueError, match="TransactionID"):
        stratified_split(df.drop("TransactionID"))
    with pytest.raises(ValueError, match="TransactionAmt"):
        stratified_split(df.drop("TransactionAmt"))
    rates = {r["part"]: r for r in split_rates(stratified_split(df, test_fraction=0.3)).collect()}
    assert (rates["train"]["rows"], rates["test"]["rows"]) == (140, 60)
    assert rates["train"]["positive_rate"] == rates["test"]["positive_rate"] == pytest.approx(0.1)


@pytest.mark.parametrize("fetch", [1, 10, 20_000])
def test_exact_medians(spark, fetch):
    import random
    import statistics

    random.seed(1)
    odd = [random.gauss(0, 1) for _ in range(501)]
    hot = [5.0] * 300 + [random.random() for _ in range(201)]
    gaps = [random.choice([None, random.randrange(9)]) for _ in range(501)]
    rows = list(zip(odd, hot, gaps))
    df = spark.createDataFrame(rows, "odd double, hot double, gaps int").withColumn("none", F.lit(None).cast("double"))
    found = exact_medians(df, ["odd", "hot", "gaps", "none"], fetch_at_most=fetch)
    assert found["odd"] == statistics.median(odd)
    assert found["hot"] == statistics.median(hot)
    assert found["gaps"] == statistics.median([g for g in gaps if g is not None])
    assert found["none"] is None
