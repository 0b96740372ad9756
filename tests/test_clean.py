import math

import pytest

from riskloom.operators import clean as C
from riskloom.operators.join import identity_coverage, join_identity
from riskloom.plans.load_clean import load_clean
from riskloom.sources.transactions import (
    SourceMissing, lookup_transaction, sample_rows, scan_identity, scan_identity_if_present, scan_transactions,
)


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_missing_required_source(spark, tmp_path):
    with pytest.raises(SourceMissing):
        scan_transactions(spark, str(tmp_path / "nothing.csv"))
    assert scan_identity_if_present(spark, str(tmp_path / "nothing.csv")) is None


def test_csv_columns_types_and_null_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "Extra,TransactionAmt,TransactionID,isFraud,ProductCD,card1,P_emaildomain\n"
        'x,10.5,1,0,W,13000,"a ""b"", c"\n'
        "y,20,2,1,H,abc,NA\n"
        "z,null,3,0,C,,None\n"
    )
    df = scan_transactions(spark, str(path))
    assert df.columns == ["TransactionID", "isFraud", "TransactionAmt", "ProductCD", "card1", "P_emaildomain"]
    rows = df.orderBy("TransactionID").collect()
    assert [r["TransactionAmt"] for r in rows] == [10.5, 20.0, None]
    assert [r["card1"] for r in rows] == ["13000", "abc", None]
    assert [r["P_emaildomain"] for r in rows] == ['a "b", c', None, None]


def test_identity_columns(spark, tmp_path):
    (tmp_path / "i.csv").write_text("id_01,TransactionID,DeviceInfo,DeviceType\n0,1,Win10,desktop\n")
    assert scan_identity(spark, str(tmp_path / "i.csv")).columns == ["TransactionID", "DeviceType", "DeviceInfo"]


@pytest.mark.parametrize("n, expected", [(10, 10), (1000, 100), (0, 0)])
def test_sample(spark, n, expected):
    df = spark.range(100).withColumnRenamed("id", "TransactionID")
    first = sorted(column(sample_rows(df, n), "TransactionID"))
    assert len(first) == len(set(first)) == expected
    assert first == sorted(column(sample_rows(df.repartition(3), n), "TransactionID"))


def test_lookup(spark):
    df = spark.range(5).withColumnRenamed("id", "TransactionID")
    assert column(lookup_transaction(df, "3"), "TransactionID") == [3]
    assert column(lookup_transaction(df, 9), "TransactionID") == []


def test_enums(spark):
    df = spark.createDataFrame(
        [("VISA", "CREDIT", "Desktop"), ("\tMastercard ", "Debit", "tablet"), ("unknown", "prepaid", None)],
        "card4 string, card6 string, DeviceType string",
    )
    rows = C.clean_enums(df).collect()
    assert [tuple(r) for r in rows] == [("visa", "credit", "desktop"), ("mastercard", "debit", None), (None, None, None)]


def test_product(spark):
    df = spark.createDataFrame([("w",), (" h ",), ("X",), (None,)], "ProductCD string")
    assert column(C.filter_product(df), "ProductCD") == ["W", "H"]


def test_amount_keeps_unknown(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-5.0,), (50.0,), (None,)], "TransactionAmt double")
    assert column(C.filter_amount(df), "TransactionAmt") == [100.0, 50.0, None]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("13000",), ("abc",), ("15000",), (None,)], "card1 string")
    assert column(C.coerce_numeric(df), "card1") == [13000.0, None, 15000.0, None]


def test_text_null_tokens_and_limit(spark):
    df = spark.createDataFrame(
        [("gmail.com",), ("nan",), ("NaN",), ("",), ("  ",), (None,), ("None",), ("A" * 500,), ("\x1c x  ",)], "DeviceInfo string"
    )
    assert column(C.clean_text(df), "DeviceInfo") == [
        "gmail.com", None, None, None, None, None, "None", "A" * 256, "x",
    ]


def test_engineered_columns(spark):
    schema = "TransactionAmt double, P_emaildomain string, R_emaildomain string, card1 double, card4 string, card6 string, addr1 double, DeviceType string"
    df = spark.createDataFrame(
        [
            (100.0, "gmail.com", "gmail.com", 1000.0, "visa", "credit", 100.0, "desktop"),
            (1.0, None, None, None, None, "debit", None, None),
            (None, "gmail.com", "yahoo.com", None, None, None, None, None),
        ],
        schema,
    )
    rows = C.engineer(df).collect()
    assert rows[0]["TransactionAmt_log"] == pytest.approx(math.log1p(100.0))
    assert [r["email_domain_match"] for r in rows] == [1, 0, 0]
    assert [r["missing_count"] for r in rows] == [0, 5, 5]


def test_engineering_skips_absent_columns(spark):
    df = spark.createDataFrame([(None, "visa")], "card1 double, card4 string")
    assert C.engineer(df).columns == ["card1", "card4", "missing_count"]


def test_join_and_coverage(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "TransactionID int")
    i = spark.createDataFrame([(1, "desktop", "x"), (3, None, "y")], "TransactionID int, DeviceType string, DeviceInfo string")
    merged = join_identity(t, i)
    assert merged.count() == 3
    assert tuple(identity_coverage(merged).first()) == (3, 1)
    assert tuple(identity_coverage(join_identity(t, None)).first()) == (3, 0)


def test_load_clean_without_identity(spark, tmp_path):
    (tmp_path / "train_transaction.csv").write_text(
        "TransactionID,isFraud,TransactionAmt,ProductCD,card4\n100,0,10,w,Visa\n101,1,-1,W,visa\n102,0,5,Z,visa\n103,0,,H,amex\n"
    )
    df = load_clean(spark, str(tmp_path))
    assert "DeviceType" not in df.columns
    rows = {r["TransactionID"]: r for r in df.collect()}
    assert set(rows) == {"100", "103"}
    assert rows["103"]["card4"] is None and rows["103"]["missing_count"] == 1


def test_redaction(spark):
    df = spark.createDataFrame([("a sk-12345678 b sk-12345678",), ("short 1234567",)], "text string")
    assert column(C.redact_secrets(df, "text", ["sk-12345678", "1234567", ""]), "text") == [
        "a [REDACTED] b [REDACTED]", "short 1234567",
    ]


def test_filters_move_below_the_join(spark, folder):
    from riskloom.plans.load_clean import clean_tables
    from riskloom.registry import bindings as b

    joined = clean_tables(b.f_txn(spark, folder), b.f_ident(spark, folder))
    lines = joined._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert not any("Filter" in line for line in lines[:join])
    assert any("Filter" in line for line in lines[join:])
