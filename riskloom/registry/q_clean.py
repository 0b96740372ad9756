"""Queries: sources, cleaning, joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.functions.numbers import round_even
from riskloom.operators import clean as C
from riskloom.operators.join import (
    assemble_results, identity_coverage, join_identity, price_calls, scenarios_with_detections, ungrounded_citations,
)
from riskloom.operators.encode import feature_columns, score_features
from riskloom.operators.explain import parse_responses
from riskloom.operators.costs import call_records
from riskloom.plans.load_clean import clean_tables
from riskloom.registry import bindings as b
from riskloom.registry.core import query
from riskloom.registry.oracle_bindings import rounded
from riskloom.session import shared_folder
from riskloom.sources.call_log import append_calls, scan_calls
from riskloom.sources.scenarios import scan_scenarios
from riskloom.sources.splits import read_split, write_split
from riskloom.sources.transactions import lookup_transaction, sample_rows, scan_identity, scan_transactions


def _fresh(spark, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _written_csv(spark, df) -> str:
    path = _fresh(spark, "csv")
    df.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return path


def merged(spark, d):
    return join_identity(b.f_txn(spark, d), b.f_ident(spark, d))


def cleaned(spark, d):
    return clean_tables(b.f_txn(spark, d), b.f_ident(spark, d))


@query("scan_transactions", "f_txn", oracle="""
SELECT CAST(TransactionID AS VARCHAR) AS TransactionID, isFraud, TransactionAmt, ProductCD, card1, card4, card6,
  CAST(addr1 AS VARCHAR) AS addr1,
  CASE WHEN P_emaildomain NOT IN ('nan', '') THEN P_emaildomain END AS P_emaildomain,
  CASE WHEN R_emaildomain <> 'NaN' THEN R_emaildomain END AS R_emaildomain
FROM f_txn""")
def _(spark, d):
    """The table is put out as CSV first, with a column nobody wants."""
    return scan_transactions(spark, _written_csv(spark, b.f_txn(spark, d).withColumn("other", F.lit("x"))))


@query("scan_identity", "f_ident", oracle="""
SELECT CAST(TransactionID AS VARCHAR) AS TransactionID, DeviceType,
  CASE WHEN DeviceInfo <> 'nan' THEN DeviceInfo END AS DeviceInfo FROM f_ident""")
def _(spark, d):
    return scan_identity(spark, _written_csv(spark, b.f_ident(spark, d).withColumn("id_01", F.lit(0))))


@query("write_split", "f_txn", oracle="""
SELECT CAST(TransactionID AS VARCHAR) AS TransactionID, isFraud, CASE WHEN TransactionID % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM f_txn""")
def _(spark, d):
    """Both parts are put out and read back."""
    path = _fresh(spark, "split")
    rows = b.f_txn(spark, d).select(F.col("TransactionID").cast("string").alias("TransactionID"), "isFraud", (F.col("TransactionID") % 3 == 0).alias("test"))
    write_split(rows.filter("NOT test").drop("test"), rows.filter("test").drop("test"), path)
    train, test = read_split(spark, path)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("scan_scenarios", "f_scenarios", oracle="""
SELECT id, transaction_id, target_audience, expected_eval_passed, expected_overall_score_min, explanation_must_contain,
  explanation_must_not_contain, CAST(NULL AS VARCHAR) AS "DeviceInfo" FROM f_scenarios""")
def _(spark, d):
    """Scenarios are put out as JSON arrays of a thousand, one for each file."""
    path, rows = _fresh(spark, "scenarios"), b.f_scenarios(spark, d)
    names = ["id", "transaction_id", "target_audience", "expected_eval_passed", "expected_overall_score_min", "explanation_must_contain", "explanation_must_not_contain"]
    each = rows.withColumn("chunk", F.floor(F.col("transaction_id").cast("bigint") / 4000))
    arrays = each.groupBy("chunk").agg(F.to_json(F.collect_list(F.struct(*names))).alias("value"))
    arrays.write.partitionBy("chunk").text(path)
    return scan_scenarios(spark, f"{path}/*").select(*names, "DeviceInfo")


@query("sample_rows", "f_txn", oracle="""
SELECT TransactionID, isFraud, TransactionAmt FROM f_txn
ORDER BY md5('42:' || CAST(TransactionID AS VARCHAR)), TransactionID LIMIT 500""")
def _(spark, d):
    """A sample of 500 rows is the feature itself."""
    return sample_rows(b.f_txn(spark, d), 500).select("TransactionID", "isFraud", "TransactionAmt")


@query("scan_call_log", "records", oracle="""
SELECT transaction_id, phase, agent_name, model, tier, input_tokens, output_tokens, cost_usd, duration_seconds, budget_breached
FROM records WHERE phase = 'phase_3'""")
def _(spark, d):
    path = _fresh(spark, "calls")
    append_calls(call_records(b.f_calls(spark, d)), path)
    return scan_calls(spark, path, "phase_3").drop("timestamp", "confidence", "passed")


@query("lookup_transaction", "f_txn", oracle="SELECT TransactionID, TransactionAmt, isFraud FROM f_txn WHERE TransactionID = 1234")
def _(spark, d):
    return lookup_transaction(b.f_txn(spark, d), "1234").select("TransactionID", "TransactionAmt", "isFraud")


@query("clean_enums", "merged", oracle="""
SELECT TransactionID,
  CASE WHEN lower(trim(card4)) IN ('discover','mastercard','visa','american express') THEN lower(trim(card4)) END AS card4,
  CASE WHEN lower(trim(card6)) IN ('credit','debit') THEN lower(trim(card6)) END AS card6,
  CASE WHEN lower(trim(DeviceType)) IN ('desktop','mobile') THEN lower(trim(DeviceType)) END AS DeviceType FROM merged""")
def _(spark, d):
    return C.clean_enums(merged(spark, d)).select("TransactionID", "card4", "card6", "DeviceType")


@query("filter_product", "f_txn", oracle="""
SELECT TransactionID, upper(trim(ProductCD)) AS ProductCD FROM f_txn WHERE upper(trim(ProductCD)) IN ('W','H','C','S','R')""")
def _(spark, d):
    return C.filter_product(b.f_txn(spark, d)).select("TransactionID", "ProductCD")


@query("coerce_numeric", "f_txn", oracle="""
SELECT TransactionID, TRY_CAST(card1 AS DOUBLE) AS card1, CAST(addr1 AS DOUBLE) AS addr1 FROM f_txn""")
def _(spark, d):
    return C.coerce_numeric(b.f_txn(spark, d)).select("TransactionID", "card1", "addr1")


@query("filter_amount", "f_txn", oracle="""
SELECT TransactionID, TransactionAmt FROM f_txn WHERE TransactionAmt > 0 OR TransactionAmt IS NULL""")
def _(spark, d):
    return C.filter_amount(b.f_txn(spark, d)).select("TransactionID", "TransactionAmt")


@query("clean_text", "merged", oracle="""
SELECT TransactionID,
  CASE WHEN trim(P_emaildomain) NOT IN ('nan','NaN','') THEN left(trim(P_emaildomain), 256) END AS P_emaildomain,
  CASE WHEN trim(R_emaildomain) NOT IN ('nan','NaN','') THEN left(trim(R_emaildomain), 256) END AS R_emaildomain,
  CASE WHEN trim(DeviceInfo) NOT IN ('nan','NaN','') THEN left(trim(DeviceInfo), 256) END AS DeviceInfo FROM merged""")
def _(spark, d):
    return C.clean_text(merged(spark, d)).select("TransactionID", "P_emaildomain", "R_emaildomain", "DeviceInfo")


@query("id_to_string", "f_txn", oracle="SELECT CAST(TransactionID AS VARCHAR) AS TransactionID, isFraud FROM f_txn")
def _(spark, d):
    return C.id_to_string(b.f_txn(spark, d)).select("TransactionID", "isFraud")


@query("amount_log", "f_txn", oracle=f"""
SELECT TransactionID, {rounded('ln(1 + TransactionAmt)', 6)} AS TransactionAmt_log FROM f_txn
WHERE TransactionAmt > 0 OR TransactionAmt IS NULL""")
def _(spark, d):
    df = C.amount_log(C.filter_amount(b.f_txn(spark, d)))
    return df.select("TransactionID", round_even(F.col("TransactionAmt_log"), 6).alias("TransactionAmt_log"))


@query("email_match", "cleaned", oracle="SELECT TransactionID, email_domain_match FROM cleaned")
def _(spark, d):
    return cleaned(spark, d).select("TransactionID", "email_domain_match")


@query("missing_count", "cleaned", oracle="SELECT TransactionID, missing_count FROM cleaned")
def _(spark, d):
    return cleaned(spark, d).select("TransactionID", "missing_count")


_CLEANED = f"""SELECT TransactionID, isFraud, TransactionAmt, ProductCD, card1, card4, card6, addr1, P_emaildomain,
  R_emaildomain, DeviceType, DeviceInfo, {rounded('TransactionAmt_log', 6)} AS TransactionAmt_log,
  email_domain_match, missing_count FROM cleaned"""


@query("load_clean", "cleaned", oracle=_CLEANED)
def load_clean(spark, d):
    return cleaned(spark, d).withColumn("TransactionAmt_log", round_even(F.col("TransactionAmt_log"), 6))


@query("feature_columns", "cleaned", oracle=f"""
SELECT TransactionAmt, ProductCD, card1, card4, card6, addr1, DeviceType, {rounded('TransactionAmt_log', 6)} AS TransactionAmt_log,
  email_domain_match, missing_count FROM cleaned""")
def _(spark, d):
    df = load_clean(spark, d)
    return df.select(*feature_columns(df))


@query("score_features", "cleaned", oracle=f"""
SELECT TransactionID, TransactionAmt, card1, addr1, {rounded('TransactionAmt_log', 6)} AS TransactionAmt_log,
  email_domain_match, missing_count FROM cleaned""")
def _(spark, d):
    plain = clean_tables(b.f_txn(spark, d), b.f_ident(spark, d), features=False)
    return score_features(plain).select(
        "TransactionID", "TransactionAmt", "card1", "addr1",
        round_even(F.col("TransactionAmt_log"), 6).alias("TransactionAmt_log"), "email_domain_match", "missing_count",
    )


@query("redact_secrets", "f_secret", oracle="""
SELECT doc_id, replace(text, 'sk-test-0123456789', '[REDACTED]') AS text FROM f_secret""")
def _(spark, d):
    return C.redact_secrets(b.f_secret(spark, d), "text", [b.SECRET, "short", ""])


@query("join_identity", "merged", oracle="SELECT TransactionID, TransactionAmt, DeviceType, DeviceInfo FROM merged")
def _(spark, d):
    return merged(spark, d).select("TransactionID", "TransactionAmt", "DeviceType", "DeviceInfo")


@query("identity_coverage", "merged", oracle="""
SELECT count(*) AS transactions, count(DeviceType) AS with_identity FROM merged""")
def _(spark, d):
    return identity_coverage(merged(spark, d))


@query("price_calls", "priced", oracle=f"SELECT call_id, model, {rounded('raw_cost_usd', 10)} AS cost FROM priced")
def _(spark, d):
    priced = price_calls(b.f_calls(spark, d))
    return priced.select("call_id", "model", round_even(F.col("raw_cost_usd"), 10).alias("cost"))


@query("scenarios_with_detections", "f_scenarios", "f_det", oracle="""
SELECT s.transaction_id, s.id, d.fraud_probability,
  s.id IN ('GS-004','GS-005','GS-008') OR d.transaction_id IS NULL AS skipped,
  CASE WHEN s.id IN ('GS-004','GS-005','GS-008') THEN 'out of scope' WHEN d.transaction_id IS NULL THEN 'no detection' END AS skip_reason
FROM f_scenarios s LEFT JOIN (SELECT * FROM f_det WHERE fraud_probability <= 1) d USING (transaction_id)""")
def _(spark, d):
    """Detections that break the probability rule are left out, so some scenarios have none."""
    usable = b.f_det(spark, d).filter("fraud_probability <= 1")
    return scenarios_with_detections(b.f_scenarios(spark, d), usable).select(
        "transaction_id", "id", "fraud_probability", "skipped", "skip_reason"
    )


@query("assemble_results", "cleaned", "f_det", "f_expl", "scored", oracle="""
SELECT t.TransactionID AS transaction_id, d.fraud_probability, e.target_audience,
  CASE WHEN e.explanation_generated THEN v.g END AS grounding_score
FROM cleaned t LEFT JOIN f_det d ON d.transaction_id = t.TransactionID
LEFT JOIN f_expl e ON e.transaction_id = t.TransactionID LEFT JOIN scored v ON v.transaction_id = t.TransactionID""")
def _(spark, d):
    from riskloom.operators.scoring import clamp_scores, generated_only

    explanations = b.f_expl(spark, d)
    judged = generated_only(explanations).select("transaction_id").join(clamp_scores(b.f_scores(spark, d)), "transaction_id")
    ids = cleaned(spark, d).select(F.col("TransactionID").alias("transaction_id"))
    wide = assemble_results(ids, b.f_det(spark, d), explanations, judged)
    return wide.select(
        "transaction_id", "detection.fraud_probability", "explanation.target_audience", "evaluation.grounding_score"
    )


@query("ungrounded_citations", "f_resp", "f_attr", oracle="""
SELECT c.transaction_id, c.feature_name FROM
  (SELECT transaction_id, unnest(cited_features) AS feature_name FROM f_resp WHERE parsed) c
WHERE NOT EXISTS (SELECT 1 FROM f_attr a WHERE a.transaction_id = c.transaction_id AND a.feature_name = c.feature_name)""")
def _(spark, d):
    return ungrounded_citations(parse_responses(b.f_resp(spark, d)).filter("parsed"), b.f_attr(spark, d))
