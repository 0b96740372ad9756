"""Explicit schemas of the record types the operators exchange."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _B, _I, _L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()

RAW_TRANSACTION = _struct(
    TransactionID=_S, isFraud=_I, TransactionAmt=_D, ProductCD=_S, card1=_S,
    card4=_S, card6=_S, addr1=_S, P_emaildomain=_S, R_emaildomain=_S,
)
RAW_IDENTITY = _struct(TransactionID=_S, DeviceType=_S, DeviceInfo=_S)

TRANSACTION = _struct(
    TransactionID=_S, TransactionAmt=_D, ProductCD=_S, card1=_D, card4=_S, card6=_S,
    addr1=_D, P_emaildomain=_S, R_emaildomain=_S, DeviceType=_S, DeviceInfo=_S,
)

# The raw value may be a number or a text: both renderings travel together.
ATTRIBUTION = _struct(feature_name=_S, shap_value=_D, feature_value=_S, feature_number=_D)

DETECTION = _struct(
    transaction_id=_S, fraud_probability=_D, is_fraud_predicted=_B,
    top_shap_features=T.ArrayType(ATTRIBUTION), model_version=_S,
    inference_latency_ms=_D, confidence_tier=_S,
)

EXPLANATION = _struct(
    transaction_id=_S, target_audience=_S, fraud_probability=_D, is_fraud_predicted=_B,
    explanation_text=_S, cited_features=T.ArrayType(_S), uncited_features=T.ArrayType(_S),
    hallucinated_features=T.ArrayType(_S), uncertainty_flag=_B, uncertainty_disclosure=_S,
    explanation_generated=_B, warning=_S, token_cost_usd=_D, generation_latency_seconds=_D,
)

EVALUATION = _struct(
    transaction_id=_S, target_audience=_S, grounding_score=_D, clarity_score=_D,
    completeness_score=_D, audience_appropriateness_score=_D, uncertainty_handling_score=_D,
    overall_score=_D, pass_threshold=_D, passed=_B, failure_reasons=T.ArrayType(_S), token_cost_usd=_D,
)

CALL_RECORD = _struct(
    timestamp=_S, transaction_id=_S, phase=_S, agent_name=_S, model=_S, tier=_S,
    input_tokens=_L, output_tokens=_L, cost_usd=_D, duration_seconds=_D,
    confidence=_D, passed=_B, budget_breached=_B,
)

RESPONSE = _struct(explanation_text=_S, cited_features=T.ArrayType(_S), uncertainty_disclosure=_S)

SCENARIO = _struct(
    id=_S, description=_S, transaction_id=_S, target_audience=_S,
    DeviceInfo=_S, inject_empty_shap=_B, inject_high_token_count=_B, inject_poor_explanation=_S,
    expected_fraud_probability_min=_D, expected_fraud_probability_max=_D,
    expected_confidence_tier=_S, expected_is_fraud=_B, expected_outcome=_S,
    expected_explanation_generated=_B, expected_warning=_S, expected_budget_breached=_B,
    expected_eval_passed=_B, expected_overall_score_min=_D, eval_pass_threshold=_D,
    uncertainty_flag_must_be_true=_B, explanation_must_not_be_generated=_B,
    analyst_explanation_must_contain_features=T.ArrayType(_S),
    analyst_explanation_must_contain=T.ArrayType(_S), analyst_explanation_must_not_contain=T.ArrayType(_S),
    customer_explanation_must_contain=T.ArrayType(_S), customer_explanation_must_not_contain_probability=_B,
    explanation_must_contain=T.ArrayType(_S), explanation_must_not_contain=T.ArrayType(_S),
    disqualifying_hallucinations=T.ArrayType(_S),
)
