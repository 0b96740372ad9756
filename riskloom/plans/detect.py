"""Detections for a table of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.operators.attribution import topk_attributions, with_attributions
from riskloom.operators.encode import align, score_features
from riskloom.operators.train import decide, score_batch
from riskloom.session import spread
from riskloom.sources.models import StoredModel


def detect(
    transactions: DataFrame,
    model: StoredModel,
    *,
    k: int = fixed.TOP_K,
    threshold: float = fixed.FRAUD_THRESHOLD,
    attributions: bool = True,
) -> DataFrame:
    """One detection record per transaction; without attributions the list is empty.

    Encoding, scoring and decision are JVM expressions; one Arrow stage adds attributions. The
    rows are dealt out once, before they are encoded.
    """
    row_id = F.col(fixed.ROW_ID).cast("string").alias("transaction_id")
    prepared = score_features(spread(transactions)).withColumn("transaction_id", row_id)
    matrix = align(prepared, model.features, "transaction_id")
    scored = score_batch(model.pipeline, matrix, model.features)
    if attributions and model.leaves:
        keep = ["transaction_id", "fraud_probability", *model.features]
        scored = topk_attributions(with_attributions(scored, model.features, model.leaves, keep), model.features, k)
    else:
        empty = "array<struct<feature_name:string,shap_value:double,feature_value:string,feature_number:double>>"
        scored = scored.withColumn("top_shap_features", F.array().cast(empty))
    return decide(scored, threshold).select(
        "transaction_id", "fraud_probability", "is_fraud_predicted", "top_shap_features",
        F.lit(model.version).alias("model_version"), F.lit(None).cast("double").alias("inference_latency_ms"), "confidence_tier",
    )
