"""Queries: encoding, split, balancing, model, attributions."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.numbers import round_even
from riskloom.operators import attribution as T
from riskloom.operators import train as G
from riskloom.operators.balance import median_impute, nearest_neighbours, synthetic_rows
from riskloom.operators.encode import align, discover_vocabulary, one_hot, score_features
from riskloom.operators.split import split_rates, stratified_split
from riskloom.plans.detect import detect
from riskloom.plans.load_clean import clean_tables
from riskloom.plans.preprocess import preprocess
from riskloom.registry import bindings as b
from riskloom.registry.core import query
from riskloom.registry.oracle_bindings import rounded
from riskloom.session import settle, shared_folder, spread
from riskloom.sources.models import load_model, save_model

_VALUES = {
    "ProductCD": ["C", "H", "R", "S", "W"],
    "card4": ["american express", "discover", "mastercard", "missing", "visa"],
    "card6": ["credit", "debit", "missing"],
    "DeviceType": ["desktop", "missing", "mobile"],
}


def _hot(kind: str = "INT") -> str:
    return ", ".join(
        f"CAST(coalesce({c}, 'missing') = '{v}' AS {kind}) AS \"{c}_{v}\"" for c, values in _VALUES.items() for v in values
    )


def _cleaned(spark, d):
    return clean_tables(b.f_txn(spark, d), b.f_ident(spark, d))


@query("onehot_discover", "cleaned", oracle=f"SELECT TransactionID, {_hot()} FROM cleaned")
def _(spark, d):
    df = settle(_cleaned(spark, d).select("TransactionID", *fixed.CATEGORICAL))
    return one_hot(df, discover_vocabulary(df))


@query("onehot_align", "cleaned", oracle=f"""
SELECT TransactionID, TransactionAmt, CAST(coalesce(card4, 'missing') = 'visa' AS DOUBLE) AS card4_visa, 0e0 AS card4_maestro,
  CAST(coalesce(DeviceType, 'missing') = 'missing' AS DOUBLE) AS "DeviceType_missing", 0e0 AS gone, card1 FROM cleaned""")
def _(spark, d):
    stored = ["TransactionAmt", "card4_visa", "card4_maestro", "DeviceType_missing", "gone", "card1"]
    return align(_cleaned(spark, d), stored, "TransactionID")


_SPLIT = """
sizes AS (SELECT isFraud, count(*) AS k FROM cleaned GROUP BY isFraud),
target AS (SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(k) - ceil(sum(k) * 0.2e0) AS BIGINT) AS nt FROM sizes),
shares AS (SELECT isFraud, k, (k * nt) // n AS low, row_number() OVER (ORDER BY (k * nt) % n DESC, isFraud) AS turn,
    nt - sum((k * nt) // n) OVER () AS spare FROM sizes, target),
quotas AS (SELECT isFraud, k - low - CASE WHEN turn <= spare THEN 1 ELSE 0 END AS quota FROM shares),
parted AS (SELECT TransactionID, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY md5('42:' || TransactionID)) <= quota AS in_test
  FROM cleaned JOIN quotas USING (isFraud))"""


@query("stratified_split", "cleaned", oracle=f"WITH {_SPLIT} SELECT TransactionID, isFraud, in_test FROM parted")
def _(spark, d):
    df = settle(_cleaned(spark, d).select("TransactionID", "TransactionAmt", "isFraud"))
    return stratified_split(df).select("TransactionID", "isFraud", "in_test")


@query("split_rates", "cleaned", oracle=f"""WITH {_SPLIT}
SELECT CASE WHEN in_test THEN 'test' ELSE 'train' END AS part, count(*) AS rows, {rounded('avg(isFraud)', 8)} AS positive_rate
FROM parted GROUP BY in_test""")
def _(spark, d):
    df = settle(_cleaned(spark, d).select("TransactionID", "TransactionAmt", "isFraud"))
    rates = split_rates(stratified_split(df))
    return rates.withColumn("positive_rate", round_even(F.col("positive_rate"), 8))


@query("median_impute", "cleaned", oracle=f"""
SELECT TransactionID, coalesce(TransactionAmt, (SELECT median(TransactionAmt) FROM cleaned)) AS TransactionAmt,
  coalesce(card1, (SELECT median(card1) FROM cleaned)) AS card1, coalesce(addr1, (SELECT median(addr1) FROM cleaned)) AS addr1,
  coalesce(card4, '0') AS card4 FROM cleaned""")
def _(spark, d):
    columns = ["TransactionAmt", "card1", "addr1", "card4"]
    return median_impute(settle(_cleaned(spark, d).select("TransactionID", *columns)), columns)


def _minority(spark, d):
    return b.f_vec(spark, d).withColumn("id", F.col("id").cast("string"))


_NEAR = """
vectors AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, label = 0 AS minority FROM embeddings),
near AS (SELECT a.id, b.id AS neighbour, b.v AS w, list_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.minority AND b.minority)"""


@query("minority_knn", oracle=f"""WITH {_NEAR}
SELECT id, CAST(rank AS INT) AS rank, neighbour, {rounded('distance', 6)} AS distance FROM near WHERE rank <= 5""")
def _(spark, d):
    found = nearest_neighbours(_minority(spark, d).filter("isFraud = 1").select("id", "v"), fixed.NEIGHBOURS)
    return found.withColumn("distance", round_even(F.col("distance"), 6))


@query("minority_knn_lsh")
def _(spark, d):
    """The same neighbours by projection buckets: approximate, distances exact (recall tested against the tree)."""
    found = nearest_neighbours(_minority(spark, d).filter("isFraud = 1").select("id", "v"), fixed.NEIGHBOURS, method="lsh")
    return found.withColumn("distance", round_even(F.col("distance"), 6))


_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("smote", oracle=f"""WITH {_NEAR},
few AS (SELECT id, v, row_number() OVER (ORDER BY md5('42:' || id)) AS turn FROM vectors WHERE minority),
wanted AS (SELECT CAST(floor(count(*) FILTER (NOT minority) * 0.5e0 - count(*) FILTER (minority)) AS BIGINT) AS n,
    count(*) FILTER (minority) AS m FROM vectors),
copies AS (SELECT id, v, unnest(range(1, n // m + CASE WHEN turn <= n % m THEN 2 ELSE 1 END)) AS copy FROM few, wanted),
mixed AS (SELECT c.id || '~' || copy AS id, c.v, near.w, {_HASH.format("'42:gap:' || c.id || ':' || copy")} / 4294967296e0 AS gap
  FROM copies c JOIN near ON near.id = c.id AND near.rank = 1 + {_HASH.format("'42:pick:' || c.id || ':' || copy")} % 5),
cells AS (SELECT id, gap, unnest(v) AS a, unnest(w) AS z, generate_subscripts(v, 1) AS p FROM mixed)
SELECT id, CAST(p - 1 AS INT) AS position, {rounded('a + gap * (z - a)', 6)} AS value FROM cells""")
def _(spark, d):
    made = synthetic_rows(_minority(spark, d))
    return made.select("id", F.posexplode("v").alias("position", "value")).withColumn("value", round_even(F.col("value"), 6))


@query("preprocess", "cleaned", oracle=f"""WITH {_SPLIT},
counts AS (SELECT count(*) FILTER (NOT in_test) AS train, count(*) FILTER (in_test) AS test,
  count(*) FILTER (NOT in_test AND isFraud = 1) AS train_pos, count(*) FILTER (in_test AND isFraud = 1) AS test_pos FROM parted)
SELECT 'test' AS part, test AS rows, test_pos AS positives, 0 AS unfilled_cells FROM counts
UNION ALL SELECT 'train', train, train_pos, 0 FROM counts
UNION ALL SELECT 'training matrix', train + made, train_pos + made, 0 FROM
  (SELECT *, CAST(floor((train - train_pos) * 0.5e0 - train_pos) AS BIGINT) AS made FROM counts)""")
def _(spark, d):
    made = preprocess(_cleaned(spark, d))

    def row(df, part, filled):
        cells = sum((F.col(c).isNull().cast("int") for c in made.features), F.lit(0)) if filled else F.lit(0)
        return df.agg(
            F.lit(part).alias("part"), F.count("*").alias("rows"), F.count_if(F.col(fixed.LABEL) == 1).alias("positives"),
            F.sum(cells).cast("int").alias("unfilled_cells"),
        )

    return (
        row(made.test, "test", False).unionByName(row(made.train, "train", False))
        .unionByName(row(made.training_matrix, "training matrix", True))
    )


@query("class_weight", "cleaned", oracle=f"""
SELECT count(*) FILTER (isFraud = 0) AS negatives, count(*) FILTER (isFraud = 1) AS positives,
  {rounded('count(*) FILTER (isFraud = 0) / CAST(count(*) FILTER (isFraud = 1) AS DOUBLE)', 8)} AS positive_weight FROM cleaned""")
def _(spark, d):
    out = G.class_weights(_cleaned(spark, d))
    return out.withColumn("positive_weight", round_even(F.col("positive_weight"), 8))


@query("auc_roc", "f_txn", oracle=f"""
WITH r AS (SELECT isFraud, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS rank
  FROM (SELECT isFraud, round(abs(TransactionAmt) / 10000) AS s FROM f_txn WHERE TransactionAmt IS NOT NULL))
SELECT {rounded('(sum(rank) FILTER (isFraud = 1) - p * (p + 1) / 2e0) / (p * n)', 6)} AS auc
FROM r, (SELECT count(*) FILTER (isFraud = 1) AS p, CAST(count(*) FILTER (isFraud = 0) AS DOUBLE) AS n FROM r) GROUP BY p, n""")
def _(spark, d):
    """Coarse scores, so that many rows tie."""
    rows = b.f_txn(spark, d).filter("TransactionAmt IS NOT NULL")
    auc = G.auc_roc(rows.select(F.round(F.abs("TransactionAmt") / 10000).alias("s"), fixed.LABEL), "s")
    return spark.createDataFrame([(auc,)], "auc double").select(round_even(F.col("auc"), 6).alias("auc"))


@query("topk_attributions", "ranked_attr", oracle="""
SELECT transaction_id, CAST(rank AS INT) AS rank, feature_name, shap_value, feature_value FROM ranked_attr WHERE rank <= 5""")
def _(spark, d):
    return T.topk_rows(b.f_attr(spark, d)).select("transaction_id", "rank", "feature_name", "shap_value", "feature_value")


# --- the model: trained once per session and table on the whole training part -----------


def _trained(spark, d):
    """Trained anew when the files behind the table change."""
    files = []
    for name in ("orders", "customer", "supplier"):
        at = F.struct("_metadata.file_path", "_metadata.file_modification_time").cast("string").alias("f")
        files += [r["f"] for r in b.table(spark, d, name).select(at).distinct().collect()]
    return _trained_on(spark, d, tuple(sorted(files)))


@lru_cache(maxsize=8)
def _trained_on(spark, d, files):
    made = preprocess(_cleaned(spark, d))
    matrix = made.training_matrix
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    fitted = G.train(matrix, made.features)
    save_model(spark, fitted, made.features, "1.0.0", path)
    return load_model(spark, path), settle(made.test), matrix, fitted


@query("train_gbt", "cleaned", oracle=f"""WITH {_SPLIT},
counts AS (SELECT count(*) FILTER (NOT in_test) AS train, count(*) FILTER (in_test) AS test,
  count(*) FILTER (NOT in_test AND isFraud = 1) AS train_pos, count(*) FILTER (in_test AND isFraud = 1) AS test_pos FROM parted)
SELECT 'test' AS part, test AS rows, test_pos AS positives, true AS sane FROM counts
UNION ALL SELECT 'train', train + made, train_pos + made, true FROM
  (SELECT *, CAST(floor((train - train_pos) * 0.5e0 - train_pos) AS BIGINT) AS made FROM counts)""")
def _(spark, d):
    """Rows seen and held out; the areas must beat chance on what was learned and stay in bounds."""
    model, test, matrix, _ = _trained(spark, d)
    rows = []
    for part, df in (("train", matrix), ("test", test)):
        # Scored once for both areas, each of which takes several passes.
        scored = settle(G.score_batch(model.pipeline, spread(df), model.features).select("fraud_probability", fixed.LABEL))
        roc, pr = G.auc_roc(scored), G.auc_pr(scored)
        negatives, positives = G.class_sizes(scored)
        sane = (roc > 0.5 and pr > positives / (negatives + positives)) if part == "train" else 0 <= roc <= 1 and 0 <= pr <= 1
        rows.append((part, negatives + positives, positives, sane))
    return spark.createDataFrame(rows, "part string, rows long, positives long, sane boolean")


@query("auc_pr", "f_txn", oracle=f"""
WITH s AS (SELECT round(abs(TransactionAmt) / 10000) AS s, count(*) FILTER (isFraud = 1) AS p, count(*) AS n
  FROM f_txn WHERE TransactionAmt IS NOT NULL GROUP BY 1),
c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS seen, CAST(sum(p) OVER () AS DOUBLE) AS positives FROM s WINDOW w AS (ORDER BY s DESC)),
points AS (SELECT s, tp / positives AS recall, tp / CAST(seen AS DOUBLE) AS precision FROM c)
SELECT {rounded('sum((recall - before) * (precision + first) / 2e0)', 6)} AS auc FROM (SELECT recall, precision,
  coalesce(lag(recall) OVER (ORDER BY s DESC), 0e0) AS before, coalesce(lag(precision) OVER (ORDER BY s DESC), precision) AS first FROM points)""")
def _(spark, d):
    """Coarse scores, so that many rows tie; the first precision also holds at recall 0."""
    rows = b.f_txn(spark, d).filter("TransactionAmt IS NOT NULL")
    area = G.auc_pr(rows.select(F.round(F.abs("TransactionAmt") / 10000).alias("s"), fixed.LABEL), "s")
    return spark.createDataFrame([(area,)], "auc double").select(round_even(F.col("auc"), 6).alias("auc"))


def _scored(spark, d):
    """Every cleaned row in the model's encoding, with its probability."""
    model = _trained(spark, d)[0]
    matrix = align(score_features(spread(_cleaned(spark, d))), model.features, "TransactionID")
    return model, G.score_batch(model.pipeline, matrix, model.features)


@query("score_batch", "cleaned", oracle="SELECT TransactionID, true AS in_bounds FROM cleaned")
def _(spark, d):
    scored = _scored(spark, d)[1]
    return scored.select("TransactionID", F.col("fraud_probability").between(0, 1).alias("in_bounds"))


@query("model_save_load", "cleaned", oracle="SELECT TransactionID, true AS same, '1.0.0' AS version FROM cleaned")
def _(spark, d):
    """The stored model gives the probabilities of the one that was trained."""
    model, _, _, fitted = _trained(spark, d)
    matrix = align(score_features(spread(_cleaned(spark, d))), model.features, "TransactionID")
    both = G.score_batch(fitted, G.score_batch(model.pipeline, matrix, model.features).withColumnRenamed("fraud_probability", "stored"), model.features)
    return both.select("TransactionID", (F.col("stored") == F.col("fraud_probability")).alias("same"), F.lit(model.version).alias("version"))


@query("tree_attributions", "cleaned", oracle="SELECT TransactionID, true AS adds_up FROM cleaned")
def _(spark, d):
    """Base value plus attributions must give the log-odds of each row's probability."""
    model, scored = _scored(spark, d)
    out = T.with_attributions(scored, model.features, model.leaves, ["TransactionID", "fraud_probability"])
    total = F.aggregate("shap_values", F.lit(T.base_value(model.leaves)), lambda a, x: a + x)
    odds = F.ln(F.col("fraud_probability") / (1 - F.col("fraud_probability")))
    return out.select("TransactionID", (F.abs(total - odds) < 1e-6).alias("adds_up"))


@query("detect", "cleaned", oracle="""
SELECT TransactionID AS transaction_id, 5 AS entries, true AS in_order, true AS flag_agrees, true AS tier_agrees FROM cleaned""")
def _(spark, d):
    """Decisions against the printed probability: the five strongest entries, in order."""
    out = detect(_cleaned(spark, d), _trained(spark, d)[0])
    sizes = F.transform("top_shap_features", lambda f: F.abs(f["shap_value"]))
    p = F.col("fraud_probability")
    tier = F.when(F.abs(p - 0.5) > 0.3, "high").when((p >= 0.6) | (p < 0.4), "medium").otherwise("low")
    return out.select(
        "transaction_id", F.size("top_shap_features").alias("entries"), (sizes == F.reverse(F.array_sort(sizes))).alias("in_order"),
        (F.col("is_fraud_predicted") == (p >= 0.5)).alias("flag_agrees"), (F.col("confidence_tier") == tier).alias("tier_agrees"),
    )
