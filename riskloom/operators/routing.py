"""Which stage of the pipeline a transaction reached, and the events it gave off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed
from riskloom.functions.risk import timed_out
from riskloom.functions.text import fill_template, quoted_list

STAGES = ["sanitize", "detect", "explain", "evaluate"]
_RESULT_OF = {"detect": "detection", "explain": "explanation", "evaluate": "evaluation"}
_KEEP_NULLS = {"ignoreNullFields": "false"}


def injection_error(injection: Column) -> Column:
    """Error text of an injection hit; null where there is none."""
    shown = F.replace(injection["pattern"], F.lit("\\"), F.lit("\\\\"))
    text = fill_template(fixed.INJECTION_ERROR, source=injection["source"], pattern=shown)
    return F.when(injection.isNotNull(), text)


def ungrounded_error(names: Column) -> Column:
    return F.when(F.size(names) > 0, fill_template(fixed.UNGROUNDED_ERROR, names=quoted_list(names)))


def route(df: DataFrame, *, streamed: bool = False) -> DataFrame:
    """First failing stage and its error; results of that stage and of later ones become null.

    Takes one nullable error text per stage (``sanitize_error`` ...) and, as far as present,
    the nested results. A failing judge leaves the run completed in a batch, but not in a
    stream of stage events.
    """
    errors = {s: F.col(f"{s}_error") for s in STAGES}
    stage = F.coalesce(*[F.when(e.isNotNull(), F.lit(s)) for s, e in errors.items()])
    out = df.withColumns({"error_stage": stage, "error": F.coalesce(*errors.values())})
    reached = F.lit(True)
    nulled: dict[str, Column] = {}
    for s in STAGES:
        reached = reached & errors[s].isNull()
        result = _RESULT_OF.get(s)
        if result in df.columns:
            nulled[result] = F.when(reached, F.col(result))
    completed = F.lit(True) if not streamed else F.col("error_stage").isNull()
    return out.withColumns(nulled).withColumn("completed", completed)


def result_record(failed: bool = True) -> Column:
    """The response record of a routed row, with or without its error."""
    none = F.lit(None).cast("string")
    return F.struct(
        "transaction_id",
        "completed",
        F.col("detection").alias("detection_result"),
        F.col("explanation").alias("explanation_result"),
        F.col("evaluation").alias("eval_result"),
        F.col("error") if failed else none.alias("error"),
        F.col("error_stage") if failed else none.alias("error_stage"),
    )


def result_json(routed: DataFrame) -> DataFrame:
    """One JSON text per transaction with every field present, null or not."""
    return routed.select("transaction_id", F.to_json(result_record(), _KEEP_NULLS).alias("result"))


def stage_events(routed: DataFrame) -> DataFrame:
    """The ordered events of each transaction, one row per event.

    Takes rows routed with ``streamed=True``. At most six events arise per row, from an
    array built in place: no shuffle, so the same plan runs on a stream.
    """
    failed = F.col("error_stage")

    def event(seq: int, name: str, data: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event"), data.alias("data")))

    def past(stage: str) -> Column:
        """No failure up to and including the stage."""
        return failed.isNull() | ~failed.isin(*STAGES[: STAGES.index(stage) + 1])

    error = F.to_json(F.struct("error", "error_stage"), _KEEP_NULLS)
    as_json = lambda c: F.to_json(F.col(c), _KEEP_NULLS)
    events = F.array(
        event(1, "sanitize", F.lit('{"status":"ok"}'), past("sanitize")),
        event(2, "detection", as_json("detection"), past("detect")),
        event(3, "explanation", as_json("explanation"), past("explain")),
        event(4, "evaluation", as_json("evaluation"), past("evaluate") & F.col("evaluation").isNotNull()),
        event(5, "error", error, failed.isNotNull()),
        # A failed evaluation does not reach the state that the last event shows.
        event(6, "complete", F.to_json(result_record(failed=False), _KEEP_NULLS), past("explain")),
    )
    return routed.select("transaction_id", F.explode(F.array_compact(events)).alias("e")).select(
        "transaction_id", "e.seq", "e.event", "e.data"
    )


def classify_timeouts(df: DataFrame) -> DataFrame:
    """Per stage whether a recorded duration or message counts as a timeout.

    Takes ``stage``, ``duration_seconds`` and ``message``. Detection runs over strictly above
    its limit; the two remote calls count from the limit on, or by their message.
    """
    d, m = F.col("duration_seconds"), F.col("message")
    late = (
        F.when(F.col("stage") == "detect", d > fixed.DETECTION_LIMIT_S)
        .when(F.col("stage") == "explain", timed_out(d, m, fixed.EXPLANATION_LIMIT_S))
        .when(F.col("stage") == "evaluate", timed_out(d, m, fixed.EVALUATION_LIMIT_S))
    )
    return df.withColumn("timed_out", F.coalesce(late, F.lit(False)))
