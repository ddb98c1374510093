"""Tool outcomes from the results handed back to the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import messages, outcome, text
from spanloom.plans.digest import digest


def tool_results(nodes: DataFrame) -> DataFrame:
    """``(session_id, tool_use_id, is_error, text)``; of several results the last one counts.

    The last is told by references alone (time and id of the inference, then place); only the message that holds it is
    read for its text.
    """
    refs = digest(nodes, ("session_id", "start_time_ns")).select("session_id", "start_time_ns", "id", F.explode("results").alias("r"))
    order = F.struct("start_time_ns", "id", "r.at", "r.pos")
    last = refs.groupBy("session_id", F.col("r.use_id").alias("tool_use_id")).agg(F.max_by(F.struct("id", "r"), order).alias("w"))
    wanted = last.groupBy(F.col("w.id").alias("id")).agg(
        F.collect_list(F.struct("session_id", "tool_use_id", "w.r.at", "w.r.pos", "w.r.is_error")).alias("wanted")
    )
    read = nodes.select("id", "request_messages").join(wanted, "id").select("request_messages", F.inline("wanted"))
    message = F.get("request_messages", F.col("at"))
    raw = F.get(messages.blocks_of(message), F.col("pos"))
    return read.select("session_id", "tool_use_id", "is_error", messages.result_text(raw).alias("text"))


def attach_outcomes(nodes: DataFrame) -> DataFrame:
    """Fill the outcome columns of tool nodes; calls without a result keep nulls."""
    columns = nodes.columns
    failed = F.col("r_is_error")
    results = tool_results(nodes).select(
        "session_id",
        "tool_use_id",
        F.col("is_error").alias("r_is_error"),
        F.col("text").alias("r_text"),
        F.lit(True).alias("r_found"),
    )
    # Calls without an id never match, so they stay out of the join and its one null partition.
    called = F.expr("type = 'tool' and tool_use_id is not null")
    joined = nodes.filter(called).join(results, ["session_id", "tool_use_id"], "left")
    failure = joined.withColumn("r_failure", F.when(failed, F.col("r_text"))).drop(
        "is_error", "error_kind", "output_size", "error_message"
    )
    classed = outcome.with_error_kind(failure, "r_failure", "error_kind")
    done = (
        outcome.with_error_message(classed, "r_failure", "error_message")
        .withColumn("is_error", failed)
        .withColumn("output_size", F.when(F.col("r_found"), text.utf16_length(F.col("r_text"))))
        .select(*columns)
    )
    return done.unionByName(nodes.filter(~F.coalesce(called, F.lit(False))))
