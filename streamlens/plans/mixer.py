"""Mixing: the layouts asked for, what each changes, and what each tick shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.operators.cells import DEFAULT_CELL_SECONDS
from streamlens.operators.layout import explode_streams, last_of_duplicates
from streamlens.operators.requests import SUCCESS, respond


def accepted_requests(
    requests: DataFrame, time: str = "ts", cell_seconds: int = DEFAULT_CELL_SECONDS
) -> DataFrame:
    """The mix requests that start a task or update a running one; refused ones change nothing."""
    # one column, so that requests may have a code or a message of their own
    whole = requests.select("req_id", time, "body", F.struct(*requests.columns).alias("_request"))
    answers = respond(whole, "mix", time=time, cell_seconds=cell_seconds, keep=["_request"])
    return answers.filter(F.col("code") == SUCCESS).select("_request.*")


def layouts_of_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """The layout rows of accepted mix requests that carry ``task_id`` and ``ver``."""
    lists = requests.select(
        "task_id", "ver", F.get_json_object(body, "$.streams").alias("streams")
    )
    return last_of_duplicates(explode_streams(lists))
