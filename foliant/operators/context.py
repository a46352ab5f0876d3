"""Retrieval context: the latest search of a session joined to later prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.ordered import ordered


def wants_context(prompt: Column) -> Column:
    return F.contains(F.lower(prompt), F.lit("based on"))


def attach_last_search(
    log: DataFrame,
    session: str,
    order: list[str],
    is_prompt: Column,
    found: Column,
    prompt: Column,
    name: str = "last_search",
    **kw,
) -> DataFrame:
    """Prompts with the result of the session's latest successful search before them.

    ``found`` is the search result of a row, NULL on prompts and on searches without result, so
    those do not overwrite. Prompts that do not ask for it get NULL.
    """
    marked = log.withColumn("_found", found).withColumn("_ask", is_prompt)
    marked = marked.where(F.col("_ask") | F.col("_found").isNotNull())  # other rows say nothing
    carried = ordered(marked, [session], order, **kw).carry("_found", name).rows()
    prompts = carried.where(F.col("_ask")).drop("_found", "_ask")
    return prompts.withColumn(name, F.when(wants_context(prompt), F.col(name)))
