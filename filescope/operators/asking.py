"""Asking a model: each prompt once, answers kept by digest, failures as columns, limits of what may be asked.

A provider is a function (system, prompt) -> answer that runs in the tasks. It says that it is busy or out of credit by
raising Busy or OutOfCredit; anything else that it raises is a failure of that prompt. No failure stops a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.sources import shared

# Characters and numbers of what a request may hold.
QUESTION_LIMIT, MESSAGE_LIMIT, NAME_LIMIT, TYPE_LIMIT, MESSAGES_LIMIT = 2_000, 4_000, 300, 200, 20
#: Times that a prompt is asked in a run, when the provider is busy.
TRIES = 3
ANSWER = "answer string, error string, tries int"


class Busy(Exception):
    """Too many requests: the same prompt may be asked again."""


class OutOfCredit(Exception):
    """Nothing more can be asked for now."""


def refused(name: Column, kind: Column, question: Column, history: Column) -> Column:
    """Why a question may not be asked, or null. history is an array of (role, content)."""
    long = lambda column, most: F.coalesce(F.length(column), F.lit(0)) > most
    return (
        F.when(F.coalesce(F.length(question), F.lit(0)) < 1, "no question")
        .when(long(question, QUESTION_LIMIT), "question too long")
        .when(long(name, NAME_LIMIT), "name too long")
        .when(long(kind, TYPE_LIMIT), "type too long")
        .when(F.size(history) > MESSAGES_LIMIT, "too many messages")
        .when(F.exists(history, lambda m: ~m["role"].isin("user", "assistant")), "message of another role")
        .when(F.exists(history, lambda m: F.length(m["content"]) > MESSAGE_LIMIT), "message too long")
    )


def ask(provider: Callable[[str, str], str], system: str, prompt: str, tries: int = TRIES) -> tuple[str | None, str | None, int]:
    """(answer, error, tries) of a prompt: error is `busy`, `no credit` or `failed: ...`, or null."""
    for turn in range(1, tries + 1):
        try:
            return provider(system, prompt), None, turn
        except Busy:
            continue
        except OutOfCredit:
            return None, "no credit", turn
        except Exception as e:  # noqa: BLE001 - a failure of one prompt is that prompt's
            return None, f"failed: {str(e)[:300]}", turn
    return None, "busy", tries


def digest(system: str, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(system), prompt), 256)


def answered(df: DataFrame, system: str, provider: Callable[[str, str], str], kept: DataFrame | None = None, prompt_col: str = "prompt", tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """(df with answer and error, the table of answers to keep): what `kept` (digest, answer) has is not asked again.

    Prompts that are alike are asked once, whatever number of rows has them; a null prompt is not asked and has the error
    `no prompt`. Only answers are kept, so that what failed is asked in the next run. The provider's calls are made while
    this runs, once each, and their outcome is a table in the shared folder.
    """

    @F.pandas_udf(ANSWER)
    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in prompts:
            yield pd.DataFrame([ask(provider, system, p, tries) for p in series], columns=["answer", "error", "tries"])

    own = df.withColumn("_digest", F.when(F.col(prompt_col).isNotNull(), digest(system, F.col(prompt_col))))
    new = own.filter("_digest is not null").select("_digest", F.col(prompt_col).alias("_prompt")).dropDuplicates(["_digest"])
    if kept is not None:
        new = new.join(kept.select(F.col("digest").alias("_known")), F.col("_digest") == F.col("_known"), "left_anti")
    asked = shared.written(new.select(F.col("_digest").alias("digest"), call("_prompt").alias("x")).select("digest", "x.*"))
    outcome = asked.select("digest", "answer", "error")
    good = asked.filter("error is null").select("digest", "answer")
    if kept is not None:
        outcome = outcome.unionByName(kept.select("digest", "answer", F.lit(None).cast("string").alias("error")))
        good = kept.select("digest", "answer").unionByName(good)
    out = own.join(outcome, F.col("_digest") == F.col("digest"), "left").drop("digest")
    out = out.withColumn("error", F.when(F.col("_digest").isNull(), "no prompt").otherwise(F.col("error"))).drop("_digest")
    return out, good
