"""Answers that are kept, and providers that fail."""

from pyspark.sql import functions as F

from filescope.operators import asking

HISTORY = "array<struct<role:string,content:string>>"


def test_prompts_are_asked_once_and_failures_are_columns(spark, tmp_path):
    log = str(tmp_path / "asked")

    def provider(system, prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "credit":
            raise asking.OutOfCredit
        if prompt == "busy":
            raise asking.Busy
        if prompt == "broken":
            raise ValueError("x" * 500)
        return f"{system}:{prompt}"

    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "credit"), (6, "busy"), (7, "broken"), (8, "")]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(3)
    out, kept = asking.answered(df, "s", provider)
    got = {r["id"]: (r["answer"], r["error"]) for r in out.collect()}
    assert got == {1: ("s:a", None), 2: ("s:a", None), 3: ("s:b", None), 4: (None, "no prompt"), 5: (None, "no credit"), 6: (None, "busy"), 7: (None, "failed: " + "x" * 300), 8: ("s:", None)}
    first = open(log).read().split("\n")
    assert first.count("a") == first.count("b") == 1 and first.count("busy") == asking.TRIES
    again, more = asking.answered(df.unionByName(spark.createDataFrame([(9, "new")], "id long, prompt string")), "s", provider, kept)
    assert {r["id"]: r["answer"] for r in again.collect()} == {k: v for k, (v, _) in got.items()} | {9: "s:new"}
    then = open(log).read().split("\n")
    assert then.count("a") == then.count("b") == then.count("new") == 1 and then.count("credit") == 2
    assert more.count() == 4 and kept.count() == 3


def test_a_busy_provider_is_asked_again():
    calls = []

    def provider(system, prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise asking.Busy
        return "at last"

    assert asking.ask(provider, "s", "p") == ("at last", None, 3) and asking.ask(provider, "s", "p", 1) == ("at last", None, 1)


def test_limits_of_questions(spark):
    said = lambda n, role="user", size=1: [(role, "x" * size)] * n
    rows = [("n", "t", "q", []), ("n", "t", "", []), ("n", "t", None, []), ("n", "t", "q" * 2001, []), ("n" * 301, "t", "q", []), ("n", "t" * 201, "q", []), ("n", "t", "q", said(21)), ("n", "t", "q", said(1, "system")), ("n", "t", "q", said(2, size=4001)), ("n" * 300, "t" * 200, "q" * 2000, said(20, "assistant", 4000)), (None, None, "q", None)]
    df = spark.createDataFrame(rows, f"name string, kind string, question string, history {HISTORY}")
    got = [r[0] for r in df.select(asking.refused(*map(F.col, df.columns))).collect()]
    assert got == [None, "no question", "no question", "question too long", "name too long", "type too long", "too many messages", "message of another role", "message too long", None, None]
