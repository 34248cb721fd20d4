"""Model calls: order, retries, one call a prompt, bounded concurrency; retrieval gaps by policy."""

import os
from collections import Counter

from pyspark.sql import functions as F

from sievework.operators import model_calls, policies, recovery


def slow_and_failing(folder):
    """Fails twice for prompts that end in f, always for those in x; leaves a file for each call, and how many ran at a time."""

    def call(prompt):
        import threading
        import time
        import uuid

        mine = os.path.join(folder, f"run-{os.getpid()}-{threading.get_ident()}")
        open(mine, "w").close()
        running = sum(n.startswith(f"run-{os.getpid()}-") for n in os.listdir(folder))
        before = sum(n.startswith(f"call-{prompt}-") for n in os.listdir(folder))
        open(os.path.join(folder, f"call-{prompt}-{running}-{uuid.uuid4().hex}"), "w").close()
        time.sleep(0.01 * (hash(prompt) % 5))
        os.remove(mine)
        if prompt.endswith("x") or prompt.endswith("f") and before < 2:
            raise TimeoutError(f"no answer to {prompt}")
        if prompt.endswith("b"):
            raise ValueError("bad prompt")
        return prompt.upper()

    return call


def test_replies_in_order_one_call_a_prompt(spark, tmp_path):
    prompts = [f"p{k % 7}" for k in range(40)] + ["af", "cx", "db", None, "af"]
    df = spark.createDataFrame(list(enumerate(prompts)), "k int, prompt string").coalesce(1).withColumns({"reply": F.lit("old"), "odd `name`": F.lit(1)})
    rows = model_calls.with_replies(df, slow_and_failing(str(tmp_path)), concurrency=3, window=8, wait=0.001).collect()
    assert [r.k for r in rows] == list(range(45)) and {r["odd `name`"] for r in rows} == {1}
    assert [r.reply for r in rows[:40]] == [p.upper() for p in prompts[:40]]
    assert [(r.reply, r.reply_calls) for r in rows[40:]] == [("AF", 3), (None, 3), (None, 1), (None, 0), ("AF", 0)]
    assert rows[41].reply_error == "TimeoutError: no answer to cx" and rows[42].reply_error == "ValueError: bad prompt" and rows[0].reply_error is None
    calls = [n.split("-") for n in os.listdir(tmp_path) if n.startswith("call-")]
    assert Counter(c[1] for c in calls) == {**{f"p{k}": 1 for k in range(7)}, "af": 3, "cx": 3, "db": 1}
    assert 1 < max(int(c[2]) for c in calls) <= 3


def test_without_a_model(spark):
    df = spark.createDataFrame([(1, "p", "had")], "k int, prompt string, reply string")
    assert tuple(model_calls.with_replies(df, None).first()) == (1, "p", "had", None, 0)
    assert model_calls.with_replies(df.drop("reply"), None).first().reply is None
    assert model_calls.with_replies(df.where("false"), str.upper).collect() == []


def test_calls_serve_recovery(spark):
    records = spark.createDataFrame([(1, '{"protocol_urgency":"odd"}', ["protocol_urgency is missing or invalid"])], "id int, output string, failures array<string>")
    respond = lambda turns: model_calls.with_replies(turns.withColumn("prompt", F.concat(F.lit("repair "), "scope")), lambda p: '{"protocol_urgency":"urgent"}')
    found = recovery.repair_rounds(records, recovery.plan_turns(records, "id"), "id", respond).first()
    assert found.repaired == {"protocol_urgency": '"urgent"'} and found.events == []


def test_retrieval_gap(spark):
    rows = [(1, ["A", "B"], ["A", " B", "", None], ["A"]), (2, ["A"], ["C", "B"], ["D"]), (3, ["A"], [], ["Z", "A", "Y"]), (4, ["A"], ["Z"], ["Z"])]
    df = spark.createDataFrame(rows, "k int, retrieved array<string>, fired array<string>, wanted array<string>")
    gap = lambda v: {r.k: r.g and (r.g.reason.split("_")[0], r.g.missing) for r in df.select("k", policies.retrieval_gap(v, F.col("retrieved"), F.col("fired"), F.col("wanted")).alias("g")).collect()}
    assert gap("v3") == {1: None, 2: ("rule", ["B", "C"]), 3: ("target", ["Y", "Z"]), 4: ("rule", ["Z"])}
    assert gap("v6") == gap("v5") == {1: None, 2: ("target", ["D"]), 3: ("target", ["Y", "Z"]), 4: None}
