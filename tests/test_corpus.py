from pyspark.sql import functions as F

from sievework.operators import corpus


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def strings(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def test_scenarios_depend_on_the_index_only(spark):
    dims = {"place": ["a", "b"], "kind": ["x", "y", "z"]}
    whole = {r["index"]: (r.place, r.kind) for r in corpus.scenarios(spark, 0, 12, 1, dims).collect()}
    part = {r["index"]: (r.place, r.kind) for r in corpus.scenarios(spark, 1, 4, 3, dims).collect()}
    assert part == {k: whole[k] for k in (1, 4, 7, 10)}
    assert len(set(whole.values())) == 6


def test_unfinished_shards(spark):
    shards = spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "shard int, size int")
    done = spark.createDataFrame([(0,), (0,), (1,)], "shard int")
    assert [r.shard for r in corpus.unfinished(shards, done, "shard", "size").collect()] == [1]


def test_coercion_and_softening(spark):
    output = F.lit('{"a": ["x"], "b": "y", "c": 3, "d": 1}')
    assert [one(spark, corpus.coerced_list(output, f)) for f in "abcz"] == [["x"], ["y"], [], []]
    assert one(spark, corpus.coerced_text(output, "d")) == "1"
    assert one(spark, corpus.soften(F.lit("- You MUST  go, must stay -"), (("must", "should"), ("should stay", "may stay")), 20)) == "You should go, may s"


def test_corrections(spark):
    assert one(spark, corpus.removed_cards(strings("R1", "R2", "R3"), strings("R2"), {"R1": "C9", "R3": "C1"})) == ["C1", "C9"]
    assert one(spark, corpus.corrected_cards(strings("C1", "C2", "C9"), strings("C1", "C9"), F.lit("C9"), strings("C4", "C3"))) == ["C2", "C9", "C3", "C4"]
    assert one(spark, corpus.corrected_cues(strings("Repeat vitals", "skin"), strings("repeat VITALS", "skin"), strings("Skin"))) == ["skin"]
    df = spark.createDataFrame([(1, 1, None, "x"), (2, 3, "y", "y")], "a int, b int, c string, d string")
    assert tuple(corpus.changed_counts(df, {"n": ("a", "b"), "s": ("c", "d")}).first()) == (1, 1, 2)


def test_rows_and_masks(spark):
    made = corpus.training_row(F.lit("k"), F.lit("q"), F.lit(" "), {"v": F.lit("v1")})
    row = one(spark, made)
    assert [m.role for m in row.messages] == ["user", "assistant"] and row.metadata.v == "v1"
    assert one(spark, corpus.row_issues(made["messages"], F.lit(""))) == ["blank_content", "missing_id"]
    prompt, answer = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (7, 8)))
    assert tuple(one(spark, corpus.masked_tokens(prompt, answer, 4))) == ([2, 3, 7, 8], [-100, -100, 7, 8])


def test_triage(spark):
    df = spark.createDataFrame([(1, True, True, False), (2, False, True, False), (3, True, False, False), (4, False, None, True)], "id int, model boolean, harness boolean, held boolean")
    got = {r.id: (r.repair_scopes, r.seed_type, r.kept) for r in corpus.triage(df, {"model": "obs", "harness": "cite"}, ("model",), F.col("held")).collect()}
    assert got == {1: ([], "replay", True), 2: (["obs"], "repair", True), 3: (["cite"], "harness_only", False), 4: (["obs"], "embargoed", False)}
