from pyspark.sql import functions as F

from sievework.operators import intake, prompts

SCHEMA = (
    "case_id string, " + ", ".join(f"{f} string" for f in intake.FIELDS) + ", fired array<struct<rule_id:string,label:string,evidence:string,card_id:string>>, "
    "retrieved array<struct<card_id:string,required_observations:array<string>>>"
)


def frame(spark):
    fields = {"symptoms": "cough", "vitals": " "}
    row = ("c1", *(fields.get(f) for f in intake.FIELDS), [("R1", "Rule one", "cough", "C1")], [("C1", ["pulse", "skin"]), ("SAFETY-BOUNDARIES-v1", [])])
    return spark.createDataFrame([row], SCHEMA)


def test_allowed_facts_are_intake_rules_and_cards_in_order(spark):
    got = [tuple(r) for r in prompts.allowed_facts(frame(spark), "case_id").orderBy("ordinal").collect()]
    assert got == [("c1", 0, "intake", "symptoms", "cough"), ("c1", 1, "rule", "R1", "Rule one: cough"), ("c1", 2, "card", "C1", "pulse"), ("c1", 3, "card", "C1", "skin")]


def test_prompt_and_template_hash(spark):
    text, template = prompts.prompt("system text", ("Facts", F.col("symptoms")), ("Notes", F.col("responder_note")))
    other = prompts.prompt("system text", ("Facts", F.lit("other")))[1]
    r = frame(spark).select(text.alias("t"), template.alias("h"), other.alias("o"), prompts.mandatory_cards().alias("m")).first()
    assert r.t == "system text\n\n## Facts\ncough\n\n## Notes\n" and r.h == r.o and len(r.h) == 16
    assert r.m == ["C1", "SAFETY-BOUNDARIES-v1"]


def test_repair_prompts_name_failures_and_fields(spark):
    scopes = spark.createDataFrame([("c1", "schema", ["x must be a list"]), ("c1", "odd", ["y"])], "case_id string, scope string, failures array<string>")
    got = {r.scope: r.prompt for r in prompts.repair_prompts(scopes, F.lit("original"), {"schema": ("x",)}).collect()}
    assert got["schema"] == "original\n\nThese checks failed:\n- x must be a list\n\nReturn JSON with only these fields: x"
    assert got["odd"].endswith("fields: all")


def test_compact_card(spark):
    card = spark.createDataFrame([("C1", "t", ["a", "b", "c"])], "card_id string, title string, red_flags array<string>")
    assert card.select(prompts.compact_card(("red_flags",), 2)).first()[0] == '{"card_id":"C1","title":"t","red_flags":["a","b"]}'
