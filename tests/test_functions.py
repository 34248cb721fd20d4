import pytest
from pyspark.sql import functions as F

from sievework.functions import jsontext, sets, severity, text, urls
from sievework.operators import audio, policies


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def texts(spark, column, *rows):
    return values(spark, column(F.col("t")) if callable(column) else column, [(r,) for r in rows], "t string")


def test_tokens_and_normalizers(spark):
    assert texts(spark, text.normalize, "  A-b, c!", None) == ["a b c", ""]
    assert texts(spark, text.squeeze, " A_b--c  d. ") == ["a b c d."]
    assert texts(spark, text.query_terms, "a bb BB c1") == [["bb", "bb", "c1"]]
    assert texts(spark, text.grounding_tokens, "The allergies reported: vitals, glasses gas pains") == [["allergy", "glasse", "gas", "pain"]]
    assert texts(spark, text.cue_tokens, "Vitals signs breaths gas cuts") == [["vital", "sign", "breathing", "gas", "cut"]]
    assert texts(spark, lambda T: text.occurrences(T, F.lit("aa")), "aaaa", "aaa", "b") == [2, 1, 0]
    assert texts(spark, lambda T: text.compact(T, 10), "a |  b", "x" * 30) == ["a \\| b", "x" * 9 + "…"]
    assert texts(spark, text.spoken_number, "twenty three", "forty", "many", "") == [23, 40, None, None]
    assert texts(spark, text.slug, "Not OK: a/b") == ["not_ok_a_b"]


def test_snippet(spark):
    long = "x" * 100 + " pain " + "y" * 100
    assert texts(spark, lambda T: text.snippet(T, "pain"), long)[0] == "x" * 39 + " pain " + "y" * 39
    assert texts(spark, lambda T: text.snippet(T, "none"), "z" * 300)[0] == "z" * 120


def test_ages(spark):
    assert texts(spark, text.age_in_years, "8 months", "30 mo", "17 years", "42", "3 weeks", "adult", None) == [0, 2, 17, 42, 0, None, None]
    assert texts(spark, text.is_minor, "17", "18 y", "x") == [True, False, False]


def test_severity_has_three_null_rules(spark):
    rows = [("urgent", "monitor"), ("monitor", "urgent"), ("odd", "routine"), ("urgent", "odd"), ("urgent", None), (None, "urgent")]
    a, b = F.col("a"), F.col("b")
    assert values(spark, severity.at_least(a, b), rows, "a string, b string") == [True, False, False, True, True, False]
    assert values(spark, severity.meets_expected(a, b), rows, "a string, b string") == [True, False, False, False, None, False]
    assert values(spark, severity.strictly_at_least(a, b), rows, "a string, b string") == [True, False, False, False, False, False]
    assert values(spark, severity.highest(F.array(a, b)), rows, "a string, b string") == ["urgent", "urgent", "routine", "urgent", "urgent", "urgent"]


def test_sets(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], ["a"]), (["A", "a", "B"], ["x"])]
    a, b = F.col("a"), F.col("b")
    schema = "a array<string>, b array<string>"
    assert values(spark, F.round(sets.jaccard(a, b), 4), rows, schema) == [0.3333, 0.0, 0.0]
    assert values(spark, sets.containment(a, b), rows, schema) == [0.5, None, 0.0]
    assert values(spark, sets.missing(b, a), rows, schema) == [["c"], ["a"], ["x"]]
    assert values(spark, sets.distinct_ignoring_case(a), rows, schema) == [["a", "b"], [], ["A", "B"]]
    assert values(spark, sets.priority_first(a, ["b", "z"]), rows, schema) == [["b", "a"], [], ["A", "a", "B"]]


def test_open_json(spark):
    assert texts(spark, jsontext.extract_object, 'say {bad {"a": 1} x', '{"b": 2}', "none", None) == ['{"a": 1}', '{"b": 2}', None, None]
    assert texts(spark, jsontext.joined_strings, '{"a": ["x", {"b": "y"}], "c": 1}') == ["x\ny"]
    assert texts(spark, lambda T: jsontext.has_path(T, "a.1.b"), '{"a": [0, {"b": null}]}', '{"a": []}') == [True, False]
    assert texts(spark, lambda T: jsontext.scrub(T, ("audio",), ("file",), ((r"\d{3,}", "#"),)), '{"audio_raw": 1, "file": "x", "k123": ["v4567"]}') == ['{"file": null, "k#": ["v#"]}']
    assert texts(spark, jsontext.content_hash, '{"b":1,"a":2}', '{"a": 2, "b": 1}', "{")[0:2] == texts(spark, jsontext.content_hash, '{"a":2,"b":1}') * 2
    assert texts(spark, jsontext.message_content, '{"content": "x"}', '{"content": [{"text": "a"}, "b"]}', '{"content": {"text": "c"}}', "{}") == ["x", "a\nb", "c", None]


def test_urls(spark):
    assert texts(spark, urls.normal_url, " host:80/ ", "https://a//", "") == ["http://host:80", "https://a", None]
    found = texts(spark, urls.host_class, "http://127.0.0.1:8", "http://localhost", "http://10.2.3.4", "http://172.32.0.1", "http://169.254.1.1", "http://box.local", "http://a.example", "", "http://192.168.300.1")
    assert found == ["loopback", "loopback", "private", "public_ip", "link_local", "mdns", "dns", "none", "none"]
    assert texts(spark, urls.safe_message, "at https://x.example/k?t=1 Bearer abc.def") == ["at [url] Bearer [token]"]
    assert texts(spark, urls.event_data, "data: {1}", "data: [DONE]", "event: x") == ["{1}", None, None]


def test_audio_lifecycle(spark):
    keywords = (("fever", "symptoms", "fever"), ("cough", "symptoms", "cough"), ("pulse", "vitals", "pulse told"))
    rows = [("a", "A forty two year old with cough and fever, pulse 90", None, None), ("b", None, "She is 8 months old", None), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "id string, provider_transcript string, typed_transcript string, canned_transcript string").withColumn("provider_fields", F.lit(None).cast(audio.SUGGESTION))
    found = {r.id: r for r in audio.draft(df, keywords).collect()}
    assert [(s.field, s.draft_value) for s in found["a"].drafts] == [("patient_age", "42 years"), ("symptoms", "fever"), ("vitals", "pulse told")]
    assert found["b"].source == "typed" and found["b"].drafts[0].draft_value == "8 months" and found["c"].source == "unprocessed" and found["c"].drafts == []
    edits, rejected = F.create_map(F.lit("symptoms"), F.lit("dry cough")), F.array(F.lit("vitals"))
    done = audio.draft(df, keywords).where("id = 'a'").withColumn("done", audio.confirm(F.col("drafts"), edits, rejected))
    r = done.select("done", audio.waiting(F.col("drafts")).alias("w"), audio.waiting(F.col("done")).alias("d"), audio.merged_field(F.col("done"), "symptoms", F.lit(None)).alias("s"), audio.merged_field(F.col("done"), "vitals", F.lit(None)).alias("v")).first()
    assert [s.status for s in r.done] == ["accepted", "edited", "rejected"] and r.w and not r.d and r.s == "dry cough" and r.v is None


@pytest.mark.parametrize(("version", "expected"), [("v2", ("v2",)), ("v1", ("v1",)), ("odd", ("v1",)), ("v4_x", ("v4", "v3")), ("v11p", ("v11", "v10", "v9", "v8", "v7", "v6", "v3")), ("field_workflow_holdout_v1", ("field_workflow_holdout", "v3"))])
def test_version_lattice(version, expected):
    assert policies.policies_of(version) == expected


def test_policies(spark):
    rows = [(["check pulse", "monitor closely", "monitor it", "keep monitoring"], ["Check  pulse", "monitor closely", "monitor it", "keep monitoring"], "no pulse oximeter here", ["C1"], "C2")]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, supplies string, cards array<string>, target string")
    a, b = F.col("a"), F.col("b")
    own = (
        policies.Policy("v3", (("generic", policies.mostly_generic(a, "monitor")),)),
        policies.Policy("v6", (("same_lists", policies.same_long_lists(a, b)),)),
        policies.Policy("v2", (("never", F.lit(True)),)),
    )
    r = df.select(policies.issues(own, "v7").alias("v7"), policies.issues(own, "v3").alias("v3")).first()
    assert r.v7 == ["v3:generic", "v6:same_lists"] and r.v3 == ["v3:generic"]
    vector, total, passed = policies.rewards({"x": F.lit(True), "y": F.lit(None).cast("boolean")})
    assert tuple(df.select(total, passed).first()) == (1, False)
    key = df.select(policies.rejection_key(F.lit(None).cast("string"), F.lit("Below Floor: x"))).first()[0]
    assert key == "below_floor_x"
    attributes = spark.createDataFrame([('{"uuid": "u1", "metadata": {"failure_class": "f", "task_type": " "}}',)], "t string").select(*(c.alias(n) for n, c in policies.candidate_attributes(F.col("t")).items())).first()
    assert (attributes.case_id, attributes.category, attributes.task_type) == ("u1", "f", "unknown")
