"""What the pipeline's stages must keep and take out."""

import pytest

pytest.importorskip("sievework.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def prose(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", host, len(t)) for i, t, host in rows], DOCS).repartition(3)


def test_one_of_a_group_of_copies_survives(spark, tmp_path):
    copy = prose(0) + "\n" + prose(1)
    rows = [(k, copy, "a") for k in range(12)] + [(100 + k, prose(10 + k) + "\nshared footer", "a") for k in range(10)]
    docs = STAGES["line dedup"](spark, documents(spark, rows), str(tmp_path))
    found = {r.doc_id: r.text for r in STAGES["near-dedup"](spark, docs, str(tmp_path)).collect()}
    assert found == {0: copy, **{100 + k: prose(10 + k) for k in range(10)}}


def test_boilerplate_lines_are_taken_out(spark, tmp_path):
    rows = [(k, f"Site  Footer\n{prose(k)}\n site  footer \nlast {k}", "a") for k in range(12)]
    rows += [(50, rows[0][1], "a"), (60, rows[0][1], "b"), (70, "short\nSite  Footer", "a"), (71, prose(71) + "\n" + "Site  Footer\n" * 40, "a")]
    found = {r.doc_id: (r.text, r.n_chars) for r in STAGES["quality rules"](spark, documents(spark, rows), str(tmp_path)).collect()}
    expected = {k: f"{prose(k)}\nlast {k}" for k in range(12)} | {50: f"{prose(0)}\nlast 0", 60: rows[0][1]}
    assert found == {k: (t, len(t)) for k, t in expected.items()}


def test_a_line_limit_does_not_grow_with_the_host(spark, tmp_path):
    rows = [(k, prose(k) + ("\nrare footer" if k < 12 else ""), "a") for k in range(200)]
    near = [(300 + k, prose(300, 80) + f" end{k}\n" + prose(301) + "\n" + prose(302), "a") for k in range(12)]
    found = {r.doc_id: r.text for r in STAGES["quality rules"](spark, documents(spark, rows + near), str(tmp_path)).collect()}
    assert found == {**{k: prose(k) for k in range(200)}, **{k: t for k, t, _ in near}}
