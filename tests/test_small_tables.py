"""Queries held against their SQL over small tables made for a case."""

import __spark_entry__
from oracle import plain
from pyspark.sql import functions as F

from sievework.operators import decontaminate, merging


def held(spark, folder, name, **tables):
    """The rows of a query over tables of (schema, rows), which its SQL over the same tables must give as well."""
    import duckdb

    with duckdb.connect() as db:
        for table, (schema, rows) in tables.items():
            path = f"{folder}/{table}.parquet"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        found = __spark_entry__.queries()[name](spark, str(folder))
        expected = db.sql(__spark_entry__.oracle_sql()[name])
        mine = sorted((tuple(map(plain, r)) for r in found.collect()), key=repr)
        theirs = sorted((tuple(map(plain, r)) for r in expected.select(*(f'"{c}"' for c in found.columns)).fetchall()), key=repr)
    assert mine == theirs
    return mine


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts, lang="en"):
    return DOCUMENTS, [(k, t, lang, "web", len(t or "")) for k, t in enumerate(texts)]


def test_stop_words_of_a_cue_count(spark, tmp_path):
    texts = documents("a clown", "clown, the", "trash idiots", "trash of idiots")
    assert held(spark, tmp_path, "q69_cue_presence", documents=texts) == [(1, "the clown"), (3, "idiots of trash")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_orphans_meet_in_one_grouping(spark):
    left, right = (spark.createDataFrame([(k,) for k in keys], "k int") for keys in ([1, 2, 2, None], [2, 3, 3, None]))
    found = merging.orphans(left, "k", right, "k")
    assert exchanges(found) == 1
    assert sorted(map(tuple, found.collect()), key=repr) == [("left", 1), ("left", None), ("right", 3), ("right", None)]


def test_candidates_are_tried_in_the_row(spark, tmp_path):
    orders = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string"
    rows = [(k, c, p, s) for k in range(8) for c in (1, 2) for p in ("1-URGENT", "5-LOW") for s in "PF"]
    rows = [(8 * n + k % 4, c, p, s) for n, (k, c, p, s) in enumerate(rows)]
    assert len(held(spark, tmp_path, "q87_settled_outputs", orders=(orders, rows))) == len(rows)
    assert exchanges(__spark_entry__.queries()["q87_settled_outputs"](spark, str(tmp_path))) == 0


def test_near_sets_of_all_sizes(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base[:56]), " ".join(base[1:]), " ".join([*base, "x"]), "w1 w2", "w2 w1", "w1", "", "-", " ".join(base[:25]), " ".join(base[:23]), " ".join(base[:24])]
    assert len(held(spark, tmp_path, "q36_near_neighbor_jaccard", documents=documents(*texts))) > 5
    held(spark, tmp_path / "classes", "q36_token_set_classes", documents=documents(*texts))


def test_prefixes_shuffle_no_tokens(spark):
    sets = decontaminate.token_sets(spark.createDataFrame([(1, "a b c")], "k long, t string"), "k", F.col("t"))
    assert exchanges(decontaminate.prefixes(sets, "k", 0.9)) == 0
