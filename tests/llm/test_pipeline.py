"""Each stage of the pipeline against brute force on its own input."""

import duckdb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_dedup import brute_jaccard
from tests.llm.test_text import check_packing
from vecmill.llm import queries as Q
from vecmill.llm.line_dedup import line_dedup_sql

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    out = {}
    for name, stage in P.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    assert list(out) == ["language_id", "line_dedup", "near_dedup", "packing"]
    for name in list(out)[:-1]:
        assert out[name].columns == spark.read.parquet(f"{SF}/documents.parquet").columns

    # Language: texts of words are kept as they are.
    kept = {r["doc_id"]: r for r in out["language_id"].collect()}
    assert all(given[i] == r for i, r in kept.items())
    assert all(sum(c.isalpha() for c in (given[i]["text"] or "")) < 20 for i in set(given) - set(kept))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/language_id/*.parquet'")
    expected = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({line_dedup_sql(Q.LINE_RATIO, Q.LINE_PAGES, copies_once=True)})").fetchall()}
    lines = {r["doc_id"]: r for r in out["line_dedup"].collect()}
    assert {i: r["text"] for i, r in lines.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())

    groups = brute_jaccard([(i, r["text"]) for i, r in lines.items()], 5, 4, 5)
    single = {r["doc_id"]: r for r in out["near_dedup"].collect()}
    assert set(single) == {i for i, (_, c) in groups.items() if i == c} and all(lines[i] == r for i, r in single.items())

    rows = [r.asDict() for r in out["packing"].collect()]
    assert check_packing(rows, {i: r["text"] for i, r in single.items()}, Tokenizer.from_file(Q.byte_vocabulary()), 2048) > 0.9
    digest = lambda df: sorted(map(tuple, df.drop("sequence_id", "offset").collect()))
    whole = P.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == sum(r["length"] for r in rows) and {r[0] for r in digest(whole)} == set(single)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_nulls_and_other_columns(spark, tmp_path):
    text = "the and of with this that there is a word "
    rows = [(i, text * (1 + i), "en", "s", 1, "x", "y") for i in range(5)] + [(None, text, None, None, None, "x", "y"), (7, None, None, None, None, None, None), (1, text * 2, "en", "s", 1, "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()}
    assert {0, None} <= found and 7 not in found
