"""naive_loop_lexical against its SQL where an excerpt has no term that could support it, or characters of which engines differ."""

import duckdb

from lodestone.plans import evidence


def test_extractive_answers_equal_sql(spark, tmp_path):
    texts = ["Of " * 200, "and of in", "zorp\x0bquix [S9] glim \x0b", "brandt node.js [S1] zorp  ", "w1 " * 7000, "of the", "hello zorp", "", "of " * 5199 * 2 + "zebra"]
    questions = ["of", "zorp quix", "node.js of", "w1", None, " Hello ", "!!", "zebra in"]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"src{i % 6}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(questions)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "zorp")], "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    want = duck.sql(f"select query_id, answer, refused, action from ({evidence.SQL['naive_loop_lexical']})").fetchall()
    got = evidence.naive_loop_lexical(spark, sf).select("query_id", "answer", "refused", "action").collect()
    assert len(got) == len(questions) and sorted(map(tuple, got)) == sorted(want)
