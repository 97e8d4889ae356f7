"""The functions under their SQL names, over batches."""

import pyarrow as pa

from quillon.functions import batches, codec, registry, text


def test_unpacked_documents():
    texts = pa.array(["x b a b", None, "", "c b"], pa.string())
    docs = batches.documents(*batches.cut(texts), texts.is_null().to_numpy(False))
    whole = [None if t is None else codec.analyze(t) for t in texts.to_pylist()]
    assert registry.unpacked(docs) == whole and registry.unpacked(docs.slice(2)) == whole[2:]
    assert [d and [(t["term"], t["pos"]) for t in d["terms"]] for d in registry.unpacked(docs, {"b", "zz"})] == [[("b", [2, 4])], None, [], [("b", [2])]]


def test_functions_in_sql_take_nulls_and_queries_of_rows(spark):
    registry.register(spark)
    rows = [(1, "the fox", "fox"), (2, "the fox", "!fox | f*"), (3, None, "fox"), (4, "der Fuchs", None), (5, "ein turtle", "/^tur/"), (6, "", "!a")]
    spark.createDataFrame(rows, "id int, t string, q string").coalesce(1).createOrReplaceTempView("rows_of_queries")
    got = spark.sql("SELECT fts_match(to_ftsdoc(t), q) AS m, ftsdoc_length(to_ftsdoc(t)) AS n, to_ftsdoc(t) IS NULL AS none, fts_bm25_dfs(to_ftsdoc(t), q, 10D, CAST('NaN' AS DOUBLE), array(1D)) AS s, fts_distance(to_ftsdoc(t), q) AS d FROM rows_of_queries ORDER BY id").collect()
    assert [r.m for r in got] == [True, True, None, None, True, True] and [r.n for r in got] == [2, 2, None, 2, 2, 0]
    assert [r.none for r in got] == [False, False, True, False, False, False] and all(r.s is None for r in got) and [r.d is None for r in got] == [False, False, True, True, False, False]
    want = text.analyze(spark.table("rows_of_queries"), "t").orderBy("id").select("doc").collect()
    assert [r.doc for r in want] == [r.d for r in spark.sql("SELECT id, to_ftsdoc(t) AS d FROM rows_of_queries ORDER BY id").collect()]
