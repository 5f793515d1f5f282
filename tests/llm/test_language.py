from plumbline.llm import language
from plumbline.llm.queries import op4_language_id


def test_words_first_then_shorter_n_grams(spark):
    rows = [(1, "haus maus " * 5, "de"), (2, "house the the " * 5, "en"), (3, None, "de"), (4, "house", None)]
    m = language.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert m.langs == ["de", "en"] and set(m.rows[0]) == {"haus", "maus", "house", "the"}
    for k in language.ORDERS:
        assert set(m.rows[k]) == {g for w in m.rows[0] for g in language.grams(w, k)}
    assert m.predict("Haus", {})[0] == "de"
    assert (m.back_off("xaus") == m.logs[4][m.rows[4]["aus "]]).all()
    assert m.back_off("zzzzh") is not None and m.back_off("日本") is None
    assert m.predict("日本", {}) == ("de", 0.5) and m.predict("12 3", {}) == ("und", 0.0) and m.predict(None, {}) == ("und", 0.0)


def test_held_out_documents_are_told_apart(spark):
    got = op4_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert len(got) == len(truth) and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_nothing_labelled_and_empty(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    assert {(r.doc_id, r.lang_pred, r.score) for r in language.identify(rows, F.lit(True)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language.identify(rows.limit(0), F.lit(True)).count() == 0
