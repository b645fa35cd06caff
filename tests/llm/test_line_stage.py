import corpus_pipeline as cp


def test_stage_cuts_pages_that_are_mostly_boilerplate(spark):
    plate = "one long shared line that stands on every page of every site"
    rows = [(i, f"{plate}\nown {i}", "en", f"s{i}", len(plate) + 6) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, df, "").collect()}
    assert got == {0: (rows[0][1], rows[0][4]), **{i: (f"own {i}", 5) for i in range(1, 10)}}
