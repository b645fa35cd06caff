import pandas as pd
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.queries import load
from tests.oracle import compare

TEXTS = ["Card 4550 | Ref 1011", "\u00a0Note\u00a0|\u3000Sheet\u2003", "x\u000b yz\u000bw", "\u0130zmir \u03a3\u039f\u03a3 | ab\t\tc", "\u3000"]


def _documents(tmp_path):
    # twenty lines, so that the last is in the footer's band
    rows = [(i, "\n".join(["body"] * 20 + [TEXTS[i % len(TEXTS)]]), "en", "s", 1) for i in range(60)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    spark_only = "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split()
    for t in spark_only:
        pd.DataFrame({"unused": [1]}).to_parquet(tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_key_keeps_digits_at_the_ends_and_drops_any_space(spark):
    got = [r.k for r in spark.createDataFrame([(t,) for t in TEXTS[:2]], "t string").select(T.running_key(F.col("t")).alias("k")).collect()]
    assert got == ["card #### | ref ####", "note | sheet"]


def test_running_keys_match_their_sql_on_odd_spaces(spark, tmp_path):
    queries, sql = load()
    d = _documents(tmp_path)
    compare(queries["f6_running_keys"](spark, d), sql["f6_running_keys"], d)


def test_segmentation_matches_its_sql_on_odd_spaces(spark, tmp_path):
    queries, sql = load()
    d = _documents(tmp_path)
    compare(queries["w1_segmentation"](spark, d), sql["w1_segmentation"], d)


ODD = ["end \r", "page\u000b1", "page 1é", "épage 7", "itemé", "part", "figureſ", "figureſx", "İndex", "abࡰ", "abᲉC", "ab | ꟋZ9"]


def test_segmentation_matches_its_sql_on_odd_edges_and_letters(spark, tmp_path):
    """Spaces before a return, the vertical tab, word edges beside letters beyond ASCII, letters that one Unicode table alone knows."""
    queries, sql = load()
    d = _documents(tmp_path)
    rows = [(i, "\n".join([ODD[i % len(ODD)], *["body"] * 20, ODD[i // len(ODD) % len(ODD)]]), "en", "s", 1) for i in range(3 * len(ODD) ** 2)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    compare(queries["w1_segmentation"](spark, d), sql["w1_segmentation"], d)
