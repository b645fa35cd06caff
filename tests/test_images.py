import numpy as np

from folioscan.functions import images as I
from folioscan.queries import load


def test_find_like_finds_other_sizes_and_turns(spark):
    rng = np.random.default_rng(2)
    mark = rng.choice([0, 255], (12, 12)).astype(np.uint8)
    page = np.full((120, 120), 255, np.uint8)
    big = np.rint(I.scaled(mark, I.SCALES[10])).astype(np.uint8)
    page[10 : 10 + len(big), 10 : 10 + len(big)] = big
    page[70:82, 20:32] = np.rot90(mark, 1)
    page[70:82, 80:92] = np.rot90(mark, 3)
    small = np.rint(I.scaled(mark, I.SCALES[2])).astype(np.uint8)
    page[20 : 20 + len(small), 80 : 80 + len(small)] = small
    df = spark.createDataFrame([(1, 120, 120, page.tobytes())], "id int, height int, width int, pixels binary")
    best = {(r.x0, r.y0): r for r in I.find_like(df, ["id"], mark).collect()}
    assert best[10, 10].scale == I.SCALES[10] and best[10, 10].turn == 0
    assert best[20, 70].turn == 90 and best[80, 70].turn == 270
    assert best[80, 20].scale == I.SCALES[2]


def test_query_looks_for_quarter_turns(spark):
    got = load()[0]["x24_find_like"](spark, "/root/testdata/sf0.001").select("turn", "scale").distinct().collect()
    assert {r.turn for r in got} == {0, 90, 180, 270} and len({r.scale for r in got}) > 1
