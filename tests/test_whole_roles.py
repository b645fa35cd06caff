from folioscan.queries import load

QUERIES = load()[0]
D = "/root/testdata/sf0.001"


def test_no_segment_is_left_out_of_the_labels(spark):
    got = {r.label_id % 3 for r in QUERIES["j9_labels_of_regions"](spark, D).collect()}
    assert got == {1, 2}


def test_every_segment_gives_dimension_heads(spark):
    got = {r.arrow_a // 2 % 3 for r in QUERIES["x2_j6_dimensions"](spark, D).collect()}
    assert got == {0, 1, 2}


def test_texts_of_dimensions_are_of_all_points(spark):
    got = {r.text_id % 3 for r in QUERIES["x2_j6_dimensions"](spark, D).collect() if r.text_id is not None}
    assert got == {0, 1, 2}
