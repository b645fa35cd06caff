import json

import numpy as np
import pytest

from folioscan import derive, surface
from folioscan.functions import images as I
from folioscan.plans.pagemap import parse_pages

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kit(spark):
    return surface.Toolkit(lambda h: surface.DocumentSet(derive.lines(spark, D), derive.pages(spark, D), derive.markups(spark, D)))


def test_replies_page_without_loss(kit):
    seen, offset = [], 0
    while offset is not None:
        r = json.loads(kit.call("document_page_map", {"handle": "x", "offset": offset}, 4000))
        assert r["items"] and len(json.dumps(r["items"], separators=(",", ":"), ensure_ascii=False)) <= 4000
        seen += [(i["doc_key"], i["page"]) for i in r["items"]]
        offset = r.get("next_offset")
    assert len(seen) == len(set(seen)) == 200


def test_every_tool_answers(kit):
    extra = {"search_document": {"pattern": "the"}}
    for spec in kit.specs():
        r = json.loads(kit.call(spec["name"], {"handle": "x", **extra.get(spec["name"], {})}))
        assert "items" in r, (spec["name"], r)


def test_errors_are_replies(kit):
    assert json.loads(kit.call("document_pagemap"))["hint"] == "document_page_map"
    assert json.loads(kit.call("search_document", {"handle": "x", "patern": "a"}))["hint"] == "pattern"
    assert "error" in json.loads(kit.call("search_document", {"handle": "x", "pattern": "(", "regex": True}))
    assert "error" in json.loads(kit.call("read_document", {"handle": "x", "pages": "900"}))
    assert surface.scrub_paths("cannot open /srv/data/a b/plan.pdf now") == "cannot open plan.pdf now"
    assert surface.viewer_pages({"page": 3, "items": [{"page": 0}]}, 1) == {"page": 4, "items": [{"page": 1}]}


def test_sets_are_closed_in_order(spark):
    opened = []
    kit = surface.Toolkit(lambda h: opened.append(h) or surface.DocumentSet(None, None))
    for h in [*"abcdefgh", "a", "i", "a", "b"]:
        kit.open(h)
    assert opened == [*"abcdefgh", "i", "b"]


def test_page_specs():
    assert parse_pages(None, 3) == [0, 1, 2] and parse_pages("0-1, 2,1", 3) == [0, 1, 2] and parse_pages(2, 3) == [2] and parse_pages([1], 3) == [1]
    for bad in ("3", 9, "2-1", "x", True):
        with pytest.raises(ValueError):
            parse_pages(bad, 3)


def test_matching_finds_planted_marks():
    rng = np.random.default_rng(0)
    mark = rng.integers(0, 256, (9, 7)).astype(np.uint8)
    page = rng.integers(0, 60, (60, 50)).astype(np.uint8)
    page[20:29, 11:18] = mark
    score = I.correlation(page, mark)
    assert np.unravel_index(score.argmax(), score.shape) == (20, 11) and score.max() > 0.999
    y, x = 33, 5
    w = page[y : y + 9, x : x + 7].astype(float)
    t = mark - mark.mean()
    assert score[y, x] == pytest.approx(((w - w.mean()) * t).sum() / np.sqrt(((w - w.mean()) ** 2).sum() * (t**2).sum()))


def test_ink_and_rules():
    m = np.zeros((12, 20), bool)
    m[2, 1:18] = True
    m[2, 8] = False
    m[5:11, 4] = True
    m[9, 10:12] = m[10, 12:14] = True
    assert ("h", 2, 1, 18) in I.drawn_lines(m, 10) and ("v", 4, 5, 11) in I.drawn_lines(m, 6, 1)
    assert (10, 9, 14, 11, 4) in I.components(m)
    assert I.difference_hash(np.full((40, 40), 255, np.uint8)) is None
    assert I.same_picture(np.zeros((2, 2)), np.full((2, 2), 16)) and not I.same_picture(None, np.zeros((2, 2)))
