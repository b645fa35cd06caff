import hashlib
import random
import re

from folioscan.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_ok(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for no, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn_ok(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def check(df, texts):
    for r in pii.digest(pii.detect(df)).collect():
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, want, texts[r.doc_id][:300])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == i for w in want) for i in range(4)]
        have = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(have)


def test_base_matches_brute_force(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "%d@e.f.g", "x@y", "@", "1.2.3.4", "300.1.1.1", ".5", "4532015112830366", "4532 0151 1283 0366", "-", " ", "  ", "+1 (555) 123-4567", "+", "(", "12", "é", "🦜", "\n", "0000000000000", "256", "a.b", "..", "007.08.9.1"]
    texts = {i: "".join(rng.choices(bits, k=rng.randint(1, 14))) for i in range(1500)}
    texts |= {5000: "", 5001: None, 5002: "1" * 60000, 5003: "a" * 60000 + "@b" + ".c" * 20000, 5004: "1." * 30000, 5005: "+1" + " " * 40000, 5006: "1 " * 30000}
    check(spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, base string").select("doc_id", "text"), texts)


def test_wider_candidates_are_added_by_the_classifier(spark):
    texts = [f"Call +1 (555) 123-456{i % 10} about {i}." for i in range(40)] + [f"mail me{i}@mail.example.com now" for i in range(40)]
    texts += [f"card 45320151128303{66} paid {i}" for i in range(40)] + ["ref 1234 4532015112830366 paid by card"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digest(pii.detect(df)).collect()}
    assert all(rows[i].spans for i in range(120))
    assert "card:9:25" in rows[121].spans and rows[121].n_card == 0


def test_reliabilities_follow_the_votes():
    good, bad = 0, 0
    counts = {}
    for c in range(pii.CELLS // 4):
        votes = [c // 6 // 3**k % 3 for k in range(4, -1, -1)]
        if votes == [1, 1, 1, 2, 1]:
            counts[c], good = 1000, c
        if votes == [0, 0, 2, 2, 0]:
            counts[c], bad = 1000, c
    post = pii.estimate(counts)["posterior"]
    assert post[good] > 0.95 and post[bad] < 0.05
    p = pii.train(counts)
    assert p[good] > 0.5 > p[bad]


def test_empty_table_and_columns_pass_through(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, None, 3), (None, "a@b.co", 4), (1, "a@b.co", 5), (1, "a@b.co", 5)], "doc_id long, text string, cell int")
    got = pii.detect(df)
    assert got.columns == ["doc_id", "text", "cell", "base", "spans"] and got.count() == 4


def test_query_matches_brute_force(spark):
    from folioscan.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, d, "documents").collect()}
    got = queries.op9_pii(spark, d).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_a_long_text_of_many_matches(spark):
    text = " ".join(f"user{i}@mail{i}.example.com" for i in range(40000))
    wider = " ".join(f"45320151128303{i % 100:02d} me{i} at host dot org" for i in range(4000))
    marks = f"a@b.c {pii.OPENED} 1.2.3.4 {pii.CLOSED}{pii.OPENED} x@y.zz +1 555 123 4567"
    texts = {1: text, 2: wider, 3: marks, 4: pii.CLOSED}
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_wider_spans_overlap_no_base_span_of_their_kind(spark):
    rng = random.Random(8)
    bits = ["4532015112830366", "4532 0151 1283 0366", "1111222233334444", " ", " x ", "card ", "555-123-4567", "+1 555-123-4567", "me at host dot org", "a@b.co", "9.9.9.9", "9[.]9[.]9[.]9"]
    texts = {i: " ".join(rng.choices(bits, k=rng.randint(1, 30))) for i in range(300)}
    for r in pii.digest(pii.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect():
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        base = {(k, a, b) for a, _, b, k in brute(texts[r.doc_id])}
        for k, a, b in spans:
            if (k, int(a), int(b)) not in base:
                assert not any(q == k and c < int(b) and int(a) < d for q, c, d in base)
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))
