import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from folioscan.llm import mixing, quality
from folioscan.llm.queries import table, tokenizer
from folioscan.storage import materialize
from tests.llm.test_similar import brute_components

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, D, "documents")
    out = [docs]
    for _, f in cp.STAGES:
        docs = materialize(f(spark, docs, D), "test")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing", "sentencepiece"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_quality_keeps_good_and_drops_bad(spark, stages):
    labels = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert all(after[i] == before[i] for i in after)
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good)
    assert sum(i in after for i in bad) <= 0.1 * len(bad)


def test_line_dedup_matches_brute_force(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sites, first = defaultdict(set), {}
    for i in sorted(before):
        for k, line in enumerate((before[i].text or "").split("\n")):
            line = line.strip(" ")
            if line:
                sites[line].add(before[i].source)
                first.setdefault(line, (i, k))
    assert set(before) == set(after)
    for i, r in before.items():
        lines = r.text.split("\n")
        kept = [x for k, x in enumerate(lines) if not (len(sites[x.strip(" ")]) >= 8 and first[x.strip(" ")] != (i, k)) or not x.strip(" ")]
        assert after[i].text == "\n".join(kept)
        assert after[i].n_chars == (r.n_chars if kept == lines else len(after[i].text))


def test_near_dedup_matches_brute_force(stages):
    before, after = rows(stages[2]), rows(stages[3])
    comp = brute_components({i: r.text for i, r in before.items()})
    assert set(after) == set(comp.values()) and all(after[i] == before[i] for i in after)


def brute_mix(docs, share=1.5, most=2.0):
    """(doc_id -> taken) by sorting every source as a whole."""
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0d]+", r.text or "") if w]) for i, r in docs.items()}
    total = Counter()
    for i, r in docs.items():
        total[r.source] += size[i]
    names = sorted(total, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(total.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * w[s] > most * total[s]}
        if not full:
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * w[s] for s in open_}
    taken = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        u = {i: (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i, r in docs.items() if r.source == s}
        run = 0
        for i in sorted(u, key=lambda i: (u[i], i)):
            taken[i] = size[i] * (whole + (rest > 0 and run + size[i] / 2 <= rest))
            run += size[i]
    return size, total, target, taken


def test_mixing_matches_brute_force(spark, stages):
    before = rows(stages[3])
    size, total, target, taken = brute_mix(before)
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert copies == Counter({i: taken[i] // size[i] for i in taken if taken[i]})
    by = Counter()
    for i, t in taken.items():
        by[before[i].source] += t
        assert t <= 2 * size[i]
    for s in total:
        assert abs(by[s] - target[s]) <= max(size[i] for i in before if before[i].source == s) / 2 + 1e-6
    got = mixing.mix(stages[3])
    assert {r.doc_id: r.taken for r in got.collect()} == taken
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got.collect())


def test_encoding_equals_the_library(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.round_trip


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(cp.run(spark, D)) == key(stages[5])


def test_awkward_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, host string, component_id string, n_removed long, __p string"
    long = "lorem ipsum dolor sit amet, consectetur. " * 4000
    some = [(i, f"The {i} sentence of this text is plain, and so is number {i * 7}. It ends here.", "en", f"s{i % 3}", 9, 1, "h", "c", 2, "p") for i in range(30)]
    odd = [(None, None, None, None, None, None, None, None, None, None), (None, "text without an id, plain enough.", "en", "s1", 3, 1, "h", "c", 2, "p"), (50, "", "en", "s1", 0, 1, "h", "c", 2, "p"), (51, long, "en", None, len(long), 1, "h", "c", 2, "p"), some[0], some[0]]
    df = spark.createDataFrame(some + odd, schema)
    for docs in (df, df.limit(0)):
        for name, f in cp.STAGES:
            nxt = materialize(f(spark, docs, D), "test")
            if name != "sentencepiece":
                assert nxt.columns == df.columns
            if name == "line dedup":
                assert nxt.count() == docs.count()
            docs = nxt
        docs.count()


def test_site_posteriors_shrink_sparse_sites(spark):
    data = [("big", "a", 0.9)] * 400 + [("big", "b", 0.2)] * 2 + [("tiny", "a", 0.0)] + [("mid", "a", 0.1)] * 200
    df = spark.createDataFrame(data, "__host string, __path string, __p double")
    got = {(r.host, r.path): r for r in quality.site_posteriors(df).collect()}
    g = got["big", "a"].global_rate
    assert abs(got["big", "a"].path_rate - 0.9) < 0.05 and got["mid", "a"].path_rate < 0.2
    assert abs(got["tiny", "a"].path_rate - g) < g  # pulled towards the corpus
    assert 0.2 < got["big", "b"].path_rate <= got["big", "b"].host_rate


def test_quality_is_accurate_on_other_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    teach, hold = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.quality(docs, teach).join(hold, "doc_id").select("keep", "quality").collect()
    assert np.mean([r.keep == bool(r.quality) for r in got]) > 0.95


def test_mix_on_awkward_rows(spark):
    schema = "doc_id long, text string, source string, source_size string, target int, n long"
    rows = [(1, "a b c", "\U0010ffff", "x", 1, 1), (2, "d e", None, "y", 2, 2), (3, "f", "\U0010ffff", "z", 3, 3), (None, None, None, None, None, None), (4, "", "s", "w", 4, 4), (1, "a b c", "\U0010ffff", "x", 1, 1)]
    got = mixing.mix(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "source", "n", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == 6
    assert {(r.source, r.source_size) for r in rows} == {("\U0010ffff", 7), (None, 2), ("s", 0)}
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0


def test_the_last_cell_is_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 4)
    rng = np.random.default_rng(5)
    docs = {i: (i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{i % 3}") for i in range(400)}
    df = spark.createDataFrame(list(docs.values()), "doc_id long, text string, source string")
    _, _, _, taken = brute_mix({r.doc_id: r for r in df.collect()})
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == taken


def test_lines_of_awkward_rows(spark):
    plate = "the same line on every site"
    rows = [(i, f"{plate}\nown line {i}", f"s{i}", 5) for i in range(9)] + [(None, plate, "s1", 5), (None, None, "s2", 5), (20, "", None, 5), (21, f"{plate}\n{plate}", "s3", 5)]
    from folioscan.llm import linededup

    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed long"))
    assert got.columns == ["doc_id", "text", "source", "n_removed"]
    by = sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str)
    # the least id is null, which is before all others
    want = [(i, f"own line {i}", 1) for i in range(9)] + [(None, plate, 0), (None, None, 0), (20, "", 0), (21, "", 2)]
    assert by == sorted(want, key=str)


def test_lines_of_one_long_text(spark):
    from folioscan.llm import linededup

    plate = [f"plate {k}" for k in range(5000)]
    rows = [(i, "\n".join(plate), f"s{i}") for i in range(8)]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == ("\n".join(plate), 0) and all(got[i] == ("", 5000) for i in range(1, 8))


def test_scores_follow_from_p_by_brute_force(spark):
    """Every posterior, score and decision again, from doc_score, host and path alone."""
    from folioscan.llm import queries

    rows = queries.op1_quality(spark, D).collect()
    assert len(rows) == table(spark, D, "documents").count()
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r.host, r.path].append(r.doc_score)
        hosts[r.host].append(r.doc_score)
    rate = (sum(r.doc_score for r in rows) + 0.5) / (len(rows) + 1.0)

    def strength(groups):
        noise = sum(q * (1 - q) for _, q in groups)
        spread = sum(len(ps) * (sum(ps) / len(ps) - q) ** 2 for ps, q in groups) - noise
        between = spread / max(sum(len(ps) for ps, _ in groups) - len(groups), 1.0)
        m = noise / len(groups) / between - 1 if between > 0 else quality.STRENGTH[1]
        return min(max(m, quality.STRENGTH[0]), quality.STRENGTH[1])

    m_host = strength([(ps, rate) for ps in hosts.values()])
    whole = {h: (sum(ps) + m_host * rate) / (len(ps) + m_host) for h, ps in hosts.items()}
    m_path = strength([(ps, whole[h]) for (h, _), ps in paths.items()])
    logit = lambda p: np.log(p / (1 - p))
    for r in rows:
        host = (sum(hosts[r.host]) - r.doc_score + m_host * rate) / (len(hosts[r.host]) - 1 + m_host)
        ps = paths[r.host, r.path]
        path = (sum(ps) - r.doc_score + m_path * host) / (len(ps) - 1 + m_path)
        assert abs(r.host_rate - host) < 1e-6 and abs(r.path_rate - path) < 1e-6
        score = 1 / (1 + np.exp(-(logit(r.doc_score) + logit(path) - logit(rate))))
        assert abs(r.score - score) < 1e-5 and r.keep == (r.score >= 0.5)


def test_quality_of_ties_and_repeated_ids(spark):
    docs = [(1, "same text here.", "h", "en")] * 3 + [(1, "other !!! ### text", "h", "en"), (None, None, None, None), (2, "", "h", "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.quality(df, labels).collect()
    assert len(rows) == 6 and len({(r.doc_score, r.score) for r in rows if r.doc_id == 1}) <= 2
    assert all(0 < r.score < 1 for r in rows)
    assert quality.quality(df.limit(0), labels.limit(0)).count() == 0
