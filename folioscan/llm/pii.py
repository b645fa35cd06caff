"""Personal data by aggregating weak labelers.

Candidates: the base patterns of `BASE` (every match that passes its test is a span
for good), and wider patterns that the base passes over: cards and phone numbers run
together with other digits, numbers without a country code, addresses with "at" and
"dot" spelled out, and addresses with bracketed dots.

Five labelers vote on every candidate, for, against or not at all: a strict pattern, a
checksum or range test, a gazetteer (top-level domains, issuer prefixes, area codes,
reserved networks), the words just before, and the characters at both ends.  The
corpus is reduced to a count for each pattern of votes, of which there are at most
``CELLS``, so what reaches the driver is bounded.  Expectation-maximisation on these
counts estimates each labeler's reliability for each kind, and the posteriors train
the final span classifier, a logistic model of votes, length and origin.  Its verdict
is a table by cell, looked up for each candidate of the second pass.

Every step over documents is a DataFrame expression.  Quantifiers are possessive where
nothing can follow, which keeps the matcher from recursing or backtracking over very
long runs; a match can only begin where a run begins or where the last match ended, as
for leftmost matching.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.storage import materialize

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a chain of fewer than 12 digits is passed over as a whole
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
LABELERS, VOTES = 5, 3  # votes: 0 against, 1 for, 2 none
#: kind, votes, three lengths, base or wider
CELLS = len(KINDS) * VOTES**LABELERS * 3 * 2
#: Fixed values of the gazetteers.
TOP_LEVEL = "com org net edu gov mil int info biz io co de fr es uk eu us ca au jp cn in it nl ch".split()
CUES = {
    "email": "mail|contact|write|reach|courriel|correo",
    "ip": r"\bip\b|host|addr|server|from|client",
    "card": "card|visa|amex|master|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|contact|whatsapp",
}


#: Marks around matches; a text's own marks are read as another private character, which no pattern knows.
OPENED, CLOSED, OTHER = "\ue010", "\ue011", "\ue012"
FOUND = "struct<start:int,end:int,hit:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join) -> Column:
    """Running results of ``join`` (sum, greatest, least) over an array, in blocks of about its root.

    An aggregate that appends to an array copies it each time; over blocks that is
    about n ** 1.5 copies for n values, and few for few.
    """
    none = F.array().cast("array<bigint>")

    def scanned(xs: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            v = F.when(acc["v"].isNull(), x).otherwise(join(acc["v"], x))
            return F.struct(v.alias("v"), F.concat(acc["out"], F.array(v)).alias("out"))

        return F.aggregate(xs, F.struct(first.cast("bigint").alias("v"), none.alias("out")), step, lambda acc: acc["out"])

    def over(vs: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(vs)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(vs), F.lit(1)), width), lambda k: scanned(F.slice(vs, k, width), F.lit(None)))

        def moved(bs: Column) -> Column:
            before = scanned(F.transform(bs, lambda b: F.element_at(b, -1)), F.lit(None))
            shift = lambda o: F.flatten(F.transform(bs, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: join(F.get(o, k - 1), x)))))
            return F.when(F.size(bs) == 1, F.element_at(bs, 1)).otherwise(_let(before, shift))

        return F.when(F.size(vs) == 0, none).otherwise(_let(blocks, moved))

    return _let(values.cast("array<bigint>"), over)


def _cut(text: Column, pattern: str, may: Column) -> Column:
    """The text cut at its matches: a gap, a match, a gap and so on.  One pass of the matcher."""
    marked = F.regexp_replace(text, pattern, f"{OPENED}$0{CLOSED}")
    return F.when(may, F.split(marked, f"[{OPENED}{CLOSED}]", -1)).otherwise(F.array(F.lit("")))


def _located(parts: Column) -> Column:
    """The matches among alternate gaps and matches, with their places in code points and some text on either side."""
    none = F.array().cast(f"array<{FOUND}>")

    def spans(ps: Column) -> Column:
        def found(upto: Column) -> Column:
            def span(k: Column) -> Column:
                before = F.right(F.concat(F.coalesce(F.get(ps, 2 * k - 1), F.lit("")), F.get(ps, 2 * k)), F.lit(32))
                after = F.left(F.concat(F.get(ps, 2 * k + 2), F.coalesce(F.get(ps, 2 * k + 3), F.lit(""))), F.lit(2))
                return F.struct(F.get(upto, 2 * k).cast("int").alias("start"), F.get(upto, 2 * k + 1).cast("int").alias("end"), F.get(ps, 2 * k + 1).alias("hit"), before.alias("before"), after.alias("after"))

            return F.transform(F.sequence(F.lit(0), F.floor(F.size(ps) / 2).cast("int") - 1), span)

        return F.when(F.size(ps) >= 3, _let(running(F.transform(ps, F.length), lambda a, b: a + b), found)).otherwise(none)

    return spans(parts)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _octets(hit: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(hit, r"[\[\]]", ""), r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))


def _small(part: Column) -> Column:
    return (F.length(part) <= 3) & (F.lpad(part, 3, "0") <= "255")


def _passes(kind: str, hit: Column) -> Column:
    """The test that a base match must pass; failing matches are dropped."""
    n = F.length(_digits(hit))
    if kind == "ip":
        return F.forall(_octets(hit), _small)
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(hit))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _strict(kind: str, hit: Column) -> Column:
    shape = {
        "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*+)@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}$",
        "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
        "card": r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$",
        "phone": r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    }
    return hit.rlike(shape[kind])


def _listed(kind: str, hit: Column) -> Column:
    """The gazetteer labeler; null where it has no vote."""
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(F.right(hit, F.lit(64)), "([A-Za-z0-9]+)$", 1)).isin(TOP_LEVEL), 1)
    if kind == "ip":
        first = _octets(hit)[0]
        return F.when(first.isin("0", "127", "255"), 0).otherwise(1)
    if kind == "card":
        return F.when(_digits(hit).rlike("^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"), 1)
    return F.when(_digits(hit).rlike("^(?:1?[2-9][0-9]{2}[2-9])"), 1)


def _sound(kind: str, hit: Column) -> Column:
    if kind == "email":
        return ~hit.rlike(r"\.\.|^[.]|-\.|\.-")
    return F.length(_digits(hit)).between(10, 15) if kind == "phone" else _passes(kind, hit)


def _candidates(found: Column, kind: str, wider: bool) -> Column:
    """``array<struct<start, end, cell>>`` of one kind, base or wider, from its located matches."""
    if not wider:
        found = F.filter(found, lambda s: _passes(kind, s["hit"]))

    def cell(s: Column) -> Column:
        hit, before, after = s["hit"], F.lower(s["before"]), s["after"]
        cue = F.when(before.rlike(CUES[kind]), 1)
        ends = ~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^(?:[\p{L}\p{N}]|[.-][0-9])")
        code = F.lit(KINDS.index(kind))
        for vote in (_strict(kind, hit).cast("int"), _sound(kind, hit).cast("int"), _listed(kind, hit), cue, ends.cast("int")):
            code = code * VOTES + F.coalesce(vote, F.lit(2))
        n = F.length(hit)
        code = code * 3 + F.when(n < 12, 0).when(n < 20, 1).otherwise(2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (code * 2 + int(wider)).cast("int").alias("cell"))

    return F.transform(found, cell)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays ``__base_<kind>`` and ``__wider_<kind>``."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPENED + CLOSED, OTHER + OTHER)
    which = [(kind, wider) for kind in KINDS for wider in (False, True)]
    out = docs.withColumn("__text", text).withColumn("__digit", F.col("__text").rlike("[0-9]"))
    text, digit = F.col("__text"), F.col("__digit")
    may = {("email", False): text.contains("@"), ("email", True): text.rlike("(?i)at"), ("phone", False): text.contains("+") & digit}
    cut = F.array(*(_cut(text, (WIDER if wider else BASE)[kind], may.get((kind, wider), digit)) for kind, wider in which))
    out = out.withColumn("__found", F.transform(cut, _located))
    for i, (kind, wider) in enumerate(which):
        out = out.withColumn(f"__{'wider' if wider else 'base'}_{kind}", _candidates(F.get("__found", F.lit(i)), kind, wider))
    return out.drop("__text", "__digit", "__found")


def estimate(counts: dict[int, int], rounds: int = 60) -> dict[str, np.ndarray]:
    """Labeler reliabilities and posteriors from counts by cell, by expectation-maximisation.

    Returns ``posterior`` by cell, ``right`` and ``wrong`` (kind, labeler, vote): the
    probability of a vote given personal data and given anything else.
    """
    cells = np.arange(CELLS)
    votes = np.stack([cells // 6 // VOTES**k % VOTES for k in range(LABELERS - 1, -1, -1)])
    kind = cells // 6 // VOTES**LABELERS
    weight = np.zeros(CELLS)
    for c, n in counts.items():
        weight[c] = n
    # begin with what labelers claim; smoothing keeps rare votes from certainty
    right = np.tile([0.15, 0.6, 0.25], (len(KINDS), LABELERS, 1))
    wrong = np.tile([0.5, 0.2, 0.3], (len(KINDS), LABELERS, 1))
    prior = np.full(len(KINDS), 0.5)
    posterior = np.zeros(CELLS)
    for _ in range(rounds):
        yes, no = np.log(prior[kind]), np.log(1 - prior[kind])
        for k in range(LABELERS):
            yes = yes + np.log(right[kind, k, votes[k]])
            no = no + np.log(wrong[kind, k, votes[k]])
        posterior = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        for q in range(len(KINDS)):
            mine = kind == q
            a, b = weight * posterior * mine, weight * (1 - posterior) * mine
            prior[q] = (a.sum() + 1) / (a.sum() + b.sum() + 2)
            for k in range(LABELERS):
                right[q, k] = np.bincount(votes[k], a, VOTES) + [1.5, 6, 2.5]
                wrong[q, k] = np.bincount(votes[k], b, VOTES) + [5, 2, 3]
        right /= right.sum(2, keepdims=True)
        wrong /= wrong.sum(2, keepdims=True)
    return {"posterior": posterior, "right": right, "wrong": wrong, "prior": prior}


def train(counts: dict[int, int], rounds: int = 30) -> np.ndarray:
    """The span classifier's probability for every cell, from the posteriors as soft labels."""
    soft = estimate(counts)["posterior"]
    cells = np.arange(CELLS)
    parts = [np.eye(len(KINDS))[cells // 6 // VOTES**LABELERS]]
    parts += [np.eye(VOTES)[cells // 6 // VOTES**k % VOTES] for k in range(LABELERS)]
    parts += [np.eye(3)[cells // 2 % 3], (cells % 2)[:, None]]
    x = np.hstack(parts)
    weight = np.full(CELLS, 1e-3)
    for c, n in counts.items():
        weight[c] += np.log1p(n)  # a common form of candidate should not drown the rest
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        grad = x.T @ (weight * (soft - p)) - 0.05 * beta
        beta += np.linalg.solve(x.T @ (w[:, None] * x) + 0.05 * np.eye(len(beta)), grad)
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def cell_counts(found: DataFrame) -> dict[int, int]:
    """How many candidates of the whole corpus fall in each cell; at most ``CELLS`` rows."""
    every = F.concat(*(F.transform(f"__{n}_{k}", lambda s: s["cell"]) for k in KINDS for n in ("base", "wider")))
    rows = found.select(F.explode(every).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}


def _named(no: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _accepted(verdict: str) -> Column:
    """The wider candidates of each kind that the classifier accepts and that overlap no base span of it."""
    span = "array<struct<start:int,end:int,cell:int>>"

    def tagged(kind: str) -> Column:
        base = F.transform(f"__base_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("cell")))
        wider = F.filter(f"__wider_{kind}", lambda s: F.substring(F.lit(verdict), s["cell"] + 1, F.lit(1)) == "1")
        return F.when(F.size(wider) > 0, F.array_sort(F.concat(base.cast(span), wider.cast(span)))).otherwise(F.array().cast(span))

    def free(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: F.when(s["cell"] < 0, s["end"]).otherwise(-1))
        starts = F.reverse(F.transform(spans, lambda s: F.when(s["cell"] < 0, s["start"]).otherwise(1 << 30)))

        def kept(upto: Column) -> Column:
            def keep(s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(upto["ends"], i - 1) <= s["start"], F.lit(True))
                behind = F.coalesce(F.get(upto["starts"], F.size(spans) - 2 - i) >= s["end"], F.lit(True))
                return (s["cell"] >= 0) & before & behind

            return F.filter(spans, keep)

        bounds = F.struct(running(ends, lambda a, b: F.greatest(a, b)).alias("ends"), running(starts, lambda a, b: F.least(a, b)).alias("starts"))
        return F.when(F.size(spans) == 0, spans).otherwise(_let(bounds, kept))

    return F.transform(F.array(*map(tagged, KINDS)), free)


def detect(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``struct<start, kind_no, end, kind>``.

    Both are ordered by start, then kind.  ``spans`` is the base plus the wider
    candidates that the classifier accepts and that overlap no base span of their
    kind.  A null or empty text has none.  The columns ``keep`` (all of them if not given)
    pass through, but those named ``base`` or ``spans`` give way to the operator's.
    Texts are matched once: the candidates are written and both counted and judged.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    arrays = [f"__{n}_{k}" for k in KINDS for n in ("base", "wider")]
    found = materialize(candidates(docs, text_col).select(*kept, *arrays), "pii")
    verdict = "".join("1" if p >= threshold else "0" for p in train(cell_counts(found)))
    shape = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
    found = found.withColumn("__more", _accepted(verdict))
    base = [F.transform(f"__base_{kind}", _named(no, kind)) for no, kind in enumerate(KINDS)]
    more = [F.transform(F.get("__more", F.lit(no)), _named(no, kind)) for no, kind in enumerate(KINDS)]
    out = found.withColumn("base", F.array_sort(F.concat(*base)).cast(shape))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base"), *more)).cast(shape)).drop("__more", *arrays)


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of a `detect` result; the counts are of base spans."""

    def joined(col: str) -> Column:
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
