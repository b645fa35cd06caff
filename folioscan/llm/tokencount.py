"""Token counts by prefix dynamic programming.

A text is cut at white space; for every distinct run between, the tokenizer's own
normaliser and pre-tokenizer give its pretokens (plain ASCII runs take the same rules by
`regex`), and the lattice stores the number of tokens of each.  A running sum over them
gives the exact number at every pretoken of the text, and `Prefixes` stores the number at
every prefix.  Truncation and budget questions are then look-ups; nothing is encoded again.

The counts equal the library's for files of the kind served here: byte-level merges
with an end-of-word mark over NFC, single-spaced, lower-cased text, in which no pretoken
holds white space.  Special strings inside a text are one token each, as is that
library's default.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.lattice import Lattice
from folioscan.storage import small_batches

CLOSING = 256
_WORDS_KEPT = 250_000
_BYTES_KEPT = 1 << 25
_BYTES_AT_ONCE = 1 << 20
_BYTES_TOGETHER = 1 << 17
#: A sum of tokens is above this bit of a number, the sum of pretokens below it.
_TOKENS = 32
_PRETOKENS = (1 << _TOKENS) - 1
_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_loaded: dict[str, WordCounter] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class WordCounter:
    """Counts for one tokenizer file; one for each Python worker and path."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or splits[0]["behavior"] != "Removed":
            raise ValueError(f"{path}: not a tokenizer of the kind counted here")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.space = re.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"], re.ASCII)
        # for ASCII text letters and digits are these, and white space is that of the C library
        self.words = re.compile(splits[0]["pattern"]["Regex"].replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]").replace("\\p{L}\\p{N}", "A-Za-z0-9"), re.ASCII)
        self.words_and_ends = re.compile(self.words.pattern + r"|\n", re.ASCII)
        to_byte, vocab = byte_alphabet(), model["vocab"]
        pieces: list[tuple[int, ...]] = [()] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            closed = text.endswith(suffix)
            row = [to_byte[c] for c in (text[: -len(suffix)] if closed else text)]
            pieces[i] = (*row[:-1], row[-1] + CLOSING * closed)
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._normaliser, self._splitter = library.normalizer, library.pre_tokenizer
        self.lattice = Lattice(pieces, merges)
        self.known: dict[str, int] = {}
        self.closed: dict[str, list[int]] = {}
        self._broken: dict[tuple[str, str], list[int]] = {}
        #: Tokens of each pretoken of the runs learned last.
        self.runs: dict[str, tuple[int, ...]] = {}
        #: Tokens of a whole run, its special strings among them, above the number of its pretokens.
        self.sums: dict[bytes, int] = {}
        self._older: dict[bytes, int] = {}
        self._held = 0

    def normalise(self, text: str) -> str:
        return self.space.sub(" ", text).lower() if text.isascii() else self._normaliser.normalize_str(text.encode("utf-8", "replace").decode())

    def find(self, normal: str) -> list[tuple[int, str]]:
        """The pretokens of normalised text and where they begin."""
        if normal.isascii():
            return [(m.start(), m[0]) for m in self.words.finditer(normal)]
        return [(a, normal[a:b]) for _, (a, b) in self._splitter.pre_tokenize_str(normal)]

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[np.cumsum(lengths) - 1] += CLOSING
        return symbols, lengths

    def learn(self, words: set[str]) -> None:
        """Store the counts of the words that are new."""
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            symbols, lengths = self._symbols(new)
            _, count = self.lattice.solve(symbols, lengths)
            self.known.update(zip(new, count[np.cumsum(lengths) - 1].tolist()))

    def learn_runs(self, runs: set[str]) -> None:
        """Hold the counts of the pretokens of these runs."""
        cut = {r: self.words.findall(r.lower()) if r.isascii() else [w for _, w in self.find(self.normalise(r))] for r in runs}
        self.learn(set().union(*cut.values()))
        self.runs = {r: tuple(map(self.known.__getitem__, words)) for r, words in cut.items()}

    def _cut_plain(self, runs: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The pretokens of ASCII runs, and the run of each."""
        found = self.words_and_ends.findall(b"\n".join(runs).lower().decode())
        ends = np.fromiter(map("\n".__eq__, found), bool, len(found))
        return [w for w in found if w != "\n"], np.cumsum(ends)[~ends]

    def _cut_other(self, runs: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The pretokens of runs without U+0000, and the run of each."""
        words, owners = [], [np.zeros(0, np.int64)]
        upto = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        cuts = [0, *(np.flatnonzero(np.diff(upto // _BYTES_TOGETHER)) + 1).tolist(), len(runs)]
        for lo, hi in zip(cuts, cuts[1:]):
            # U+0000 parts what is normalised, as nothing composes with it; the splitter would take it for a sign, but drops spaces
            normal = self._normaliser.normalize_str(b"\0".join(runs[lo:hi]).decode()).split("\0")
            ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)
            text = " ".join(normal)
            spans = [span for _, span in self._splitter.pre_tokenize_str(text)]
            words += [text[a:b] for a, b in spans]
            owners.append(np.searchsorted(ends, np.fromiter((a for a, _ in spans), np.int64, len(spans)), "right") + lo)
        return words, np.concatenate(owners)

    def learn_sums(self, runs: set[bytes]) -> None:
        """Store the sums of the runs that are new."""
        if len(self.sums) > _WORDS_KEPT or self._held > _BYTES_KEPT:
            self._older, self.sums, self._held = self.sums, {}, 0
        new = runs.difference(self.sums)
        again = list(filter(self._older.__contains__, new))
        self.sums.update(zip(again, map(self._older.__getitem__, again)))
        new.difference_update(again)
        odd = {r for r in new if b"<|" in r or b"\0" in r}
        new -= odd
        plain, other = [r for r in new if r.isascii()], [r for r in new if not r.isascii()]
        words, owner = self._cut_plain(plain)
        more, its = self._cut_other(other)
        words += more
        owner = np.concatenate([owner, its + len(plain)])
        self.learn(set(words))
        n = len(plain) + len(other)
        tokens = np.bincount(owner, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), n).astype(np.int64)
        self.sums.update(zip(plain + other, ((tokens << _TOKENS) + np.bincount(owner, minlength=n)).tolist()))
        parts = {r: _runs(self, r.decode()) for r in odd}
        self.learn_runs({p for row in parts.values() for p in row if p is not None})
        for r, row in parts.items():
            self.sums[r] = sum(1 << _TOKENS if p is None else (sum(self.runs[p]) << _TOKENS) + len(self.runs[p]) for p in row)
        self._held += sum(map(len, again)) + sum(map(len, new)) + sum(map(len, odd))

    def learn_prefixes(self, words: set[str]) -> None:
        """Store the number of tokens of every prefix of the words, each prefix taken as a text."""
        if len(self.closed) > _WORDS_KEPT:
            self.closed.clear()
        parts: dict[str, list[list[str]]] = {}
        for w in words:
            if w not in self.closed:
                # a prefix may fall apart ("'re" into "'" and "r")
                parts[w] = [[x for _, x in self.find(w[:k])] for k in range(1, len(w) + 1)] if w[0] == "'" else []
        if not parts:
            return
        pieces = list(dict.fromkeys([w for w in parts] + [x for rows in parts.values() for row in rows for x in row]))
        symbols, lengths = self._symbols(pieces)
        counts = self.lattice.solve(symbols, lengths, CLOSING)[2]
        ends = np.cumsum(lengths)
        whole = dict(zip(pieces, counts[ends - 1].tolist()))
        first = dict(zip(pieces, (ends - lengths).tolist()))
        for w, rows in parts.items():
            if rows:
                self.closed[w] = [0, *(sum(whole[x] for x in row) for row in rows)]
            else:
                width = np.cumsum([len(c.encode("utf-8", "replace")) for c in w])
                self.closed[w] = [0, *counts[first[w] + width - 1].tolist()]

    def broken(self, before: str, special: str) -> list[int]:
        """Tokens of ``before`` and each part of a special string right behind it, as plain text."""
        key = (before, special)
        if key not in self._broken:
            cut = [[w for _, w in self.find(before + self.normalise(special[:k]))] for k in range(len(special))]
            self.learn({w for words in cut for w in words})
            self._broken[key] = [sum(self.known[w] for w in words) for words in cut]
        return self._broken[key]

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text)


class Prefixes:
    """The exact token count at every prefix of one text.

    Positions are characters of the normalised text, in which a special string
    stands for itself and is counted once it is whole.
    """

    def __init__(self, counter: WordCounter, text: str | None) -> None:
        at, run = 0, 0
        #: Ends of pretokens, and the number of tokens up to each.
        self.ends, self.counts, self._pieces, texts = [], [], [], []
        for k, part in enumerate(counter.cut.split(text or "")):
            if k % 2:
                self._pieces.append((at, part, None))
            else:
                part = counter.normalise(part)
                self._pieces += [(at + a, w, w) for a, w in counter.find(part)]
            at += len(part)
            texts.append(part)
        self.text = "".join(texts)
        words = {w for _, _, w in self._pieces if w is not None}
        counter.learn_prefixes(words)
        #: Tokens at every prefix of each distinct pretoken.
        self._closed = {w: counter.closed[w] for w in words}
        #: For a special string that is cut: the count before it and what its part adds, with the pretoken it touches.
        self._parts: dict[int, tuple[int, list[int]]] = {}
        for k, (start, shown, word) in enumerate(self._pieces):
            if word is None:
                touched = k > 0 and self.ends[-1] == start and self._pieces[k - 1][2] is not None
                base = (self.counts[k - 2] if k > 1 else 0) if touched else run
                self._parts[k] = base, counter.broken(self._pieces[k - 1][1] if touched else "", shown)
            run += 1 if word is None else self._closed[word][-1]
            self.ends.append(start + len(shown))
            self.counts.append(run)

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters of the normalised text, by look-up."""
        k = bisect_right(self.ends, chars)
        before = self.counts[k - 1] if k else 0
        if k == len(self._pieces) or self._pieces[k][0] >= chars:
            return before
        start, _, word = self._pieces[k]
        if word is None:
            base, parts = self._parts[k]
            return base + parts[chars - start]
        return before + self._closed[word][chars - start]

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix ending with a pretoken that fits the budget."""
        k = bisect_right(self.counts, budget)
        return self.ends[k - 1] if k else 0


def counter(path: str) -> WordCounter:
    if path not in _loaded:
        _loaded[path] = WordCounter(path)
    return _loaded[path]


def _runs(c: WordCounter, text: str) -> list[str | None]:
    """Runs between ASCII white space; None stands for a special string."""
    if "<|" not in text:
        return _RUN.findall(text)
    out: list[str | None] = []
    for k, part in enumerate(c.cut.split(text)):
        out += [None] if k % 2 else _RUN.findall(part)
    return out


def _fits(c: WordCounter, texts: list[list[bytes]], limit: int) -> list[int]:
    """Pretokens of the longest prefix within the limit for texts above it; special strings take a token and are no pretokens."""
    at, cut = [], set()
    for runs in texts:
        done = 0
        for run in runs:
            if (done + c.sums[run]) >> _TOKENS > limit:
                break
            done += c.sums[run]
        at.append((done, run))
        cut.add(run)
    parts = {run: _runs(c, run.decode()) for run in cut}
    c.learn_runs({r for row in parts.values() for r in row if r is not None})
    out = []
    for done, run in at:
        left, words = limit - (done >> _TOKENS), done & _PRETOKENS
        for n, word in [cost for r in parts[run] for cost in ([(1, 0)] if r is None else [(n, 1) for n in c.runs[r]])]:
            if n > left:
                break
            left, words = left - n, words + word
        out.append(words)
    return out


def _batches(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            held: list[list[bytes]] = []
            size = 0

            def flush() -> None:
                c.learn_sums(set().union(*held))
                sums, over = c.sums, []
                for runs in held:
                    total = sum(map(sums.__getitem__, runs))
                    n_tokens.append(total >> _TOKENS)
                    if n_tokens[-1] > limit:
                        over.append(len(fit))
                    fit.append(total & _PRETOKENS)
                for k, words in zip(over, _fits(c, [held[k - len(fit)] for k in over], limit)):
                    fit[k] = words
                held.clear()

            for value in batch.column(1).cast(pa.large_binary()):
                raw = value.as_py() or b""
                n_bytes.append(len(raw))
                held.append(raw.split())  # bytes are cut at ASCII white space alone
                size += len(raw)
                if size >= _BYTES_AT_ONCE:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_words"],
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_words)``, one row per row of ``docs``.

    ``fit_words``: pretokens of the longest prefix within the limit; a special string
    takes one token of it and is no pretoken itself.  A null text counts as empty; ids pass through, null ones too.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return cols.mapInArrow(_batches(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_words long")
