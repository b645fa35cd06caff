"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (identity rule set;
spaces become U+2581, one is put before a text that is not empty), the pieces, and
byte fallback (a character that no piece covers becomes the pieces of its UTF-8
bytes).  Each input is composed with them and the shortest path in the tropical
semiring is its encoding.  For a merge-based model an arc weighs nothing where its
piece is compatible with the state before it and infinity elsewhere, so exactly one
path is finite (see `lattice`); the ids are those of the library.

No piece has U+2581 after another character, so composition may stop before every
run of it; the composed parts are remembered by each Python worker up to a bound.
Decoding runs the transducer backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.lattice import Lattice
from folioscan.storage import small_batches

SPACE = "▁"
_CHUNKS_KEPT = 250_000
_CHARS_AT_ONCE = 1 << 20
_loaded: dict[str, Transducer] = {}


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the runs ``starts[i] : starts[i] + sizes[i]``, end to end."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: not a merge-based model with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path}: a normaliser other than identity")
        normal, byte = 1, 6
        self.bytes_of, self.byte_id = [], np.zeros(256, np.int64)
        pieces: list[tuple[int, ...]] = []
        for i, p in enumerate(spec.pieces):
            if p.type == byte:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            else:
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode() if p.type == normal else b"")
            pieces.append(tuple(map(ord, p.piece)) if p.type == normal else ())
        by_text = {p: i for i, p in enumerate(pieces) if p}
        order = sorted(by_text.values(), key=lambda i: (-spec.pieces[i].score, i))
        rank = {i: k for k, i in enumerate(order)}
        merges = {}
        for p, i in by_text.items():
            for k in range(1, len(p)):
                a, b = by_text.get(p[:k]), by_text.get(p[k:])
                if a is not None and b is not None:
                    merges[a, b] = (rank[i], i)
        self.lattice = Lattice(pieces, merges)
        inner = set().union(*(set(p) for p in pieces if len(p) > 1))
        stops = any(ord(SPACE) in p[1:] and set(p) != {ord(SPACE)} for p in pieces)
        # a character outside all longer pieces (the line feed here) also ends a part
        alone = "" if ord("\n") in inner else "\n"
        self.parts = re.compile("(?s).+" if stops else rf"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def compose(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest paths of the parts, end to end, and the number for each."""
        joined = "".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ids, n = self.lattice.paths(symbols, lengths)
        lost = np.flatnonzero(ids == self.lattice.unknown)
        if len(lost):
            at = np.cumsum(self.lattice.width[ids]) - 1
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in symbols[at[lost]].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[lost] = [len(b) for b in raw]
            upto = np.cumsum(sizes)
            n = np.diff(np.r_[0, np.r_[0, upto][np.cumsum(n)]])
            ids = np.repeat(ids, sizes)
            fill = gather((upto - sizes)[lost], sizes[lost])
            ids[fill] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, n

    def _learn(self, parts: set[str]) -> None:
        if len(self.known) > _CHUNKS_KEPT:
            self.known = {}
            self.start, self.size, self.flat = self.start[:0], self.size[:0], self.flat[:0]
        if new := [p for p in parts if p not in self.known]:
            ids, n = self.compose(new)
            self.known.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(n) - n]
            self.size, self.flat = np.r_[self.size, n], np.r_[self.flat, ids.astype(np.int32)]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the number for each text."""
        parts = [self.parts.findall(self.normalise(t)) for t in texts]
        self._learn({p for row in parts for p in row})
        known = self.known
        which = np.array([known[p] for row in parts for p in row], np.int64)
        size = self.size[which]
        upto = np.r_[0, np.cumsum(size)]
        ends = upto[np.cumsum([len(row) for row in parts])]
        return self.flat[gather(self.start[which], size)], np.diff(np.r_[0, ends])

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)

        def made(ids: list, texts: list[str]) -> pa.RecordBatch:
            flat, n = t.encode(texts)
            ends = np.r_[0, np.cumsum(n)]
            whole = [t.decode(flat[a:b].tolist()) == x for x, a, b in zip(texts, ends, ends[1:])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(whole, pa.bool_())],
                names=["doc_id", "n_bytes", "n_pieces", "ids", "round_trip"],
            )

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, x in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(x.as_py() or "")
                size += len(texts[-1])
                if size >= _CHARS_AT_ONCE:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_pieces, ids, round_trip)``, one row per row of ``docs``.

    ``round_trip``: decoding the ids gives the text exactly (false where the text
    itself holds U+2581, which the normaliser cannot tell from a space).  A null text
    counts as empty and has no ids; null and repeated ids pass through.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return cols.mapInArrow(_encode_batches(path), "doc_id long, n_bytes long, n_pieces long, ids array<int>, round_trip boolean")


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts = [None if x.as_py() is None else t.decode([i for i in x.as_py() if i is not None and 0 <= i < len(t.bytes_of)]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of rows with ids; null ids give a null text, ids outside the model nothing."""
    cols = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return cols.mapInArrow(_decode_batches(path), "doc_id long, text string")
