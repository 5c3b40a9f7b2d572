"""Operator 5, SentencePiece encoding and decoding by weighted finite-state transducers.

Machines are data: states, and for each state arcs that read a label, write an output, weigh and lead on (`Fst`).

- normaliser: an entry arc that reads nothing and writes the dummy prefix, then one state that writes a blank as the visible
  space and every other character as itself;
- pieces: a trie whose leaves write a piece with weight -score and lead back to its root;
- byte fallback: entered from the trie's root; a character that is no piece is written as its bytes' ids;
- the pieces and the fallback are joined, and the normaliser is composed with them, once for a model (`union`, `compose`);
- order: an acceptor of symbols. A BPE model's segmentation is not the path of least summed weight over all piece paths, so a
  symbol may follow another only if byte-pair merging of their joined text gives just these two (`Order`). Its arcs are made
  when first met. Every text has one path that it accepts, and that path is what the model encodes.

Each input is composed with the joint machine and the order, and the shortest path in the tropical semiring is taken (`shortest`).
Where the order leaves one path the weights have nothing left to decide; without an order (`order=None`, as for a unigram
model) they decide alone. Decoding is the inverse: ids
write their bytes, and the dummy prefix goes.

Defined cases: a literal visible space decodes to a blank, as the model's normaliser makes no difference between them
(lossless is then false); a null or empty text has no ids and decodes to an empty text; of paths of equal weight the first found
is taken; a very long text is cut where no piece reaches across, and a very long word costs memory in proportion to its ids;
null ids stay null; repeated rows are encoded row by row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memo, cut_at_blanks, in_slices, kept_by_worker, per_batch
from .piece_model import SPACE, PieceModel, merge
from .token_counts import ODD

#: Weight of a byte-fallback arc, above that of any piece.
_FALLBACK = 1e6
#: Labels: an arc under EPS reads nothing; one under ANY reads each label that has no arc of its own. Output SAME is what was read.
#: START stands before a whole text.
EPS, ANY, SAME, START = "", "any", "same", "start"
#: Bytes of text that are encoded together.
SLICE = 1 << 23
_CHUNK = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")


class Fst:
    """arcs[state][label] = (output, weight, next state), or None where a label is refused. State 0 is the start and the end."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, tuple[str, float, int] | None]] = [{}]

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1


def normaliser(model: PieceModel) -> Fst:
    out = Fst()
    at = out.state() if model.dummy_prefix else 0
    if at:
        out.arcs[0][EPS] = (SPACE, 0.0, at)
    out.arcs[at] |= {" ": (SPACE, 0.0, at), ANY: (SAME, 0.0, at)}
    return out


def pieces(weights: dict[str, float]) -> Fst:
    out = Fst()
    for piece, weight in weights.items():
        at = 0
        for c in piece:
            if c not in out.arcs[at]:
                out.arcs[at][c] = ("", 0.0, out.state())
            at = out.arcs[at][c][2]
        out.arcs[at][EPS] = (piece, weight, 0)
    return out


def fallback(weights: dict[str, float]) -> Fst:
    """Refuses what is a piece."""
    out = Fst()
    out.arcs[0] = {p: None for p in weights if len(p) == 1} | {ANY: (SAME, _FALLBACK, 0)}
    return out


def union(a: Fst, b: Fst) -> Fst:
    """Either machine, again and again: an arc that reads nothing leads from a's start to b's, and b's arcs to its start lead to a's."""
    out, first = Fst(), len(a.arcs)
    out.arcs = [dict(x) for x in a.arcs] + [{k: v and (v[0], v[1], v[2] + first if v[2] else 0) for k, v in x.items()} for x in b.arcs]
    out.arcs[0][EPS] = ("", 0.0, first)
    return out


def compose(a: Fst, b: Fst) -> tuple[Fst, int]:
    """What b makes of what a writes, for an a that writes one label an arc; and the state from which nothing is left of a's entry."""
    out, place, todo = Fst(), {(0, 0): 0}, [(0, 0)]

    def state(pair: tuple[int, int]) -> int:
        if pair not in place:
            place[pair] = out.state()
            todo.append(pair)
        return place[pair]

    while todo:
        s, t = todo.pop()
        here, mine, theirs = out.arcs[place[s, t]], a.arcs[s], b.arcs[t]
        if EPS in mine:  # the entry comes before all else
            got = theirs.get(mine[EPS][0])
            if got:
                here[EPS] = (got[0], mine[EPS][1] + got[1], state((mine[EPS][2], got[2])))
            continue
        for label, got in theirs.items():
            if label == EPS:
                here[EPS] = (got[0], got[1], state((s, got[2])))
            elif label == ANY or label not in mine:  # a writes it as it is
                here[label] = got and (got[0], got[1], state((s, got[2])))
        for label, arc in mine.items():
            got = theirs.get(arc[0], theirs.get(ANY)) if label != ANY else None
            if got:
                here[label] = (arc[0] if got[0] == SAME else got[0], arc[1] + got[1], state((arc[2], got[2])))
            elif label != ANY and ANY in theirs:
                here[label] = None
    inside = place.get((a.arcs[0][EPS][2], 0)) if EPS in a.arcs[0] else 0
    return out, 0 if inside is None else inside


class Order(Memo):
    """Whether a symbol may follow another: an acceptor with a state for each symbol, whose arcs are made when first met."""

    def __init__(self, rank: dict[str, float], bound: int = 300_000):
        super().__init__(lambda pair: merge(pair[0] + pair[1], rank) == list(pair), bound)


class Linked:
    """A joint machine with its arcs linked for walking: to each label the symbol and weight of the arc out of the state that it
    leads to (or None), and how to look up that state's own arcs. The entry arc reads the label START. Only arcs that read nothing,
    and those of the fallback, may write or weigh."""

    def __init__(self, machine: Fst, root: int):
        nodes: list[dict] = [{} for _ in machine.arcs]
        aside = machine.arcs[root][EPS][2] if EPS in machine.arcs[root] else None

        def to(state: int) -> tuple:
            arc = machine.arcs[state].get(EPS)
            return arc[:2] if arc and arc[0] else None, nodes[state].get

        for at, arcs in enumerate(machine.arcs):
            for label, arc in arcs.items():
                if label == EPS or at == aside:
                    continue
                if arc[0] or arc[1]:
                    raise ValueError("an arc that reads also writes or weighs")
                nodes[at][label] = to(arc[2])
        if root:
            nodes[root][START] = to(machine.arcs[0][EPS][2])
        self.root = nodes[root].get
        self.loose = machine.arcs[aside] | {START: None} if aside is not None else {}


def shortest(machine: Linked, labels: Sequence[str], order: Order | None) -> list[str]:
    """The symbols of the shortest path of an input through the machine and the order.

    An order accepts at most one path of a prefix, and without one a path's rest does not depend on its symbols so far: either way
    a state is a position, with the least weight to it and the last symbol on the way. Each label writes one character."""
    n, root, loose, other, inf = len(labels), machine.root, machine.loose, machine.loose.get(ANY), float("inf")
    weight, last = [inf] * (n + 1), [""] * (n + 1)
    weight[0] = 0.0
    for at in range(n):
        w, prior, i, get = weight[at], last[at], at, root
        if w == inf:
            continue
        found = loose.get(labels[at], other)
        if found and w + found[1] < weight[at + 1] and (not prior or order is None or order[prior, labels[at]]):
            weight[at + 1], last[at + 1] = w + found[1], labels[at]
        while i < n:
            arc = get(labels[i])
            if arc is None:
                break
            out, get = arc
            i += 1
            if out is not None and w + out[1] < weight[i] and (not prior or order is None or order[prior, out[0]]):
                weight[i], last[i] = w + out[1], out[0]
    if weight[n] == inf:
        raise ValueError("no path")
    out = []
    while n:
        out.append(last[n])
        n -= len(last[n])
    return out[::-1]


class Transducer:
    def __init__(self, path: str):
        self.model = m = PieceModel(path)
        # a piece that merging never makes is on no path
        made = {p: r for p, r in m.rank.items() if len(merge(p, m.rank)) == 1}
        self.machine = Linked(*compose(normaliser(m), union(pieces(made), fallback(m.rank))))
        self.order = Order(m.rank)
        #: Ids that a symbol writes.
        self.ids: Callable[[str], bytes] = Memo(lambda s: struct.pack(f"<{len(x := self.ids_of(s))}I", *x), 100_000).__getitem__
        both = lambda x: {" ", SPACE} if x == SPACE else {x}
        #: Characters, as they are read, that stand side by side inside some piece.
        self.joined = {a + b for x in m.joined for a in both(x[0]) for b in both(x[1])}
        self.part = Memo(self._encode_part, 500_000)
        self.word = Memo(self._encode_chunk, 500_000)
        bytes_of = {i: bytes([b]) for b, i in m.byte_id.items()}
        self.written = [
            bytes_of.get(i, b"" if i in m.control else b" \xe2\x81\x87 " if i == m.unk_id else p.replace(SPACE, " ").encode())
            for i, p in enumerate(m.pieces)
        ]

    def path(self, text: str, entry: bool = False) -> list[str]:
        """The symbols of a text as it is read; entry: with the dummy prefix before it."""
        return shortest(self.machine, [START, *text] if entry else text, self.order)

    def ids_of(self, symbol: str) -> list[int]:
        m = self.model
        if symbol in m.ids:
            return [m.ids[symbol]]
        return [m.byte_id[b] for b in symbol.encode()] if m.byte_fallback else [m.unk_id]

    def parts(self, chunk: str) -> Iterator[str]:
        """A chunk cut between characters that no piece joins."""
        start = 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in self.joined:
                yield chunk[start:i]
                start = i
        yield chunk[start:]

    def _encode_part(self, part: str, entry: bool = False) -> bytes:
        return b"".join(map(self.ids, self.path(part, entry)))

    def _encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._encode_part if len(chunk) > 256 else self.part.__getitem__, self.parts(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = _CHUNK.findall(text)
        if not self.model.dummy_prefix:
            return b"".join(map(self._encode_chunk, chunks))
        first, *others = self.parts(chunks[0])
        return b"".join([self._encode_part(first, entry=True), *map(self._encode_part, others), *map(self._encode_chunk, chunks[1:])])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of a batch of texts, and the number of each text's ids: each distinct word is composed once."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        if self.model.dummy_prefix:  # to enter by the prefix or to read a blank is the same, so first words need no memo of their own
            plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        words, codes, starts = cut_at_blanks(plain)
        ids = [self.word[w] for w in words]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        flat = table.take(pa.array(codes)).flatten().to_numpy() if len(codes) else np.empty(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(size[codes])])[starts]
        if not odd.any():
            return flat, np.diff(ends)
        pieces = [np.frombuffer(self.encode(texts[i].as_py()), "<u4") if odd[i] else flat[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a text's ids; ids made by this model give back whole characters."""
        out = b"".join(map(self.written.__getitem__, ids.tolist()))
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out


@kept_by_worker
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs(doc_id, text)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in in_slices(b, 1, SLICE):
            ids, n = transducer(model_path).encode_all(s.column(1))
            off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for each row of encoded(doc_id, ids). Null ids decode to an empty text; bytes that are no UTF-8 to U+FFFD."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fst = transducer(model_path)
        text = [fst.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return per_batch(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode, decode and digest each document: doc_id, n_bytes, n_tokens, ids_crc32, decoded_sha256, lossless."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fst = transducer(model_path)
        for s in in_slices(b, 1, SLICE):
            ids, n = fst.encode_all(s.column(1))
            ends = np.cumsum(n).tolist()
            cols = ([], [], [], [])
            for raw, lo, hi in zip(pc.fill_null(s.column(1), "").cast(pa.binary()).to_pylist(), [0, *ends], ends, strict=False):
                back = fst.decode(ids[lo:hi])
                for c, v in zip(cols, (len(raw), zlib.crc32(np.ascontiguousarray(ids[lo:hi], "<u4")), hashlib.sha256(back).hexdigest(), back == raw), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [s.column(0), pa.array(cols[0], pa.int64()), pa.array(n), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
