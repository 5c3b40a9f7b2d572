"""Reads a SentencePiece BPE model file: pieces, ranks, byte fallback and the normaliser's switches."""

from __future__ import annotations

import heapq
import re

SPACE = "▁"


class PieceModel:
    """Pieces of a SentencePiece BPE model with an identity normaliser.

    Raises ValueError for a model of another kind, so no text is counted by rules that do not hold for it.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kind = m.SentencePiece.Type
        if m.trainer_spec.model_type != m.trainer_spec.BPE or m.normalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that remove or move white space are not supported")
        if any(p.type == kind.USER_DEFINED for p in m.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.byte_fallback = m.trainer_spec.byte_fallback
        self.pieces = [p.piece for p in m.pieces]
        self.unk_id = next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN)
        self.control = {i for i, p in enumerate(m.pieces) if p.type == kind.CONTROL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.UNUSED)}
        if any(p.type == kind.UNUSED for p in m.pieces):
            raise ValueError("models with unused pieces are not supported")
        self.rank = {p.piece: -p.score for p in m.pieces if p.type == kind.NORMAL}
        #: Pairs of characters that stand side by side inside some piece. Elsewhere no merge crosses, so a text may be cut there.
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("models with pieces across words are not supported")

    def normalise(self, text: str) -> str:
        """The model's view of a text: blanks as the visible space, one put in front."""
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def chunks(self, normal: str) -> list[str]:
        """Runs of spaces with what follows them; no merge crosses their borders."""
        return _CHUNK.findall(normal)

    def parts(self, chunk: str) -> list[str]:
        """A chunk cut between characters that no piece joins."""
        out, start = [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in self.joined:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out

    def loose(self, symbol: str) -> int:
        """Tokens of a symbol that is no piece: its bytes, or one unknown."""
        return len(symbol.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1


_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def merge(chars: str, rank: dict[str, float]) -> list[str]:
    """Byte-pair merging with a heap over a doubly linked list of symbols: the adjacent pair of lowest rank, leftmost on ties, is merged until none is left."""
    n = len(chars)
    if n < 2:
        return [chars] if n else []
    sym = list(chars)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank.get(chars[i : i + 2])
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        s = sym[i]
        if not s:
            continue
        j = right[i]
        if j >= n or len(s) + len(sym[j]) != size:  # one of the two was merged meanwhile
            continue
        s = sym[i] = s + sym[j]
        sym[j] = ""
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            r = rank.get(s + sym[k])
            if r is not None:
                heapq.heappush(heap, (r, i, len(s) + len(sym[k])))
        h = left[i]
        if h >= 0:
            r = rank.get(sym[h] + s)
            if r is not None:
                heapq.heappush(heap, (r, h, len(sym[h]) + len(s)))
    return [s for s in sym if s]
