"""Operator 2, exact substring deduplication by sorting suffixes.

A byte goes if some LENGTH-byte string over it also starts earlier (in a smaller doc_id, or earlier in the same document).
Suffixes are sorted by deep-shallow sorting: multikey quicksort, eight bytes a key and all open groups at once, to a shallow
depth of SHALLOW keys; blind tries then order the groups whose members still agree. Sorting all suffixes of a corpus in one place is neither
possible nor needed:

1. Anchors: in each LENGTH-byte string the GRAM-byte string of smallest hash is an anchor, so equal strings have equal anchors
   at the same place. Anchors are dealt by hash, in blocks of arrays; those that occur once are dropped, and so are those that
   only copies of one text share.
2. Copies: of equal texts only the first goes on; the others go whole if they have LENGTH bytes, and else stay.
3. Suffixes: each remaining anchor takes with it the bytes that a string over it can have, LENGTH to its right and
   LENGTH - GRAM to its left. Within a block, of anchors with equal surroundings only the first travels on.
4. By anchor hash, the right sides and the reversed left sides are sorted with their common-prefix lengths. Strings that start
   d bytes before an anchor are equal if the right sides agree for LENGTH - d bytes and the left ones for d; of each class all
   but the first are marked. The strings over one anchor overlap, so its marked bytes are one span.
5. Spans meet their document, and its bytes outside them are kept.

All is exact: hashes only bring together what is then compared byte by byte. Defined cases: a null text is empty; texts with less than LENGTH
bytes keep all; a null doc_id comes before all others; rows that share a doc_id but not their text are ordered by their text's
hash; rows equal in both are judged alike and do not remove each other; a very long text is looked at in pieces, and a long run of a
short period by its first strings, as all others in it repeat these; an empty table gives an empty table; other columns are
ignored (`deduplicated` keeps them). A cut can fall inside a character: `deduplicated` leaves out its stray bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import drop_stored, ship_package, stored

from .common import in_slices, per_batch, release

LENGTH, GRAM = 100, 32
LEFT = LENGTH - GRAM
#: Bytes of text for each block of anchors.
BLOCK_BYTES = 1 << 24
#: Bytes of text whose windows are looked at together.
PIECE = 1 << 21
SHALLOW = 5
#: Bytes that repeat after at most so many are treated as a run.
PERIOD = LEFT // 2
#: Bytes between the places where runs are looked for.
STEP = 32
#: Anchors whose surroundings are held together.
CHUNK = 1 << 17
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# --- sorting -------------------------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The sorted order of strings of equal length, by a blind trie: its nodes hold only where their strings part.

    A string goes down by its bytes at the nodes' places to some leaf, is compared once with that leaf, and is put where the
    two part. Equal strings share a leaf, in the order they came.
    """
    leaves: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        leaves.setdefault(s, []).append(i)
    # a node is [depth, {byte: node}], a leaf is the string
    root: list | bytes | None = None
    for s in leaves:
        if root is None:
            root = s
            continue
        node = root
        while not isinstance(node, bytes):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = _common(s, node)
        old = node[depth]
        above, node = None, root
        while not isinstance(node, bytes) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, bytes) and node[0] == depth:
            node[1][s[depth]] = s
            continue
        new = [depth, {old: node, s[depth]: s}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out: list[int] = []
    todo = [root] if root is not None else []
    while todo:
        node = todo.pop()
        if isinstance(node, bytes):
            out += leaves[node]
        else:
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of keys (m x k) sorted by their first `depth` keys: the order, and for each place in it where its run of equal rows starts.

    Each open group is parted three ways by a pivot (the median of its first, middle and last key at the group's depth); what
    equals the pivot goes one key deeper. All open groups take a step at once, so a step is a few passes over arrays.
    """
    m = len(words)
    order, group, deep = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
    open_at = np.arange(m if m > 1 and depth else 0)
    while len(open_at):
        own = group[open_at]
        key = words[order[open_at], deep[open_at]].astype(_U)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(first, len(own)))
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        less, more = key < pivot, key > pivot
        # where each part of a group begins, and each row's place in its part
        ahead = lambda x: np.cumsum(x) - x
        before = [ahead(x.astype(np.int64)) for x in (less, ~(less | more), more)]
        place = [x - np.repeat(x[first], size) for x in before]
        n_less, n_more = (np.add.reduceat(x.astype(np.int64), first) for x in (less, more))
        of_equal, of_more = np.repeat(first + n_less, size), np.repeat(first + size - n_more, size)
        begin = np.where(less, np.repeat(first, size), np.where(more, of_more, of_equal))
        to = begin + np.where(less, place[0], np.where(more, place[2], place[1]))
        at = open_at[to]
        order[at] = order[open_at]
        group[at] = open_at[begin]
        deep[at] = deep[open_at] + ~(less | more)
        own = group[open_at]
        again = np.append(own[1:] == own[:-1], False)
        open_at = open_at[(again | np.append(False, again[:-1])) & (deep[open_at] < depth)]
    return order, group


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows (m x k), and each one's common prefix with the row before it in this order."""
    m, k = rows.shape
    if not m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = np.zeros((m, -(-k // 8) * 8), np.uint8)
    wide[:, :k] = rows
    words = wide.view(">u8")
    order, group = multikey_quicksort(words, min(SHALLOW, words.shape[1]))
    if words.shape[1] > SHALLOW:
        again = np.append(group[1:] == group[:-1], False)
        open_at = np.flatnonzero(again | np.append(False, again[:-1]))
        firsts = group[open_at]
        rest = wide[:, SHALLOW * 8 : k]
        # groups whose rows all agree need no trie
        differ = (rest[order[open_at]] != rest[order[firsts]]).any(axis=1)
        for first in np.unique(firsts[differ]).tolist():
            lo, hi = np.searchsorted(firsts, [first, first + 1])
            at = open_at[lo:hi]
            own = order[at]
            order[at] = own[blind_trie_order([r.tobytes() for r in rest[own]])]
    lcp = np.zeros(m, np.int64)
    for lo in range(1, m, 100_000):
        hi = min(m, lo + 100_000)
        apart = rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]
        lcp[lo:hi] = np.where(apart.any(axis=1), apart.argmax(axis=1), k)
    return order, lcp


def marked(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors in order of their place in the corpus: the least and the most bytes before it at which a string starts that occurs earlier (-1: none).

    right and left: the bytes after and, reversed, before each anchor, filled up with zeros; n_right and n_left: how many are real.
    """
    m = len(right)
    low, high = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    order_r, lcp_r = deep_shallow(right)
    order_l, lcp_l = deep_shallow(left)
    rid, lid = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(LEFT + 1):
        ok = np.flatnonzero((n_left >= d) & (n_right >= LENGTH - d))
        if len(ok) < 2:
            continue
        rid[order_r] = np.cumsum(lcp_r < LENGTH - d)
        lid[order_l] = np.cumsum(lcp_l < d)
        key = rid[ok] * (m + 1) + lid[ok]
        by = np.argsort(key, kind="stable")
        again = ok[by[1:][key[by][1:] == key[by][:-1]]]
        high[again] = d
        low[again] = np.where(low[again] < 0, d, low[again])
    return low, high


# --- anchors -------------------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, n: int, take: np.ufunc) -> np.ndarray:
    """take over n neighbours from each place on; n places less one fall away."""
    step = 1
    while 2 * step <= n:
        x = take(x[:-step], x[step:])
        step *= 2
    return take(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def periodic_runs(raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """start, end, period of each run of at least LENGTH + period bytes that repeat every period <= PERIOD bytes, in one document.

    In a run a string equals the one a period before, so all that start a period or more after the run's start are repeats.
    """
    n, out = len(raw), []
    for p in range(1, PERIOD + 1):
        m = (n - p) // 8
        # eight bytes from a multiple of STEP on, and the same a period later; a run holds two of these in a row
        hit = raw[: 8 * max(0, m)].view("<u8")[:: STEP // 8] == raw[p : p + 8 * max(0, m)].view("<u8")[:: STEP // 8]
        if not (hit[1:] & hit[:-1]).any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if last - first < 2:
                continue
            lo, hi = max(0, first - 1) * STEP, min(n, last * STEP + 8 + p)
            k = int(np.searchsorted(ends, lo, "right"))
            while lo < hi:  # in each document by itself
                end = min(hi, int(ends[k]))
                if end - lo >= LENGTH + p:
                    same = np.zeros(end - lo - p + 2, np.int8)
                    same[1:-1] = raw[lo + p : end] == raw[lo : end - p]
                    at = np.flatnonzero(np.diff(same))
                    out += [(lo + x, lo + y + p, p) for x, y in zip(at[::2].tolist(), at[1::2].tolist(), strict=True) if y - x >= LENGTH]
                lo, k = end, k + 1
    return out


_SPREAD = _mix(np.arange(1, 257, dtype=_U)).astype(np.uint32)


def anchors(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of anchors in the bytes of documents laid end to end; ends: where each document ends."""
    n = len(raw)
    if n < LENGTH:
        return np.empty(0, np.int64)
    h, step, factor = _SPREAD[raw], 1, 0x9E3779B1
    while step < GRAM:
        h = h[:-step] * np.uint32(factor) + h[step:]
        factor = (factor * factor + 2) & 0xFFFFFFFF
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    h |= np.uint32(1)
    least = _slide(h, LEFT + 1, np.minimum)  # of each LENGTH-byte string
    for e in ends[:-1].tolist():  # no string crosses documents
        least[max(0, e - LENGTH + 1) : e] = 0
    for start, end, period in periodic_runs(raw, ends):  # of a run's strings the first ones, and one that repeats, stand for all
        least[start + period + 1 : end - LENGTH + 1] = 0
    most = _slide(np.concatenate([np.zeros(LEFT, np.uint32), least, np.zeros(LEFT, np.uint32)]), LEFT + 1, np.maximum)
    return np.flatnonzero(most == h)


def anchors_of(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text (by its place in the list) its anchors."""
    held: list[int] = []
    size = 0

    def several() -> Iterator[tuple[int, np.ndarray]]:
        ends = np.cumsum([len(raws[i]) for i in held])
        at = anchors(np.frombuffer(b"".join([raws[i] for i in held]), np.uint8), ends)
        own = np.searchsorted(ends, at, "right")
        cut = np.searchsorted(own, np.arange(len(held) + 1))
        for k, i in enumerate(held):
            yield i, at[cut[k] : cut[k + 1]] - (ends[k] - len(raws[i]))

    for i, raw in enumerate(raws):
        if len(raw) > PIECE:  # pieces overlap, so that each LENGTH-byte string lies in one of them whole
            x = np.frombuffer(raw, np.uint8)
            found = [lo + anchors(x[lo : lo + PIECE + LENGTH - 1], np.array([min(len(x), lo + PIECE + LENGTH - 1)])) for lo in range(0, len(x), PIECE)]
            yield i, np.unique(np.concatenate(found))
            continue
        held.append(i)
        size += len(raw)
        if size >= PIECE:
            yield from several()
            held, size = [], 0
    if held:
        yield from several()


def _gram_hash(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place on."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, GRAM)[at]).view("<u8").reshape(-1, GRAM // 8)
    h = np.zeros(len(at), _U)
    for i in range(GRAM // 8):
        h = _mix((h + words[:, i]) * _U(0x9E3779B97F4A7C15) + _U(1))
    return h


# --- the job -------------------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _cuts(key: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]


def _rows_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that share their first column; they come sorted by it."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
    del held
    release()


def _all(rows: list[tuple], i: int, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[i], kind) for r in rows])


def _places(d: np.ndarray, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The order of places in the corpus, each place once (repeated rows have equal places)."""
    order = np.lexsort((pos, h, d))
    d, h, pos = d[order], h[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (pos[1:] != pos[:-1])
    return order[new]


def _home(d: np.ndarray, h: np.ndarray, homes: int) -> np.ndarray:
    return (_mix(d.view(_U) * _U(31) + h.view(_U)) % _U(homes)).astype(np.int32)


def _by_document(arrays: list[np.ndarray], homes: int) -> list[tuple]:
    """Rows (home, blobs of d, h and the other arrays), one a home."""
    home = _home(arrays[0], arrays[1], homes)
    order = np.argsort(home, kind="stable")
    home, arrays = home[order], [a[order] for a in arrays]
    cut = _cuts(home)
    return [(int(home[lo]), *(a[lo:hi].tobytes() for a in arrays)) for lo, hi in zip(cut, cut[1:], strict=False)]


def _keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return docs.select(F.coalesce(docs["doc_id"], F.lit(-(1 << 63))).alias("d"), F.xxhash64(raw).alias("h"), raw.alias("raw"))


def _anchor_blocks(base: DataFrame, buckets: int) -> DataFrame:
    """bucket, and blobs of anchor hash, document's place in the block, its d and h, position."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in in_slices(b, 2):
            d, h = s.column(0).to_numpy(), s.column(1).to_numpy()
            raws = s.column(2).to_pylist()
            at_doc, at_pos, gram = [], [], []
            for i, pos in anchors_of(raws):
                if len(pos):
                    at_doc.append(np.full(len(pos), i, np.uint32))
                    at_pos.append(pos.astype(np.uint32))
                    gram.append(_gram_hash(np.frombuffer(raws[i], np.uint8), pos))
            if not gram:
                continue
            g, doc, pos = np.concatenate(gram), np.concatenate(at_doc), np.concatenate(at_pos)
            bucket = (g % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            g, doc, pos, bucket = g[order], doc[order], pos[order], bucket[order]
            cut, rows = _cuts(bucket), []
            for lo, hi in zip(cut, cut[1:], strict=False):
                own, place = np.unique(doc[lo:hi], return_inverse=True)
                rows.append((int(bucket[lo]), g[lo:hi].tobytes(), place.astype(np.uint32).tobytes(), d[own].tobytes(), h[own].tobytes(), pos[lo:hi].tobytes()))
            yield _batch(rows, ["bucket", "g", "at", "d", "h", "pos"], [pa.int32(), *[pa.binary()] * 5])

    return per_batch(base.select("d", "h", "raw").filter(F.octet_length("raw") >= LENGTH), run, "bucket int, g binary, at binary, d binary, h binary, pos binary")


def _repeated(blocks: DataFrame, buckets: int, homes: int) -> DataFrame:
    """Anchors that occur twice or more, by document: d, h, pos (blob)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by_key(batches):
            g, pos = _all(rows, 1, "<u8"), _all(rows, 5, "<u4")
            d, h = (np.concatenate([np.frombuffer(r[i], "<i8")[np.frombuffer(r[2], "<u4")] for r in rows]) for i in (3, 4))
            order = np.lexsort((pos, h, g))
            g, text, place = g[order], h[order], pos[order]
            first = np.append(True, g[1:] != g[:-1])
            # an anchor is repeated if it has two places; copies of a text share one
            other = np.append(False, (g[1:] == g[:-1]) & ((text[1:] != text[:-1]) | (place[1:] != place[:-1])))
            group = np.cumsum(first) - 1
            keep = order[np.bincount(group, other, len(g))[group] > 0]
            yield _batch(_by_document([d[keep], h[keep], pos[keep]], homes), ["home", "d", "h", "pos"], [pa.int32(), *[pa.binary()] * 3])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by_key(batches):
            d, h, pos = _all(rows, 1, "<i8"), _all(rows, 2, "<i8"), _all(rows, 3, "<u4")
            order = _places(d, h, pos)
            d, h, pos = d[order], h[order], pos[order]
            cut = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(h) != 0)) + 1).tolist(), len(d)] if len(d) else [0]
            yield _batch([(int(d[lo]), int(h[lo]), pos[lo:hi].tobytes()) for lo, hi in zip(cut, cut[1:], strict=False)], ["d", "h", "pos"], [pa.int64(), pa.int64(), pa.binary()])

    by_home = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(found, "home int, d binary, h binary, pos binary")
    return by_home.repartition(homes, "home").sortWithinPartitions("home").mapInArrow(gathered, "d long, h long, pos binary")


_SURROUNDED = "bucket int, right binary, left binary, n_right binary, n_left binary, d binary, h binary, pos binary, decided int"


def _surroundings(base: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """Blocks of anchors with the bytes around them; bucket -1: spans that are already known (d, h, pos, and their size in n_right)."""
    width = LEFT + LENGTH

    def held(s: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Surroundings, n_left, n_right, d, h, pos of up to CHUNK anchors at a time."""
        parts, size = [], 0
        for dd, hh, raw, blob in zip(*(s.column(i).to_pylist() for i in range(4)), strict=True):
            every = np.frombuffer(blob, "<u4").astype(np.int64)
            x = np.zeros(len(raw) + width, np.uint8)
            x[LEFT : LEFT + len(raw)] = np.frombuffer(raw, np.uint8)
            around = np.lib.stride_tricks.sliding_window_view(x, width)
            for lo in range(0, len(every), CHUNK):
                at = every[lo : lo + CHUNK]
                parts.append((around[at], np.minimum(at, LEFT), np.minimum(len(raw) - at, LENGTH), np.full(len(at), dd, np.int64), np.full(len(at), hh, np.int64), at))
                size += len(at)
                if size >= CHUNK:
                    yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                    parts, size = [], 0
        if parts:
            yield tuple(map(np.concatenate, zip(*parts, strict=True)))

    def runs(s: pa.RecordBatch) -> tuple:
        """What is known of runs: all but their first period repeats."""
        raws = s.column(2).to_pylist()
        ends = np.cumsum([len(x) for x in raws])
        found = np.array(periodic_runs(np.frombuffer(b"".join(raws), np.uint8), ends), "<i8").reshape(-1, 3)
        own = np.searchsorted(ends, found[:, 0], "right")
        pos = found[:, 0] + found[:, 2] - (ends - [len(x) for x in raws])[own]
        size, d, h = (x.astype("<i8") for x in (found[:, 1] - found[:, 0] - found[:, 2], s.column(0).to_numpy()[own], s.column(1).to_numpy()[own]))
        return (-1, b"", b"", size.tobytes(), b"", d.tobytes(), h.tobytes(), pos.tobytes(), 1)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in in_slices(b, 2):
            rows = [runs(s)]
            for c, nl, nr, d, h, pos in held(s):
                order = _places(d, h, pos)
                c, nl, nr, d, h, pos = (x[order] for x in (c, nl, nr, d, h, pos))
                # of anchors whose surroundings are equal, only the first travels; all strings of the others occur earlier
                whole = np.concatenate([c, nl[:, None].astype(np.uint8), nr[:, None].astype(np.uint8)], axis=1)
                key = np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1]))).ravel()
                again = np.ones(len(key), bool)
                seen: dict[bytes, int] = {}
                for i, k in enumerate(key.tolist()):
                    again[i] = seen.setdefault(k, i) != i
                low, high = np.maximum(0, LENGTH - nr), np.minimum(nl, LEFT)
                known = again & (low <= high)
                if known.any():
                    rows.append((-1, b"", b"", (high - low + LENGTH)[known].astype("<i8").tobytes(), b"", d[known].tobytes(), h[known].tobytes(), (pos - high)[known].tobytes(), 1))
                keep = np.flatnonzero(~again)
                bucket = (_gram_hash(c[keep].ravel() if len(keep) else np.zeros(width, np.uint8), np.arange(len(keep)) * width + LEFT) % _U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keep, bucket = keep[order], bucket[order]
                cut = _cuts(bucket)
                for lo, hi in zip(cut, cut[1:], strict=False):
                    i = keep[lo:hi]
                    rows.append((int(bucket[lo]), c[i, LEFT:].tobytes(), c[i, :LEFT][:, ::-1].tobytes(), nr[i].astype(np.uint8).tobytes(), nl[i].astype(np.uint8).tobytes(), d[i].tobytes(), h[i].tobytes(), pos[i].tobytes(), 0))
                yield _batch(rows, [x.split()[0] for x in _SURROUNDED.split(", ")], [pa.int32(), *[pa.binary()] * 7, pa.int32()])
                rows = []

    return per_batch(base.join(repeated, ["d", "h"]).select("d", "h", "raw", "pos"), run, _SURROUNDED)


def _spans(surrounded: DataFrame, buckets: int, homes: int) -> DataFrame:
    """d, h, start, size (blobs): the bytes to remove of each document, as merged spans."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by_key(batches):
            d, h, pos = (_all(rows, i, "<i8") for i in (5, 6, 7))
            if rows[0][0] < 0:
                start, size = pos, _all(rows, 3, "<i8")
            else:
                right, left = _all(rows, 1, "u1").reshape(-1, LENGTH), _all(rows, 2, "u1").reshape(-1, LEFT)
                nr, nl = _all(rows, 3, "u1").astype(np.int64), _all(rows, 4, "u1").astype(np.int64)
                order = _places(d, h, pos)
                d, h, pos = d[order], h[order], pos[order]
                low, high = marked(right[order], left[order], nr[order], nl[order])
                hit = high >= 0
                d, h, start, size = d[hit], h[hit], (pos - high)[hit], (high - low + LENGTH)[hit]
            yield _batch(_by_document([d, h, start, size], homes), ["home", "d", "h", "start", "size"], [pa.int32(), *[pa.binary()] * 4])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by_key(batches):
            d, h, start, size = (_all(rows, i, "<i8") for i in (1, 2, 3, 4))
            order = np.lexsort((start, h, d))
            d, h, start, end = d[order], h[order], start[order], (start + size)[order]
            cut = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(h) != 0)) + 1).tolist(), len(d)] if len(d) else [0]
            out = []
            for lo, hi in zip(cut, cut[1:], strict=False):
                s, reach = start[lo:hi], np.maximum.accumulate(end[lo:hi])
                new = np.append(True, s[1:] > reach[:-1])
                first = s[new]
                out.append((int(d[lo]), int(h[lo]), first.tobytes(), (reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] - first).tobytes()))
            yield _batch(out, ["d", "h", "start", "size"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    # a known span needs no company: it is dealt by any key
    spread = surrounded.withColumn("deal", F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("pos")))
    by_home = spread.repartition(buckets, "deal").drop("deal").sortWithinPartitions("bucket").mapInArrow(judged, "home int, d binary, h binary, start binary, size binary")
    return by_home.repartition(homes, "home").sortWithinPartitions("home").mapInArrow(merged, "d long, h long, start binary, size binary")


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For docs(doc_id, text): written spans d, h, start, size, and the written firsts d, h of each distinct text."""
    ship_package(docs.sparkSession)
    base = _keyed(docs)
    firsts = stored(base.groupBy(F.sha2("raw", 256).alias("digest")).agg(F.min(F.struct("d", "h")).alias("f"), F.max(F.octet_length("raw")).alias("size")).select("f.d", "f.h", "size"), "firsts")
    total = firsts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BLOCK_BYTES))
    # the texts move only once, to meet their repeated anchors: which are first of their kind is known there
    repeated = stored(_repeated(_anchor_blocks(base, buckets), buckets, buckets).join(firsts.select("d", "h"), ["d", "h"], "left_semi"), "repeated")
    found = stored(_spans(_surroundings(base, repeated, buckets), buckets, buckets), "spans")
    drop_stored(repeated)
    return found, firsts


def _cut(raw: bytes, first: bool, start: bytes | None, size: bytes | None) -> tuple[bytes, int, int]:
    """What is kept of a text, the bytes removed and the spans removed."""
    if not first:
        return (b"", len(raw), 1) if len(raw) >= LENGTH else (raw, 0, 0)
    if start is None:
        return raw, 0, 0
    s = np.frombuffer(start, "<i8")
    e = s + np.frombuffer(size, "<i8")
    kept = b"".join([raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)])
    return kept, len(raw) - len(kept), len(s)


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with d, h, raw, whether the text is the first of its kind, and its spans."""
    found, firsts = spans(docs.select("doc_id", "text"))
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    known = firsts.select("d", "h", F.lit(True).alias("is_first")).join(found, ["d", "h"], "left").withColumnsRenamed({"d": "_d", "h": "_h", "start": "_start", "size": "_size", "is_first": "_first"})
    own = docs.withColumns({"_kd": F.coalesce(docs["doc_id"], F.lit(-(1 << 63))), "_kh": F.xxhash64(raw)})
    return own.join(known, (own["_kd"] == known["_d"]) & (own["_kh"] == known["_h"]), "left").drop("_d", "_h", "_kd", "_kh").withColumn("_first", F.coalesce("_first", F.lit(False)))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs(doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for d, raw, first, start, size in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            kept, n, k = _cut(raw, first, start, size)
            out.append((d, len(raw), n, k, hashlib.sha256(kept).hexdigest()))
        return _batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])

    rows = _with_spans(docs.select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), "_first", "_start", "_size")
    return per_batch(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with what is kept of each text, and n_chars to match if there is such a column; other columns are as they were."""
    rows = _with_spans(docs)
    names = docs.columns
    at, k = names.index("text"), len(names)
    count = names.index("n_chars") if "n_chars" in names else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = [b.column(i) for i in range(k)]
        texts, lengths = [], []
        for t, n, first, start, size in zip(cols[at].to_pylist(), cols[count].to_pylist() if count is not None else [None] * b.num_rows, *(b.column(k + i).to_pylist() for i in range(3)), strict=True):
            kept, gone, _ = _cut((t or "").encode(), first, start, size)
            texts.append(kept.decode("utf-8", "ignore") if gone else t)
            lengths.append(len(texts[-1]) if gone else n)
        cols[at] = pa.array(texts, pa.string())
        if count is not None:
            cols[count] = pa.array(lengths, cols[count].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return per_batch(rows.select(*names, "_first", "_start", "_size"), run, docs.schema)
