"""Operator 3, n-gram Jaccard join by a token-group matrix.

Documents link when their sets of word shingles have a Jaccard similarity of at least NUM / DEN; the result is one row for each
document with the smallest doc_id reachable by links. All steps are exact but for 64-bit hashes that stand for shingles and sets.

1. Copies: equal sets share a signature; only one of each goes on.
2. Shared tokens: shingles are dealt by hash, in blocks of arrays rather than rows, and those of one set alone are dropped: a
   set can link only if NUM / DEN of it is shared. A token's list may be long, so it is first counted in SALT parts.
3. Groups: a set is compared with the most central set (by the mean logarithm of its tokens' counts) among those with the same
   smallest hash, for KEYS hash functions, and again for ROUNDS among sets without a link so far. Linked sets are one group.
   This step only saves work: links that it does not try are found below.
4. The matrix: (token, group, size class) for the union of each group's tokens. Two groups are candidates if members of like
   size share a token of their prefixes (rarest tokens first) so early that enough tokens can follow. Then a member's overlap
   with the other, larger group's union is counted, and that group is opened for it only if the overlap reaches NUM / DEN of its
   size; it is compared with the members that share a prefix token with it.
5. Components, by alternating large and small stars.

classes() is components only, as its SQL is; links() and link_counts() find every link by prefixes, also inside groups.

Defined cases: a null or wordless text has an empty set and is linked with nothing; fewer words than SHINGLE are one shingle;
a null doc_id keeps its row, and never names a component if another id does; repeated rows are copies; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import drop_stored, ship_package, stored

from .common import in_slices, per_batch, release

SHINGLE, NUM, DEN = 5, 4, 5
#: Tokens a block of the shared-token step should hold, and sets a token's list may have before it is split.
BLOCK_TOKENS, SALT_SETS = 1 << 21, 4_000_000
#: Bytes of text whose shingles are held and dealt together.
SLICE = 1 << 22
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def shingles(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, _U)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], _U)
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = mix(h * _MIX[0] + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def signature(tokens: np.ndarray) -> int:
    """A set's hash, as a signed 64-bit number."""
    parts = np.array([tokens.sum(dtype=_U), np.bitwise_xor.reduce(mix(tokens)), len(tokens)], _U)
    return int(mix(parts * np.array([1, 3, 5], _U) + _MIX[0]).sum(dtype=_U).view(np.int64))


def linked(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> bool:
    """Whether sets of these sizes link; a and b are their shared tokens, each sorted."""
    if DEN * min(na, nb) < NUM * max(na, nb):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return DEN * inter >= NUM * (na + nb - inter)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), n, sig of each row of docs(doc_id, text). sig is null for an empty set."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [shingles(x) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(x) for x in got], pa.int64()), pa.array([signature(x) if len(x) else None for x in got], pa.int64())], ["doc_id", "h", "n", "sig"]
        )

    return per_batch(docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("raw")), run, "doc_id long, h long, n long, sig long")


_DEALT = "bucket int, part int, tok binary, at binary, sig binary, n binary"


def _deal(docs: DataFrame, buckets: int, salt: int) -> DataFrame:
    """Blocks of tokens by hash, each set once for a slice of a batch."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen = set()
        for s in in_slices(b, 0, SLICE):
            toks, sigs, ns = [], [], []
            for raw in s.column(0).to_pylist():
                x = shingles(raw)
                if len(x) and (g := signature(x)) not in seen:
                    seen.add(g)
                    toks.append(x)
                    sigs.append(g)
                    ns.append(len(x))
            if not toks:
                continue
            tok = np.concatenate(toks)
            at = np.repeat(np.arange(len(toks), dtype=np.uint32), ns)
            sig, n = np.array(sigs, np.int64), np.array(ns, np.uint32)
            part = (mix(sig.view(_U)) % _U(salt)).astype(np.int64)
            key = (tok % _U(buckets)).astype(np.int64) * salt + part[at]
            order = np.argsort(key, kind="stable")
            tok, at, key = tok[order], at[order], key[order]
            cut = np.flatnonzero(np.diff(key)) + 1
            rows = []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                own, place = np.unique(at[lo:hi], return_inverse=True)
                rows.append((int(key[lo]) // salt, int(key[lo]) % salt, tok[lo:hi].tobytes(), place.astype(np.uint32).tobytes(), sig[own].tobytes(), n[own].tobytes()))
            cols = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "part", "tok", "at", "sig", "n"])

    return per_batch(docs.select(F.col("text").cast("binary").alias("raw")), run, _DEALT)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each key; they come sorted by it."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
    del held
    release()


_SHARED = "home int, tok binary, sig binary, n binary, df binary"


def _shared_tokens(dealt: DataFrame, buckets: int, salt: int, homes: int) -> DataFrame:
    """Tokens of two sets or more, dealt by set: home, and arrays of token, sig, n and the token's number of sets.

    With salt, each part of a bucket is counted alone; (token, part) counts then meet in a second, small step.
    """

    def entries(rows: list[tuple], skip: int) -> tuple[np.ndarray, ...]:
        tok = np.concatenate([np.frombuffer(r[skip], _U) for r in rows])
        sig = np.concatenate([np.frombuffer(r[skip + 2], np.int64)[np.frombuffer(r[skip + 1], np.uint32)] for r in rows])
        n = np.concatenate([np.frombuffer(r[skip + 3], np.uint32)[np.frombuffer(r[skip + 1], np.uint32)] for r in rows])
        order = np.lexsort((sig, tok))
        tok, sig, n = tok[order], sig[order], n[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        return tok[new], sig[new], n[new]

    def counted(tok: np.ndarray) -> np.ndarray:
        """For each entry, how many entries its token has; entries come sorted by token."""
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(first, len(tok)))
        return np.repeat(size, size).astype(np.uint32)

    def rehome(tok: np.ndarray, sig: np.ndarray, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        home = (mix(sig.view(_U)) % _U(homes)).astype(np.int32)
        order = np.lexsort((sig, home))
        tok, sig, n, df, home = tok[order], sig[order], n[order], df[order], home[order]
        cut = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)] if len(home) else [0]
        rows = [(int(home[lo]), *(x[lo:hi].tobytes() for x in (tok, sig, n, df))) for lo, hi in zip(cut, cut[1:], strict=False)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["home", "tok", "sig", "n", "df"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            tok, sig, n = entries(rows, 2)
            rows.clear()  # copied; a bucket is held once
            df = counted(tok)
            keep = df > 1
            yield rehome(tok[keep], sig[keep], n[keep], df[keep])

    by_bucket = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    if salt == 1:
        return by_bucket.mapInArrow(whole, _SHARED)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2):
            tok, size = np.unique(entries(rows, 2)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in (([rows[0][0]], pa.int32()), ([tok.tobytes()], pa.binary()), ([size.astype(np.uint32).tobytes()], pa.binary()))], ["bucket", "tok", "size"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            tok = np.concatenate([np.frombuffer(r[1], _U) for r in rows])
            size = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]).astype(np.int64)
            one, at = np.unique(tok, return_inverse=True)
            df = np.bincount(at, size, len(one)).astype(np.uint32)
            keep = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in (([rows[0][0]], pa.int32()), ([one[keep].tobytes()], pa.binary()), ([df[keep].tobytes()], pa.binary()))], ["bucket", "all_tok", "all_df"])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2):
            tok, sig, n = entries(rows, 2)
            one, df = np.frombuffer(rows[0][6], _U), np.frombuffer(rows[0][7], np.uint32)
            at = np.minimum(np.searchsorted(one, tok), max(0, len(one) - 1))
            keep = one[at] == tok if len(one) else np.zeros(len(tok), bool)
            yield rehome(tok[keep], sig[keep], n[keep], df[at[keep]])

    parts = dealt.repartition(buckets * salt, "bucket", "part").sortWithinPartitions("bucket", "part")
    sums = stored(parts.mapInArrow(totals, "bucket int, tok binary, size binary").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(summed, "bucket int, all_tok binary, all_df binary"), "token-counts")
    # a bucket's distinct tokens are few beside its entries, and go with each of its parts
    joined = dealt.join(sums, "bucket").select(*dealt.columns, "all_tok", "all_df").repartition(buckets * salt, "bucket", "part").sortWithinPartitions("bucket", "part")
    return joined.mapInArrow(looked_up, _SHARED)


_SET = "sig long, n int, w double, toks binary"


def _sets_that_may_link(shared: DataFrame, homes: int) -> DataFrame:
    """sig, n, w (mean logarithm of the tokens' counts), toks (shared tokens, rarest first) of sets with enough shared tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            tok, sig, n, df = (np.concatenate([np.frombuffer(r[i], k) for r in rows]) for i, k in ((1, _U), (2, np.int64), (3, np.uint32), (4, np.uint32)))
            rows.clear()
            order = np.lexsort((tok, df, sig))
            tok, sig, n = tok[order], sig[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
            ends = np.append(first[1:], len(sig)) if len(first) else first
            keep = DEN * (ends - first) >= NUM * n[first].astype(np.int64)
            weight = np.concatenate([[0.0], np.cumsum(np.log(df[order]))])
            out = [(int(sig[lo]), int(n[lo]), float((weight[hi] - weight[lo]) / n[lo]), tok[lo:hi].tobytes()) for lo, hi in zip(first[keep].tolist(), ends[keep].tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["sig", "n", "w", "toks"])

    return shared.repartition(homes, "home").sortWithinPartitions("home").mapInArrow(run, _SET)


KEYS, ROUNDS = 4, 2


def _smallest(rows: DataFrame, first: int, keys: int) -> DataFrame:
    """sig, w, key: the smallest hash of each set under several functions, numbered from `first`."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        key = np.array([[mix(np.frombuffer(t, _U) * _U(2 * j + 1) + _U(j)).min() ^ _U(j) for j in range(first, first + keys)] for t in b.column(2).to_pylist()], _U).reshape(-1)
        row = pa.array(np.repeat(np.arange(b.num_rows), keys))
        return pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(key.view(np.int64))], ["sig", "w", "key"])

    return per_batch(rows.select("sig", "w", "toks"), run, "sig long, w double, key long")


def groups(may: DataFrame) -> DataFrame:
    """sig, grp for each set: the smallest of the sets that it reaches by the links tried here."""
    edges, left = None, may
    for k in range(ROUNDS):
        keyed = stored(_smallest(left, KEYS * k, KEYS), "keys")
        center = stored(keyed.groupBy("key").agg(F.max(F.struct("w", "sig")).alias("c"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", F.col("c.sig").alias("b")), "centers")
        pairs = keyed.join(center, "key").filter("sig <> b").select(F.col("sig").alias("a"), "b").distinct()
        found = stored(_verified(pairs, may), "links")
        drop_stored(keyed, center)
        edges = found if edges is None else edges.unionByName(found)
        if k + 1 < ROUNDS:
            done = edges.select(F.col("a").alias("sig")).unionByName(edges.select(F.col("b").alias("sig"))).distinct()
            left = may.join(done, "sig", "left_anti")
    comp = components(edges)
    return stored(may.select("sig").join(comp.select(F.col("node").alias("sig"), "comp"), "sig", "left").select("sig", F.coalesce("comp", "sig").alias("grp")), "groups")


def _exploded(rows: DataFrame, prefix: bool) -> DataFrame:
    """The other columns of rows(sig, n, toks, ...) with each token; prefix: only those of the set's prefix, with n and room: how
    many tokens of the set, this one included, do not come before it."""
    others = [c for c in rows.columns if c not in ("n", "toks", "w")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    at_n, at_toks = len(others), len(others) + 1

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, b.num_rows, 1000):
            s = b.slice(lo, 1000)
            toks = [np.frombuffer(t, _U) for t in s.column(at_toks).to_pylist()]
            size = s.column(at_n).to_pylist()
            room = [len(t) for t in toks]  # tokens of this set alone come first, then these in order
            if prefix:
                toks = [t[: n + (-NUM * n) // DEN + 1 - (n - len(t))] for n, t in zip(size, toks, strict=True)]
            row = pa.array(np.repeat(np.arange(len(toks)), [len(t) for t in toks]))
            flat = np.concatenate(toks or [np.empty(0, _U)]).view(np.int64)
            cols = [*(s.column(i).take(row) for i in range(at_n)), pa.array(flat)]
            if prefix:
                left = np.concatenate([r - np.arange(len(t)) for r, t in zip(room, toks, strict=True)] or [np.empty(0, np.int64)]).astype(np.int32)
                cols += [s.column(at_n).take(row), pa.array(left)]
            yield pa.RecordBatch.from_arrays(cols, [*others, "tok", *(["n", "room"] if prefix else [])])

    more = ", n int, room int" if prefix else ""
    return per_batch(rows.select(*others, "n", "toks"), run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", tok long" + more)


def _may_link(a: str, b: str) -> Column:
    """Whether sets with these least and greatest sizes and greatest room after a shared token can link."""
    c = F.col
    sizes = (DEN * c(f"hi_{a}") >= NUM * c(f"lo_{b}")) & (DEN * c(f"hi_{b}") >= NUM * c(f"lo_{a}"))
    return sizes & ((NUM + DEN) * F.least(f"room_{a}", f"room_{b}") >= NUM * (c(f"lo_{a}") + c(f"lo_{b}")))


def _verified(pairs: DataFrame, may: DataFrame) -> DataFrame:
    """The pairs a, b, ... whose sets link."""
    side = lambda x: may.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("toks").alias(f"toks_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "n_a", "toks_a", "n_b", "toks_b")
    names = pairs.columns
    k = len(names)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = [linked(np.frombuffer(x, _U), m, np.frombuffer(y, _U), n) for m, x, n, y in zip(*(b.column(k + i).to_pylist() for i in range(4)), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in range(k)], names)

    return per_batch(rows, run, pairs.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of the nodes of edges(a, b), by alternating large and small stars."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        if not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, stored(small.distinct(), "edges")
        drop_stored(before)


def links_between_groups(may: DataFrame, grp: DataFrame) -> DataFrame:
    """a, b: linked sets of different groups, enough of them to connect all that links connect."""
    member = may.join(grp, "sig")
    prefixes = stored(_exploded(member.select("sig", "grp", "n", "toks"), prefix=True), "prefixes")
    # sets that link are of one size class or of neighbouring ones
    sized = prefixes.withColumn("size", F.floor(F.log("n") / F.lit(np.log(DEN / NUM).item())).cast("int"))
    by_group = sized.groupBy("tok", "grp", "size").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room"))
    shared = by_group.groupBy("tok").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 < g1").select("tok")
    members = grp.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    by_group = stored(by_group.join(shared, "tok", "left_semi").join(members, "grp"), "matrix")
    side = lambda x: by_group.select("tok", F.col("grp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "lo", "hi", "room", "m")))
    near = side("a").withColumn("size_b", F.explode(F.array(F.col("size_a") - 1, F.col("size_a"), F.col("size_a") + 1)))
    # of two groups the smaller one's members ask; a link is found from either side
    asks = (F.col("m_a") < F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("a") < F.col("b")))
    hits = near.join(side("b"), ["tok", "size_b"]).filter((F.col("a") != F.col("b")) & asks).filter(_may_link("a", "b"))
    hits = hits.select("tok", F.col("a").alias("grp"), F.col("size_a").alias("size"), F.col("b").alias("other"), "lo_b", "hi_b", "room_b")
    mine = sized.select("tok", "grp", "size", "sig", F.col("n").alias("lo_a"), F.col("n").alias("hi_a"), F.col("room").alias("room_a"))
    query = stored(mine.join(hits, ["tok", "grp", "size"]).filter(_may_link("a", "b")).select("sig", "other").distinct(), "queries")
    drop_stored(by_group)
    none = may.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    if query.isEmpty():
        return none
    # the bound: how many of a member's tokens the other group's union holds
    of_query = _exploded(may.join(query, "sig").select("sig", "other", "n", "toks"), prefix=False)
    in_question = query.select(F.col("other").alias("grp")).distinct()
    union = _exploded(member.join(in_question, "grp", "left_semi").select("sig", "grp", "n", "toks"), prefix=False).select("tok", F.col("grp").alias("other")).distinct()
    overlap = of_query.join(union, ["tok", "other"]).groupBy("sig", "other").agg(F.count(F.lit(1)).alias("bound"))
    opened = stored(overlap.join(may.select("sig", "n"), "sig").filter(F.col("bound") * DEN >= F.col("n") * NUM).select("sig", "other"), "opened")
    if opened.isEmpty():
        return none
    cols = lambda x: [F.col("n").alias(f"lo_{x}"), F.col("n").alias(f"hi_{x}"), F.col("room").alias(f"room_{x}")]
    first = prefixes.join(opened, "sig").select(F.col("sig").alias("a"), "tok", "other", *cols("a"))
    second = prefixes.select(F.col("sig").alias("b"), "tok", F.col("grp").alias("other"), *cols("b"))
    met = first.join(second, ["tok", "other"]).filter(_may_link("a", "b")).select("a", "b").distinct()
    links = stored(_verified(met, may), "links")
    drop_stored(prefixes, query, opened)
    return links


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets, the distinct ones (sig, first, n, copies), and those that may link."""
    ship_package(docs.sparkSession)
    own = stored(sets(docs), "sets")
    by_sig = stored(own.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "signatures")
    total, n_sets = by_sig.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(8, -(-total // BLOCK_TOKENS))
    salt = max(1, -(-n_sets // SALT_SETS))
    return own, by_sig, stored(_sets_that_may_link(_shared_tokens(_deal(docs, buckets, salt), buckets, salt, buckets), buckets), "may-link")


def _links(may: DataFrame) -> DataFrame:
    """a, b: all linked sets a < b, also those that groups and components do without."""
    prefixes = stored(_exploded(may.select("sig", "n", "toks"), prefix=True), "prefixes")
    side = lambda x: prefixes.select("tok", F.col("sig").alias(x), F.col("n").alias(f"lo_{x}"), F.col("n").alias(f"hi_{x}"), F.col("room").alias(f"room_{x}"))
    met = side("a").join(side("b"), "tok").filter("a < b").filter(_may_link("a", "b")).select("a", "b").distinct()
    return stored(_verified(met, may), "links")


def links(docs: DataFrame) -> DataFrame:
    """doc_a, doc_b: links between different texts, each as the smallest doc_id of either set; as many rows as there are links."""
    _, by_sig, may = _prepared(docs)
    of = lambda x: by_sig.select(F.col("sig").alias(x), F.col("first").alias(f"doc_{x}"))
    return _links(may).join(of("a"), "a").join(of("b"), "b").select("doc_a", "doc_b")


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_links of each row of docs(doc_id, text): how many other rows it links with, copies included."""
    own, by_sig, may = _prepared(docs)
    found = _links(may)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(by_sig.select(F.col("sig").alias("b"), "copies"), "b").groupBy(F.col("a").alias("sig")).agg(F.sum("copies").alias("far"))
    of_sig = by_sig.join(far, "sig", "left").select("sig", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return own.join(of_sig, "sig", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and sig, comp, component_id of the distinct ones."""
    own, by_sig, may = _prepared(docs)
    grp = groups(may)
    # links between sets of different groups, as links between groups
    of = lambda x: grp.select(F.col("sig").alias(x), F.col("grp").alias(f"g{x}"))
    links = links_between_groups(may, grp).join(of("a"), "a").join(of("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
    comp = components(links)
    of_sig = grp.join(comp.select(F.col("node").alias("grp"), "comp"), "grp", "left").select("sig", F.coalesce("comp", "grp").alias("comp"))
    named = by_sig.select("sig", "first").join(of_sig, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    return own, stored(named.select("sig", "comp").join(least, "comp").select("sig", "comp", "component_id"), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text)."""
    own, class_of = _classes(docs)
    return own.join(class_of.drop("comp"), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: of those with its smallest doc_id (null if it has no other) one with the smallest hash of its
    text. Rows without a word are linked with nothing, and all stay."""
    own, class_of = _classes(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))).alias("k")
    named = own.join(class_of, "sig").groupBy("comp").agg(least).select(F.col("k.doc_id").alias("_d"), F.col("k.h").alias("_h"), F.lit(False).alias("_all"))
    kept = stored(named.unionByName(own.filter("sig is null").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.lit(True).alias("_all")).distinct()), "kept")
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_d"]) & (F.xxhash64(docs["text"]) == kept["_h"]))
    # of equal rows one; a row that stays anyway has a key of its own
    return rows.withColumn("_row", F.when(F.col("_all"), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "_h", "_row"]).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
link AS (SELECT x.r AS a, y.r AS b FROM sh x JOIN sh y ON x.s = y.s AND x.r <> y.r JOIN n nx ON nx.r = x.r JOIN n ny ON ny.r = y.r GROUP BY x.r, y.r, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a) c USING (r)
"""
