"""Operator 10, benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

The index is a written table of postings (document, position, term), partitioned by document as the scan deals them, so that
building it shuffles nothing. Only terms of some benchmark item get postings: no query can read another list. A query (a
window of WINDOW consecutive item words, or a whole shorter item) takes the list of its rarest term, shifts it by the term's
offset, and intersects it with the shifted list of the next rarest, and then with those of all others; what is left starts an
exact occurrence. `proximity` asks for all distinct terms of a query within NEAR words of its rarest one instead, by the same order of
intersections over buckets of positions. The texts are tokenised once: a document's number of words is one more posting.

Lists are never gathered: each intersection is an equi-join on (document, position, term), which no single term, document or
item makes skewed. Query tables and vocabularies are broadcast only while they hold at most BROADCAST_ROWS rows, which is
counted first; beyond that the same joins shuffle. Before the last intersection postings are cut to the documents still in
question by a broadcast table of at most BUCKETS hash buckets; where all buckets are taken that only costs time.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. Defined cases: a null or wordless text
has no words, is not hit, and its items_sha256 is that of the empty string; an item without words has no window; documents
are told apart by id and text together, so rows that share an id or are repeated are judged one by one; a null id stays null;
an item id that occurs twice counts once; of equally rare terms that which comes first in the query counts as rarest; a very long
text has more postings, which any tasks share; empty tables give no hits or an empty table; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stored

WINDOW, NEAR = 10, 20
#: Stands after a text's last word; no word holds the first character. ENDS kinds of it, so that none is hot.
END, ENDS = "\x00", 1024
#: What stands between words whose capitals are not yet lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 100_000
BUCKETS = 1 << 18
_KEY = ["d", "h"]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """All words in order. Splitting is some twenty times faster than extracting all matches."""
    return F.array_remove(F.split(text, BETWEEN), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is its id and text. No id is the smallest number."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, q (the window's hash), len, terms of each distinct window of each item."""
    w = items.select("item_id", F.transform(words(F.col("text")), ascii_lower).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(size)))).alias("terms"))
    return cut.select("item_id", F.xxhash64("terms").alias("q"), F.size("terms").alias("len"), "terms").distinct()


def query_terms(wins: DataFrame) -> DataFrame:
    """q, len, off, term, t (the term's hash) of each distinct window."""
    one = wins.select("q", "len", "terms").distinct()
    return one.select("q", "len", F.posexplode("terms").alias("off", "term")).withColumn("t", F.xxhash64("term"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """Postings d, h, pos, t of docs(doc_id, text) for terms(term, t), and d, h, n_words of each text, in one written table."""
    ends = docs.sparkSession.range(ENDS).select(F.concat(F.lit(END), F.col("id").cast("string")).alias("term"), F.lit(None).cast("long").alias("t"))
    vocabulary = terms.select("term", "t").distinct().unionByName(ends).withColumn("k", F.xxhash64("term"))
    end = F.concat(F.lit(END), F.pmod("h", F.lit(ENDS)).cast("string"))
    tokens = _keyed(docs).select(*_KEY, F.posexplode(F.concat(words(F.col("text")), F.array(end))).alias("pos", "word"))
    # lower() is the faster one, but also folds letters beyond ASCII
    folded = F.when(F.octet_length("word") == F.char_length("word"), F.lower("word")).otherwise(ascii_lower(F.col("word")))
    met = tokens.select(*_KEY, "pos", folded.alias("word")).join(_small(vocabulary, n_terms), F.xxhash64("word") == F.col("k"))
    # the join's key is one number; that the words are equal is said so that it stays the only key
    written = stored(met.filter((F.col("word") >= F.col("term")) & (F.col("word") <= F.col("term"))).select(*_KEY, "pos", "t"), "postings")
    return written.filter("t is not null"), written.filter("t is null").select(*_KEY, F.col("pos").cast("long").alias("n_words")).distinct()


def rank_terms(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Query terms with rank 1 for the rarest in the index; queries with a term that has no posting are left out."""
    counts = postings.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    known = terms.join(counts, "t", "left")
    per_q = Window.partitionBy("q")
    ranked = known.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(per_q)).filter("least > 0")
    return ranked.withColumn("rank", F.row_number().over(per_q.orderBy("n", "off"))).select("q", "len", "off", "t", "rank")


def _intersect(found: DataFrame, ranked: DataFrame, lists: DataFrame, n_terms: int) -> DataFrame:
    """Occurrences d, h, start, q, len in question whose expected terms of `ranked` all stand in `lists`."""
    want = found.join(_small(ranked.select("q", "off", "t"), n_terms), "q").select(*_KEY, "start", "q", "len", (F.col("start") + F.col("off")).alias("pos"), "t")
    got = want.join(lists, [*_KEY, "pos", "t"]).groupBy(*_KEY, "start", "q", "len").agg(F.count_distinct("pos").alias("met"))
    need = ranked.groupBy("q").agg(F.count(F.lit(1)).alias("need"))
    return got.join(_small(need, n_terms), "q").filter("met = need").select(*_KEY, "start", "q", "len")


def occurrences(postings: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Every exact occurrence d, h, start, q, len of the queries in the index."""
    ranked = stored(rank_terms(terms, postings), "ranked")
    first, second, others = (ranked.filter(x) for x in ("rank = 1", "rank = 2", "rank > 2"))
    anchored = postings.join(_small(first, n_terms), "t").select(*_KEY, (F.col("pos") - F.col("off")).alias("start"), "q", "len").filter("start >= 0").distinct()
    one = anchored.filter("len = 1")
    of_second = postings.join(_small(second.select("t").distinct(), n_terms), "t", "left_semi")
    two = stored(_intersect(anchored.filter("len > 1"), second, of_second, n_terms), "candidates")
    return one.unionByName(two.filter("len = 2")).unionByName(_intersect(two.filter("len > 2"), others, _in_question(postings, two.filter("len > 2")), n_terms))


def _in_question(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of documents that share a hash bucket with some document of `found`."""
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(BUCKETS))
    asked = found.select(bucket.alias("_bucket")).distinct()  # at most BUCKETS rows
    return postings.withColumn("_bucket", bucket).join(F.broadcast(asked), "_bucket", "left_semi").drop("_bucket")


def proximity(postings: DataFrame, terms: DataFrame, n_terms: int, within: int = NEAR) -> DataFrame:
    """d, h, q, at: documents and positions of a query's rarest term with all its other distinct terms within so many words.

    Positions are dealt into buckets of `within` words, and a posting meets those of its own and both neighbouring buckets.
    """
    ranked = stored(rank_terms(terms.groupBy("q", "len", "t").agg(F.min("off").alias("off")), postings), "ranked")
    bucket = F.floor(F.col("pos") / F.lit(within))

    def near(found: DataFrame, others: DataFrame, postings: DataFrame) -> DataFrame:
        """Of found(d, h, q, at) those near whose place all terms of `others` stand."""
        around = F.floor(F.col("at") / F.lit(within))
        want = found.join(_small(others.select("q", "t"), n_terms), "q").withColumn("bucket", F.explode(F.array(around - 1, around, around + 1)))
        lists = postings.join(_small(others.select("t").distinct(), n_terms), "t", "left_semi").withColumn("bucket", bucket)
        met = want.join(lists, [*_KEY, "t", "bucket"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
        got = met.groupBy(*_KEY, "q", "at").agg(F.count_distinct("t").alias("met"))
        need = others.groupBy("q").agg(F.count(F.lit(1)).alias("need"))
        return got.join(_small(need, n_terms), "q").filter("met = need").select(*_KEY, "q", "at")

    sizes = ranked.groupBy("q").agg(F.count(F.lit(1)).alias("size"))
    first = ranked.filter("rank = 1").select("q", "t").join(_small(sizes, n_terms), "q")
    at = postings.join(_small(first, n_terms), "t").select(*_KEY, "q", F.col("pos").alias("at"), "size").distinct()
    out = at.filter("size = 1").select(*_KEY, "q", "at")
    left = at.filter("size > 1").select(*_KEY, "q", "at")
    # by the second rarest term alone, then by the third, then by all others
    for step, (others, size) in enumerate(((F.col("rank") == 2, 2), (F.col("rank") == 3, 3), (F.col("rank") > 3, None))):
        left = near(left, ranked.filter(others), _in_question(postings, left) if step else postings)
        if size is None:
            return out.unionByName(left)
        sized = stored(left, "near").join(_small(sizes, n_terms), "q")
        out = out.unionByName(sized.filter(F.col("size") == size).select(*_KEY, "q", "at"))
        left = sized.filter(F.col("size") > size).select(*_KEY, "q", "at")


def prepared(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, int, DataFrame, DataFrame]:
    """The items' windows (written), their terms and number of terms, and the index: postings, and words of each text."""
    wins = stored(windows(items.select("item_id", "text"), size), "windows")
    terms = query_terms(wins)
    n_terms = terms.count()
    return wins, terms, n_terms, *build_index(docs.select("doc_id", "text"), terms, n_terms)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a window near together) of each row of
    docs(doc_id, text) against items(item_id, text)."""
    wins, terms, n_terms, postings, counts = prepared(docs, items, size)
    found = stored(occurrences(postings, terms, n_terms), "occurrences")
    close = proximity(postings, terms, n_terms).select(*_KEY, "q").distinct().join(_small(wins.select("q", "item_id"), n_terms), "q")
    close = close.groupBy(*_KEY).agg(F.count_distinct("item_id").alias("n_near"))
    spans = found.groupBy(*_KEY, "start").agg(F.max("len").alias("len")).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("spans"))
    # words covered by the spans, which come in order: (end so far, words so far)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    hit = spans.select(*_KEY, covered.cast("long").alias("n_hit"))
    of_items = found.select(*_KEY, "q").distinct().join(wins.select("q", "item_id"), "q").groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = _keyed(docs.select("doc_id", "text")).select("doc_id", *_KEY)
    for more in (counts, hit, of_items, close):
        out = out.join(more, _KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of an item occurs; their columns are as they were."""
    _, terms, n_terms, postings, _ = prepared(docs, items, size)
    bad = stored(occurrences(postings, terms, n_terms).select(*_KEY).distinct(), "contaminated")
    d, h = F.coalesce(docs["doc_id"], F.lit(-(1 << 63))), F.xxhash64(docs["text"])
    return docs.join(bad, (d == bad["d"]) & (h == bad["h"]), "left_anti")


ORACLE = r"""
WITH
itw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM itw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS l FROM win),
dw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (SELECT r, i, l, list_slice(w, i, i + l - 1) AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
occ AS (SELECT DISTINCT r, i, l, g FROM grams WHERE g IN (SELECT g FROM win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM occ) GROUP BY r),
qt AS (SELECT q, t, min(o) AS o FROM (SELECT g AS q, unnest(g) AS t, unnest(range(len(g))) AS o FROM (SELECT DISTINCT g FROM win)) GROUP BY q, t),
dt AS (SELECT * FROM (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw) WHERE t IN (SELECT t FROM qt)),
ct AS (SELECT t, count(*) AS n FROM dt GROUP BY t),
rk AS (SELECT * FROM (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY n, o) AS k, count(*) OVER (PARTITION BY q) AS need, min(coalesce(n, 0)) OVER (PARTITION BY q) AS least FROM qt LEFT JOIN ct USING (t)) WHERE least > 0),
an AS (SELECT r, q, p, need FROM rk JOIN dt USING (t) WHERE k = 1),
close AS (SELECT a.r, a.q FROM an a JOIN rk ON rk.q = a.q AND rk.k > 1 JOIN dt ON dt.r = a.r AND dt.t = rk.t AND abs(dt.p - a.p) <= 20 GROUP BY a.r, a.q, a.p, a.need HAVING count(DISTINCT rk.t) = a.need - 1 UNION SELECT r, q FROM an WHERE need = 1),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM close JOIN win ON win.g = close.q GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ JOIN win USING (g)) GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN near USING (r)
"""
