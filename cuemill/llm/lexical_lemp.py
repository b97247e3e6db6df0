"""Ranked lexical search: impact vectors in buckets by length, pruned by Cauchy-Schwarz and by coordinate bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of query texts that are searched for at once, bytes of texts taken apart at once, and terms of documents in a task's memory.
QUERY_BYTES, RUN, AT_ONCE = 8 << 20, 4 << 20, 1 << 22
#: A bucket holds vectors down to this share of its longest one, and so many at least.
SHARE, LEAST = 0.8, 128
#: Bounds are in doubles; this much is added to each, in proportion.
SLACK = 1 + 1e-9

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Bytes of terms, A-Z lower-cased; all others are spaces.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[0x41:0x5B] += 0x20
_TABLE[_SEPARATORS] = 0x20


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(owner, number, terms): the texts' terms in order, told apart; text owner[i] has the term numbered number[i]. Terms are the
    maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; null has none."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _TABLE[np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]]] if raw else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((edges - edges[0]).copy()), pa.py_buffer(data))
    split = pc.ascii_split_whitespace(plain)
    coded = split.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    number = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index_in(pa.array([""], coded.dictionary.type), coded.dictionary)[0].as_py()  # texts that begin or end with a space
    if empty is not None:
        full = number != empty
        owner, number = owner[full], number[full]
    return owner, number, coded.dictionary


def term_vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, counts) of docs(doc_id, text) that have a term: n of them with repeats, and those of the vocabulary by
    their places in it, rising, with the occurrences of each."""
    schema = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
    arrow = common.arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        known = shared.value
        for batch in (part for whole in batches for part in common.slices(whole, 1, RUN)):
            owner, number, terms = terms_of(batch.column(1))
            n = np.bincount(owner, minlength=batch.num_rows)
            place = pc.fill_null(pc.index_in(terms, known), -1).to_numpy(zero_copy_only=False)[number].astype(np.int64)
            some = place >= 0
            pairs, counts = np.unique(owner[some] * len(known) + place[some], return_counts=True)
            edges = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(len(known), 1), minlength=batch.num_rows))])
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x.astype(np.int32))) for x in (pairs % max(len(known), 1), counts)]
            made = [batch.column(0), pa.array(n), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(common.lean(run), schema)


class Vectors:
    """Sparse vectors of whole numbers by row: row k has terms[edges[k] : edges[k + 1]] with these impacts."""

    def __init__(self, edges: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        self.edges, self.terms, self.impacts = edges, terms, impacts
        square = np.concatenate([[0.0], np.cumsum(impacts.astype(np.float64) ** 2)])
        self.square = np.maximum(square[edges[1:]] - square[edges[:-1]], 0) * SLACK + square[-1] * 1e-12

    def take(self, rows: np.ndarray) -> Vectors:
        size = self.edges[rows + 1] - self.edges[rows]
        edges = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.edges[rows] - edges[:-1], size) + np.arange(edges[-1])
        return Vectors(edges, self.terms[at], self.impacts[at])

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact inner products of rows with the mask `asked` over terms, in 64-bit whole numbers."""
        some = self.take(rows)
        total = np.concatenate([[0], np.cumsum(np.where(asked[some.terms], some.impacts, 0))])
        return total[some.edges[1:]] - total[some.edges[:-1]]


class Bucket:
    """Vectors of much the same length, with a list for each term of the rows that hold it, by falling impact."""

    def __init__(self, vectors: Vectors, rows: np.ndarray, n_terms: int) -> None:
        self.vectors, self.rows = vectors.take(rows), rows
        self.square = vectors.square[rows]
        self.longest = math.sqrt(self.square.max()) * SLACK
        owner = np.repeat(np.arange(len(rows)), np.diff(self.vectors.edges))
        order = np.lexsort((-self.vectors.impacts, self.vectors.terms))
        self.owner, self.impact = owner[order], self.vectors.impacts[order]
        self.start = np.searchsorted(self.vectors.terms[order], np.arange(n_terms + 1))
        self.top = np.zeros(n_terms, np.int64)  # each term's largest impact
        held = self.start[1:] > self.start[:-1]
        self.top[held] = self.impact[self.start[:-1][held]]

    def candidates(self, terms: np.ndarray, bar: int) -> np.ndarray:
        """Rows that may score `bar` or more with a query of these terms; all that do are among them.

        A row that does holds each term t with an impact of bar minus the others' largest ones at least. Where this is above
        zero for a term, only that stretch of its list is looked at. Else the terms of the largest impacts are read, until the
        others together are under the bar. What was read of a row is a part of its score; the rest is bounded by the others'
        largest impacts, and by Cauchy-Schwarz with the length that is left of the row."""
        terms = terms[self.top[terms] > 0]
        top = self.top[terms]
        total = int(top.sum())
        if total < bar:
            return np.zeros(0, np.int64)
        terms, top = terms[np.argsort(-top, kind="stable")], -np.sort(-top)
        least = bar - (total - top)  # each coordinate's lower bound
        bound = np.flatnonzero(least > 0)
        if len(bound):
            spans = [self._stretch(terms[i], int(least[i])) for i in bound]
            lo, hi = min(spans, key=lambda s: s[1] - s[0])
            found = self.owner[lo:hi]
            return found if len(found) < 64 else self._bounded(terms, top, bar, found)
        return self._bounded(terms, top, bar, None)

    def _stretch(self, term: int, least: int) -> tuple[int, int]:
        lo, hi = int(self.start[term]), int(self.start[term + 1])
        return lo, lo + int(np.searchsorted(-self.impact[lo:hi], -least, "right"))

    def _bounded(self, terms: np.ndarray, top: np.ndarray, bar: int, among: np.ndarray | None) -> np.ndarray:
        rest = int(top.sum()) - np.cumsum(top)  # the others' largest impacts, after each term
        n = int(np.searchsorted(-rest, -bar, "right")) + 1  # terms to read, until the rest is under the bar
        n = min(n, len(terms))
        at = np.concatenate([np.arange(self.start[t], self.start[t + 1]) for t in terms[:n]])
        read = np.bincount(self.owner[at], self.impact[at], minlength=len(self.rows))
        square = np.bincount(self.owner[at], self.impact[at].astype(np.float64) ** 2, minlength=len(self.rows))
        left = np.sqrt(np.maximum(self.square - square, 0) * (len(terms) - n))
        upper = (read + np.minimum(left, rest[n - 1])) * SLACK
        good = upper >= bar
        if among is None:
            return np.flatnonzero(good & (read > 0))
        return among[good[among]]


def length_buckets(vectors: Vectors) -> Iterator[np.ndarray]:
    """Rows by falling length, cut where a vector is shorter than SHARE of the bucket's longest; vectors without terms left out."""
    order = np.argsort(-vectors.square, kind="stable")
    order = order[np.diff(vectors.edges)[order] > 0]
    length, at = np.sqrt(vectors.square[order]), 0
    while at < len(order):
        end = int(np.searchsorted(-length, -SHARE * length[at], "right"))
        end = max(end, min(at + LEAST, len(order)))
        yield order[at:end]
        at = end


class Ranking:
    """The k best rows of each query so far."""

    def __init__(self, queries: list[np.ndarray], n_terms: int, k: int, bars: np.ndarray) -> None:
        self.queries, self.n_terms, self.k = queries, n_terms, k
        self.bar = np.maximum(bars, 1)  # scores to reach; none of 0 is listed
        self.best: list[tuple] = [(np.zeros(0, np.int64),) * 3 for _ in queries]  # scores, ids, whether the id is null
        self.norm = np.sqrt([len(q) for q in queries])
        self.rescored = 0  # rows whose scores were worked out, a measure of the pruning

    def add(self, vectors: Vectors, ids: np.ndarray, null: np.ndarray, first_only: bool = False) -> None:
        """Search vectors, from their longest bucket on; first_only: that bucket alone."""
        asked = np.zeros(self.n_terms, bool)
        for rows in length_buckets(vectors):
            longest = math.sqrt(vectors.square[rows].max()) * SLACK
            open_ = np.flatnonzero(self.norm * longest * SLACK >= self.bar)
            if not len(open_):  # nor can any later bucket, whose vectors are shorter
                break
            bucket = Bucket(vectors, rows, self.n_terms)
            for q in open_:
                found = bucket.candidates(self.queries[q], int(self.bar[q]))
                if len(found):
                    asked[self.queries[q]] = True
                    self._merge(q, bucket.vectors.scores(found, asked), ids[rows[found]], null[rows[found]])
                    asked[self.queries[q]] = False
                    self.rescored += len(found)
            if first_only:
                break

    def _merge(self, q: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.bar[q]
        scores, ids, null = (np.concatenate([a, b[good]]) for a, b in zip(self.best[q], (scores, ids, null), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.best[q] = scores[order], ids[order], null[order]
        if len(order) == self.k:
            self.bar[q] = max(self.bar[q], int(scores[order[-1]]))


def _search(vectors: DataFrame, queries: list[np.ndarray], weights: np.ndarray, k: int, bars: np.ndarray, n_docs: int, all_terms: int, first_only: bool) -> DataFrame:
    """(query, doc_id, score): each task's k best rows of each query that reach its bar."""
    schema = "query int, doc_id bigint, score bigint"
    arrow = common.arrow_schema(schema)
    shared = vectors.sparkSession.sparkContext.broadcast((queries, weights, bars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, bars = shared.value
        ranking = Ranking(queries, len(weights), k, bars)
        waiting, size = [], 0

        def work() -> None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            n = rows.column("n").to_numpy()
            edges = np.concatenate([[0], np.cumsum(rows.column("terms").combine_chunks().value_lengths().to_numpy())])
            terms, counts = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            m = np.repeat(10 + (90 * n * n_docs) // all_terms, np.diff(edges))
            impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))
            ids = rows.column("doc_id")
            ranking.add(Vectors(edges, terms, impacts), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.int64), first_only)

        for batch in batches:
            waiting.append(batch)
            size += len(batch.column(2).flatten())
            if size >= AT_ONCE:
                work()
                waiting, size = [], 0
        if waiting:
            work()
        for q, (scores, ids, null) in enumerate(ranking.best):
            if len(scores):
                made = [pa.array(np.full(len(scores), q)), pa.array(ids, mask=null > 0), pa.array(scores)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return vectors.select("doc_id", "n", "terms", "counts").mapInArrow(common.lean(run), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k rows of docs(doc_id, text) of the highest scores above 0 for each item of
    items(item_id, text), ties by doc_id, null last.

    Items are the stated query set. They are taken in blocks of some `query_bytes` of text, each searched for in all documents:
    only a block's terms, their counts of documents and its bars go to the driver and to all tasks. Of a block, (1) each document
    becomes the sparse vector of its counts of the block's terms, kept in the checkpoint folder; (2) a task sorts its vectors by
    length and cuts them into buckets; the k-th best score of all tasks' longest buckets is each query's bar; (3) all buckets are
    searched: a query leaves out a bucket whose longest vector times its own length is under the bar, then rows by coordinate
    bounds, and works out the rest exactly. Nothing is left out that could rank.

    Rows are documents, repeated ones too; rows without an id are found and listed last among equals. Null and empty texts have no
    terms and are no documents. Rows of one item_id are one item with the terms of all of them; an item without terms, or an
    empty table, gives no rows. Further columns are not read."""
    spark = docs.sparkSession
    items = common.cut(items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // query_bytes))
    out = None
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64(F.lit(11), "item_id"), F.lit(blocks)) == b).toArrow().combine_chunks()  # some query_bytes
        part = _search_block(docs, held, k)
        if part is not None:
            part = common.cut(part) if blocks > 1 else part
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def _search_block(docs: DataFrame, held: pa.Table, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    owner, number, vocabulary = terms_of(held.column("text").combine_chunks())
    if not len(number):
        return None
    # Items by id, and the distinct terms of each.
    item_ids = held.column("item_id").combine_chunks().dictionary_encode("encode")
    of_item = item_ids.indices.to_numpy(zero_copy_only=False)[owner]
    pairs = np.unique(of_item.astype(np.int64) * len(vocabulary) + number)
    queries = [np.zeros(0, np.int64) for _ in range(len(item_ids.dictionary))]
    at = pairs // len(vocabulary)
    for q in np.unique(at):
        queries[q] = pairs[at == q] % len(vocabulary)
    vectors = common.cut(term_vectors(docs, vocabulary.cast(pa.string())))
    sums = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not sums["docs"]:
        return None
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a block's terms
    df = np.zeros(len(vocabulary), np.int64)
    df[counted.column("t").to_numpy()] = counted.column("df").to_numpy()
    n_docs, all_terms = sums["docs"], sums["terms"]
    seen = {d: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in np.unique(df).tolist()}
    weights = np.array([seen[d] for d in df.tolist()], np.int64)
    none = np.zeros(len(queries), np.int64)
    first = _ranked(_search(vectors, queries, weights, k, none, n_docs, all_terms, True), k)
    bars = none.copy()
    for r in first.where(F.col("rank") == k).select("query", "score").collect():  # one number a query of the block
        bars[r["query"]] = r["score"]
    best = _ranked(_search(vectors, queries, weights, k, bars, n_docs, all_terms, False), k)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(queries)), pa.int32()), "item_id": item_ids.dictionary.cast(pa.int64())}))
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def op11_lexical_lemp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item; see search()."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents
), full_ AS (
  SELECT doc_id, r, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0
), all_ AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM full_
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark
), tf AS (
  SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM full_) WHERE t IN (SELECT t FROM q) GROUP BY r, t
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT t, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY t), all_
), x AS (
  SELECT tf.r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS x
  FROM tf JOIN full_ ON tf.r = full_.r JOIN w USING (t), all_
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN x USING (t) GROUP BY item_id, r, doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS "rank", doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, "rank", doc_id, score FROM k WHERE "rank" <= 10
"""
