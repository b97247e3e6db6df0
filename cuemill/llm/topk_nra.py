"""Exact top-k by inner product: sorted lists read in step, with lower and upper bounds and no random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that a block of lists holds, and queries that are worked on against it at once.
BLOCK, AT_ONCE = 8192, 128
#: Bytes of the queries that a task holds at a time.
QUERY_BYTES = 32 << 20
#: Blocks that a part of the vectors has, or more; tasks that a pass has at most, each working on one cell after another.
PART_BLOCKS, MOST_TASKS = 4, 16384


def nra_top(
    queries: np.ndarray, qid: np.ndarray, vectors: np.ndarray, vid: np.ndarray, k: int, first: int = 64, bar: np.ndarray | None = None
) -> list:
    """(place of the query, vector, score) of the k best of the vectors for each query, ties to smaller ids, the query's own
    id left out. bar: scores that k other vectors reach for each query; vectors below them may be left out.

    A list for each dimension holds the vectors by their component, and is read from both ends. After a depth of all lists
    what a vector has not shown yet lies between the two places where its list stands: its score is known but for a
    radius, which gives the lower and the upper bound. A query stops when no vector outside its best k by lower bound
    has an upper bound over the k-th lower bound, or when none reaches its bar. Each depth is eight times the one before. Vectors
    that may still qualify then have their scores resolved: their remaining components are summed up."""
    n, d = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    rank = np.empty((n, d), np.int32)
    rank[order, np.arange(d)] = np.arange(n, dtype=np.int32)[:, None]
    rising = np.take_along_axis(vectors, order, 0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    out: list[tuple] = []
    bar = np.full(len(queries), -np.inf) if bar is None else bar
    # Heads of the lists alone: what no vector of the block is above.
    open_ = np.nonzero(plus @ rising[-1] + minus @ rising[0] >= bar)[0]
    depth = min(first, n)
    by_id = np.argsort(vid, kind="stable")
    lo, hi = np.searchsorted(vid[by_id], qid, "left"), np.searchsorted(vid[by_id], qid, "right")
    own = [by_id[a:b] for a, b in zip(lo, hi, strict=True)]  # the places of each query's own rows
    while len(open_):
        whole = 2 * depth >= n  # the readers from both ends have met
        if not whole:
            read = (rank < depth) | (rank >= n - depth)
            below, above = rising[depth - 1], rising[n - depth]  # where the lists stand
            middle, radius = np.where(read, vectors, (below + above) / 2), np.where(read, 0, (above - below) / 2)
        still: list[np.ndarray] = []
        for s in range(0, len(open_), AT_ONCE):
            q = open_[s : s + AT_ONCE]
            if whole:
                lower = queries[q] @ vectors.T
                upper = lower.copy()
            else:
                lower, spread = queries[q] @ middle.T, np.abs(queries[q]) @ radius.T
                upper = lower + spread
                lower -= spread
            for i, at in enumerate(q):
                lower[i, own[at]] = upper[i, own[at]] = -np.inf
            m = min(k, n)
            least = np.maximum(np.partition(lower, n - m, axis=1)[:, n - m], bar[q])
            may = upper >= least[:, None]
            few = may.sum(axis=1) <= max(4 * k, 64)
            ready = few | whole
            for i in np.nonzero(ready)[0]:
                at = np.nonzero(may[i] & (upper[i] > -np.inf))[0]
                score = vectors[at] @ queries[q[i]]
                best = np.lexsort((vid[at], -score))[:k]
                out += [(int(q[i]), int(vid[at[b]]), int(score[b])) for b in best if score[b] >= bar[q[i]]]
            still.append(q[~ready])
        open_ = np.concatenate(still) if still else open_[:0]
        depth = min(n, depth * 8)
    return out


class Best:
    """The k best vectors so far of each query of one length, over blocks of vectors as they come. bar: scores that k other
    vectors are known to reach, for each query."""

    def __init__(self, queries: np.ndarray, qid: np.ndarray, bar: np.ndarray, k: int, block: int) -> None:
        self.queries, self.qid, self.k, self.block = queries, qid, k, block
        self.top: list[list[tuple]] = [[] for _ in qid]  # (-score, vector)
        self.bar = bar.copy()
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, vectors: np.ndarray, vid: np.ndarray) -> None:
        self.waiting.append((vectors, vid))
        self.size += len(vid)
        if self.size >= self.block:
            self.work()

    def work(self) -> None:
        if not self.waiting:
            return
        vectors, vid = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        for at in range(0, len(vid), self.block):
            part = slice(at, at + self.block)
            for q, v, score in nra_top(self.queries, self.qid, vectors[part], vid[part], self.k, bar=self.bar):
                self.top[q].append((-score, v))
            for q, own in enumerate(self.top):
                if len(own) > self.k:
                    own.sort()
                    del own[self.k :]
                if len(own) == self.k:
                    self.bar[q] = -max(own)[0]

    def rows(self) -> list[tuple]:
        self.work()
        return [(int(self.qid[q]), v, -minus) for q, own in enumerate(self.top) for minus, v in own]


def whole_components(column: str = "embedding", scale: int = 256):
    """floor(scale * x) of each component x, as double; null if the vector is null, empty or has a null, NaN or
    infinite component."""
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good & (F.size(x) > 0), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double")))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, v array<double> of whole numbers).

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the query's id. Queries are
    dealt into blocks of `query_bytes` or so, vectors into parts of some blocks, both by hash, and a cell is a block of
    queries with a part of the vectors: a task gets a cell's queries, then streams its vectors. A first pass is over one part;
    a query's k-th best there is its bar in all other cells. Nothing but sizes comes to the driver, and a cell gives k rows a
    query at most. Null ids and null vectors take no part; vectors of other lengths are compared with their own kind only;
    rows that repeat an id and vector count once."""
    usable = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("bigint"), "v").dropDuplicates()
    usable = common.cut(usable)
    is_query = F.col("vec_id") % every == 0
    sizes = usable.agg(F.count("*").alias("n"), F.sum(F.when(is_query, 8 * F.size("v") + 16)).alias("b")).first()
    across = max(1, -(-(sizes["b"] or 0) // query_bytes))
    # Queries go to each part and vectors to each block of queries: no more parts than make both shuffles alike.
    down = max(1, min(-(-sizes["n"] // (PART_BLOCKS * block)), every * across))
    dealt = usable.select(
        "vec_id", "v", F.pmod(F.xxhash64(F.lit(3), "vec_id", "v"), F.lit(across)).cast("int").alias("q"), F.pmod(F.xxhash64(F.lit(4), "vec_id", "v"), F.lit(down)).cast("int").alias("part")
    )
    asked = dealt.where(is_query).select("vec_id", "v", "q", F.lit(float("-inf")).alias("bar"))
    first = _best_of_cells(asked, dealt.where("part = 0"), across, range(1), k, block)
    if down == 1:
        return first
    first = common.cut(first)
    bars = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reached"))
    asked = asked.drop("bar").join(bars, "vec_id", "left").select("vec_id", "v", "q", F.coalesce("reached", F.lit(float("-inf"))).alias("bar"))
    others = _best_of_cells(asked, dealt.where("part > 0"), across, range(1, down), k, block)
    return _ranked(first.unionByName(others).drop("rank"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_of_cells(asked: DataFrame, vectors: DataFrame, across: int, parts: range, k: int, block: int) -> DataFrame:
    """Ranked rows of the k best of vectors(vec_id, v, part) for asked(vec_id, v, q, bar), parts being numbers of parts."""
    schema = "query_id bigint, vec_id bigint, score bigint"
    arrow = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        cell, held, kinds = None, [], None  # held: the cell's queries; kinds: by length, once vectors come

        def close() -> Iterator[pa.RecordBatch]:
            for kind in (kinds or {}).values():
                rows = kind.rows()
                for at in range(0, len(rows), 1 << 16):
                    columns = zip(*rows[at : at + (1 << 16)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)])
            edges = [0, *(np.nonzero((np.diff(key) != 0).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if cell != (now := (int(key[0, lo]), int(key[1, lo]))):
                    yield from close()
                    cell, held, kinds = now, [], None
                own = batch.slice(lo, hi - lo)
                if not key[2, lo]:
                    held.append(own)
                    continue
                if kinds is None:
                    kinds = {}
                    queries = pa.Table.from_batches(held) if held else own.slice(0, 0)
                    length = pc.list_value_length(queries.column(4)).to_numpy()
                    for d, ids, v in _by_length(queries.column(3), queries.column(4)):
                        kinds[d] = Best(v, ids, queries.column(5).to_numpy()[length == d], k, block)
                for d, ids, v in _by_length(own.column(3), own.column(4)):
                    if d in kinds:
                        kinds[d].add(v, ids)
        yield from close()

    to_parts = F.explode(F.sequence(F.lit(parts[0]), F.lit(parts[-1]))).alias("part")
    to_blocks = F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q")
    sent = asked.select("q", to_parts, F.lit(0).alias("kind"), "vec_id", "v", "bar").unionByName(
        vectors.select(to_blocks, "part", F.lit(1).alias("kind"), "vec_id", "v", F.lit(0.0).alias("bar"))
    )
    tasks = min(across * len(parts), MOST_TASKS)
    cells = sent.repartition(tasks, "q", "part").sortWithinPartitions("q", "part", "kind")
    return _ranked(cells.mapInArrow(common.lean(run), schema), k)


def _by_length(ids: pa.Array | pa.ChunkedArray, vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, rows) of the vectors of each length."""
    import pyarrow.compute as pc

    ids, vectors = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, vectors))
    length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(length).tolist():
        own = pa.array(length == d)
        yield d, ids.filter(own).to_numpy(), vectors.filter(own).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def op7_topk_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vectors for each query of all embeddings; see whole_components() and top_k()."""
    rows = common.table(spark, sf_dir, "embeddings")
    return top_k(rows.select("vec_id", whole_components().alias("v")))


ORACLE = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, o.vec_id, CAST(list_dot_product(q.v, o.v) AS BIGINT) AS score
  FROM c q JOIN c o ON o.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
