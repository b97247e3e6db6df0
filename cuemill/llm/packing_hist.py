"""Packing token sequences: shortest pack first over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import itertools
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LIMIT = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker keeps with their ids, more or less, the longest of them in bytes, and bytes of texts done at once.
REMEMBERED, LONGEST, RUN = 400_000, 40, 8 << 20
#: Marks that are split from the end of a word before it is looked up.
MARKS = ".,;:!?%$&*#|"
#: Parts that each length's pieces are ranked in, so that a very frequent length is no single task.
BUCKETS = 256


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of an array of texts, told apart: (edges, numbers, words). Text k has the words numbered
    numbers[edges[k] : edges[k + 1]]; A-Z are lower-cased as in texts, and white space is that of ASCII. A text that begins or
    ends with white space has an empty word there."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))])
    return edges.astype(np.int64), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class WordEncoder:
    """Ids of whole texts, word by word. No pre-token of this tokenizer spans ASCII white space, so a text's ids are
    those of its words one after another. Nor does one span a letter or digit and the marks after it, so a word's ids
    are those of its stem and of its closing marks. Words met are kept with their ids, in Arrow arrays; case is folded by
    the tokenizer, and that of A-Z before."""

    def __init__(self, name: str = TOKENIZER):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # For words that are lower-case letters in composed form, which the normalizer and splitter leave alone.
        self.plain = (
            normalizers.Sequence([]),
            pre_tokenizers.Sequence(
                [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            ),
        )
        self.words, self.ids = pa.array([""]), _lists(np.zeros(2), np.zeros(0))  # the empty word has no ids
        self.met, self.clock = np.zeros(1, np.int64), 0

    @classmethod
    def of_worker(cls, name: str = TOKENIZER) -> WordEncoder:
        """One that all tasks of a Python worker share, and the words it has met."""
        if name not in _ENCODERS:
            _ENCODERS[name] = cls(name)
        return _ENCODERS[name]

    def _encode(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words by the tokenizer."""
        import pyarrow.compute as pc

        letters = pc.match_substring_regex(words, "^[a-z]+$").to_numpy(zero_copy_only=False)
        odd = np.nonzero(~letters & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))[0]
        for i, t in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist(), strict=True):
            letters[i] = t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        plain = words.filter(pa.array(letters))
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain
        for at in range(0, len(plain), 5000):  # words side by side: one encoding, cut by the words its ids belong to
            some = plain.slice(at, 5000)
            found = self.tokenizer.encode(" ".join(some.to_pylist()), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        others = words.filter(pa.array(~letters))
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
        for at in range(0, len(others), 5000):
            found = self.tokenizer.encode_batch_fast(others.slice(at, 5000).to_pylist(), add_special_tokens=False)
            parts = [x.ids for x in found]
            ids.append(np.array([i for x in parts for i in x], np.uint32))
            sizes.append(np.array([len(x) for x in parts], np.int64))
        made = _lists(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(ids))
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.nonzero(letters)[0], np.nonzero(~letters)[0]])] = np.arange(len(words))
        return made.take(pa.array(place))

    def _keep(self, words: pa.Array, ids: pa.Array) -> None:
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        self.met = np.concatenate([self.met, np.full(len(words), self.clock)])

    def _find(self, words: pa.Array) -> np.ndarray:
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().copy()

    def _learn(self, words: pa.Array) -> None:
        """Keep distinct words that are not kept yet."""
        import pyarrow.compute as pc

        stems = pc.ascii_rtrim(words, MARKS)
        size = pc.binary_length(stems).to_numpy()
        cut = (size < pc.binary_length(words).to_numpy()) & (size > 0)
        sure = pc.match_substring_regex(stems, "[0-9A-Za-z]$").to_numpy(zero_copy_only=False)
        for k in np.nonzero(cut & ~sure)[0].tolist():
            cut[k] = unicodedata.normalize("NFC", stems[k].as_py()).lower()[-1].isalnum()
        both, stems = words.filter(pa.array(cut)), stems.filter(pa.array(cut))
        marks = pa.array([w[len(t) :] for w, t in zip(both.to_pylist(), stems.to_pylist(), strict=True)], pa.string())
        parts = pa.concat_arrays([words.filter(pa.array(~cut)), stems, marks]).unique()
        parts = parts.filter(pa.array(self._find(parts) < 0))
        self._keep(parts, self._encode(parts))
        pairs = self._find(pa.concat_arrays([stems, marks])).reshape(2, -1).T.ravel()
        joined = self.ids.take(pa.array(pairs))
        self._keep(both, _lists(joined.offsets.to_numpy()[::2], joined.flatten().to_numpy()))

    def _number(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those kept; words that were met least lately give way."""
        import pyarrow.compute as pc

        if len(self.words) > REMEMBERED:
            last = np.sort(self.met)[-REMEMBERED // 2]
            stays = (self.met > last) & (pc.binary_length(self.words).to_numpy() <= LONGEST)
            stays[0] = True
            stays = pa.array(np.nonzero(stays)[0])
            self.words, self.ids, self.met = self.words.take(stays), self.ids.take(stays), self.met[stays.to_numpy()]
        self.clock += 1
        at = self._find(words)
        new = at < 0
        if new.any():
            some = words.filter(pa.array(new))
            self._learn(some)
            at[new] = self._find(some)
        self.met[at] = self.clock
        return at

    def encode_runs(self, texts: pa.Array, size: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, edges) of runs of texts, of about `size` bytes each: text k of a run has ids[edges[k] : edges[k + 1]]."""
        import pyarrow.compute as pc

        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        for part in common.slices(batch, 0, size):
            t = pc.fill_null(part.column(0), "")
            low, special = pc.ascii_lower(t), pc.match_substring(t, "<|")  # special tokens heed case
            edges, numbers, words = words_of(pc.if_else(special, t, low) if pc.any(special).as_py() else low)
            at = self._number(words)  # which may replace self.ids
            taken = self.ids.take(pa.array(at[numbers]))
            yield taken.flatten().to_numpy(), taken.offsets.to_numpy()[edges]

    def encode_all(self, texts: list | pa.Array) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers; null is empty."""
        for ids, edges in self.encode_runs(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield bytes(raw[4 * lo : 4 * hi])


def _lists(edges: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(edges.astype(np.int64)), pa.array(values.astype(np.uint32)))


_ENCODERS: dict[str, WordEncoder] = {}


def token_pieces(
    docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, end: int = END, keep_ids: bool = False, narrow: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of each piece of docs(doc_id, text).

    A document's ids and then `end` are cut every `limit` ids. Null and empty texts are the id `end` alone. ids, kept
    on demand, is a binary of little-endian 32-bit numbers, or if narrow of 16-bit ones, for vocabularies that allow it."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", ids binary" if keep_ids else ""
    arrow = common.arrow_schema(schema)
    tail = np.array([end], "<u4").tobytes()
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer)
        for batch in (part for whole in batches for part in common.slices(whole, 1, 2 << 20)):
            rows: list[tuple] = []
            encoded = encoder.encode_all(batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                raw = ids + tail
                n = len(raw) // 4
                for at in range(0, n, limit):
                    part = raw[4 * at : 4 * (at + limit)]
                    kept = [_narrowed(part) if narrow else part] if keep_ids else []
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, *kept))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(common.lean(run), schema)


def _narrowed(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError("ids beyond 16 bits")
    return wide.astype("<u2").tobytes()


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack in order) and their counts. Lengths are placed longest first; pieces of a length go
    to the packs that are filled least, all packs of a pattern at a time, or open new packs where these have no room."""
    packs: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(used: int, pattern: tuple, count: int) -> None:
        if used not in packs:
            packs[used] = []
            heapq.heappush(heap, used)
        packs[used].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while heap and not packs[heap[0]]:
                del packs[heapq.heappop(heap)]
            if not heap or heap[0] + length > limit:
                put(length, (length,), left)
                break
            used = heap[0]
            pattern, count = packs[used].pop()
            taken = min(left, count)
            if count > taken:
                packs[used].append([pattern, count - taken])
            put(used + length, (*pattern, length), taken)
            left -= taken
    return sorted((tuple(p), c) for own in packs.values() for p, c in own)


def pattern_slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: the pieces of a length are ranked from
    0, and a slot of a pattern takes as many ranks as the pattern has packs."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_pieces(pieces: DataFrame, limit: int = LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """pieces(doc_id, start, length, ids_crc32, ...) with sequence_id and offset.

    The histogram of lengths has `limit` rows at most, whatever the corpus; patterns are made of it alone. Pieces of
    a length are ranked in `buckets` parts by hash, or in as many as shuffles have partitions if these are more, parts after
    one another, and each finds its slot by its rank. Pieces that are equal in all of doc_id, start and ids_crc32 may
    change places. Columns named sequence_id and offset give way to the new ones. An empty table packs to none."""
    from pyspark.sql import types as T

    new = ("sequence_id", "offset")
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in new])
    bucket, inside, before = (common.hidden_name(pieces, n) for n in ("bucket", "inside", "before"))
    buckets = max(buckets, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = common.cut(dealt.groupBy("length", bucket).agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = pattern_slots(shortest_pack_first(histogram, limit))
    by_bucket = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    base = counts.select("length", bucket, (F.sum("n").over(by_bucket) - F.col("n")).alias(before))
    order = Window.partitionBy("length", bucket).orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn(inside, F.row_number().over(order)).join(base, ["length", bucket])
    shared = pieces.sparkSession.sparkContext.broadcast(slots)
    out = T.StructType([*pieces.schema.fields, *[T.StructField(n, T.LongType()) for n in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            n = batch.num_columns - 2
            length, rank = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            at = np.searchsorted(starts, (length << 44) | rank, "right") - 1
            found = table[at]
            sequence = found[:, 2] + rank - found[:, 1]
            columns = [batch.column(i) for i in range(n)] + [pa.array(sequence), pa.array(found[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    rank = F.col(before) + F.col(inside) - 1
    kept = [F.col(f"`{c}`") for c in pieces.columns]
    return ranked.select(*kept, F.col("length").alias(bucket), rank.alias(inside)).mapInArrow(common.lean(run), out)


def pack_documents(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of docs(doc_id, text), with its place in a sequence of at most `limit` ids. Null and empty
    texts are one piece of one id; repeated rows are packed one by one; other columns are not read; see pack_pieces()."""
    return pack_pieces(common.cut(token_pieces(docs, limit, tokenizer, keep_ids=keep_ids)), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) of pieces packed with keep_ids: at most `limit` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")
    )


#: Sequences of a shard, more or less.
SHARD = 4096
SEQUENCES = "shard int, place bigint, sequence_id bigint, n_ids int, ids binary, doc_id array<bigint>, start array<bigint>, length array<bigint>, doc_tokens array<bigint>"


def pack_sequences(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, per_shard: int = SHARD, seed: int = 6) -> DataFrame:
    """The packed sequences of docs(doc_id, text) in training order: (shard, place, sequence_id, n_ids, ids, doc_id, start, length,
    doc_tokens), the last four being lists of its pieces in their order, ids a binary of little-endian 32-bit numbers.

    Sequences are packed by length, so their numbers and pieces go by length; here a seeded hash deals them out to shards of
    some `per_shard`, puts each shard in order, and each sequence's pieces. place counts from 0 in a shard, whose rows are in one
    file. ids go through two shuffles, 16 bits each: to be ranked by length, and to their shard. Null texts are empty, rows without
    an id and repeated rows are packed like others; see pack_pieces()."""
    pieces = common.cut(token_pieces(docs, limit, tokenizer, keep_ids=True, narrow=True))
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, total // (limit * per_shard))
    drawn = lambda k, *c: F.xxhash64(F.lit(seed + k), *c)
    rows = pack_pieces(pieces, limit).select(
        F.pmod(drawn(0, "sequence_id"), F.lit(shards)).cast("int").alias("shard"), drawn(1, "sequence_id").alias("key"), "sequence_id",
        drawn(2, "doc_id", "start", "ids_crc32").alias("piece"), "doc_id", "start", "length", "doc_tokens", "ids",
    )
    arrow = common.arrow_schema(SEQUENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, place = None, None, 0  # rows of the sequence that a batch ends in; the shard before, and its sequences so far
        for batch in itertools.chain(batches, [None]):
            some = [b for b in (held, batch) if b is not None and b.num_rows]
            held = None
            if not some:
                continue
            table = pa.Table.from_batches(some).combine_chunks()
            sequence = table.column("sequence_id").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(sequence)) + 1, [len(sequence)]])
            if batch is not None:
                held, edges = table.slice(edges[-2]).to_batches()[0], edges[:-1]
            if len(edges) < 2:
                continue
            shard = table.column("shard").to_numpy()[edges[:-1]]
            first = np.concatenate([[True], np.diff(shard) != 0])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(shard)), 0))
            places = np.arange(len(shard)) - begin + np.where(begin == 0, place if shard[0] == last else 0, 0)
            last, place = shard[-1], int(places[-1]) + 1
            # Pieces of a sequence lie side by side, and so do their ids.
            own = table.column("ids").combine_chunks()
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            at = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1][edges].astype(np.int64)
            ids = np.frombuffer(own.buffers()[2], "<u2", (at[-1] - at[0]) // 2, at[0]).astype("<u4")
            offsets = (2 * (at - at[0])).astype(np.int32)
            made = [pa.array(shard), pa.array(places), pa.array(sequence[edges[:-1]]), pa.array(np.diff(offsets) // 4), pa.BinaryArray.from_buffers(pa.binary(), len(shard), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])]
            for name in ("doc_id", "start", "length", "doc_tokens"):
                column = table.column(name).combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                made.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), column))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return rows.repartition("shard").sortWithinPartitions("shard", "key", "sequence_id", "piece").mapInArrow(common.lean(run), SEQUENCES)


def op6_packing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces and their places; see pack_documents()."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
