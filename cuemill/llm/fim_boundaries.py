"""Fill-in-the-middle: texts cut in three at unit boundaries, found by select over a compressed boundary set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are rearranged, and of these, the percent with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Offsets a container spans, and members up to which a plain array of them is smaller than a bitmap.
SPAN, FEW = 1 << 16, 1 << 12
#: Bytes of texts that one boundary set is made over.
RUN = 8 << 20


class BoundarySet:
    """A set of offsets below 2^16 times any number, in containers of 2^16 offsets. Each container takes the smallest of three
    forms: a sorted array (two bytes a member), a bitmap (8 KB), or runs of neighbours (four bytes a run). `before` holds the
    number of members before each container, so that the k-th member is found by a search for its container and a select
    within it, and the rank of an offset by its high bits and a count within."""

    def __init__(self, members: np.ndarray) -> None:
        """members: a mask over the offsets."""
        sizes, self.containers = [0], []
        for at in range(0, len(members), SPAN):
            own = np.flatnonzero(members[at : at + SPAN])
            sizes.append(len(own))
            self.containers.append(self._container(own))
        self.before = np.cumsum(sizes, dtype=np.int64)

    @staticmethod
    def _container(own: np.ndarray) -> tuple:
        first = np.flatnonzero(np.diff(own, prepend=-2) != 1)  # places of members that begin a run
        if 4 * len(first) <= min(2 * len(own), SPAN // 8):
            # starts of the runs, and the members before each run
            return "runs", own[first].astype(np.uint16), first.astype(np.uint16)
        if len(own) <= FEW:
            return "array", own.astype(np.uint16)
        bits = np.zeros(SPAN, bool)
        bits[own] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        return "bitmap", words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The members of these ranks, counted from 0; all below len()."""
        ranks = np.asarray(ranks, np.int64)
        where = np.searchsorted(self.before, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for at, asked in _grouped(where):
            out[asked] = at * SPAN + self._select(self.containers[at], ranks[asked] - self.before[at])
        return out

    @staticmethod
    def _select(container: tuple, k: np.ndarray) -> np.ndarray:
        if container[0] == "array":
            return container[1][k].astype(np.int64)
        if container[0] == "runs":
            run = np.searchsorted(container[2], k, "right") - 1
            return container[1][run] + (k - container[2][run])
        _, words, before = container
        word = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + np.argmax(np.cumsum(bits, axis=1, dtype=np.int64) > (k - before[word])[:, None], axis=1)

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """How many members lie below each offset."""
        offsets = np.asarray(offsets, np.int64)
        out = np.full(len(offsets), len(self), np.int64)
        for at, asked in _grouped(offsets // SPAN):
            if at < len(self.containers):
                out[asked] = self.before[at] + self._rank(self.containers[at], offsets[asked] % SPAN)
        return out

    @staticmethod
    def _rank(container: tuple, low: np.ndarray) -> np.ndarray:
        if container[0] == "array":
            return np.searchsorted(container[1], low, "left")
        if container[0] == "runs":
            _, start, before = container
            if not len(start):
                return np.zeros(len(low), np.int64)
            run = np.maximum(np.searchsorted(start, low, "right") - 1, 0)
            # A run's last member is the one before the next run; of the last run, only its offsets below `low` are known.
            ends = np.append(before[1:], SPAN + int(before[-1])).astype(np.int64)
            return np.where(low < start[run], 0, np.minimum(before[run] + (low - start[run]), ends[run]))
        _, words, before = container
        partial = words[low // 64] & ((np.uint64(1) << (low % 64).astype(np.uint64)) - np.uint64(1))
        return before[low // 64] + np.bitwise_count(partial)


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=-1))
    for part in np.split(order, edges[1:]) if len(order) else ():
        yield int(keys[part[0]]), part


def unit_starts(data: np.ndarray, starts: np.ndarray, unit: str = "code point") -> np.ndarray:
    """Mask over UTF-8 bytes of texts that lie side by side, each of `starts` the first byte of one: where a unit begins.
    Units: code points; words, with the white space (ASCII) after them; lines, with their line feed."""
    if unit == "code point":
        mask = (data & 0xC0) != 0x80
    elif unit in ("word", "line"):
        mask = np.zeros(len(data), bool)
        space = data == 10 if unit == "line" else (data == 32) | ((data >= 9) & (data <= 13))
        mask[1:] = space[:-1] & (~space[1:] if unit == "word" else True)
    else:
        raise ValueError(f"unit: code point, word or line, not {unit}")
    mask[starts[starts < len(data)]] = True
    return mask


def cut_offsets(texts: pa.Array, low: Column, high: Column, unit: str = "code point"):
    """(bytes, edges, first cut, second cut) of texts without nulls: text k is bytes[edges[k] : edges[k + 1]], its cuts come
    after low(n) and high(n) of its n units, functions of arrays, and are offsets into bytes."""
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    empty = edges[1:] == edges[:-1]
    # The end of all texts is a boundary, too.
    kept = BoundarySet(np.append(unit_starts(data, edges[:-1][~empty], unit), True))
    first = kept.rank(edges)
    n = np.diff(first)
    return data, edges, n, kept.select(first[:-1] + low(n)), kept.select(first[:-1] + high(n))


def contains_marker(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def drawn(key: str, seed: int, i: int) -> Column:
    """The i-th of the unsigned numbers, 1 to 8, that the SHA-256 of `seed:key` is made of. A null key reads as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, unit: str = "code point", rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_units, middle_units and output, the rearranged text.

    The draws hang on the row's key alone, so reruns agree and rows alike are treated alike; rows with a null key share one
    draw. Null texts are empty; empty texts and texts that hold a marker stay plain, with null cuts, since a marker in the text
    would make the output ambiguous. Of the rest, `rearranged` in 100 are cut after two drawn numbers of units, of which
    `suffix_first` in 100 with the suffix before the prefix. Columns of the new names give way to the new ones. A row's work is
    in proportion to its text, and a batch's to 8 MB of texts or one text."""
    new = T.StructType.fromDDL("n bigint, form string, prefix_units bigint, middle_units bigint, output string")
    gone = {f.name for f in new}
    kept = [f for f in docs.schema if f.name.lower() not in gone]
    out = T.StructType([*kept, *new.fields])
    arrow = common.arrow_schema("n bigint, form string, prefix_units bigint, middle_units bigint, output string")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    form = F.when((whole == "") | contains_marker(whole) | (drawn(key, seed, 3) % 100 >= rearranged), "plain").when(drawn(key, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    common.small_batches(docs.sparkSession)
    # Hidden columns come last: the two draws, the form, and the text.
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], drawn(key, seed, 1), drawn(key, seed, 2), form, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(kept)
        for batch in (part for b in batches for part in common.slices(b, m + 3, RUN)):
            h1, h2 = (batch.column(m + i).to_numpy() for i in (0, 1))
            low, high = lambda n: np.minimum(h1 % (n + 1), h2 % (n + 1)), lambda n: np.maximum(h1 % (n + 1), h2 % (n + 1))
            data, edges, n, one, two = cut_offsets(batch.column(m + 3), low, high, unit)
            forms = batch.column(m + 2).to_pylist()
            raw, outputs = memoryview(data), []
            for k, form in enumerate(forms):
                prefix, middle, suffix = raw[edges[k] : one[k]], raw[one[k] : two[k]], raw[two[k] : edges[k + 1]]
                if form == "plain":
                    outputs.append(bytes(raw[edges[k] : edges[k + 1]]))
                elif form == "psm":
                    outputs.append(b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)))
                else:
                    outputs.append(b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            made = [pa.array(n), batch.column(m + 2), pa.array(low(n), mask=plain), pa.array((high(n) - low(n)), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
            columns = [batch.column(i) for i in range(m)] + [c.cast(f.type) for c, f in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    return rows.mapInArrow(common.lean(run), out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle() was made of. No text that is rearranged holds a marker, and no marker
    begins as another or itself ends, so the first of each kind is the real one."""
    after = lambda mark: F.substring(output, F.instr(output, mark) + F.lit(len(mark)), F.length(output))
    upto = lambda part, mark: F.substring(part, F.lit(1), F.instr(part, mark) - 1)
    psm = F.concat(upto(after(PREFIX), SUFFIX), after(MIDDLE), upto(after(SUFFIX), MIDDLE))
    spm = F.concat(upto(after(PREFIX), MIDDLE), after(MIDDLE), upto(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fim_boundary_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, rearranged and put back; see fill_in_middle() and restored()."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE x || y || z END) AS restored_sha256
FROM p
"""
