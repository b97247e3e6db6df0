"""SimHash near-duplicates: binary trie self-join over fingerprints, then components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BITS = 64
#: Fingerprints that agree in one block and are still one task's work.
CROWD = 1 << 17
#: Ids, 8 bytes each, that are sent to every executor at most.
BROADCAST_IDS = 1 << 20


def fingerprint_bytes(text: bytes, words: int) -> int:
    """SimHash of the word shingles of text; see fingerprints()."""
    import xxhash

    tokens = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(t) for t in zip(*[tokens[i:] for i in range(words)], strict=False)]
    digest = xxhash.xxh64_intdigest
    total, out = np.zeros(BITS, np.int64), 0
    for at in range(0, len(shingles), 65536):
        part = shingles[at : at + 65536]
        h = np.fromiter((digest(s, 42) for s in part), np.dtype(">u8"), len(part))
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, BITS)
        for low in range(0, len(part), 255):  # sums of at most 255 bits fit a byte
            total += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    for i in np.nonzero(2 * total > len(shingles))[0]:
        out |= 1 << (BITS - 1 - int(i))
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """docs with a BIGINT SimHash of each whole text.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of `words` words, repeats included, are
    joined by a space and hashed with XXH64, seed 42. A bit is set if over half the shingles have it. Fewer words
    make one shingle; null, empty and blank texts have fingerprint zero."""

    def start():
        def score(texts: list) -> dict:
            raw = np.array([fingerprint_bytes((t or "").encode(), words) for t in texts], np.uint64)
            return {out: raw.view(np.int64)}

        return score

    return common.add_by_text(docs, start, text, f"{out} bigint")


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if not by else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def trie_links(keys: np.ndarray, shared: int, budget: int, few: int = 64, most: int = 1 << 20) -> Iterator[tuple]:
    """Pairs (i, j) of positions in the sorted, distinct uint64 keys that have their first `shared` bits in common and
    differ in at most `budget` of the rest.

    The sorted keys are a binary trie: a node is a range of positions. Pairs of nodes go down together; a step into
    unlike children costs a bit, and a pair beyond the budget is dropped with all below it. Pairs of nodes with few
    leaves are compared at once. At most `most` pairs are open at a time in one array; the rest wait on a stack."""
    n = len(keys)
    if n < 2:
        return
    head = keys >> np.uint64(BITS - shared) if shared else np.zeros(n, np.uint64)
    edge = np.concatenate([[0], np.nonzero(head[1:] != head[:-1])[0] + 1, [n]]).astype(np.int64)
    big = np.diff(edge) > 1
    lo, hi = edge[:-1][big], edge[1:][big]
    counts: dict[int, np.ndarray] = {}
    stack = [(shared, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        level, al, ah, bl, bh, used = stack.pop()
        if len(al) > most:
            stack += [(level, *(x[s : s + most] for x in (al, ah, bl, bh, used))) for s in range(0, len(al), most)]
            continue
        work = (ah - al) * (bh - bl)
        now = (work <= few) | (level == BITS)
        if now.any():
            yield from _compare(keys, al[now], ah[now], bl[now], bh[now], budget, most)
            al, ah, bl, bh, used = (x[~now] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        if level not in counts:
            bit = (keys >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            counts[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))])
        ones = counts[level]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        nxt = [
            (al, am, bl, bm, used, None),
            (am, ah, bm, bh, used, None),
            (al, am, bm, bh, used + 1, None),
            (am, ah, bl, bm, used + 1, ~same),  # of a node with itself, its mirror image
        ]
        parts = []
        for x in nxt:
            ok = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget)
            ok &= ~((x[0] == x[2]) & (x[1] - x[0] < 2))
            if x[5] is not None:
                ok &= x[5]
            parts.append([y[ok] for y in x[:5]])
        merged = [np.concatenate(y) for y in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((level + 1, *merged))


def _compare(keys, al, ah, bl, bh, budget, most) -> Iterator[tuple]:
    """All pairs of leaves of the given node pairs, by the differing bits of the whole keys."""
    na, nb = ah - al, bh - bl
    total = np.concatenate([[0], np.cumsum(na * nb)])
    at = 0
    while at < len(al):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        w = (na * nb)[at:to]
        own = np.repeat(np.arange(at, to), w)
        k = np.arange(len(own)) - np.repeat(total[at:to] - total[at], w)
        i, j = al[own] + k // nb[own], bl[own] + k % nb[own]
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j)
        if near.any():
            yield i[near], j[near]
        at = to


def join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[k] with b[k] in the array of roots."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _thirds(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(start, size) of each of the blocks that so many bits are cut into."""
    size = [bits // blocks + (k < bits % blocks) for k in range(blocks)]
    return [(sum(size[:k]), size[k]) for k in range(blocks)]


def _lead(fp: Column, start: int, size: int) -> Column:
    """The bits [start, start + size) of fp, from the highest."""
    return F.shiftrightunsigned(fp, BITS - start - size).bitwiseAND(F.lit((1 << size) - 1))


def _pick(which: Column, choices: list[Column]) -> Column:
    out = F.lit(None).cast("bigint")
    for k, c in enumerate(choices):
        out = F.when(which == k, c).otherwise(out)
    return out


def _turned(fp: np.ndarray, k: int, j: int, blocks: int) -> tuple[np.ndarray, int]:
    """fp with block k first and, where j is not negative, block j of the other bits second; and how many bits lead."""
    start, size = _thirds(BITS, blocks)[k]
    fp = _rotate(fp, start)
    if j < 0:
        return fp, size
    rest = BITS - size
    at, more = _thirds(rest, blocks)[j]
    low = fp & np.uint64((1 << rest) - 1)
    low = ((low << np.uint64(at)) | (low >> np.uint64(rest - at))) & np.uint64((1 << rest) - 1)
    return (fp & ~np.uint64((1 << rest) - 1)) | low, size + more


def fingerprint_links(classes: DataFrame, budget: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) of a spanning forest of all links between the rows (fp, rep) of distinct fingerprints.

    The bits are cut into budget + 1 blocks. Two fingerprints within the budget agree in one block at least, so the
    trie is laid out once with each block first; its subtries under a whole block are dealt out by the block's value
    and joined with themselves. A subtrie of over `crowd` fingerprints is dealt out once more: its other bits are cut in
    the same way, and it is laid out once with each of these blocks next. Links within a task are united there, so a task
    gives no more rows than it read. Crowded blocks are 1 / crowd of the rows at most, and are broadcast."""
    blocks = budget + 1
    cuts = _thirds(BITS, blocks)
    spread = classes.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(blocks)])))
    spread = spread.withColumn("block", _pick(F.col("k"), [_lead(F.col("fp"), *c) for c in cuts]))
    full = common.cut(spread.groupBy("k", "block").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("k", "block", F.lit(True).alias("full")))
    spread = spread.join(F.broadcast(full), ["k", "block"], "left")
    j = F.explode(F.when(F.col("full"), F.array(*[F.lit(j) for j in range(blocks)])).otherwise(F.array(F.lit(-1))))
    spread = spread.select("k", "block", "fp", "rep", j.alias("j"))

    def second(k: int) -> Column:  # block j of the bits besides block k, which follow it in a ring
        start, size = cuts[k]
        ring = F.col("fp") if not start else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", BITS - start))
        return _pick(F.col("j"), [_lead(ring, size + at, more) for at, more in _thirds(BITS - size, blocks)])

    spread = spread.withColumn("block2", _pick(F.col("k"), [second(k) for k in range(blocks)]))
    dealt = spread.repartition("k", "block", "j", "block2").select("k", "j", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
        if not read:
            return
        which, then, fp, rep = (np.concatenate(x) for x in zip(*read, strict=True))
        for k, j in itertools.product(range(blocks), range(-1, blocks)):
            own = (which == k) & (then == j)
            keys, lead = _turned(fp[own].view(np.uint64), k, j, blocks)
            at, order = rep[own], np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            parent = np.arange(len(keys))
            for i, j_ in trie_links(keys, lead, budget):
                join_up(parent, i, j_)
            hung = np.nonzero(parent != np.arange(len(keys)))[0]
            for s in range(0, len(hung), 1 << 16):
                h = hung[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(at[h]), pa.array(at[parent[h]])], names=["a", "b"])

    return dealt.mapInArrow(common.lean(run), "a bigint, b bigint")


def near_duplicate_classes(marked: DataFrame, budget: int = 2, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of marked. component_id is the smallest id reachable over
    fingerprints within the budget. Rows without an id lend their fingerprint no link; a fingerprint that only such
    rows have gets a null component."""
    classes = common.cut(
        marked.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(doc_id).cast("bigint")).alias("rep"))
    )
    linked = connected_components(fingerprint_links(classes.where("rep is not null"), budget))
    return classes.join(linked, classes.rep == linked.node, "left").select(
        classes.fp, F.coalesce("component", "rep").alias("component_id")
    )


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """docs' rows as (doc_id, fingerprint, component_id), one for each row.

    Equal fingerprints are one class before the join, so a group of copies costs one fingerprint. Repeated rows are
    kept; an empty table gives no rows; other columns of docs are not read."""
    marked = common.cut(fingerprints(docs.select("doc_id", "text"), "text", words).select("doc_id", "fp"))
    classes = near_duplicate_classes(marked, budget)
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """docs without the documents whose group holds a smaller doc_id; columns as before. Rows without a doc_id stay,
    and all rows that repeat the id that stays. Ids to drop are broadcast while they are BROADCAST_IDS at most, so that
    texts are not shuffled; more of them are joined by a shuffle."""
    gone = near_duplicates(docs, words, budget).where("doc_id <> component_id")
    name = common.hidden_name(docs, "gone")
    dropped = common.cut(gone.select(F.col("doc_id").cast("bigint").alias(name)).distinct())
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components; see near_duplicates()."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
