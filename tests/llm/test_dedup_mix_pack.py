import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cuemill.llm import mixing_tree, packing_hist, simhash_dedup
from cuemill.llm.components import connected_components
from pyspark.sql import functions as F

from .helpers import documents, empty, water_fill


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    out = 0
    for bit in range(64):
        if shingles and 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def test_fingerprint_and_components_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sorted(simhash_dedup.near_duplicates(docs).collect(), key=str)
    assert len(got) == len(rows)
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    assert Counter((i, f"{f:016x}") for i, f in fps) == Counter((r["doc_id"], r["fingerprint"]) for r in got)
    own = {i: f for i, f in fps if i is not None}
    parent = {i: i for i in own}
    for _ in own:
        for a in own:
            for b in own:
                if (own[a] ^ own[b]).bit_count() <= 2:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == parent[r["doc_id"]]


def test_trie_join_finds_all_links_and_no_more():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64).tolist()
    keys = set(base) | {0, 1, 3, 2**64 - 1}
    for b in base:
        for _ in range(25):
            x = b
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
            keys.add(x)
    keys = np.sort(np.array(sorted(keys), np.uint64))
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 2
    want = {(i, j) for i, j in zip(*map(list, np.nonzero(near)), strict=True) if i < j}
    for few, most in ((1, 50), (64, 1 << 20)):
        got = set()
        for i, j in simhash_dedup.trie_links(keys, 0, 2, few, most):
            got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == want
    assert list(simhash_dedup.trie_links(keys[:1], 0, 2)) == []


def test_crowded_blocks_are_dealt_out_again(spark):
    rng = np.random.default_rng(5)
    heads = [0, 0xABCDE, 0x1FFFFF]
    keys = {(h << 43) ^ int(x) for h in heads for x in rng.integers(0, 2**43, 40)} | {0, 2**64 - 1, 1}
    for x in list(keys):
        for n in (1, 2, 2, 3):
            y = x
            for bit in rng.choice(64, n, replace=False):
                y ^= 1 << int(bit)
            keys.add(y)
    keys = sorted(keys)
    signed = [x - 2**64 if x >= 2**63 else x for x in keys]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, rep bigint")
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(keys):
        for j in range(i):
            if (x ^ keys[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for crowd in (1 << 17, 30, 2):
        linked = {r["node"]: r["component"] for r in connected_components(simhash_dedup.fingerprint_links(classes, 2, crowd)).collect()}
        assert [linked.get(i, i) for i in range(len(keys))] == [root(i) for i in range(len(keys))]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(edges.where("a < 0")).count() == 0


def test_dropping_keeps_the_smallest_and_the_columns(spark):
    kept = simhash_dedup.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[1] == 0 and ids[2] == 1 and ids[3] == 0 and ids[None] == 2
    assert simhash_dedup.drop_near_duplicates(empty(spark)).count() == 0
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_water_filling(spark):
    def filled(sizes, weights, budget, most):
        rows = spark.createDataFrame([(float(most * s), float(w)) for s, w in zip(sizes, weights, strict=True)], "room double, weight double")
        level = mixing_tree.water_level(rows, budget)
        return [min(most * s, level * w) if s else 0.0 for s, w in zip(sizes, weights, strict=True)]

    assert filled([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    assert filled([0, 10], [1, 1], 15, 2) == pytest.approx([0, 15])
    assert filled([1, 1000], [5, 2], 1501.5, 2) == pytest.approx([2, 1499.5])
    assert filled([], [], 0, 2) == [] and filled([3, 4], [1, 1], 100, 2) == [6, 8]
    rng = np.random.default_rng(2)
    sizes, weights = rng.integers(0, 50, 400).tolist(), [(5.0, 2.0, 1.0)[i % 3] for i in range(400)]
    for share in (0.3, 1.5, 1.9):
        want = water_fill(sizes, weights, share * sum(sizes), 2)
        assert filled(sizes, weights, share * sum(sizes), 2) == pytest.approx(want)


def test_splitting_tree_is_exact():
    q = np.array([100, 7, 0, 33])
    table = mixing_tree.split_quotas(q, 8, 1)
    assert (table.sum(axis=0) == q).all() and (table >= 0).all()
    assert np.ptp(table.sum(axis=1)) <= 1
    assert (table == mixing_tree.split_quotas(q, 8, 1)).all()
    many = np.arange(300) % 7
    totals = mixing_tree.split_quotas(np.array([many.sum()]), 16, 5)[:, 0]
    parts = np.concatenate(list(mixing_tree.split_in_groups(many, totals, 3, group=8)), axis=1)
    assert (parts.sum(axis=0) == many).all() and (parts.sum(axis=1) == totals).all() and (parts >= 0).all()


def test_mix_near_targets_and_reruns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", "abc"[i % 3] if i % 7 else None) for i in range(900)]
    docs = documents(spark, rows)
    mixed = [sorted(r["doc_id"] for r in mixing_tree.mix_documents(docs).collect()) for _ in range(2)]
    assert mixed[0] == mixed[1]
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    taken, whole = Counter(), Counter()
    for i in size:
        whole[source[i]] += size[i]
    for i, n in Counter(mixed[0]).items():
        assert n <= 2
        taken[source[i]] += n * size[i]
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    goal = water_fill([whole[s] for s in order], [5.0, 2.0, 1.0, 5.0], 1.5 * sum(whole.values()), 2)
    for s, g in zip(order, goal, strict=True):
        assert abs(taken[s] - g) <= 60


def test_draws_against_a_walk_over_each_source(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[min(2, i % 5)] if i % 11 else None, int(rng.integers(0, 90))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    plan = mixing_tree.plan_mix(docs, shards=4, block_docs=16)
    of = {r["source"]: r for r in plan.table.collect()}
    hashed = docs.select("*", mixing_tree._hash(plan.seed, ["doc_id", "size"]).alias("h")).collect()
    got = {r["doc_id"]: (r["passes"], r["at"]) for r in mixing_tree.draw_mix(docs, shards=4, block_docs=16).collect()}
    dealt = Counter()
    for source, p in of.items():
        own = [(p["mul"] * (r["h"] % p["blocks"]) + p["add"]) % p["blocks"] for r in hashed if r["source"] == source]
        assert len(set(own)) == p["blocks"]  # a permutation
        rest, reach, blocks = p["target"] - p["whole"] * p["source_size"], 0, {}
        for place, h, i, size in sorted(zip(own, *zip(*[(r["h"], r["doc_id"], r["size"]) for r in hashed if r["source"] == source]))):
            more = size > 0 and reach + size / 2 <= rest and rest > 0
            reach += size
            assert size == 0 or got[i][0] == p["whole"] + more, (i, got[i], place, p)
            blocks.setdefault(place, []).append(got[i])
        for place, docs_ in blocks.items():
            longest = max(at for _, at in docs_)
            assert all(at == longest[:n] for n, at in docs_)
            dealt.update((source, s) for s in longest)
    for source, p in of.items():
        assert [sum(dealt[source, s] for s in range(k + 1)) for k in range(4)] == p["ends"] and p["owners"] is None


def test_many_sources(spark):
    """300,000 sources, most of a document or two: the targets of a plain filling, and each source's words near its own."""
    n = 300_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, F.format_string("s%07d", F.col("id"))).otherwise(F.format_string("s%07d", F.floor(F.col("id") / 3 % 1000))).alias("source"), (F.col("id") * 7 % 90 + 1).alias("size"))
    mixed = mixing_tree.draw_mix(docs).select("source", "size", "target", "source_size", "passes", F.size("at").alias("k")).toPandas()
    assert len(mixed) == 2 * n and (mixed.passes == mixed.k).all() and mixed.passes.max() <= 2
    own = mixed.groupby("source", sort=True).agg(size=("size", "sum"), target=("target", "first"), said=("source_size", "first"))
    assert (own["size"] == own.said).all() and len(own) == n
    want = water_fill(own["size"].tolist(), [(5.0, 2.0, 1.0)[i % 3] for i in range(n)], 1.5 * own["size"].sum(), 2)
    assert np.allclose(own.target, want)
    taken = (mixed.passes * mixed["size"]).groupby(mixed.source).sum()
    assert (abs(taken - own.target) <= 45.01).all()


def test_mix_edges(spark):
    clash = spark.createDataFrame([(1, "a", 3, 7, 8, "x"), (2, None, 0, 7, 8, "y"), (2, None, 0, 7, 8, "y")], "doc_id int, source string, size bigint, rank int, target int, text string")
    got = mixing_tree.draw_mix(clash)
    assert got.columns == ["doc_id", "source", "size", "rank", "text", "source_size", "target", "passes", "at"]
    assert sorted(map(tuple, got.select("doc_id", "rank", "text", "target", "passes").collect())) == [(1, 7, "x", 4.5, 2), (2, 7, "y", 0.0, 0), (2, 7, "y", 0.0, 0)]
    assert mixing_tree.mix_documents(empty(spark)).count() == 0
    out = mixing_tree.mix_documents(documents(spark))
    assert out.columns == documents(spark).columns and out.count() >= 1


def test_shortest_pack_first():
    patterns = packing_hist.shortest_pack_first({4: 3, 3: 2, 2: 3, 1: 5}, 6)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 6 and list(p) == sorted(p, reverse=True)
        for length in p:
            used[length] += n
    assert used == {4: 3, 3: 2, 2: 3, 1: 5}
    assert packing_hist.shortest_pack_first({}) == []


def test_packing_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's. can't!", "ΑΣ Σ.", "Å x İ.", "1,234.5% a1.", "<|endoftext|> Foo<|ENDOFTEXT|>.", "x y 你好。 fi ﬁ."]
    docs = documents(spark).unionByName(documents(spark, [(100 + i, t, "en", "a") for i, t in enumerate(odd)]))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed = packing_hist.pack_documents(docs, keep_ids=True)
    got = packed.collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[(i, at, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing_hist.sequences(packed).collect()}
    for s, own in places.items():
        own.sort()
        assert [o for o, *_ in own] == np.cumsum([0, *(n for _, n, _ in own)])[:-1].tolist()
        assert sum(n for _, n, _ in own) <= 4096
        assert made[s] == b"".join(x for *_, x in own)
    assert sorted(places) == list(range(len(places)))
    assert packing_hist.pack_documents(empty(spark)).count() == 0


def test_sequences_in_training_order(spark):
    rng = np.random.default_rng(3)
    docs = documents(spark, [(i % 290, " ".join(f"w{k}" for k in rng.integers(0, 900, int(rng.integers(1, 900)))), "en", "a") for i in range(300)] + [(None, None, None, None), (7, "", "en", "a")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = packing_hist.pack_sequences(docs, 2048, per_shard=20).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pieces, each = Counter(), Counter()
    want = {(r["doc_id"], r["start"], bytes(r["ids"])): 0 for r in packing_hist.token_pieces(docs, 2048, keep_ids=True).collect()}
    for r in packing_hist.token_pieces(docs, 2048, keep_ids=True).collect():
        each[r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]] += 1
    for r in got:
        assert r["n_ids"] == len(r["ids"]) // 4 == sum(r["length"]) <= 2048
        at = 0
        for doc, start, n, tokens in zip(r["doc_id"], r["start"], r["length"], r["doc_tokens"], strict=True):
            pieces[doc, start, bytes(r["ids"])[4 * at : 4 * (at + n)], tokens] += 1
            at += n
    assert pieces == each and len(want) <= len(each)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    assert len(shards) > 1 and len({r["sequence_id"] for r in got}) == len(got)
    for own in shards.values():
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    order = [r["length"] for r in sorted(got, key=lambda r: (r["shard"], r["place"])) if len(r["length"]) > 2]
    assert sum(x != sorted(x, reverse=True) for x in order) > len(order) / 3
    numbers = [r["sequence_id"] for r in sorted(shards[0], key=lambda r: r["place"])]
    assert numbers != sorted(numbers)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions without rows
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    again = packing_hist.pack_sequences(docs.repartition(3), 2048, per_shard=20).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: (r["shard"], r["place"], r["n_ids"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert packing_hist.pack_sequences(empty(spark)).count() == 0
