import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from cuemill.llm import attention_lm, packing_hist, quality_rank, registry, toxicity_pu

import corpus_pipeline

from .helpers import documents, empty
from .test_dedup_mix_pack import plain_fingerprint


def slow_log10(model, ids):
    """One id at a time, without windows in batches: the attention of each target over its own block and the one
    before, starts before the text."""
    p, step, total = model.p, attention_lm.STEP, 0.0
    start = attention_lm.IDS + 1
    rows = [start] * (step + 1) + model.place[ids].tolist()  # input before target t is rows[t + step]
    for t, goal in enumerate(ids):
        lo = (t // step) * step  # first target of the block; its inputs begin at lo + step
        keys = rows[lo : t + step + 1]
        q = p["q"][rows[t + step]]
        back = np.arange(len(keys))[::-1]
        w = np.exp(p["k"][keys] @ q + p["near"][back])
        h = (w[:, None] * p["v1"][keys][:, :-1]).sum(0) / w.sum() + p["e"][rows[t + step]]
        z = h @ p["c"] + p["b"]
        share = model.inside[goal]
        if model.follow is not None:
            z = z + model.follow[0][rows[t + step]]
            share += model.follow[1][rows[t + step], model.place[goal]]
        total += (z[model.kind[goal]] - np.log(np.exp(z).sum())) / np.log(10) + share
    return total


def small_model():
    rng = np.random.default_rng(0)
    counts = np.zeros(attention_lm.VOCABULARY, int)
    counts[rng.integers(0, attention_lm.VOCABULARY, 5000)] += rng.integers(1, 50, 5000)
    return attention_lm.new_model(counts, rng.integers(0, 5, (attention_lm.IDS + 2, attention_lm.CLASSES)).astype(float))


def test_windows_score_each_id_once():
    model, rng = small_model(), np.random.default_rng(1)
    texts = [rng.integers(0, attention_lm.VOCABULARY, n) for n in (1, 2, 15, 16, 17, 33, 200)]
    assert model.log10_of(texts) == pytest.approx([slow_log10(model, t) for t in texts], rel=1e-4)
    long = rng.integers(0, attention_lm.VOCABULARY, 20_000)
    assert model.log10_of([long, texts[3]]) == pytest.approx([slow_log10(model, long), slow_log10(model, texts[3])], rel=1e-4)
    inputs, target, own = model.windows(texts)
    assert sorted(own[own >= 0].tolist()) == sorted(k for k, t in enumerate(texts) for _ in t)


def test_a_target_depends_on_ids_far_back():
    model, rng = small_model(), np.random.default_rng(3)
    ids = rng.integers(0, attention_lm.VOCABULARY, 32)
    last = lambda t: np.subtract(*model.log10_of([t, t[:-1]]))
    other = ids.copy()
    other[8] = np.nonzero(model.place == (model.place[ids[8]] + 1) % attention_lm.IDS)[0][0]
    assert abs(last(ids) - last(other)) > 1e-4
    assert len(set(model.kind.tolist())) >= 64


def test_it_is_a_probability():
    model = small_model()
    share = 10.0**model.inside
    assert np.bincount(model.kind, share) == pytest.approx(np.ones(attention_lm.CLASSES))


def following_model():
    """A model that knows what rows follow others: of each of 300 rows, some 20."""
    model, rng = small_model(), np.random.default_rng(4)
    pairs = np.zeros((attention_lm.IDS + 2, attention_lm.IDS + 2))
    pairs[rng.integers(0, 300, 6000), rng.integers(0, attention_lm.IDS + 1, 6000)] += rng.integers(1, 9, 6000)
    counts = np.zeros(attention_lm.VOCABULARY, int)
    counts[np.nonzero(model.place < attention_lm.IDS)[0]] = 1 + rng.integers(0, 50, attention_lm.IDS)
    size = np.bincount(model.kind, counts + 0.5, attention_lm.CLASSES)
    model.inside, model.p["b"] = np.log10((counts + 0.5) / size[model.kind]), np.log(size / size.sum()).astype(np.float32)
    model.follow = attention_lm.following(model, counts, pairs)
    return model, counts, pairs


def test_what_follows_a_row():
    model, counts, pairs = following_model()
    logits, share = model.follow
    kind = np.full(attention_lm.IDS + 1, attention_lm.CLASSES - 1)
    kind[model.place] = model.kind
    for row in (0, 7, 299, 300, attention_lm.IDS + 1):
        whole = 10.0 ** (model.inside + share[row, model.place])
        assert np.bincount(model.kind, whole) == pytest.approx(np.ones(attention_lm.CLASSES), rel=1e-4)
        chance = np.exp(model.p["b"] + logits[row])
        assert chance.sum() == pytest.approx(1, rel=1e-4)
        seen = pairs[row, : attention_lm.IDS + 1]
        if not seen.any():
            assert not logits[row].any() and not share[row].any()
            continue
        c = kind[seen.argmax()]
        n, new, own = seen[kind == c].sum(), (seen[kind == c] > 0).sum(), seen.max()
        ids = np.nonzero(model.place == seen.argmax())[0]
        inside = (10.0 ** model.inside[ids]).sum()
        assert (10.0 ** (model.inside[ids] + share[row, seen.argmax()])).sum() == pytest.approx((own + new * inside) / (n + new), rel=1e-4)
        first = np.exp(model.p["b"][c])
        assert chance[c] == pytest.approx((n + (seen > 0).sum() * first) / (seen.sum() + (seen > 0).sum()), rel=1e-4)
    rng = np.random.default_rng(1)
    frequent = np.nonzero(model.place < 400)[0]
    texts = [rng.choice(frequent, n) for n in (1, 16, 17, 200)]
    assert model.log10_of(texts) == pytest.approx([slow_log10(model, t) for t in texts], rel=1e-4)


@pytest.mark.parametrize("make", [small_model, lambda: following_model()[0]])
def test_gradients_against_differences(make):
    model, rng = make(), np.random.default_rng(2)
    ids = [rng.integers(0, attention_lm.VOCABULARY, 40)]
    for name in ("e", "q", "k", "v1", "c", "b", "near"):
        trainer = attention_lm.Trainer(model, rate=0.0)
        trainer.learn(ids)
        grad = trainer.m[name] / 0.1
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        loss = lambda: -model.log10_of(ids)[0] * np.log(10) / 40
        was = model.p[name][place]
        model.p[name][place] = was + 0.02
        up = loss()
        model.p[name][place] = was - 0.02
        down = loss()
        model.p[name][place] = was
        assert (up - down) / 0.04 == pytest.approx(grad[place], rel=0.05)


def test_logits_beyond_what_exp_holds():
    model, rng = small_model(), np.random.default_rng(6)
    texts = [rng.integers(0, attention_lm.VOCABULARY, n) for n in (3, 40)]
    want, bias = model.log10_of(texts), model.p["b"].copy()
    for shift in (150, -150):
        model.p["b"][:] = bias + shift
        assert model.log10_of(texts) == pytest.approx(want, rel=1e-4)


def test_a_step_takes_no_new_room():
    trainer, rng = attention_lm.Trainer(following_model()[0]), np.random.default_rng(7)
    texts = [rng.integers(0, attention_lm.VOCABULARY, 3000)]
    inputs, target, own = trainer.model.windows(texts)
    step = lambda: trainer.update(inputs, target[1:].ravel(), own[1:].ravel() >= 0)
    step()
    tracemalloc.start()
    step()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20  # one array of logits is 0.8 MB


def test_a_step_is_the_same_however_it_is_cut(monkeypatch):
    rng, got = np.random.default_rng(8), []
    texts = [np.concatenate([rng.integers(0, attention_lm.VOCABULARY, n), np.full(n, 3)]) for n in (1, 16, 90, 200)]
    for at_once, rows, many in ((192, 768, 24), (1, 16, 1), (5, 30, 10_000), (192, 768, 0)):
        for name, value in (("AT_ONCE", at_once), ("ROWS_AT_ONCE", rows), ("MANY", many)):
            monkeypatch.setattr(attention_lm, name, value)
        trainer = attention_lm.Trainer(following_model()[0], rate=0.0)
        trainer.learn(texts)
        got.append(trainer.m | {"scores": trainer.model.log10_of(texts)})
    for other in got[1:]:
        for name, whole in got[0].items():
            assert other[name] == pytest.approx(whole, rel=1e-3, abs=1e-6 * float(np.abs(whole).max()))


def test_training_lowers_the_loss():
    model = small_model()
    pattern = np.array([5, 9, 77, 5, 9, 1234] * 40)
    before = model.log10_of([pattern])[0]
    trainer = attention_lm.Trainer(model)
    for _ in range(60):
        trainer.learn([pattern])
    assert model.log10_of([pattern])[0] > before + 20


def test_base_score_against_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if train(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        own = words(t)
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[i, not train(i), len(own), sum(c[w] > 0 for w in own), n, round(base, 4)] += 1
    got = attention_lm.score_corpus(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert attention_lm.score_corpus(empty(spark)).count() == 0


def test_all_training_documents_count_and_train(spark, monkeypatch):
    texts = [f"alpha beta gamma delta word{i} " * 12 for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen, new_model = [], attention_lm.new_model

    def spy(counts, pairs):
        seen.append((counts.copy(), pairs.copy()))
        return new_model(counts, pairs)

    monkeypatch.setattr(attention_lm, "new_model", spy)
    got = {r["doc_id"]: r for r in attention_lm.score_corpus(docs).collect()}
    ids = [np.frombuffer(b, "<u4").astype(int) for b in packing_hist.WordEncoder().encode_all(texts)]
    train = [x for i, x in enumerate(ids) if not got[i]["held_out"]]
    assert 100 < len(train) < 150
    (counts, pairs), *more = seen
    assert not more and counts.tolist() == np.bincount(np.concatenate(train), minlength=attention_lm.VOCABULARY).tolist()
    assert pairs.sum() == sum(len(x) - 1 for x in train)
    untrained = new_model(counts, pairs)
    held = [i for i in range(150) if got[i]["held_out"]]
    before = untrained.log10_of([np.append(ids[i], 2) for i in held])
    assert sum(got[i]["score"] for i in held) > before.sum() * 0.85


def test_pairs_of_rows_and_scores_by_a_plain_loop(spark, monkeypatch):
    docs = documents(spark)
    models, tables = [], []
    train, count = attention_lm.train_attention, attention_lm._id_tables
    monkeypatch.setattr(attention_lm, "train_attention", lambda encoded: models.append(train(encoded)) or models[-1])
    monkeypatch.setattr(attention_lm, "_id_tables", lambda encoded: tables.append(count(encoded)) or tables[-1])
    got = attention_lm.score_corpus(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = [np.frombuffer(b, "<u4").astype(int) for b in packing_hist.WordEncoder().encode_all([t for _, t in rows])]
    pairs = np.zeros((attention_lm.IDS + 2,) * 2)
    for (i, _), x in zip(rows, ids, strict=True):
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            np.add.at(pairs, (models[0].place[x[:-1]], models[0].place[x[1:]]), 1)
    assert (tables[0][1] == pairs).all() and pairs.any()
    short = [(i, x) for (i, _), x in zip(rows, ids, strict=True) if len(x) < 400]
    want = sorted((str(i), slow_log10(models[0], np.append(x, 2))) for i, x in short)
    size = Counter(str(i) for i, _ in rows)
    once = [(i, s) for i, s in want if size[i] == 1]
    score = {str(r["doc_id"]): r["score"] for r in got}
    assert len(once) > 3 and [score[i] for i, _ in once] == pytest.approx([s for _, s in once], rel=1e-3)


def test_queries_are_registered():
    numbers = {int(n.split("_")[0][2:]) for n in registry.QUERIES}
    assert numbers == set(range(1, 14)) and len(registry.QUERIES) == 13


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    ranking = quality_rank.learn_quality(docs, labels)
    good = {i for i, r in rows.items() if ranking.score(quality_rank._features_of([r["text"]]))[0] >= ranking.threshold}
    stage = corpus_pipeline.quality(spark, docs, folder)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == good
    kept = spark.createDataFrame([rows[i] for i in sorted(good)], docs.schema)
    model = toxicity_pu.learn_toxicity(kept, labels)
    clean = {i for i in good if model.score([rows[i]["text"]])[0] < 0.5}
    stage = corpus_pipeline.toxicity(spark, kept, folder)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == clean
    prints = {i: plain_fingerprint(rows[i]["text"]) for i in clean}
    group = {i: i for i in clean}
    for _ in range(8):
        for a in clean:
            group[a] = min(group[b] for b in clean if (prints[a] ^ prints[b]).bit_count() <= 2)
    left = {i for i in clean if group[i] == i}
    kept = spark.createDataFrame([rows[i] for i in sorted(clean)], docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, folder).collect()} == left
    kept = spark.createDataFrame([rows[i] for i in sorted(left)], docs.schema)
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, kept, folder).collect())
    out = corpus_pipeline.run(spark, folder).collect()
    encoder = packing_hist.WordEncoder()
    ids = {i: b + b"\2\0\0\0" for i, b in zip(sorted(left), encoder.encode_all([rows[i]["text"] for i in sorted(left)]), strict=True)}
    got, want = Counter(), Counter()
    for i, n in mixed.items():
        for at in range(0, len(ids[i]) // 4, 4096):
            want[i, at, ids[i][4 * at : 4 * (at + 4096)]] += n
    for r in out:  # each drawn id once, in the sequence that its piece is in
        at = 0
        for doc, start, n, tokens in zip(r["doc_id"], r["start"], r["length"], r["doc_tokens"], strict=True):
            got[doc, start, bytes(r["ids"])[4 * at : 4 * (at + n)]] += 1
            assert tokens == len(ids[doc]) // 4
            at += n
        assert at == r["n_ids"] <= 4096
    assert got == want and all(n <= 2 for n in mixed.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]


def odd_folder(spark, path, rows):
    """A folder whose documents have odd rows and columns, and the labels of the smallest tables."""
    docs = documents(spark, rows)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return docs


def test_pipeline_with_odd_rows_and_columns(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in real]
    rows += [rows[3], rows[3], (None, rows[5][1], "en", None), (None, None, None, None), (900_001, "", "en", "a"), (900_002, None, None, None), (900_003, rows[7][1] + " " + rows[7][1], "en", "zz")]
    docs = odd_folder(spark, tmp_path, rows)
    kept, name_of = docs, [r["text"] for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path))
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert {(r["doc_id"], r["text"]) for r in after.collect()} <= {(r["doc_id"], r["text"]) for r in kept.collect()}
        kept = after
    assert len(name_of) == len(rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {i for r in out for i in r["doc_id"]} <= {r[0] for r in rows}
    assert sorted({r["sequence_id"] for r in out}) == list(range(len({r["sequence_id"] for r in out})))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    odd_folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
