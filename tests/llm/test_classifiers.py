import numpy as np
import zlib

from cuemill.llm import quality_rank, toxicity_pu
from pyspark.sql import functions as F

from .helpers import documents, empty

DATA = "/root/testdata/sf0.01"


def labelled(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_labels(spark):
    out = quality_rank.op5_quality_bradley_terry(spark, DATA).toPandas()
    assert len(out) == 1000 and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(held_out)).all()
    assert (out["predicted"] == (out["score"] >= 0.3)).all()
    known = out[out["held_out"]].merge(labelled(spark), on="doc_id")
    assert (known["predicted"] == known["quality"]).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    out = toxicity_pu.op1_toxicity_pu(spark, DATA).toPandas()
    assert len(out) == 1000 and out["score"].between(0, 1).all()
    known = out[out["held_out"]].merge(labelled(spark), on="doc_id")
    assert (known["predicted"] == known["toxic"]).mean() > 0.9
    clean = known[known["toxic"] == 0]
    assert clean["predicted"].mean() < 0.05


def test_pairwise_ranking_learns_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality_rank.FEATURES))
    y = (x[:, 3] - x[:, 5] > 0).astype(int)
    model = quality_rank.fit_ranking(x, y, 0.3, pairs=5000)
    assert ((model.score(x) >= 0.3) == y).mean() > 0.93


def test_ranking_without_both_labels():
    x = np.zeros((3, quality_rank.FEATURES))
    assert (quality_rank.fit_ranking(x, np.ones(3), 0.3).score(x) >= 0.3).all()
    assert (quality_rank.fit_ranking(x, np.zeros(3), 0.3).score(x) < 0.3).all()
    assert (quality_rank.fit_ranking(x[:0], np.ones(0), 0.3).score(x) >= 0.3).all()


def test_negative_risk_below_zero_turns_the_step():
    p, u = np.array([[1.0]]), np.array([[0.1]])
    w = np.array([5.0])
    su, sp = 1 / (1 + np.exp(-0.5)), 1 / (1 + np.exp(-5.0))
    plain = 0.9 * (sp - 1), 0.1 * su - 0.9 * sp
    assert toxicity_pu.nn_pu_gradient(p, u, w, 0.9)[0] == -0.2 * plain[1]
    assert np.isclose(toxicity_pu.nn_pu_gradient(p, u, w, 0.01)[0], 0.01 * (sp - 1) + 0.1 * su - 0.01 * sp)


def test_odd_rows_and_clashing_columns(spark):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (0, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark)
    ranking = quality_rank.learn_quality(docs, labels)
    scored = quality_rank.score_quality(docs, ranking)
    assert scored.count() == 12 and sorted(scored.columns) == sorted(docs.columns)
    model = toxicity_pu.learn_toxicity(docs, labels)
    scored = toxicity_pu.score_toxicity(docs, model)
    assert scored.count() == 12 and scored.where("score is null").count() == 0
    for learn, score in ((quality_rank.learn_quality, quality_rank.score_quality), (toxicity_pu.learn_toxicity, toxicity_pu.score_toxicity)):
        assert score(empty(spark), learn(empty(spark), labels.where("false"))).count() == 0


def test_toxicity_scores_by_a_plain_loop(spark):
    """The query's whole table against sums of the fitted weights of each text's terms, found letter by letter."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = toxicity_pu.learn_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert 0 < len(model.weight) <= (toxicity_pu.POSITIVES + toxicity_pu.UNLABELLED) // toxicity_pu.DOCS_A_TERM and all(w >= 0 for w in model.weight.values())
    got = {r["doc_id"]: r["score"] for r in toxicity_pu.op1_toxicity_pu(spark, DATA).collect()}
    for r in docs.collect():
        seen, word = set(), ""
        for ch in (r["text"] or "").lower() + " ":
            if ch.isalnum() and not ch.isdecimal():
                word += ch
                continue
            if word:
                seen.add(word)
                if len(word) > 4:
                    seen.add("^" + word[:4])
            word = ""
        z = model.bias
        for term in seen:
            z += model.weight.get(term, 0.0)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9, r["doc_id"]


def plain_features(text):
    """The features of a text, in their order, counted character by character and word by word."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * quality_rank.FEATURES
    n, w, different = len(text), len(words), set(words)
    letters = capitals = digits = marks = runs = 0
    inside = False
    for ch in text:
        letter = (ch.isalnum() or ch == "_") and not ch.isdecimal() and ch != "_"
        letters += letter
        runs += letter and not inside
        inside = letter
        capitals += "A" <= ch <= "Z" or "À" <= ch <= "Ö" or "Ø" <= ch <= "Þ"
        digits += ch.isdecimal()
        marks += not (ch.isalnum() or ch == "_" or ch.isspace() or ch in ".,;:!?'\"()-")
    lines = [x for x in text.split("\n") if x.strip()]
    stops = sum(ch in ".!?" for ch in text)
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    log = np.log1p
    return [
        1.0, log(w), log(n) - log(w), len(different) / w, log(len(different)), marks / n, log(marks), marks / w, letters / n, capitals / n, digits / n, stops / w, log(stops),
        sum(ch in ",;" for ch in text) / w, sum(a == b for a, b in zip(words, words[1:])) / w, max(words.count(x) for x in different) / w, len(lines) / w, len(set(lines)) / max(1, len(lines)), packed,
        min(packed, 0.2), runs / w, log(max(map(len, different))),
    ]


def test_quality_scores_by_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = quality_rank.learn_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality_rank.op5_quality_bradley_terry(spark, DATA).collect()}
    for r in docs.collect():
        if len(r["text"] or "") > 20_000:
            continue  # counts of words are quadratic here
        z = [max(-6.0, min(6.0, (x - m) / s)) for x, m, s in zip(plain_features(r["text"]), model.mean, model.scale, strict=True)]
        raw = sum(v * w for v, w in zip([*z, *[v * v / 3 for v in z]], model.weight, strict=True))
        logit = model.slope * (raw - model.cut) + np.log(model.threshold / (1 - model.threshold))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-max(-30, min(30, logit))))) < 1e-6, r["doc_id"]


def test_texts_of_one_id_are_chosen_alike(spark):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, 1), (3, 0, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark)
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz "), "text")))
    other = docs.withColumn("text", F.concat(F.lit("zz "), "text")).unionByName(docs)
    a, b = (quality_rank.learn_quality(d.repartition(3), labels) for d in (twice, other))
    assert (a.weight == b.weight).all() and a.cut == b.cut
    a, b = (toxicity_pu.learn_toxicity(d.repartition(3), labels) for d in (twice, other))
    assert a == b
