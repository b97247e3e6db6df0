import hashlib
import math
import random
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from cuemill.llm import fim_boundaries as fim
from cuemill.llm import lexical_lemp as lemp
from cuemill.llm import piece_prefix_table as ppt

from .helpers import DOCS, LONG, documents, empty

# ---- fill-in-the-middle


@pytest.mark.parametrize(
    "kind, members",
    [
        ("array", sorted(random.Random(1).sample(range(3 * fim.SPAN), 2000))),
        ("bitmap", sorted(random.Random(2).sample(range(3 * fim.SPAN), 90_000))),
        ("runs", [*range(5, 60_000), *range(60_010, 2 * fim.SPAN + 77), 3 * fim.SPAN - 1]),
        ("runs", list(range(fim.SPAN))),
        ("bitmap", list(range(0, 2 * fim.SPAN, 3))),
    ],
)
def test_boundary_set_selects_and_ranks(kind, members):
    mask = np.zeros(members[-1] + 1, bool)
    mask[members] = True
    kept = fim.BoundarySet(mask)
    assert kept.containers[0][0] == kind and len(kept) == len(members)
    assert kept.select(np.arange(len(members))).tolist() == members
    at = np.array([*range(0, members[-1] + 2, 97), members[-1], members[-1] + 1, members[0]])
    assert kept.rank(at).tolist() == np.searchsorted(members, at).tolist()
    assert fim.BoundarySet(np.zeros(5, bool)).rank(np.array([0, 3])).tolist() == [0, 0]


def halves(doc_id, n, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    return *sorted((h1 % (n + 1), h2 % (n + 1))), h3, h4


def arranged(doc_id, text):
    t = text or ""
    a, b, h3, h4 = halves(doc_id, len(t))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (len(t), "plain", None, None, t)
    if h4 % 100 < 20:
        return (len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


ODD = ["", None, "<", "P>", "a<P>b", "x<S>", "<M>", "<<S", "S>M><", "<P", "🙂é́你好\x00z", "\x00", "é" * 70_000, "你好吗" * 30_000, LONG, "a\r\n b"]


def test_fim_equals_slices_of_code_points(spark):
    rows = [(k, t, None, None, None, 1.0, "x", "y", "z") for k, t in enumerate(ODD * 6)] + [(None, "no id", None, None, None, 1.0, "x", "y", "z")] * 2
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == arranged(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["fp"] == "x"


def test_fim_of_lines_and_words_and_clashing_columns(spark):
    text = "eins zwei\n drei  vier\n\nfünf" * 50
    df = spark.createDataFrame([(k, text, "old") for k in range(40)], "doc_id bigint, text string, Output string")
    for unit, pieces in (("line", re.findall(r"[^\n]*\n|[^\n]+", text)), ("word", re.findall(r"\s*\S+\s*|\s+", text))):
        assert "".join(pieces) == text
        for r in fim.fill_in_middle(df, unit=unit, rearranged=100, suffix_first=0).collect():
            a, b, _, _ = halves(r["doc_id"], len(pieces))
            cut = ["".join(x) for x in (pieces[:a], pieces[b:], pieces[a:b])]
            assert (r["n"], r["output"]) == (len(pieces), f"<P>{cut[0]}<S>{cut[1]}<M>{cut[2]}")
    with pytest.raises(ValueError):
        fim.unit_starts(np.zeros(3, np.uint8), np.zeros(1, np.int64), "page")


def test_fim_query_and_sql(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = fim.op13_fim_boundary_select(spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()), key=str)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert rows == sorted(db.execute(fim.ORACLE).fetchall(), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in documents(spark).collect():
        n, form, a, m, out = arranged(r["doc_id"], r["text"])
        want.append((r["doc_id"], n, form, a, m, sha(out), sha(r["text"] or "")))
    assert rows == sorted(want, key=str)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fim.op13_fim_boundary_select(spark, str(tmp_path / "none")).collect() == []


# ---- ranked lexical search


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked_plainly(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text). Every document against every item."""
    tokens = [(i, words(t)) for i, t in docs]
    tokens = [(i, w) for i, w in tokens if w]
    n_docs, all_terms = len(tokens), sum(len(w) for _, w in tokens)
    df = {}
    for _, w in tokens:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, w in tokens:
            m = 10 + (90 * len(w) * n_docs) // all_terms
            score = 0
            for t in terms & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_terms_are_split_and_folded_as_bytes():
    texts = ["Ab-cÉ x\x7fy", None, "", " lead", "trail ", "é_1[2]", "a" * 3]
    owner, number, terms = lemp.terms_of(pa.array(["skip", *texts])[1:])
    got = [[] for _ in texts]
    for o, t in zip(owner, number, strict=True):
        got[o].append(terms[int(t)].as_py())
    assert got == [words(t) for t in texts]


def test_search_equals_every_document_against_every_item(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Éa", "你好"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for k in range(300)]
    docs += [(None, docs[0][1]), (None, "w1 w2"), (5, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "-- --"), (903, LONG + " w3")]
    docs += [(1000 + k, "w1 w2 w3 same") for k in range(30)]
    items = [(1, "w1, w2. W3!"), (2, "same"), (3, ""), (4, None), (5, "nowhere at all"), (6, "w9 w8"), (6, "w7"), (None, "w4 Éa 你好"), (7, " ".join(vocabulary))]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, item_id string, rank int").repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    want = ranked_plainly(docs, items)
    got = lemp.search(df, asked)
    assert got.schema["rank"].dataType.typeName() == "integer"
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, lemp.search(df, asked, query_bytes=40).collect()), key=str) == want  # in several blocks
    assert sorted(map(tuple, lemp.search(df, asked, k=2).collect()), key=str) == ranked_plainly(docs, items, 2)


def test_buckets_and_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    n, v = 4000, 400
    size = rng.integers(0, 40, n)
    terms = np.concatenate([np.sort(rng.choice(v, s, replace=False)) for s in size]).astype(np.int64)
    impacts = (rng.pareto(1.5, len(terms)) * 1e6).astype(np.int64) + 1
    vectors = lemp.Vectors(np.concatenate([[0], np.cumsum(size)]), terms, impacts)
    queries = [rng.choice(v, s, replace=False) for s in (1, 2, 3, 8, 30)] + [np.zeros(0, np.int64)]
    ranking = lemp.Ranking(queries, v, 10, np.zeros(len(queries), np.int64))
    ids = rng.permutation(n)
    ranking.add(vectors, ids, np.zeros(n, np.int64))
    dense = np.zeros((n, v), np.int64)
    dense[np.repeat(np.arange(n), size), terms] = impacts
    touched = 0
    for q, (scores, found, _) in zip(queries, ranking.best, strict=True):
        exact = dense[:, q].sum(axis=1)
        touched += int((exact > 0).sum())
        best = np.lexsort((ids, -exact))[:10]
        assert found.tolist() == [int(ids[b]) for b in best if exact[b] > 0] and scores.tolist() == [int(exact[b]) for b in best if exact[b] > 0]
    assert ranking.rescored < touched / 2


def test_search_query_and_sql(spark, tmp_path):
    rows = documents(spark).collect()
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "the Quick fox"), (2, "alpha-beta"), (3, None), (4, "zwei éß two")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, lemp.op11_lexical_lemp(spark, str(tmp_path)).collect()), key=str)
    assert got == ranked_plainly([(r["doc_id"], r["text"]) for r in rows], items)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert sorted(db.execute(lemp.ORACLE).fetchall(), key=str) == got
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert lemp.search(empty(spark), asked).collect() == [] and lemp.search(documents(spark), asked.limit(0)).collect() == []


# ---- SentencePiece


def _message(*fields):
    """A protocol buffer message of (number, value): whole numbers, floats, bytes or texts."""
    out = b""
    for n, v in fields:
        if isinstance(v, int):
            out += bytes([n << 3 & 127 | 128, n >> 4, v]) if n > 15 else bytes([n << 3, v])
        elif isinstance(v, float):
            out += bytes([n << 3 | 5]) + struct.pack("<f", v)
        else:
            v = v.encode() if isinstance(v, str) else v
            size = bytes([len(v)]) if len(v) < 128 else bytes([len(v) & 127 | 128, len(v) >> 7])
            out += bytes([n << 3 | 2]) + size + v
    return out


def model_file(path, pieces, normalizer=((1, "identity"), (3, 1), (4, 0), (5, 1)), kind=2):
    fixed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    parts = [_message((1, t), (2, s), (3, k)) for t, s, k in [*fixed, *[(t, s, 1) for t, s in pieces]]]
    path.write_bytes(_message(*[(1, p) for p in parts], (2, _message((3, kind), (35, 1))), (3, _message(*normalizer))))
    return str(path)


def same_as_library(model, library, texts):
    ids, edges = model.encode(pa.array(texts, pa.string()))
    decoded = model.decode(ids.astype(np.int64), edges)
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids[edges[k] : edges[k + 1]].tolist() == want, repr(t)[:100]
        assert decoded[k].decode() == library.decode(want), repr(t)[:100]


MIXED = ["a", "b", "e", "t", "h", "s", "  ", " ", "▁", "the", "ing", "\n", "é", "🙂", "你", "好", "1", ".", "\t", "x" * 5, "\x00", "ﬁ", "\u3000", "<s>", "<0x0A>"]


def test_pieces_equal_the_library_on_the_public_model():
    rng = random.Random(1)
    texts = ["", " ", "  ", "a" * 3000, "▁▁", None, LONG, "你好" * 2000, " " * 5000, "\n" * 70]
    texts += ["".join(rng.choices(MIXED, k=rng.randrange(1, 60))) for _ in range(1500)]
    texts += [" " * k + w + " " * j for k in range(0, 36, 3) for j in (0, 1, 5, 14, 15, 16, 17, 33) for w in ("", "the", "é", "\n")]
    path = public_tokenizers.path(ppt.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = ppt.PieceModel.of_worker()
    same_as_library(model, library, texts)
    assert model.steady and model.apart
    for _ in range(3000):  # ids in any order, broken bytes among them
        ids = [rng.choice([0, 1, 2, 259, rng.randrange(3, 259), rng.randrange(131, 259), rng.randrange(32000)]) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == library.decode(ids), ids


@pytest.mark.parametrize("seed", range(12))
def test_pieces_equal_the_library_on_any_vocabulary(seed, tmp_path):
    """Scores in no order and with ties, parts that merge after their whole, pieces never made, and spaces inside pieces."""
    rng = random.Random(seed)
    letters = "ab▁c" if seed % 2 else "abé"
    made = {"".join(rng.choices(letters, k=rng.randrange(2, 6))) for _ in range(60)}
    pieces = [(t, -float(rng.randrange(20 if seed % 3 else 200))) for t in [*letters, *sorted(made)]]
    if seed % 4 == 0:
        pieces = [p for p in pieces if p[0] != "b"]  # a character that is inside pieces alone
    path = model_file(tmp_path / "m.model", pieces)
    texts = ["".join(rng.choices(["a", "b", " ", "c", "é", "aab", "x"], k=rng.randrange(0, 25))) for _ in range(400)]
    same_as_library(ppt.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path), texts)


def test_models_that_are_not_covered(tmp_path):
    for k, how in enumerate([{"kind": 1}, {"normalizer": ((1, "nmt_nfkc"), (2, b"xx"), (4, 0))}, {"normalizer": ((1, "identity"), (4, 1))}]):
        with pytest.raises(ValueError):
            ppt.PieceModel(model_file(tmp_path / f"{k}.model", [("a", -1.0)], **how))


def test_pieces_query_and_columns(spark, tmp_path):
    rows = documents(spark).collect()
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ppt.MODEL))
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = sorted(map(tuple, ppt.op12_piece_prefix_table(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(want, key=str)
    both = ppt.decode_ids(ppt.encode_texts(documents(spark), out="FP", bos=False), "FP").collect()
    assert [(r["FP"], r["decoded"]) for r in both] == [((i := library.encode(r["text"] or "", add_eos=True)), library.decode(i)) for r in rows]
    assert both[0]["length"] == "y" and set(both[0].asDict()) == {*documents(spark).columns, "FP", "decoded"} - {"fp"}
    some = spark.createDataFrame([([1, 300], 1), (None, 2), ([], 3)], "ids array<int>, n int")
    assert [r["decoded"] for r in ppt.decode_ids(some).collect()] == [library.decode([300]), None, ""]
    assert ppt.encode_texts(empty(spark)).collect() == []
