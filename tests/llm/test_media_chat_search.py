import collections
import hashlib
import json
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from cuemill.llm import chat_schema, license_scan, topk_nra, webp_lossless as webp

from . import vp8l_writer
from .helpers import DOCS, LONG, documents, empty

W, H = 37, 23


def pixels(kind, w=W, h=H):
    rng = random.Random(kind)
    if kind == "noise":
        return [[rng.randrange(256) for _ in range(4)] for _ in range(w * h)]
    if kind == "smooth":
        return [[255, (3 * x + y) & 255, (x * y // 9) & 255, (200 - 2 * x) & 255] for y in range(h) for x in range(w)]
    if kind == "flat":
        return [[255, 9, 9, 9]] * (w * h)
    few = [[rng.randrange(256) for _ in range(4)] for _ in range(int(kind))]
    return [few[(x // 5 + y // 3 + (rng.random() < 0.1)) % len(few)] for y in range(h) for x in range(w)]


TILES = -(-W >> 3) * -(-H >> 3)
MODES = [k % 14 for k in range(TILES)]
FACTORS = [((k * 37) & 255, (k * 91) & 255, (k * 13) & 255) for k in range(TILES)]


@pytest.mark.parametrize("kind", ["noise", "smooth", "flat", "2", "4", "11", "40"])
@pytest.mark.parametrize(
    "transforms, how",
    [
        ((), {}),
        ((("predictor", 3, MODES),), {}),
        ((("cross", 3, FACTORS),), {}),
        ((("predictor", 3, MODES), ("cross", 3, FACTORS), ("green",)), {"cache_bits": 6, "copies": True}),
        ((("palette",),), {"copies": True}),
        ((), {"cache_bits": 3, "copies": True, "groups": (3, [k % 3 for k in range(TILES)])}),
    ],
)
def test_reads_every_feature(kind, transforms, how):
    p = pixels(kind)
    if transforms == (("palette",),) and len({tuple(x) for x in p}) > 256:
        return
    image = webp.Image(vp8l_writer.write(p, W, transforms, **how))
    assert (image.width, image.height) == (W, H)
    assert image.argb().reshape(-1, 4).tolist() == p


def test_writes_and_reads_bytes_side_by_side():
    rng = np.random.default_rng(1)
    raw = [webp.padded(x) for x in (b"", b"a", b"\0" * 100, LONG.encode(), bytes(range(256)) * 3)]
    raw += [webp.padded(rng.integers(0, 256, int(n), dtype=np.uint8).tobytes()) for n in rng.integers(1, 5000, 40)]
    raw += [webp.padded(b"ab" * int(n)) for n in rng.integers(1, 3000, 40)]
    media = [webp.write_gray(r) for r in raw]
    got = webp.read_images([*media, None, b"RIFFnothing", media[3][:60]])
    assert [g[3] for g in got[: len(raw)]] == raw and got[len(raw) :] == [None] * 3
    for m, r in list(zip(media, raw, strict=True))[:8]:  # and one by one, by the general reader
        assert (webp.Image(m).argb()[..., 1].astype(np.uint8).tobytes()) == r


def test_compact_ways_of_writing():
    rng = np.random.default_rng(2)
    words = [b"spam line %d\n" % k for k in range(5)]
    cases = [
        b"the same line again\n" * 700, b"".join(words[int(k)] for k in rng.integers(0, 5, 3000)), b"ab" * 3000, b"0123456789abcdef" * 9, bytes(rng.integers(0, 4, 5000, dtype=np.uint8)),
        b"x" * 100_000 + bytes(rng.integers(0, 256, 500, dtype=np.uint8)) + b"x" * 100_000, b"abcdefgh" * 2 + b"tail",
    ]
    for case in map(webp.padded, cases):
        for palette in (False, True) if len(set(case)) <= 16 else (False,):
            argb = webp.Image(webp.write_compact(case, palette)).argb()
            assert argb[..., 1].astype(np.uint8).tobytes() == case
            assert (argb[..., 0] == 255).all() and (argb[..., 1:2] == argb[..., 1:]).all()
        kind, length, distance = webp.copies_of(case)
        back = bytearray()
        for k, n, d in zip(kind, length, distance, strict=True):
            for _ in range(n):
                back.append(k if k >= 0 else back[-d])
        assert bytes(back) == case
        media = webp.write_payload(case)
        assert webp.read_payloads([media]) == [case] and len(media) <= len(webp.write_gray(case))
    assert len(webp.write_payload(webp.padded(cases[0]))) < len(webp.write_gray(webp.padded(cases[0]))) / 20
    symbol, more, extra = webp._prefixed(np.arange(1, 5000))
    assert [webp._extended(int(s), webp.BitReader(int(e).to_bytes(4, "little"))) for s, e in zip(symbol, extra, strict=True)] == list(range(1, 5000))
    assert (more[:4] == 0).all() and more.max() == 11


def test_long_payloads_take_several_images():
    rng = np.random.default_rng(3)
    long = webp.padded(rng.integers(0, 90, 2 * webp.PART + 100, dtype=np.uint8).tobytes())
    media = webp.write_payload(long)
    assert [webp.Image(x).width * webp.Image(x).height for x in webp.images_of(media)] == [webp.PART, webp.PART, 128]
    assert webp.read_payloads([media, None, media[:-5], b"RIFF", b"", media]) == [long, None, None, None, None, long]


def test_media_columns(spark):
    docs = documents(spark)
    out = {(r["doc_id"], r["payload_sha256"]): r for r in webp.digest_round_trip(docs.select("doc_id", "text")).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        got = out[r["doc_id"], hashlib.sha256(full).hexdigest()]
        assert (got["n_bytes"], got["payload_bytes"], got["tail_crc32"]) == (len(raw), len(full), zlib.crc32(full[-64:]))
        media = webp.write_payload(full)
        assert (got["media_bytes"], got["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        share = [n / len(full) for n in collections.Counter(full).values()]
        mean, step = sum(full) / len(full), sum(abs(a - b) for a, b in zip(full, full[1:])) / (len(full) - 1)
        told = dict(x.split("=") for x in got["feature"].split(";"))
        assert [float(told[k]) for k in ("mean", "bits", "step")] == pytest.approx([mean, -sum(x * math.log2(x) for x in share), step], abs=6e-5)
    back = webp.read_texts(webp.store_texts(docs.select("doc_id", "text"))).select("n_bytes", "payload").collect()
    assert sorted(bytes(r["payload"])[: r["n_bytes"]] for r in back) == sorted((r["text"] or "").encode() for r in docs.collect())
    read = webp.read_media(webp.store_texts(docs))
    assert read.count() == 12 and read.where("samples is null").count() == 0
    assert webp.read_media(webp.store_texts(empty(spark))).count() == 0


def test_template_is_reversible():
    rng = random.Random(5)
    parts = ["\\", "###", "</turn>", "\\</turn>", ":", "\n", "#", "<", "ok", "### assistant:\n", "é🙂", ""]
    for _ in range(400):
        turns = [("".join(rng.choices(parts, k=2)), "".join(rng.choices(parts, k=rng.randrange(8)))) for _ in range(3)]
        assert chat_schema.parse_turns("".join(chat_schema.format_turn(*t) for t in turns)) == turns
    with pytest.raises(ValueError):
        chat_schema.parse_turns("### user:\nx")


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "conv_id": 1},
        {"instruction": "a", "input": "i", "output": "b"},
        {"instruction": "a", "input": "", "output": "b", "system": "s"},
        {"prompt": "a", "completion": "b"},
        {"question": "a", "answer": 5},
        {"role": "user", "text": None, "turn": 3, "conv_id": 6},
        {"strange": 1},
        [1],
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, None), (None, "{bad")]
    got = chat_schema.canonical_turns(spark.createDataFrame(rows, "conv_id bigint, record string")).collect()
    turns = {}
    for r in got:
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert sorted(turns[0]) == [(0, "user", "a"), (1, "assistant", "")]
    assert sorted(turns[1]) == [(0, "user", "a"), (1, "assistant", "b")]
    assert sorted(turns[2]) == [(0, "user", "a\n\ni"), (1, "assistant", "b")]
    assert sorted(turns[3]) == [(0, "system", "s"), (1, "user", "a"), (2, "assistant", "b")]
    assert sorted(turns[5]) == [(0, "user", "a"), (1, "assistant", "5")]
    assert turns[6] == [(3, "user", "")]
    assert [r["layout"][:7] for r in got if r["role"] is None] == ["unknown", "bad", "bad", "bad"]


def test_chat_digests(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\ </turn>"), (1, None, "system", None), (2, 0, None, ""), (1, 2, "assistant", LONG), (None, 0, "user", "x")]
    rows += [(3, 0, "user", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_schema.op3_chat_schema_fingerprint(spark, str(tmp_path)).collect()}
    own = [("system", ""), ("user", "hi"), ("assistant", "a\\ </turn>"), ("assistant", LONG)]
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == digest(own)
    loss = "a\\ </turn>" + LONG
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    said = r"\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == digest([("user", said), ("assistant", said)]) and got[-7]["loss_chars"] == len(said)
    assert got[3]["n_turns"] == 3 and got[2]["turns_sha256"] == digest([("", "")]) and None in got


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).round(1)
    v[100:250] = v[100]  # many equal vectors
    rows = [(i, v[i].tolist()) for i in range(400)] + [(None, [1.0] * 8), (1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, []), (1004, [float("inf")] * 8)]
    rows += [(50, v[50].tolist())]  # a repeated row
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    clash = df.select("vec_id", topk_nra.whole_components().alias("v"), F.lit(1).alias("rank"), F.lit("x").alias("score"))
    for block, query_bytes in ((64, 240), (4096, 1 << 20), (7, 1 << 20)):
        out = topk_nra.top_k(clash, block=block, query_bytes=query_bytes)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
        check_top(got, v)
    assert topk_nra.top_k(df.where("vec_id < 0").select("vec_id", topk_nra.whole_components().alias("v"))).count() == 0


def check_top(got, v):
    whole = np.floor(256 * v.astype(np.float32).astype(float))
    want = {}
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        want |= {(q, k + 1): (int(i), int(score[i])) for k, i in enumerate(order)}
    assert got == want


def test_cells_of_ids_with_several_vectors(spark):
    """Ids that repeat with other vectors and lengths, over one cell and many: the k best rows of all of an id's vectors."""
    rng = np.random.default_rng(9)
    rows = {(int(i) % 130, tuple(rng.integers(-3, 4, 3 + int(i) % 2 * 2).tolist())) for i in range(600)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, v array<double>")
    want = []
    for q in (0, 50, 100):
        found = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in rows if i == q for j, y in rows if j != q and len(x) == len(y)]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:5])]
    for block, query_bytes in ((4, 100), (16, 300), (4096, 1 << 20)):
        assert sorted(map(tuple, topk_nra.top_k(df, block=block, query_bytes=query_bytes).collect())) == sorted(want)


def test_bars_leave_out_what_cannot_reach_them():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(3000, 16)))
    q, ids = v[:40], np.arange(3000)
    score = q @ v.T
    score[np.arange(40), np.arange(40)] = -np.inf
    best = np.sort(score, axis=1)[:, -5]
    for bar in (None, best - 1, best, best + 1):
        got = topk_nra.nra_top(q, ids[:40], v, ids, 5, 16, bar)
        want = {(i, int(j), int(score[i, j])) for i in range(40) for j in np.lexsort((ids, -score[i]))[:5] if bar is None or score[i, j] >= bar[i]}
        assert set(got) == want


def test_licences_of_files_and_directories(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("/a/LICENSE", f"{mit}\n"), ("/a/x.py", "code"), ("/a/b/y.py", f"# {apache}\n" + "word " * 100), ("/a/b/c/z.py", None),
        ("/a/d/COPYING", apache), ("/a/d/e/w.py", ""), ("/q/r.py", "license to kill " * 30), (None, mit), ("/a/x.py", "code"),
    ]
    out = license_scan.scan_licences(spark.createDataFrame(files, "path string, text string"))
    got = {r["path"]: (r["licence"], r["origin"], r["from_dir"]) for r in out.collect()}
    assert got == {
        "/a/LICENSE": ("MIT", "own", None), "/a/x.py": ("MIT", "inherited", "/a"), "/a/b/y.py": ("Apache-2.0", "own", None),
        "/a/b/c/z.py": ("MIT", "inherited", "/a"), "/a/d/COPYING": ("Apache-2.0", "own", None),
        "/a/d/e/w.py": ("Apache-2.0", "inherited", "/a/d"), "/q/r.py": (None, None, None),
    }


def test_wrapped_headers_and_full_licence_texts(spark):
    head = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    comment = lambda t, mark: "".join(f"{mark} {x}\n" for x in t.split("\n"))
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + license_scan.LONG[0][1].replace(", ", ",\n")
    files = [
        ("/g/two.py", comment(head.format(2), "#") + "\n" + "x = 1\n" * 300), ("/g/three.c", "/*\n" + comment(head.format(3), " *") + " */\n" + "int x;\n" * 300),
        ("/g/wrap.py", "# This work is licensed under the GNU General\n# Public License,\n# version 3.\n" + "y = 2\n" * 300),
        ("/m/LICENSE", mit), ("/m/a.py", "code"),
    ]
    want = {"/g/two.py": "GPL-2.0", "/g/three.c": "GPL-3.0", "/g/wrap.py": "GPL-3.0", "/m/LICENSE": "MIT", "/m/a.py": "MIT"}
    for f in license_scan.FOLDER.glob("*.txt"):
        files += [(f"/{f.stem}/COPYING", "Some Project\n\n" + f.read_text()), (f"/{f.stem}/src/x.py", "code")]
        want |= {f"/{f.stem}/COPYING": f.stem, f"/{f.stem}/src/x.py": f.stem}
    out = license_scan.scan_licences(spark.createDataFrame(files, "path string, text string"))
    assert {r["path"]: r["licence"] for r in out.collect()} == want


def test_licence_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(license_scan.ORACLE).fetchall()
    names = [d[0] for d in con.sql(license_scan.ORACLE).description]
    got = license_scan.op10_license_scan(spark, folder).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert license_scan.scan_licences(spark.createDataFrame([], DOCS).selectExpr("text AS path", "text")).count() == 0
