"""Registry of queries over the driver's tables, and the views that stand in for transcript, feed and release tables.

A view is one SELECT in SQL that both engines read; S(ts) stands for whole seconds since 1970."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()



def _chinese(text: str) -> str:
    marked = f"replace(replace(replace({text}, '@', '#'), ', the', ',, \"the\"'), '. ', '... ')"
    return f"translate({marked}, 'abcdefghijklmnopqrstuvwxyz', '的一是了我不人在他有这个上们来到时大地为子中你说生国')"


VIEWS: dict[str, str] = {
    # A conversation is a video, a turn a cue; two cues in three lose their full stop.
    "cue_base": """SELECT conv_id AS video_id, CAST(turn AS INT) + 1 AS cue_index, turn, role, text AS raw,
        CAST(500 + 40 * length(text) AS BIGINT) AS dur, CAST(1000 * ((turn * 7 + conv_id * 3) % 5) AS BIGINT) AS gap
        FROM conversations""",
    "cues": """SELECT video_id, cue_index,
        CAST(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY cue_index) AS BIGINT) - dur AS start_ms,
        CAST(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY cue_index) AS BIGINT) AS end_ms,
        CASE WHEN cue_index % 3 = 1 THEN raw ELSE regexp_replace(raw, '[.]+$', '') END AS text, role FROM cue_base""",
    "clips": """SELECT video_id, CAST(cue_index AS INT) AS para_id, greatest(start_ms - 2500, 0) AS start_ms,
        end_ms + 1500 AS end_ms, CAST((video_id * 13 + (cue_index - 1) * 7) % 100 AS INT) AS score,
        CAST((video_id * 5 + cue_index * 3) % 10 AS INT) AS ratio10, text FROM cues WHERE (cue_index - 1) % 3 = 1""",
    "bi": """SELECT video_id, CASE WHEN cue_index % 4 = 0 THEN cue_index + 1000 ELSE cue_index END AS cue_index,
        start_ms + CASE cue_index % 3 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 1500 END AS start_ms,
        concat('zh ', substring(text, 1, 12)) AS zh FROM cues""",
    "items": """SELECT event_id, concat(event_type, ':', CAST(event_id % 700 AS STRING)) AS id, event_type AS source,
        S(ts) AS publish_s, CAST(user_id AS STRING) AS author, props AS extra, CAST(floor(value * 37) AS INT) AS duration,
        CAST(event_id % 700 AS BIGINT) AS key FROM events""",
    "titles": """SELECT doc_id, source AS batch, regexp_replace(substring(text, 1, 60), '\\s+', ' ') AS title, text,
        lang FROM documents""",
    # Whole texts with small letters made Chinese characters, doubled marks, quotes and dots.
    "zh": f"""SELECT doc_id, source AS batch, {_chinese('text')} AS text FROM documents""",
    "zcues": f"""SELECT video_id, cue_index, {_chinese('text')} AS text FROM cues""",
    # Numbers in Chinese.
    "numerals": """SELECT event_id, key, duration, CASE WHEN key = 0 THEN '零' ELSE concat(
        CASE WHEN key >= 100 THEN concat(substring('零一二三四五六七八九', CAST(floor(key / 100) AS INT) + 1, 1), '百') ELSE '' END,
        CASE WHEN key % 100 = 0 THEN '' WHEN key % 100 < 10
        THEN concat(CASE WHEN key >= 100 THEN '零' ELSE '' END, substring('零一二三四五六七八九', CAST(key % 10 AS INT) + 1, 1))
        ELSE concat(CASE WHEN key < 20 THEN '' ELSE substring('零一二三四五六七八九', CAST(floor(key % 100 / 10) AS INT) + 1, 1) END, '十',
        CASE WHEN key % 10 = 0 THEN '' ELSE substring('零一二三四五六七八九', CAST(key % 10 AS INT) + 1, 1) END) END) END AS cn FROM items""",
    "urls": """SELECT page_id, url, concat(url, '/video/BV', CAST(page_id * 7919 AS STRING), 'x?from=a&Expires=',
        CAST(1700000000 + page_id * 3600 AS STRING)) AS media_url, html FROM pages""",
    "announce": """SELECT o_orderkey AS id, CAST(floor(S(o_orderdate) / 86400) AS BIGINT) AS day FROM orders""",
    "up_videos": """SELECT l_orderkey AS id, CAST(floor(S(l_shipdate) / 86400) AS BIGINT) AS day, l_linenumber AS n
        FROM lineitem""",
    "queue": """SELECT o_custkey AS slug, o_orderkey AS id, S(o_orderdate) AS batch_at, o_orderstatus AS status,
        CAST(o_orderkey % 7 AS INT) AS n FROM orders""",
    "idx": "SELECT * FROM queue WHERE slug % 5 <> 0",
    "releases": """SELECT c_custkey AS tag, CAST(c_custkey % 97 AS BIGINT) AS created_at,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey * 1000 AS BIGINT) END AS size FROM customer""",
    "faces": """SELECT l_orderkey % 50 AS video_id, l_orderkey AS frame_no, CAST(l_partkey % 1100 AS INT) AS x,
        CAST(l_suppkey % 500 AS INT) AS y, CAST(20 + l_quantity * 4 AS INT) AS w, CAST(20 + l_quantity * 3 AS INT) AS h
        FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_quantity""",
    "frames": """SELECT CAST(p_partkey % 50 AS BIGINT) AS video_id, p_partkey AS frame_no, p_size * 6 AS brightness,
        CAST(floor(p_retailprice) AS BIGINT) AS sharpness, p_brand AS person, CAST(p_size % 11 AS INT) AS cover_score,
        CAST(p_size % 13 AS INT) AS blue, CAST(p_partkey % 50 AS INT) AS gray FROM part""",
}
#: Array positions are unnested differently by the engines.
PER_ENGINE = {
    "row_profile": (
        """SELECT label AS video_id, vec_id AS frame_no, pos AS y, CAST(round(abs(CAST(e AS DOUBLE)) * 1000000) AS BIGINT)
        AS energy FROM (SELECT label, vec_id, posexplode(embedding) AS (pos, e) FROM embeddings)""",
        """SELECT label AS video_id, vec_id AS frame_no, CAST(pos - 1 AS INT) AS y,
        CAST(round(abs(CAST(e AS DOUBLE)) * 1000000) AS BIGINT) AS energy FROM
        (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    ),
}


def _names(sql: str, among) -> list[str]:
    found = set(re.findall(r"\b\w+\b", sql))
    return [n for n in among if n in found]


def _spark_sql(sql: str) -> str:
    return re.sub(r"\bS\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", sql).replace("\\", "\\\\")


def _duck_sql(sql: str) -> str:
    return re.sub(r"\bS\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql).replace("'\\s+', ' ')", "'\\s+', ' ', 'g')")


class Views:
    """Tables and views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = VIEWS.get(name) or PER_ENGINE[name][0]
                used = [n for n in _names(sql, [*TABLES, *VIEWS, *PER_ENGINE]) if n != name]
                used = [n for n in used if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
                text = _spark_sql(sql)
                for n in used:
                    text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in used})
        return self._made[name]


def _with(sql: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for n in [*VIEWS, *PER_ENGINE]:
            if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text) and n not in order:
                visit(VIEWS.get(n) or PER_ENGINE[n][1])
                if n not in order:
                    order.append(n)

    visit(sql)
    return ", ".join(f"{n} AS ({_duck_sql(VIEWS.get(n) or PER_ENGINE[n][1])})" for n in order)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register fn(views) under name; sql is its oracle over the same views, after further ctes."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            parts = [p for p in (_with(ctes + " " + sql), ctes) if p]
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + _duck_sql(sql)
        return fn

    return add


def columns(name: str, view: str, keys: str, cols: Callable[[], dict], sql: str):
    """Register a projection: keys and computed columns of a view; sql is the select list of the computed ones. cols is
    called when the query runs: columns need a session, names don't."""
    names = keys.split()
    query(name, f"SELECT {', '.join(names)}, {sql} FROM {view}")(
        lambda v: getattr(v, view).select(*names, *[c.alias(k) for k, c in cols().items()])
    )
