"""Chat formatting: records of any layout to canonical turns by schema fingerprint, and a reversible template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# ---- layouts


def field_paths(record, at: str = "") -> set[str]:
    """Nested field paths of a parsed record. Items of an array share one path, marked []."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in ({f"{at}.{k}"} | field_paths(v, f"{at}.{k}"))}
    if isinstance(record, list):
        return {p for v in record for p in field_paths(v, at + "[]")}
    return set()


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: A layout: the paths that it must have, those that it may have, and how its turns are found. `each` is the path of
#: an array whose items have `role` and `text`; else `turns` lists (role, field) in order, a role starting with = being
#: taken from that field. `order` names a field with the turn's number.
LAYOUTS: dict[str, dict] = {
    "messages": {"must": (".messages", ".messages[].role", ".messages[].content"), "each": "messages", "role": "role", "text": "content"},
    "conversations": {"must": (".conversations", ".conversations[].from", ".conversations[].value"), "each": "conversations", "role": "from", "text": "value"},
    "turn_row": {"must": (".role", ".text"), "may": (".turn",), "turns": (("=role", "text"),), "order": "turn"},
    "prompt_completion": {"must": (".prompt", ".completion"), "may": (".system",), "turns": (("system", "system"), ("user", "prompt"), ("assistant", "completion"))},
    "prompt_response": {"must": (".prompt", ".response"), "may": (".system",), "turns": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
    "instruction": {"must": (".instruction", ".output"), "may": (".input", ".system"), "turns": (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))},
    "question_answer": {"must": (".question", ".answer"), "may": (".system",), "turns": (("system", "system"), ("user", "question"), ("assistant", "answer"))},
}
#: Names of the same role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_table(layouts: dict[str, dict] = LAYOUTS, ids: tuple[str, ...] = ("conv_id",)) -> dict[str, str]:
    """Fingerprint to layout, for each choice of the paths that a layout may have and of the id fields."""
    table: dict[str, str] = {}
    for name, layout in layouts.items():
        free = [*layout.get("may", ()), *(f".{i}" for i in ids)]
        for bits in range(1 << len(free)):
            chosen = {p for k, p in enumerate(free) if bits >> k & 1}
            table[fingerprint({*layout["must"], *chosen})] = name
    return table


def turns_of(record: dict, layout: dict) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of each turn. Null roles and texts are empty; a part that is absent gives no turn."""

    def string(x) -> str:
        return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    if "each" in layout:
        pairs = [(string(m.get(layout["role"])), string(m.get(layout["text"]))) for m in record[layout["each"]] or []]
    else:
        pairs = []
        for role, field in layout["turns"]:
            first, _, second = field.partition("+")
            if first not in record:
                continue
            text = string(record[first])
            if second and string(record.get(second)):
                text += "\n\n" + string(record[second])
            pairs.append((string(record.get(role[1:])) if role[0] == "=" else role, text))
    number = record.get(layout["order"]) if "order" in layout else None
    return [(number if "order" in layout else k, ROLES.get(r, r), t) for k, (r, t) in enumerate(pairs)]


def canonical_turns(records: DataFrame, id_column: str = "conv_id", json_column: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records of any known layout, found by the hash of its field paths.

    Records that are null, no JSON object, or of an unknown layout give one row with null role and text, whose layout
    is `bad` or `unknown:` and the fingerprint. Empty message lists have no item paths and count as unknown."""
    table = layout_table()
    schema = "conv_id bigint, turn bigint, role string, text string, layout string"
    arrow = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((key, None, None, None, "bad"))
                    continue
                mark = fingerprint(field_paths(record))
                name = table.get(mark)
                if name is None:
                    rows.append((key, None, None, None, f"unknown:{mark}"))
                    continue
                rows += [(key, number, role, text, name) for number, role, text in turns_of(record, LAYOUTS[name])]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return records.select(F.col(id_column).cast("bigint"), json_column).mapInArrow(common.lean(run), schema)


# ---- the template

OPEN, CLOSE, END_OF_ROLE = "### ", "</turn>", ":\n"
_CONTROL = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    r"""text with a backslash before each control string: backslashes, ### and </turn>, in roles colons too."""
    return _CONTROL.sub(lambda m: m[0] if m[0] == ":" and not role else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    """One turn of the output. Turns need no context: a conversation's output is that of its turns, one after another."""
    return f"{OPEN}{escape(role, True)}{END_OF_ROLE}{escape(text)}{CLOSE}\n"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an output. A remainder that is no turn is an error."""
    out, at = [], 0
    for m in iter(lambda: _TURN.match(formatted, at), None):
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with `formatted` and `loss_start`, `loss_end`: the part of it, if any, that is
    under the loss mask, which is an assistant's text. Null roles and texts count as empty."""

    def start():
        def work(rows: list) -> dict:
            formatted, starts, ends = [], [], []
            for r in rows:
                role, text = r["role"] or "", r["text"] or ""
                out = format_turn(role, text)
                formatted.append(out)
                end = len(out) - len(CLOSE) - 1
                mask = role == "assistant"
                starts.append(end - len(escape(text)) if mask else None)
                ends.append(end if mask else None)
            return {"formatted": formatted, "loss_start": starts, "loss_end": ends}

        return work

    pair = common.hidden_name(turns, "pair")
    both = turns.withColumn(pair, F.struct("role", "text"))
    out = common.add_by_text(both, start, pair, "formatted string, loss_start bigint, loss_end bigint")
    return out.drop(pair)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests by conversation, read from format_turns() output alone.

    Rows are dealt by conv_id and sorted by turn; a conversation streams through, turn by turn, and is never held
    whole, so that one of any length takes no more memory. A digest over all its turns in order is one task's work by
    its nature. Null turns come first; equal turn numbers follow role and text."""
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    arrow = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, out, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        close()
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(out):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    loss = unescape(out[lo:hi])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(out)
            if len(done) >= 4096:
                yield flush()
        if state is not None:
            close()
            yield flush()

    sorted_ = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(common.lean(run), schema)


def op3_chat_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted output. A record of an unknown layout is an error."""
    rows = common.table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.to_json(F.struct(F.lit(-7).alias("conv_id"), F.lit(said).alias("instruction"), F.lit(said).alias("output"))).alias("record"),
    )
    records = rows.select("conv_id", record.alias("record")).unionByName(extra)
    known = F.when(F.col("role").isNull(), F.raise_error(F.concat(F.lit("no mapping for a record: "), "layout"))).otherwise(F.col("role"))
    turns = canonical_turns(records).select("conv_id", "turn", known.alias("role"), "text")
    return read_back(format_turns(turns))


_ESCAPES = r"len(regexp_extract_all({0}, '\\|###|</turn>{1}'))"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(END_OF_ROLE) + len(CLOSE) + 1} + length(role) + length(text)
    + {_ESCAPES.format("role", "|:")} + {_ESCAPES.format("text", "")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
