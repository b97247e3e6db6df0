"""SentencePiece BPE without a merge queue: a table of each prefix's last piece, found by an automaton and a test of pairs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # stands for a space in pieces
#: Stretches of text that a worker keeps with their ids, the longest of them in characters, and bytes of texts done at once.
REMEMBERED, LONGEST, RUN = 1 << 18, 48, 4 << 20
# The model file's kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields; fixed-size values as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A BPE model of SentencePiece with byte fallback: its pieces, the merges each is made by, and the automaton over them.

    Text becomes the pieces that merging makes of its characters: of all neighbours whose union is a piece, those of the best
    score are merged first, the leftmost of equal ones. A sequence of pieces is a text's encoding just if each piece encodes as
    itself and each two neighbours encode as these two, since what happens inside a piece does not hang on what is beside it
    until a merge crosses its edge. So each prefix of a text has one last piece: that which ends there and goes with the last piece
    of the prefix before it."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as file:
            top = list(_fields(file.read()))
        trainer, normalizer = (dict(_fields(next((v for n, v in top if n == k), b""))) for k in (2, 3))
        if trainer.get(3, 1) != BPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError(f"{path}: not a BPE model that leaves text as it is, with a space before it")
        parts = [dict(_fields(v)) for n, v in top if n == 1]
        self.pieces = [p[1].decode() for p in parts]
        kinds = [p.get(3, NORMAL) for p in parts]
        if not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
            raise ValueError(f"{path}: pieces of the user's own, unused pieces, or no bytes")
        self.byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.bos, self.eos = (self.pieces.index(t.decode()) for t in (trainer.get(46, b"<s>"), trainer.get(47, b"</s>")))
        known = {self.pieces[i]: i for i, k in enumerate(kinds) if k == NORMAL}
        scores = {t: struct.unpack("<f", parts[i].get(2, b"\0\0\0\0"))[0] for t, i in known.items()}
        places = {s: r for r, s in enumerate(sorted({*scores.values()}, reverse=True))}
        self.rank = {t: places[s] for t, s in scores.items()}  # smaller merges first
        # Characters inside pieces that are no pieces themselves can be merged, but go out as bytes.
        self.alphabet = {c for t in known for c in t}
        inner = sorted(self.alphabet - known.keys())
        self.text = [*self.pieces, *inner]
        self.known = known | {c: len(self.pieces) + k for k, c in enumerate(inner)}
        # Spans of each piece: the left and right parts of its last merge; pieces that merging never makes are out.
        self.left, self.right = {}, {}
        self.steady = True  # whether parts always merge before their whole
        for t, i in list(self.known.items()):
            if len(t) > 1:
                symbols, last = self._merged(t)
                if symbols != [t]:
                    del self.known[t]
                    continue
                self.left[i], self.right[i] = last
                self.steady &= all(self.rank[p] <= self.rank[t] for p in last if len(p) > 1)
        self.left = {i: self.known[p] for i, p in self.left.items()}
        self.right = {i: self.known[p] for i, p in self.right.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.known.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by the first piece's id times the number of pieces, plus the second's
        self.out = {i: self._bytes(c) for c, i in self.known.items() if i >= len(self.pieces)}
        # A text falls apart before a space that follows anything else, if no piece goes on across it; and at ASCII characters of no piece.
        self.apart = not any(SPACE in t[1:] and t.strip(SPACE) and SPACE in t.lstrip(SPACE) for t in self.known)
        self.barrier = np.array([b < 128 and b != 32 and chr(b) not in self.alphabet for b in range(256)])
        self.kept: dict[str, bytes] = {}
        # For decoding: each id's bytes side by side.
        surface = trainer.get(44, " ⁇ ".encode())
        made = {NORMAL: lambda i: self.pieces[i].replace(SPACE, " ").encode(), UNKNOWN: lambda i: surface, CONTROL: lambda i: b"", BYTE: lambda i: bytes([int(self.pieces[i][1:-1], 16)])}
        self.kinds, self.surface = np.array(kinds), pa.array([made[k](i) for i, k in enumerate(kinds)], pa.large_binary())

    _OF_WORKER: dict[str, PieceModel] = {}

    @classmethod
    def of_worker(cls, name: str = MODEL) -> PieceModel:
        """One that all tasks of a Python worker share, with what it has met."""
        if name not in cls._OF_WORKER:
            if "/" not in name:
                import public_tokenizers

            cls._OF_WORKER[name] = cls(name if "/" in name else public_tokenizers.path(name))
        return cls._OF_WORKER[name]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The symbols that merging makes of a short text, and its last merge: the rule as it stands."""
        symbols, last = list(text), None
        while True:
            ranks = [(self.rank.get(a + b, len(self.rank)), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
            best, k = min(ranks, default=(len(self.rank), 0))
            if best == len(self.rank):
                return symbols, last
            last = symbols[k], symbols[k + 1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def goes_with(self, a: int, b: int) -> bool:
        """Whether piece a followed by piece b is what merging makes of their text; kept in `pairs`."""
        if len(self.pairs) >= 1 << 20:
            self.pairs.clear()
        found = self._apart(a, b) if self.steady else self._merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        self.pairs[a * len(self.text) + b] = found
        return found

    def _apart(self, a: int, b: int) -> bool:
        """goes_with(), where parts merge before their whole: both pieces are taken apart along the edge between them, what
        merged last first. Two symbols x, y that stood side by side would have merged if their union comes before the merges that
        took x (further left: it wins a tie) and y."""
        never = len(self.rank) + 1
        x, y, took_x, took_y = a, b, never, never
        while True:
            union = self.rank.get(self.text[x] + self.text[y], never)
            if union < took_x and union <= took_y and union != never:
                return False
            of_x, of_y = (self.rank[self.text[p]] if p in self.left else -1 for p in (x, y))
            if of_x < 0 and of_y < 0:
                return True
            if of_y >= of_x:
                took_y, y = of_y, self.left[y]
            else:
                took_x, x = of_x, self.right[x]

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a text in which spaces are SPACE already, by its prefix table."""
        last = [-1] * len(text)  # of the prefix that ends with each character, the last piece; -1: a character of no piece
        filled, met, n = -1, self.pairs.get, len(self.text)
        for end, (piece, size) in self.automaton.iter(text):  # longer ones first
            if end == filled:
                continue
            before = last[end - size] if end >= size else -1
            if before >= 0:
                good = met(before * n + piece)
                if good is None:
                    good = self.goes_with(before, piece)
                if not good:
                    continue
            last[end], filled = piece, end
        out, at = [], len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece < 0:
                out += reversed(self._bytes(text[at]))
                at -= 1
            else:
                if piece in self.out:
                    out += reversed(self.out[piece])
                else:
                    out.append(piece)
                at -= len(self.text[piece])
        out.reverse()
        return out

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(edges, stretches): text k is made of stretches edges[k] to edges[k + 1], which encode by themselves."""
        import pyarrow.compute as pc

        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: edges[-1]] if raw else np.zeros(0, np.uint8)
        start = np.zeros(len(data) + 1, bool)
        if self.apart:
            space, bar = data == 32, self.barrier[data]
            start[1:-1] = (space[1:] & ~space[:-1]) | bar[1:] | bar[:-1]
        start[edges] = True
        at = np.flatnonzero(start)
        stretches = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)) if len(data) else pa.array([], pa.large_string())
        return np.searchsorted(at, edges), stretches

    def encode(self, texts: pa.Array, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): text k has ids[edges[k] : edges[k + 1]]; null is empty."""
        edges, stretches = self._stretches(texts)
        coded = stretches.dictionary_encode()
        own = []
        for t in coded.dictionary.to_pylist():
            ids = self.kept.get(t)
            if ids is None:
                ids = np.array(self.encode_stretch(t.replace(" ", SPACE)), "<u4").tobytes()
                if len(t) <= LONGEST:
                    if len(self.kept) >= REMEMBERED:
                        self.kept.clear()
                    self.kept[t] = ids
            own.append(ids)
        taken = pa.array(own, pa.large_binary()).take(coded.indices)
        raw = taken.buffers()[2]
        body = np.frombuffer(raw, "<u4") if raw else np.zeros(0, "<u4")
        at = np.frombuffer(taken.buffers()[1], np.int64)[edges] // 4 if len(taken) else np.zeros(len(edges), np.int64)
        size = np.diff(at)
        out_edges = np.concatenate([[0], np.cumsum(size + bos + eos)])
        ids = np.empty(out_edges[-1], "<u4")
        ids[np.repeat(out_edges[:-1] + bos - at[:-1], size) + np.arange(at[-1])] = body[: at[-1]]
        if bos:
            ids[out_edges[:-1]] = self.bos
        if eos:
            ids[out_edges[1:] - 1] = self.eos
        return ids, out_edges

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The texts of sequences of ids, in UTF-8. Control ids are nothing, bytes that are no UTF-8 each a U+FFFD, and the
        first piece loses the space before the text."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.kinds)):
            raise ValueError("ids beyond the vocabulary")
        taken = self.surface.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(taken.buffers()[1], np.int64)[edges] if len(ids) else np.zeros(len(edges), np.int64)
        raw = memoryview(taken.buffers()[2] or b"")
        kinds = self.kinds[ids]
        spoken = np.flatnonzero(kinds != CONTROL)
        lo, hi = np.searchsorted(spoken, edges[:-1]), np.searchsorted(spoken, edges[1:])
        out = []
        for k in range(len(edges) - 1):
            if lo[k] == hi[k]:
                out.append(b"")
                continue
            text = bytes(raw[at[k] : at[k + 1]])
            first, last = spoken[lo[k]], spoken[hi[k] - 1]
            whole = last - first + 1 == hi[k] - lo[k]  # no control id between others
            if not (whole and (text.isascii() or _is_utf8(text))):
                text = self._decode_slowly(ids[first : last + 1], kinds[first : last + 1])
            strip = kinds[first] == NORMAL and self.pieces[ids[first]].startswith(SPACE)
            out.append(text[1:] if strip else text)
        return out

    def _decode_slowly(self, ids: np.ndarray, kinds: np.ndarray) -> bytes:
        """Runs of bytes by themselves, one after another."""
        out, run = [], b""
        for i, kind in zip([*ids.tolist(), -1], [*kinds.tolist(), NORMAL], strict=True):
            if kind == BYTE:
                run += self.surface[i].as_py()
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if _is_utf8(run[:n])), 0)
                out.append(run[:n] if n else "�".encode())
                run = run[n or 1 :]
            if i >= 0:
                out.append(self.surface[i].as_py())
        return b"".join(out)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, fn) -> DataFrame:
    """df with a column made by fn(array) of a source column, batch by batch; it takes the place of one of its name."""
    kept = [f for f in df.schema if f.name.lower() != name.lower()]
    out = T.StructType([*kept, T.StructField(name, kind)])
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, whole.num_columns - 1, RUN)):
            columns = [*batch.columns[:-1], fn(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias(common.hidden_name(df, "in"))).mapInArrow(common.lean(run), out)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL, bos: bool = True, eos: bool = True, packed: bool = False) -> DataFrame:
    """df with the ids of whole texts: array<int>, or if packed a binary of little-endian unsigned 32-bit numbers.

    Null and empty texts are the begin and end ids alone. A text is taken apart where no piece can cross, before spaces and at
    characters of no piece; each distinct stretch is encoded once a batch, short ones once a worker. A stretch of any length
    takes time and memory in proportion to it. A column named as `out` gives way."""

    def fn(texts: pa.Array) -> pa.Array:
        ids, edges = PieceModel.of_worker(model).encode(texts, bos, eos)
        if packed:
            offsets = pa.py_buffer((4 * edges).astype(np.int32))
            return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(ids)])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))

    return _with_column(df, text, out, T.BinaryType() if packed else T.ArrayType(T.IntegerType()), fn)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text of ids, array<int> or packed; null for null. Ids beyond the vocabulary, or null ones, are an error. A column named
    as `out` gives way."""

    def fn(column: pa.Array) -> pa.Array:
        null = column.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_binary(column.type):
            size = np.where(null, 0, pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)) // 4
            flat = np.frombuffer(b"".join(x.as_py() for x in column if x.is_valid), "<u4").astype(np.int64)
        else:
            size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("null ids")
            flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        texts = PieceModel.of_worker(model).decode(flat, edges)
        return pa.array([None if n else t for n, t in zip(null, texts, strict=True)], pa.binary()).cast(pa.string())

    return _with_column(df, ids, out, T.StringType(), fn)


def op12_piece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; see encode_texts() and decode_ids()."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_ids(encode_texts(docs, packed=True).drop("text"))
    return both.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
