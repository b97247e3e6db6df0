"""LM scoring: a causal self-attention model on subword ids, beside a smoothed word base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .packing_hist import TOKENIZER, WordEncoder, words_of

#: Targets of a window; a window sees as many ids before them. Width of the model. Classes of ids.
STEP, WIDTH, CLASSES = 16, 16, 64
#: Ids with rows of their own in the model; the rest share one. One id more stands for the start.
IDS = 2048
#: All training documents train the attention weights, in so many rounds, after each of which copies that were trained side
#: by side are averaged, in so many parts.
ROUNDS, SUMS = 2, 8
#: Ids that a copy is trained on, at least.
LEAST_IDS = 1 << 16
#: Frequent words whose counts every task holds, and one in how many training documents they are looked for in, which
#: bears on speed alone. All others go by shuffles, however many there are.
FREQUENT, FREQUENT_RATE = 32768, 64
#: Parts that words are dealt into, at least.
PARTS = 192
VOCABULARY = 49408
#: Windows that are worked out at once.
AT_ONCE = 192
#: Inputs whose logits are worked out at once.
ROWS_AT_ONCE = 768
#: Rows that occur more often in a batch are summed one by one, which bears on speed alone.
MANY = 24


# ---- the model


#: (STEP, 2 * STEP): how far back each key of a window is from each query, and whether it comes no later.
BACK = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)
SEEN, BACK = (BACK >= 0).astype(np.float32), np.clip(BACK, 0, 2 * STEP - 1)
ONES, ROWS = np.ones(2 * max(STEP, CLASSES), np.float32), np.arange(ROWS_AT_ONCE)
#: Columns of the table of rows: queries, keys, values and a column of ones beside them, and what passes by attention.
COLUMNS = {"q": slice(0, WIDTH), "k": slice(WIDTH, 2 * WIDTH), "v1": slice(2 * WIDTH, 3 * WIDTH + 1), "e": slice(3 * WIDTH + 1, 4 * WIDTH + 1)}


@dataclass
class AttentionModel:
    """One head. place: row of each id; kind: class of each id; inside: log10 share of each id in its class. p["q"], "k",
    "v1" and "e" become views of one table, so that an input's row is fetched once. follow, if given, holds what the row before
    tells: what it adds to the logits of classes, and a row's log10 share in its class after it, in place of its share there."""

    place: np.ndarray
    kind: np.ndarray
    inside: np.ndarray
    p: dict[str, np.ndarray]
    follow: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        self.table, self.p = _one_table(self.p)
        self.rooms = _Rooms()

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the inputs, (n + 1, STEP), and the targets and owners of windows, (n, STEP), owner -1 for none.

        A text is preceded by a block of starts; its targets are cut every STEP ids. Each window's keys are its own
        block of inputs and the one before, so windows overlap by a block and each id is a target once."""
        blocks = [1 + -(-len(t) // STEP) for t in texts]
        total = sum(blocks) * STEP
        target = np.full(total, -1, np.int64)
        own = np.full(total, -1, np.int32)
        source = np.full(total + 1, IDS + 1, np.int32)
        at = 0
        for k, (t, b) in enumerate(zip(texts, blocks, strict=True)):
            lo = at + STEP
            target[lo : lo + len(t)] = t
            own[lo : lo + len(t)] = k
            source[lo + 1 : lo + 1 + len(t)] = self.place[t]
            source[lo] = source[at] = IDS + 1
            at += b * STEP
        return source[:-1].reshape(-1, STEP), target.reshape(-1, STEP), own.reshape(-1, STEP)

    def forward(self, inputs: np.ndarray, near: np.ndarray) -> Forward:
        """What attention makes of all windows but the first block's, from inputs (n + 1, STEP). near: causal_weights(). Everything
        lies in room that the next call takes again."""
        n, room = len(inputs) - 1, self.rooms
        flat = inputs.ravel()
        rows = self.table.take(flat, axis=0, out=room("rows", len(flat), self.table.shape[1]), mode="clip")
        q = rows[STEP:, COLUMNS["q"]].reshape(n, STEP, WIDTH)
        kw, vw = _overlapping(rows, COLUMNS["k"]), _overlapping(rows, COLUMNS["v1"])
        turned = room("turned", n, WIDTH + 1, 2 * STEP)  # products of many small matrices are faster without transposed ones
        turned[:, :WIDTH] = kw.transpose(0, 2, 1)
        w = np.matmul(q, turned[:, :WIDTH], out=room("w", n, STEP, 2 * STEP))
        np.exp(np.clip(w, -20, 20, out=w), out=w)
        w *= near
        flat_w = w.reshape(n * STEP, 2 * STEP)
        flat_w *= (1 / (flat_w @ ONES[: 2 * STEP]))[:, None]  # the shares that attention gives
        mixed = np.matmul(w, vw[..., :WIDTH], out=room("mixed", n, STEP, WIDTH)).reshape(n * STEP, WIDTH)
        h = room("h", n * STEP, WIDTH + 1)
        np.add(mixed, rows[STEP:, COLUMNS["e"]], out=h[:, :WIDTH])
        h[:, WIDTH] = 1
        return Forward(h, mixed, w, q, kw, vw)

    def last(self) -> np.ndarray:
        """The last layer, with its bias below."""
        return np.concatenate([self.p["c"], self.p["b"][None]])

    def classes(self, h: np.ndarray, rows: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class logits of inputs' rows, of which forward() made h; exp of these, and its sums. Logits whose exp is too large or
        too small are first lowered by the largest of their row."""
        logits = np.matmul(h, last, out=self.rooms("logits", len(h), CLASSES))
        out = self.rooms("exp", len(h), CLASSES)
        if self.follow is not None:
            logits += self.follow[0].take(rows, axis=0, out=out, mode="clip")
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.exp(logits, out=out) @ ONES[:CLASSES]
        if not (total.min() > 1e-30 and total.max() < 1e30):
            logits -= logits.max(axis=1, keepdims=True)
            total = np.exp(logits, out=out) @ ONES[:CLASSES]
        return logits, out, total

    def log10_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each array of ids. Texts go through in runs of bounded size."""
        out = np.zeros(len(texts))
        start, near, last = 0, causal_weights(self.p["near"]), self.last()
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < 1 << 15):
                size += len(texts[stop])
                stop += 1
            inputs, target, own = self.windows(texts[start:stop])
            for at in range(0, len(inputs) - 1, AT_ONCE):  # what fits the cache; windows overlap, so cuts are free
                part = inputs[at : at + AT_ONCE + 1]
                if len(part) < 2:
                    break
                h, flat = self.forward(part, near).h, part[1:].ravel()
                goal = target[at + 1 : at + len(part)].ravel()
                owner = own[at + 1 : at + len(part)].ravel()
                kind, chance = self.kind[goal], np.empty(len(h))
                for lo in range(0, len(h), ROWS_AT_ONCE):
                    some = slice(lo, lo + ROWS_AT_ONCE)
                    logits, _, total = self.classes(h[some], flat[some], last)
                    chance[some] = logits[ROWS[: len(total)], kind[some]] - np.log(total)
                score = chance / np.log(10) + self.inside[goal]
                if self.follow is not None:
                    score += self.follow[1].ravel()[flat * self.follow[1].shape[1] + self.place[goal]]
                valid = owner >= 0
                owner, score = owner[valid], score[valid]
                out[start:stop] += np.bincount(owner, score, stop - start)
            start = stop
        return out


class Forward(NamedTuple):
    """What AttentionModel.forward() works out: h has a column of ones at its end, w are shares, kw and vw keys and values of
    windows."""

    h: np.ndarray
    mixed: np.ndarray
    w: np.ndarray
    q: np.ndarray
    kw: np.ndarray
    vw: np.ndarray


class _Rooms:
    """Arrays by name that are written again and again: the system hands out pages for new ones each time."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, *shape: int) -> np.ndarray:
        """(n, *shape) numbers, with what was last written there."""
        if name not in self.kept or len(self.kept[name]) < n:
            self.kept[name] = np.zeros((n, *shape), np.float32)
        return self.kept[name][:n]


def _one_table(p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The arrays of COLUMNS side by side, and p with views of that table in their place."""
    table = np.concatenate([p[k] for k in COLUMNS], axis=1, dtype=np.float32)
    return table, {k: table[:, COLUMNS[k]] if k in COLUMNS else v for k, v in p.items()}


def _overlapping(rows: np.ndarray, columns: slice) -> np.ndarray:
    """Columns of contiguous rows (n * STEP + STEP, any) by window, (n, 2 * STEP, width): its own block of rows and the one
    before, without copies."""
    line, size = rows.strides
    return np.ndarray((len(rows) // STEP - 1, 2 * STEP, columns.stop - columns.start), rows.dtype, rows, columns.start * size, (STEP * line, line, size))


def causal_weights(near: np.ndarray) -> np.ndarray:
    """(STEP, 2 * STEP): exp of the bias of each distance back, zero for keys after the query."""
    return np.exp(near)[BACK] * SEEN


def new_model(counts: np.ndarray, pairs: np.ndarray, seed: int = 5) -> AttentionModel:
    """Untrained model. counts: of each id; pairs: (IDS + 2, CLASSES) counts of each id's row after the most frequent
    ids. The most frequent ids are classes of their own; the rest are put to classes by what they follow."""
    rng = np.random.default_rng(seed)
    order = np.lexsort((np.arange(VOCABULARY), -counts))
    place = np.full(VOCABULARY, IDS, np.int32)
    place[order[:IDS]] = np.arange(IDS)
    single = CLASSES // 2
    sign = np.sqrt((pairs[:IDS] + 0.1) / (pairs[:IDS] + 0.1).sum(axis=1, keepdims=True))
    middle = sign[single : single + CLASSES - single].copy()
    weight = np.log1p(counts[order[:IDS]])
    for _ in range(8):
        near = (sign @ middle.T / np.linalg.norm(middle, axis=1)).argmax(axis=1)
        for c in range(len(middle)):
            if (near == c).any():
                middle[c] = np.average(sign[near == c], axis=0, weights=weight[near == c] + 1e-3)
    kind = np.full(VOCABULARY, CLASSES - 1, np.int64)
    kind[order[:IDS]] = single + near
    kind[order[:single]] = np.arange(single)
    smooth = counts + 0.5
    size = np.bincount(kind, smooth, CLASSES)
    inside = np.log10(smooth / size[kind])
    p = {
        "q": rng.normal(0, 0.3, (IDS + 2, WIDTH)),
        "k": rng.normal(0, 0.3, (IDS + 2, WIDTH)),
        "v1": rng.normal(0, 0.3, (IDS + 2, WIDTH + 1)),
        "e": rng.normal(0, 0.3, (IDS + 2, WIDTH)),
        "c": rng.normal(0, 0.1, (WIDTH, CLASSES)),
        "b": np.log((size + 1e-9) / size.sum()),
        "near": np.linspace(0, -2, 2 * STEP),
    }
    p["v1"][:, WIDTH] = 1  # sums the weights
    return AttentionModel(place, kind, inside, {k: v.astype(np.float32) for k, v in p.items()})


def following(model: AttentionModel, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row tells of the next, from pairs (IDS + 2, IDS + 2) of a row and the one after it: (what it adds to the logits of
    classes, what it adds to the log10 share of each row in its class).

    Both are shares among pairs, mixed with shares among all ids by the number of different rows that were seen to follow: the
    more of them, the likelier one not seen yet. A row that nothing was seen to follow adds nothing."""
    kind = np.full(IDS + 1, CLASSES - 1)
    kind[model.place] = model.kind
    all_ids = np.bincount(model.place, counts + 0.5, IDS + 1)
    by_class = np.bincount(kind, all_ids, CLASSES)
    overall, inside = by_class / by_class.sum(), all_ids / by_class[kind]
    some = overall > 0
    logits = np.zeros((IDS + 2, CLASSES), np.float32)
    share = np.zeros((IDS + 2, IDS + 1), np.float32)
    for row in np.nonzero(pairs[:, : IDS + 1].any(axis=1))[0]:
        after = pairs[row, : IDS + 1]
        n, kinds = np.bincount(kind, after, CLASSES), np.bincount(kind, after > 0, CLASSES)
        new = kinds.sum()
        # The bias of classes is a logit of its own: only what the row changes is added.
        logits[row, some] = np.log((n + new * overall)[some] / (after.sum() + new)) - np.log(overall[some])
        new = np.maximum(kinds, 1)
        share[row] = np.log10((after + new[kind] * inside) / (n + new)[kind]) - np.log10(inside)
    return logits, share


class Trainer:
    """Adam steps on batches of windows. Rows of inputs that a batch does not have, and their moments, stay as they are."""

    def __init__(self, model: AttentionModel, rate: float = 0.015) -> None:
        self.model, self.rate, self.step, self.seen = model, rate, 0, 0
        self.m_table, self.m = _one_table({k: np.zeros_like(v) for k, v in model.p.items()})
        self.v_table, self.v = _one_table({k: np.zeros_like(v) for k, v in model.p.items()})

    def learn(self, texts: list[np.ndarray], batch: int = 192) -> None:
        inputs, target, own = self.model.windows(texts)
        for at in range(0, len(inputs) - 1, batch):
            part = inputs[at : at + batch + 1]
            if len(part) > 1:
                self.update(part, target[at + 1 : at + len(part)].ravel(), own[at + 1 : at + len(part)].ravel() >= 0)

    def update(self, inputs: np.ndarray, target: np.ndarray, valid: np.ndarray) -> None:
        n = int(valid.sum())
        if not n:
            return
        model, room = self.model, self.model.rooms
        weights = causal_weights(model.p["near"]), model.last()
        last, near = np.zeros_like(weights[1]), np.zeros((STEP, 2 * STEP), np.float32)
        of = room("of", *inputs.shape, model.table.shape[1])
        of[0] = 0
        for at in range(0, len(inputs) - 1, AT_ONCE):  # what fits the cache
            end = min(at + AT_ONCE, len(inputs) - 1)
            cut = slice(at * STEP, end * STEP)
            more = self._gradients(inputs[at : end + 1], *weights, target[cut], valid[cut] / n, of[at : end + 1])
            last += more[0]
            near += more[1]
        grad = {"c": last[:-1], "b": last[-1], "near": np.bincount(BACK.ravel(), near.ravel(), 2 * STEP).astype(np.float32)}
        rows, summed = self._by_row(inputs.ravel(), of.reshape(inputs.size, -1))
        self.step += 1
        self.seen += n
        for name, g in grad.items():
            self._adam(model.p[name], self.m[name], self.v[name], g)
        held = [x.take(rows, axis=0, out=room(f"held{k}", *summed.shape), mode="clip") for k, x in enumerate((model.table, self.m_table, self.v_table))]
        self._adam(*held, summed)
        model.table[rows], self.m_table[rows], self.v_table[rows] = held

    def _gradients(self, inputs: np.ndarray, near: np.ndarray, last: np.ndarray, target: np.ndarray, factor: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the last layer and of the bias by query and key. Those of inputs, by position, go to `of`, where the
        first block's are added to: an input is a key and a value of its own window and the next, and a query of its own."""
        model, room = self.model, self.model.rooms
        h, mixed, w, q, kw, vw = model.forward(inputs, near)
        # dh, and beside it what its product with the mixture takes from each key: values have a column of ones there.
        dh, flat, kind = room("dh", *h.shape), inputs[1:].ravel(), model.kind[target]
        grad, turned = np.zeros_like(last), np.ascontiguousarray(last[:-1].T)
        for lo in range(0, len(h), ROWS_AT_ONCE):
            some = slice(lo, lo + ROWS_AT_ONCE)
            _, d, total = model.classes(h[some], flat[some], last)
            # Gradients of logits but for a factor by row, which is left to narrower arrays.
            scale = (factor[some] / total).astype(np.float32)[:, None]
            d[ROWS[: len(d)], kind[some]] -= total
            grad += np.multiply(h[some], scale, out=room("scaled", *h[some].shape)).T @ d
            np.matmul(d, turned, out=dh[some, :WIDTH])
            dh[some] *= scale
        np.negative(np.einsum("ij,ij->i", dh[:, :WIDTH], mixed), out=dh[:, WIDTH])
        each = dh.reshape(-1, STEP, WIDTH + 1)
        turned = room("turned", len(each), WIDTH + 1, 2 * STEP)
        np.copyto(turned, vw.transpose(0, 2, 1))
        ds = np.matmul(each, turned, out=room("ds", *w.shape))
        ds *= w
        each = each[..., :WIDTH]
        for name, by, what in (("k", ds, q), ("v1", w, each)):
            part = of[..., COLUMNS[name]][..., :WIDTH]
            np.matmul(by[..., STEP:].transpose(0, 2, 1), what, out=part[1:])
            part[:-1] += np.matmul(by[..., :STEP].transpose(0, 2, 1), what, out=room("before", *q.shape))
        np.matmul(ds, kw, out=of[1:, :, COLUMNS["q"]])
        of[1:, :, COLUMNS["e"]] = each
        return grad, ds.sum(axis=0)

    def _by_row(self, flat: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different rows in flat, and the sums of `of` over each.

        Those that occur most come first, so that the k-th of each lie side by side and are added at once."""
        flat = flat.astype(np.int16)
        order = np.argsort(flat, kind="stable")
        edges = np.concatenate([[0], np.nonzero(np.diff(flat[order]))[0] + 1, [len(flat)]])
        size = np.diff(edges)
        rows = flat[order[edges[:-1]]]
        first = np.argsort(-size, kind="stable")
        rows, start, size = rows[first], edges[first], size[first]
        many = int((size > MANY).sum())  # summed by themselves
        count = len(rows) - np.searchsorted(size[::-1], np.arange(int(size[many:].max(initial=0))), side="right")
        which = [order[lo : lo + c] for lo, c in zip(start[:many].tolist(), size[:many].tolist(), strict=True)]
        which += [order[start[many:c] + k] for k, c in enumerate(count.tolist())]
        dealt = of.take(np.concatenate(which), axis=0, out=self.model.rooms("dealt", *of.shape), mode="clip")
        out, ones, at = self.model.rooms("summed", len(rows), of.shape[1]), np.ones(int(size[0]), np.float32), 0
        for k, w in enumerate(which):
            part, at = dealt[at : at + len(w)], at + len(w)
            if k < many:
                np.matmul(ones[: len(w)], part, out=out[k])
            elif k == many:
                out[many:] = part
            else:
                out[many : many + len(w)] += part
        return rows, out

    def _adam(self, weights: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray) -> None:
        """A step of weights, in place; grad is used up."""
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += np.multiply(np.square(grad, out=grad), 0.01, out=grad)
        by = np.sqrt(v, out=grad)
        by *= 1 / np.sqrt(1 - 0.99**self.step)
        by += 1e-7
        np.divide(m, by, out=by)
        by *= self.rate / (1 - 0.9**self.step)
        weights -= by


def _ids(encoder: WordEncoder, texts: list) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<u4").astype(np.int64) for raw in encoder.encode_all(texts)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words_of() of lower-cased texts, null ones empty, but without the empty words at their ends: (owner of each word, number
    of each, distinct words)."""
    import pyarrow.compute as pc

    edges, numbers, words = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[numbers]
    return owner[real], numbers[real], words


def encode(rows: DataFrame, frequent: list[bytes], logs: np.ndarray, known: np.ndarray, tokenizer: str = TOKENIZER) -> DataFrame:
    """Checkpointed rows(doc_id, key, train, n_tokens, some, part, ids) of rows(doc_id, text, key, train): each text is
    tokenized once for all passes. some and part sum `known` and `logs` over its frequent words; ids are little-endian 16-bit
    numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((frequent, logs, known))
    schema = T.StructType([*rows.select("doc_id", "key", "train").schema, *T.StructType.fromDDL("n_tokens bigint, some bigint, part double, ids binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        encoder = WordEncoder.of_worker(tokenizer)
        listed, log, seen = shared.value
        listed = pa.array(listed, pa.binary()).cast(pa.string())
        log, seen = np.append(log, 0.0), np.append(seen, 0)
        for batch in (part for whole in batches for part in common.slices(whole, 3)):
            texts, n = batch.column(3), batch.num_rows
            owner, numbers, words = _words(texts)
            place = pc.fill_null(pc.index_in(words, listed), len(listed)).to_numpy()[numbers]
            ids = [part for run in encoder.encode_runs(texts) for part in _cut(*run)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(1 + np.bincount(owner, minlength=n).astype(np.int64)), pa.array(np.bincount(owner, seen[place], n).astype(np.int64)),
                    pa.array(np.bincount(owner, log[place], n).astype(np.float64)), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()),
                ],
                names=[f.name for f in schema],
            )

    return common.cut(rows.select("doc_id", "key", "train", "text").mapInArrow(common.lean(run), schema))


def _cut(values: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    return [values[lo:hi] for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<u2").astype(np.int64) for raw in column.to_pylist()]


def train_attention(encoded: DataFrame, rounds: int = ROUNDS) -> AttentionModel:
    """Model trained on all of encoded(train, ids) that train: counts of ids and of pairs; then, in each round, every partition
    trains a copy over its texts and the copies are averaged by ids seen, in tasks: the driver gets one sum of fixed size.
    Copies grow in number with the partitions, of LEAST_IDS each or more. Without texts the model is untrained, which is a model all the same."""
    encoded = encoded.where("train").select("ids")
    counts, pairs = _id_tables(encoded)
    frequent = CLASSES - 1
    model = new_model(counts, np.column_stack([pairs[:frequent].T, pairs[frequent:].sum(axis=0)]))
    model.follow = following(model, counts, pairs)
    encoded = encoded.coalesce(max(1, int(counts.sum()) // LEAST_IDS))  # partitions side by side, if they are small
    shape = {k: v.shape for k, v in model.p.items()}
    spark = encoded.sparkSession
    chunk = 4096
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.place, model.kind, model.inside, model.p, (model.follow[0], None)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import copy

            trainer = Trainer(AttentionModel(*copy.deepcopy(shared.value)))
            for batch in (part for whole in batches for part in common.slices(whole, 0)):
                texts = _numbers(batch.column(0))
                for at in range(0, len(texts), 256):
                    trainer.learn(texts[at : at + 256])
            if trainer.seen:
                flat = np.concatenate([trainer.model.p[k].ravel() for k in shape]).astype(np.float64) * trainer.seen
                cut = [flat[at : at + chunk].tobytes() for at in range(0, len(flat), chunk)]
                yield pa.RecordBatch.from_pydict({"chunk": list(range(len(cut))), "seen": [trainer.seen] * len(cut), "weights": cut})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, int] = {}
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, n, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    seen[c] = seen.get(c, 0) + n
                    total[c] = total.get(c, 0) + np.frombuffer(w, np.float64)
            for c in sorted(total):
                yield pa.RecordBatch.from_pydict({"chunk": [c], "seen": [seen[c]], "weights": [total[c].tobytes()]})

        what = "chunk bigint, seen bigint, weights binary"
        got = encoded.mapInArrow(common.lean(run), what).repartition(SUMS, "chunk").mapInArrow(add, what)
        parts = sorted((r["chunk"], r["seen"], bytes(r["weights"])) for r in got.collect())
        shared.unpersist()
        if not parts:
            break
        mean = np.concatenate([np.frombuffer(w, np.float64) / n for _, n, w in parts])
        at, p = 0, {}
        for k, s in shape.items():
            size = int(np.prod(s))
            p[k] = mean[at : at + size].reshape(s).astype(np.float32)
            at += size
        model = AttentionModel(model.place, model.kind, model.inside, p, model.follow)
    return model


def _id_tables(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each id, and (IDS + 2, IDS + 2) of the row of an id and of the one after it, over all of encoded(ids).

    A task sends what it counted once, cut in parts that are summed side by side: the driver gets one table of fixed size."""

    def totals(add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        chunk = 1 << 16

        def sent(total: np.ndarray) -> Iterator[pa.RecordBatch]:
            for c in range(0, len(total), chunk):
                some = np.nonzero(total[c : c + chunk])[0]
                if len(some):
                    yield pa.RecordBatch.from_pydict({"chunk": [c], "at": [some.astype("<u2").tobytes()], "n": [total[c : c + chunk][some].tobytes()]})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for batch in (part for whole in batches for part in common.slices(whole, 0)):
                texts = _numbers(batch.column(0))
                total += np.bincount(np.concatenate([add(ids) for ids in texts]), minlength=size)
            yield from sent(total)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, at, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    parts.setdefault(c, np.zeros(chunk, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.int64)
            for c, total in parts.items():
                for batch in sent(total):
                    yield batch.set_column(0, "chunk", pa.array([c], pa.int64()))

        what = "chunk bigint, at binary, n binary"
        counted = encoded.select("ids").mapInArrow(common.lean(count), what).repartition(SUMS, "chunk").mapInArrow(common.lean(merge), what)
        out = np.zeros(size, np.int64)
        for r in counted.collect():  # as many rows as the table has parts
            out[r["chunk"] + np.frombuffer(bytes(r["at"]), "<u2").astype(np.int64)] = np.frombuffer(bytes(r["n"]), np.int64)
        return out

    counts = totals(lambda ids: ids, VOCABULARY)
    order = np.lexsort((np.arange(VOCABULARY), -counts))
    row = np.full(VOCABULARY, IDS, np.int64)
    row[order[:IDS]] = np.arange(IDS)
    side = IDS + 2
    return counts, totals(lambda ids: row[ids[:-1]] * side + row[ids[1:]], side * side).astype(float).reshape(side, side)


# ---- the word base


def frequent_words(sample: DataFrame, most: int = FREQUENT) -> list[bytes]:
    """At most `most` words, those most frequent in sample(text). Which they are bears on speed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, 0)):
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                seen.update((t or "").encode().lower().split())
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    words = sample.select("text").mapInArrow(common.lean(run), "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    words = common.cut(words)
    # Each partition sends its best to the driver: first leave those that a histogram of 64 bins shows to be too rare.
    bins = words.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).orderBy(F.desc("b")).collect()
    least, seen = 0, 0
    for r in bins:
        least, seen = r["b"], seen + r["c"]
        if seen >= most:
            break
    words = words.where(F.floor(F.log2("n")) >= least)
    return [bytes(r["w"]) for r in words.orderBy(F.desc("n"), "w").limit(most).select("w").collect()]


def _keyed(docs: DataFrame, held: int) -> DataFrame:
    return docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), (common.fold("doc_id") != held).alias("train")
    )


def _distinct(w: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the pairs (w, m), equal for equal pairs."""
    order = np.argsort(w)
    a, b = w[order], m[order]
    new = a[1:] != a[:-1]
    if ((b[1:] != b[:-1]) & ~new).any():  # words whose first 64 bits are alike
        order = np.lexsort((m, w))
        a, b = w[order], m[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(w), np.int64)
    which[order] = np.concatenate([[0], np.cumsum(new)]) if len(w) else 0
    return which


def word_statistics(docs: DataFrame, frequent: list[bytes], parts: int = PARTS) -> DataFrame:
    """Checkpointed rows (kind, key, value, known) over all of docs(key, text, train), known words being those of
    training documents. kind 0: for document `key`, sum of log10(c + 0.5) and number of known among its words that are
    not frequent, from one part; kind 1: count in training texts of frequent word number `key`; kind 2: words of
    training texts that are not frequent, and distinct ones; kind 3: rows of document `key`.

    A word that is not frequent goes, as 96 bits of its hash with its document's key, to the part that the hash falls in:
    one array a part and batch. A part counts its words and sums up by document at once. Counts of frequent words are
    summed before they leave a task."""
    spark = docs.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(frequent)
    n_frequent, chunk = len(frequent), 1024

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import xxhash

        listed = pa.array(shared.value, pa.binary()).cast(pa.string())
        counts = np.zeros(n_frequent, np.int64)
        for batch in (part for whole in batches for part in common.slices(whole, 1)):
            keys, train = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            o, numbers, words = _words(batch.column(1))
            place = pc.fill_null(pc.index_in(words, listed), -1).to_numpy()
            at = place[numbers]
            counts += np.bincount(at[(at >= 0) & train[o]], minlength=n_frequent)
            rare = np.nonzero(place < 0)[0]
            digests = b"".join(map(xxhash.xxh3_128_digest, words.take(pa.array(rare)).cast(pa.binary()).to_pylist()))
            both = np.zeros((len(words), 2), np.uint64)
            both[rare] = np.frombuffer(digests, "<u8").reshape(-1, 2)
            o, numbers = o[at < 0], numbers[at < 0]
            h, more = both[numbers, 0], both[numbers, 1].astype(np.uint32)
            part = (h % np.uint64(parts)).astype(np.int16 if parts < 1 << 15 else np.int64)
            order = np.argsort(part, kind="stable")
            h, more, o, part = h[order], more[order], o[order], part[order]
            edge = np.searchsorted(part, np.arange(parts + 1))
            some = np.nonzero(np.diff(edge))[0]
            cut = [slice(edge[b], edge[b + 1]) for b in some]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(some, pa.int32()),
                    "what": pa.array(np.zeros(len(some)), pa.int32()),
                    "a": pa.array([h[c].tobytes() + more[c].tobytes() for c in cut], pa.binary()),
                    "b": pa.array([keys[o[c]].tobytes() for c in cut], pa.binary()),
                    "c": pa.array([train[o[c]].astype(np.uint8).tobytes() for c in cut], pa.binary()),
                }
            )
            own = keys.astype(np.uint64) % np.uint64(parts)
            for b in np.unique(own).tolist():
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([b], pa.int32()), "what": pa.array([2], pa.int32()), "a": pa.array([keys[own == b].tobytes()]), "b": pa.array([b""]), "c": pa.array([b""])}
                )
        for c in range(0, n_frequent, chunk):
            if counts[c : c + chunk].any():
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([c // chunk % parts], pa.int32()), "what": pa.array([1], pa.int32()), "a": pa.array([counts[c : c + chunk].tobytes()]), "b": pa.array([np.int64(c).tobytes()]), "c": pa.array([b""])}
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, more, keys, train = [], [], [], []
        counts: dict[int, np.ndarray] = {}
        rows: list[np.ndarray] = []
        for batch in batches:
            for _, what, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if what == 0:
                    n = len(a) // 12
                    words.append(np.frombuffer(a, np.uint64, n))
                    more.append(np.frombuffer(a, np.uint32, n, 8 * n))
                    keys.append(np.frombuffer(b, np.int64))
                    train.append(np.frombuffer(c, np.uint8))
                elif what == 1:
                    at = int(np.frombuffer(b, np.int64)[0])
                    counts[at] = counts.get(at, 0) + np.frombuffer(a, np.int64)
                else:
                    rows.append(np.frombuffer(a, np.int64))

        def out(kind: int, key: np.ndarray, value: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), kind), pa.int32()), pa.array(key, pa.int64()), pa.array(value, pa.float64()), pa.array(known, pa.int64())],
                names=["kind", "key", "value", "known"],
            )

        if words:
            w, m, k, t = np.concatenate(words), np.concatenate(more), np.concatenate(keys), np.concatenate(train)
            words.clear(), more.clear(), keys.clear(), train.clear()
            which = _distinct(w, m)
            c = np.bincount(which, t)
            own, whose = np.unique(k, return_inverse=True)
            value = np.bincount(whose, np.log10(c + 0.5)[which])
            known = np.bincount(whose, (c > 0)[which]).astype(np.int64)
            for s in range(0, len(own), 1 << 16):
                yield out(0, own[s : s + (1 << 16)], value[s : s + (1 << 16)], known[s : s + (1 << 16)])
            yield out(2, np.zeros(1, np.int64), np.array([c.sum()]), np.array([(c > 0).sum()]))
        for at, n in sorted(counts.items()):
            yield out(1, at + np.arange(len(n)), n.astype(float), np.zeros(len(n), np.int64))
        if rows:
            own, n = np.unique(np.concatenate(rows), return_counts=True)
            for s in range(0, len(own), 1 << 16):
                yield out(3, own[s : s + (1 << 16)], n[s : s + (1 << 16)].astype(float), np.zeros(len(n[s : s + (1 << 16)]), np.int64))

    sent = docs.select("key", "text", "train").mapInArrow(common.lean(scatter), "part int, what int, a binary, b binary, c binary")
    return common.cut(sent.repartition(parts, "part").mapInArrow(common.lean(gather), "kind int, key bigint, value double, known bigint"))


def score_corpus(docs: DataFrame, held: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text).

    Training documents are those whose crc32(doc_id as text) mod 5 is not `held`; a null doc_id trains. Null and empty
    texts are one token, the end. The model scores the ids of a whole text and its end. Rows that repeat doc_id and
    text score alike. Copies of the model are trained by partition, so where rows are dealt out otherwise, on another cluster or with
    another size of splits, scores differ by a little; base_score does not. Without training documents counts are zero and the model is untrained; base_score is then what
    the smoothing gives with V = 0."""
    common.small_batches(docs.sparkSession)
    rows = _keyed(docs, held)
    some = F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(FREQUENT_RATE)) == 0
    frequent = frequent_words(common.cut(rows.where("train").where(some).select("text")))
    statistics = word_statistics(rows, frequent)
    counts = np.zeros(len(frequent))
    for r in statistics.where("kind = 1").select("key", "value").collect():  # one row a frequent word
        counts[r["key"]] += r["value"]
    rare = statistics.where("kind = 2").agg(F.sum("value").alias("n"), F.sum("known").alias("v")).first()
    encoded = encode(rows, frequent, np.log10(counts + 0.5), (counts > 0).astype(np.int64), tokenizer)
    ends = encoded.where("train").count()
    model = train_attention(encoded)
    n = int(counts.sum()) + int(rare["n"] or 0) + ends
    v = int((counts > 0).sum()) + int(rare["v"] or 0) + (ends > 0)
    shared = docs.sparkSession.sparkContext.broadcast((model.place, model.kind, model.inside, model.p, model.follow))
    end_id, end_log = 2, float(np.log10(ends + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = AttentionModel(*shared.value)
        for batch in (part for whole in batches for part in common.slices(whole, 6, 2 << 20)):
            ids = [np.append(x, end_id) for x in _numbers(batch.column(6))]
            order = np.argsort([len(x) for x in ids], kind="stable")
            logp = np.zeros(len(ids))
            logp[order] = model.log10_of([ids[i] for i in order])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(logp)], names=schema.names)

    schema = T.StructType([*encoded.schema[:6], *T.StructType.fromDDL("score double")])
    scored = encoded.mapInArrow(common.lean(run), schema)
    by_document = statistics.where("kind in (0, 3)").groupBy("key").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("value"))).alias("value"),
        F.sum(F.when(F.col("kind") == 0, F.col("known"))).alias("known"),
        F.sum(F.when(F.col("kind") == 3, F.col("value"))).alias("m"),
    )
    divisor = float(np.log10(n + 0.5 * (v + 1)))
    return scored.join(by_document, "key", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("some") + int(ends > 0) + F.coalesce(F.col("known") / F.col("m"), F.lit(0.0)).cast("bigint")).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("part") + end_log + F.coalesce(F.col("value") / F.col("m"), F.lit(0.0)) - F.col("n_tokens") * divisor).alias("base_score"),
        "score",
    )


def op8_lm_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their scores; see score_corpus()."""
    return score_corpus(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
