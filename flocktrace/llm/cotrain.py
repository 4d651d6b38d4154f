"""A quality classifier by co-training.

Two classifiers see different sides of a document: the words of its text and their make-up, and what its metadata and
layout say without its words (language, source, size, lines).  Each is trained on labelled documents; over some rounds
each gives the unlabelled ones that it is surest of to the other as labelled.  Both are then calibrated on held-out
labels, and so is the weight that each has where all documents are scored by both together.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import bounded, dropped, lean, staged
from .shingles import hashes, numbered, spans

#: Bound of the labelled documents that the classifiers are fitted on, those with the least hash of their id.
MOST_LABELLED = 4_000
ROUNDS = 4
#: Share of all unlabelled documents that each classifier hands over in a round, and how sure it must be.
GIVEN = 0.05
SURE = 0.95

WORD_BUCKETS = 1 << 15
SHAPE_BUCKETS = 1 << 10
_NUMBERS = ["log_chars", "log_lines", "line_chars"]
BINS = 12
_NAMES = 64

#: One bit for each kind of byte in a word.
_KIND = np.zeros(256, dtype=np.uint16)
for _bit, _chars in enumerate([range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".,;:!?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"'\"-", b"()[]{}", b"/\\_=+~^@`"]):
    _KIND[list(_chars)] = 1 << _bit


def _text_view(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets of its words and of their make-up, and their values, of length 1 together."""
    data, ends = shingles.texts_of(column)
    starts, stops = spans(data, ends)
    codes, contents = numbered(data, starts, stops)
    word = (hashes(contents) % np.uint64(WORD_BUCKETS)).astype(np.int64)[codes]
    kinds = np.bitwise_or.reduceat(np.concatenate([_KIND[data], [0]]).astype(np.uint16), np.stack([starts, stops], 1).ravel())[::2] if len(starts) else np.empty(0, dtype=np.uint16)
    shape = (shingles.mixed(kinds.astype(np.uint64)) % np.uint64(SHAPE_BUCKETS)).astype(np.int64) + WORD_BUCKETS
    bounds = np.searchsorted(starts, ends).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        index, count = np.unique(np.concatenate([word[a:b], shape[a:b]]), return_counts=True)
        value = np.log1p(count)
        yield index, value / np.sqrt((value * value).sum()) if len(value) else value


def _meta_view(text: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """_NUMBERS of each document, then a bucket for its language and one for its source."""
    data, ends = shingles.texts_of(text)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[ends])
    chars, lines = sums((data & 0xC0) != 0x80), sums(data == 10) + 1
    columns = [np.log1p(chars), np.log1p(lines), chars / lines]
    names = [[zlib.crc32(f"{i}{x}".encode()) % _NAMES for x in c.to_pylist()] for i, c in enumerate((lang, source))]
    return np.stack([*columns, *(np.array(n, dtype=float) for n in names)], 1) if len(text) else np.empty((0, len(_NUMBERS) + 2))


@dataclass
class Logistic:
    """Logistic regression on sparse rows, with Platt's scale and shift."""

    width: int
    weights: np.ndarray = field(default=None)
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, value * self.weights[index], minlength=n) + self.bias

    def logit(self, *rows) -> np.ndarray:
        return np.clip(self.scale * self.raw(*rows) + self.shift, -30, 30)

    def slope(self, index, value, row, n: int, y, costs: tuple[float, float]) -> np.ndarray:
        """Of the loss by each weight and, last, the bias; costs are those of a bad and of a good row."""
        error = np.where(y > 0, costs[1], costs[0]) * (1 / (1 + np.exp(-np.clip(self.raw(index, value, row, n), -30, 30))) - y)
        return np.append(np.bincount(index, value * error[row], minlength=self.width), error.sum())

    def calibrate(self, index, value, row, y, n: int) -> None:
        """Newton's method for the scale and shift under which scores are log-odds of the held-out labels."""
        raw = self.raw(index, value, row, n)
        self.scale, self.shift = 1.0, 0.0
        # targets kept off 0 and 1, as Platt does
        good = y.sum()
        wanted = np.where(y > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))
            w, e = p * (1 - p) + 1e-9, p - wanted
            h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
            move = np.linalg.solve(h, [(e * raw).sum() + 1e-3 * (self.scale - 1), e.sum()])
            self.scale, self.shift = max(1e-3, self.scale - float(np.clip(move[0], -2, 2))), self.shift - float(np.clip(move[1], -2, 2))


@dataclass
class Model:
    """Both classifiers, the edges of the bins of numbers, the log-odds of all labels, and the weights of both views and a shift."""

    text: Logistic
    meta: Logistic
    edges: list[np.ndarray]
    prior: float
    both: tuple[float, float, float] = (1.0, 1.0, 0.0)

    def together(self, by_text: np.ndarray, by_meta: np.ndarray) -> np.ndarray:
        """Log-odds by both views from those by each."""
        a, b, c = self.both
        return np.clip(a * by_text + b * by_meta + c, -30, 30)

    def weigh(self, by_text: np.ndarray, by_meta: np.ndarray, y: np.ndarray) -> None:
        """Newton's method for the weights under which both are log-odds of held-out labels, drawn a little to what holds if the views are independent."""
        usual = np.array([1.0, 1.0, -self.prior])
        w, rows = usual.copy(), np.stack([by_text, by_meta, np.ones(len(y))], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            slope = rows.T @ (p - y) + (w - usual)
            w = w - np.clip(np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.eye(3), slope), -1, 1)
            w[:2] = np.maximum(w[:2], 0.0)
        self.both = tuple(map(float, w))

    def meta_rows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return _binned(numbers, self.edges)


def _binned(numbers: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n = len(numbers)
    bins = [np.searchsorted(e, numbers[:, k], side="right") + k * BINS for k, e in enumerate(edges)]
    names = [numbers[:, len(edges) + k].astype(np.int64) + len(edges) * BINS + k * _NAMES for k in range(2)]
    index = np.stack([*bins, *names], 1) if n else np.empty((0, len(edges) + 2), dtype=np.int64)
    return index.ravel(), np.full(index.size, 1 / np.sqrt(index.shape[1])), np.repeat(np.arange(n), index.shape[1]), n


def _rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64), 0
    return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]), np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), len(parts)


#: A block of unlabelled documents: a hash of each id, how many features each text has, these and their values, and metadata.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: View that hands over, and view that gets.
_TO = (("text", "meta"), ("meta", "text"))


def _block_rows(block: Block, edges: list[np.ndarray], at: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """A block's rows, or those of some of its documents, for both views."""
    _, sizes, index, value, meta = block
    row = np.repeat(np.arange(len(sizes)), sizes)
    if at is None:
        return {"text": (index.astype(np.int64), value.astype(float), row, len(sizes)), "meta": _binned(meta, edges)}
    mine = np.isin(row, at)
    return {"text": (index[mine].astype(np.int64), value[mine].astype(float), np.searchsorted(at, row[mine]), len(at)), "meta": _binned(meta[at], edges)}


def _keys(classifier: Logistic, rows: tuple, ids: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For bad and for good: which documents the classifier is sure of, and keys that put the surest first, and then the least hash."""
    z = classifier.logit(*rows)
    p = 1 / (1 + np.exp(-z))
    place = np.round((z + 30) * (1 << 20)).astype(np.uint64)
    tie = ids >> np.uint64(26)
    return p <= 1 - sure, place << np.uint64(38) | tie, p >= sure, (np.uint64((1 << 26) - 1) - place) << np.uint64(38) | tie


def _handed(block: Block, rows: dict[str, tuple], turns: list[tuple[dict[str, Logistic], dict[tuple[str, int], int]]], sure: float) -> dict[str, np.ndarray]:
    """The pseudo-labels that a block's documents have got for each view after these turns, -1 for none."""
    labels = {view: np.full(len(block[0]), -1) for view in rows}
    for classifiers, cuts in turns:
        for view, other in _TO:
            is_bad, bad, is_good, good = _keys(classifiers[view], rows[view], block[0], sure)
            free = labels[other] < 0
            labels[other][free & is_bad & (bad <= np.uint64(cuts[view, 0]))] = 0
            labels[other][free & is_good & (good <= np.uint64(cuts[view, 1]))] = 1
    return labels


class Pool:
    """All unlabelled documents, in blocks that stay in executors.

    What has been handed over follows from the classifiers and cut-offs of the turns so far, which are all that the
    driver keeps.
    """

    def __init__(self, table: DataFrame, edges: list[np.ndarray], sure: float = SURE):
        self.size = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.edges, self.sure = edges, sure
        self.turns: list[tuple[dict[str, Logistic], dict[tuple[str, int], int]]] = []
        self.blocks = table.select("block").rdd.map(lambda r: pickle.loads(r[0]))
        self.tasks = table.sparkSession.sparkContext.defaultParallelism
        self.kept: RDD | None = None
        self.given: RDD | None = None
        #: Good pseudo-labels, and all, of each view.
        self.counts = {"text": (0, 0), "meta": (0, 0)}

    def take(self, classifiers: dict[str, Logistic], bad: int, good: int) -> None:
        """A turn: each classifier hands the bad and good documents that it is surest of, so many at most, to the other."""
        edges, sure, turns = self.edges, self.sure, list(self.turns)
        now = {k: copy.copy(c) for k, c in classifiers.items()}

        def keys(block: Block) -> dict[tuple[str, int], np.ndarray]:
            rows = _block_rows(block, edges)
            had, out = _handed(block, rows, turns, sure), {}
            for view, other in _TO:
                is_bad, low, is_good, high = _keys(now[view], rows[view], block[0], sure)
                free = had[other] < 0
                out |= {(view, 0): low[free & is_bad], (view, 1): high[free & is_good]}
            return out

        found = self.blocks.map(keys).persist(StorageLevel.MEMORY_AND_DISK)
        cuts = _cuts(found.coalesce(self.tasks), {(view, y): (bad, good)[y] for view, _ in _TO for y in (0, 1)})
        found.unpersist()
        self.turns.append((now, cuts))
        self._gather()

    def _gather(self) -> None:
        edges, sure, turns = self.edges, self.sure, list(self.turns)

        def chosen(blocks: Iterator[Block]) -> Iterator[dict[str, tuple]]:
            held: dict[str, list] = {"text": [], "meta": []}
            for block in blocks:
                labels = _handed(block, _block_rows(block, edges), turns, sure)
                for view, got in labels.items():
                    if len(at := np.flatnonzero(got >= 0)):
                        held[view].append((*_block_rows(block, edges, at)[view], got[at].astype(float)))
                if max(sum(x[3] for x in parts) for parts in held.values()) >= 4096:
                    yield {view: _merged(parts) for view, parts in held.items()}
                    held = {"text": [], "meta": []}
            yield {view: _merged(parts) for view, parts in held.items()}

        self.close()
        self.kept = self.blocks.mapPartitions(chosen).persist(StorageLevel.MEMORY_AND_DISK)
        self.given = self.kept.coalesce(self.tasks)
        told = self.given.map(lambda x: {view: (int(rows[4].sum()), rows[3]) for view, rows in x.items()}).collect()
        self.counts = {view: (sum(x[view][0] for x in told), sum(x[view][1] for x in told)) for view in self.counts}

    def slopes(self, classifiers: dict[str, Logistic], costs: dict[str, tuple[float, float]]) -> dict[str, np.ndarray] | None:
        """The slopes of the loss of all that was handed over."""
        if self.given is None:
            return None

        def run(parts: Iterator[dict[str, tuple]]) -> Iterator[dict[str, np.ndarray]]:
            total = {view: np.zeros(c.width + 1) for view, c in classifiers.items()}
            for part in parts:
                for view, rows in part.items():
                    total[view] += classifiers[view].slope(*rows, costs[view])
            yield total

        sums = self.given.mapPartitions(run).collect()
        return {view: sum(x[view] for x in sums) for view in classifiers}

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = self.given = None


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64), 0, np.empty(0)
    before = np.cumsum([0, *(p[3] for p in parts)])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + b for p, b in zip(parts, before[:-1].tolist(), strict=True)]), int(before[-1]), np.concatenate([p[4] for p in parts])


def _cuts(keys: RDD, most: dict[tuple[str, int], int]) -> dict[tuple[str, int], int]:
    """For each name the key that so many are not above; the greatest of all where there are fewer.  Counts 16 bits at a time."""
    prefix, left, open_ = dict.fromkeys(most, 0), dict(most), set(most)
    for shift in (48, 32, 16, 0):
        known, names = dict(prefix), sorted(open_)

        def run(blocks: Iterator[dict], known=known, names=names, shift=shift) -> Iterator[dict]:
            total = {name: np.zeros(1 << 16, dtype=np.int64) for name in names}
            for block in blocks:
                for name in names:
                    k = block[name]
                    k = k if shift == 48 else k[k >> np.uint64(shift + 16) == np.uint64(known[name])]
                    total[name] += np.bincount((k >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            yield {name: (some := np.flatnonzero(c), c[some]) for name, c in total.items()}

        told = keys.mapPartitions(run).collect()
        for name in names:
            count = np.zeros(1 << 16, dtype=np.int64)
            for x in told:
                count[x[name][0]] += x[name][1]
            upto = np.cumsum(count)
            at = int(np.searchsorted(upto, left[name]))
            if at == 1 << 16:
                prefix[name] = (1 << 64) - 1
                open_.remove(name)
                continue
            left[name] -= int(upto[at] - count[at])
            prefix[name] = prefix[name] << 16 | at
    return prefix


def _descend(classifiers: dict[str, Logistic], near: dict[str, tuple], pool: Pool | None, steps: int, penalty: float = 1e-4) -> None:
    """Full-batch descent with Adam's steps on the labelled rows and all that the pool has handed over; classes weigh alike."""
    costs, m, v = {}, {}, {}
    for view, c in classifiers.items():
        c.scale, c.shift = 1.0, 0.0
        if c.weights is None:
            c.weights = np.zeros(c.width)
        more = pool.counts[view] if pool else (0, 0)
        good = max(1, int(near[view][4].sum()) + more[0])
        costs[view] = (0.5 / max(1, near[view][3] + more[1] - good), 0.5 / good)
        m[view], v[view] = np.zeros(c.width + 1), np.zeros(c.width + 1)
    for t in range(1, steps + 1):
        far = pool.slopes(classifiers, costs) if pool else None
        for view, c in classifiers.items():
            slope = c.slope(*near[view], costs[view]) + np.append(penalty * c.weights, 0.0)
            slope = slope if far is None else slope + far[view]
            m[view], v[view] = 0.9 * m[view] + 0.1 * slope, 0.99 * v[view] + 0.01 * slope * slope
            step = 0.3 * (m[view] / (1 - 0.9**t)) / (np.sqrt(v[view] / (1 - 0.99**t)) + 1e-8)
            c.weights, c.bias = c.weights - step[:-1], c.bias - step[-1]


def train(text: list[tuple[np.ndarray, np.ndarray]], meta: np.ndarray, y: np.ndarray, held_out: np.ndarray, blocks: DataFrame | None = None, rounds: int = ROUNDS, given: float = GIVEN, sure: float = SURE) -> Model:
    """Co-trains on labelled documents given by both views, and on blocks of unlabelled ones."""
    edges = [np.unique(np.quantile(meta[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(meta) else np.empty(0) for k in range(len(_NUMBERS))]
    known = np.flatnonzero(~held_out)
    good = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    model = Model(Logistic(WORD_BUCKETS + SHAPE_BUCKETS), Logistic(len(edges) * BINS + 2 * _NAMES), edges, float(np.log(good / (1 - good))))
    classifiers = {"text": model.text, "meta": model.meta}
    rows = {"text": lambda at: _rows([text[i] for i in at]), "meta": lambda at: _binned(meta[at], edges)}
    near = {view: (*rows[view](known), y[known].astype(float)) for view in rows}
    _descend(classifiers, near, None, 120)
    pool = Pool(blocks, edges, sure) if blocks is not None and rounds else None
    if pool and pool.size:
        count = max(1, int(given * pool.size))
        for _ in range(rounds):
            pool.take(classifiers, max(1, int(count * (1 - good))), max(1, int(count * good)))
            _descend(classifiers, near, pool, 40)
        pool.close()
    at = np.flatnonzero(held_out)
    if len(at) and 0 < y[at].sum() < len(at):
        for view, classifier in classifiers.items():
            classifier.calibrate(*rows[view](at)[:3], y[at].astype(float), len(at))
        some = np.array([len(text[i][0]) > 0 for i in at])
        model.weigh(np.where(some, model.text.logit(*rows["text"](at)), model.prior), model.meta.logit(*rows["meta"](at)), y[at].astype(float))
    else:
        model.both = (1.0, 1.0, -model.prior)
    return model


def _views(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))


def _blocks(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Every unlabelled id's document in blocks, and their numbers of rows; of rows with one id that with the least features."""

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                index, value = zip(*_text_view(batch.column(1)), strict=True)
                meta = _meta_view(batch.column(1), batch.column(2), batch.column(3))
                packed = [[x.astype(np.uint16).tobytes() for x in index], [x.astype(np.float32).tobytes() for x in value], [x.tobytes() for x in meta]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in packed)], names=["doc_id", "index", "value", "meta"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, index, value, meta = (batch.column(i) for i in range(4))
                index, value, meta = index.to_pylist(), b"".join(value.to_pylist()), b"".join(meta.to_pylist())
                block = (ids.to_numpy().view(np.uint64), np.array([len(x) // 2 for x in index]), np.frombuffer(b"".join(index), dtype=np.uint16), np.frombuffer(value, dtype=np.float32), np.frombuffer(meta).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary()), pa.array([batch.num_rows], pa.int64())], names=["block", "n"])

    views = _views(docs.where(F.col(id_col).isNotNull()), id_col, text_col, lang_col, source_col)
    each = views.mapInArrow(lean(view), f"doc_id {docs.schema[id_col].dataType.simpleString()}, index binary, value binary, meta binary")
    free = each.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min(F.struct("index", "value", "meta")).alias("x"))
    return staged(free.select(F.xxhash64("doc_id", F.lit(7)).alias("h"), "x.*").mapInArrow(lean(pack), "block binary, n long"), "unlabelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> Model:
    """Fits on at most most_labelled labelled documents, those with the least hash of their id, and on pseudo-labels of any unlabelled ones.

    In each round executors score all unlabelled documents, and the share GIVEN of them, the surest, gets labels; what is
    fitted on these stays in executors, which send sums only.  Null labels and ids are left out.  A fifth of the labelled
    ones, by another hash, is held out for calibration; bins of numbers are those of the labelled ones.  Without labels of
    both classes scores say the share of good ones, and nothing else.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("y"))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).join(known, "doc_id")
    sample = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                index, value = zip(*_text_view(batch.column(2)), strict=True)
                meta = _meta_view(batch.column(2), batch.column(3), batch.column(4))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(np.int32) for x in index], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in value], pa.list_(pa.float32())), pa.array(list(meta), pa.list_(pa.float64()))], names=["doc_id", "y", "index", "value", "meta"])

    views = _views(docs, id_col, text_col, lang_col, source_col).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text", "lang", "source")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, y int, index array<int>, value array<float>, meta array<double>"
    once = views.mapInArrow(lean(run), schema).groupBy("doc_id", "y").agg(F.min(F.struct("index", "value", "meta")).alias("x"))
    table = once.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(5)).alias("fold"), "x.*").toPandas()  # at most the sample's rows
    table = table.sort_values("doc_id", kind="stable").reset_index(drop=True)
    y = table["y"].to_numpy(dtype=np.int64)
    meta = np.stack(table["meta"].to_list()) if len(table) else np.empty((0, len(_NUMBERS) + 2))
    if len({*y.tolist()}) < 2:
        model = train([], meta[:0], y[:0], y[:0] > 0, rounds=0)
        model.prior, model.both = 0.0, (1.0, 1.0, 0.0)
        return model
    held_out = table["fold"].to_numpy() == 0
    blocks = _blocks(docs, known, id_col, text_col, lang_col, source_col)
    model = train(list(zip(table["index"], table["value"], strict=True)), meta, y, held_out, blocks)
    dropped(blocks)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept for every row.

    p_text and p_meta are the calibrated chances that a document is good by either view, score that by both, with weights
    calibrated on held-out labels; kept is score >= least.  Null and empty texts have no text view, so p_text is the share
    of good labels.  Repeated rows are scored alike; null ids stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parts = list(_text_view(batch.column(1)))
                some = np.array([len(x[0]) > 0 for x in parts])
                by_text = np.where(some, m.text.logit(*_rows(parts)), m.prior)
                by_meta = m.meta.logit(*m.meta_rows(_meta_view(*(batch.column(i) for i in (1, 2, 3)))))
                both = m.together(by_text, by_meta)
                p = [1 / (1 + np.exp(-z)) for z in (by_text, by_meta, both)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in p), pa.array(p[2] >= least)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, p_text double, p_meta double, score double, kept boolean"
    return _views(docs, id_col, text_col, lang_col, source_col).mapInArrow(lean(run), schema)
