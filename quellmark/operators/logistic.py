"""L2-regularised logistic models over hashed bins, fitted side by side in full passes over the rows.

The objective is 1/2 |w|^2 + C * sum of class weight * log loss over all rows, the bias being the weight of a bin that every row has, and
so regularised as well. The rows are written once, in blocks that tell a text by its words and the words by their bins. One pass sends the weights of all models that are
still fitted (at most 65,537 numbers each) to the partitions, which send back their gradients, summed in blocks of bins where there are
many; each model takes its own limited-memory quasi-Newton steps on the driver until its gradient is small, however many passes that takes.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellmark.functions.features import BINS, SHAPES, distinct, each, hashed_sets, word_parts, words
from quellmark.functions.text import nfkc_text
from quellmark.runtime import Workspace

#: Weight of a feature, and the accuracy of the fit (of the first gradient's length).
BIAS, EPSILON = 1.0, 1e-8
#: Steps that the curvature is taken from (of one model, of all together), blocks that a gradient is summed in, and rows whose bins are gathered at once.
MEMORY, MEMORIES, BLOCKS, CHUNK = 300, 440, 16, 256
#: Rows and bins at which a block ends, and values that stay in a core's cache.
HELD, LONG, CACHED = 32_768, 16_000_000, 65_536
#: Share of a row's cost that foretells its curvature near the optimum, where most rows are told well.
CURVED = 3e-4
_SIZE = BINS + 1


@dataclass(frozen=True)
class Setting:
    """Cost C, class weights N / (2 * N_c) or none, and values of bins other than 1 (an index, as ratios are shared)."""

    cost: float = 1.0
    balanced: bool = False
    scaled: bool = False


def minimised(accuracy: float = EPSILON, scale: np.ndarray | None = None, memory: int = MEMORY) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as a dialogue: yields points, is sent (value, gradient) there, returns the minimum. Steps are taken in units of `scale` per weight."""
    scale = np.ones(_SIZE) if scale is None else scale
    x = np.zeros(_SIZE)
    value, slope = yield x
    small = accuracy * max(np.linalg.norm(slope), 1e-30)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    while np.linalg.norm(slope) > small:
        step, kept = -slope * scale, []
        for s, y, sy in reversed(past):
            a = (s @ step) / sy
            step -= a * y
            kept.append((a, s, y, sy))
        if past:
            s, y, sy = past[-1]
            step *= sy / (y @ y)
        for a, s, y, sy in reversed(kept):
            step += s * (a - (y @ step) / sy)
        step *= scale
        down = slope @ step
        length = 1.0 if past else min(1.0, 1.0 / np.linalg.norm(slope))
        for _ in range(30):
            other, (new, turned) = x + length * step, (yield x + length * step)
            if new <= value + 1e-4 * length * down:
                break
            length /= 2
        else:
            return x
        s, y = (other - x) / scale, (turned - slope) * scale
        if s @ y > 1e-12 * (y @ y):
            past.append((s, y, s @ y))
        if value - new <= 1e-15 * abs(value):
            return other
        x, value, slope = other, new, turned
    return x


class Block(NamedTuple):
    """Some rows of one label each, as sums: a row is its entries less the bins that these have too often.

    Numbers below BINS are bins; then come the stems of the block, which are some bins each, and the words, which are some stems and bins.
    """

    toxic: np.ndarray
    lengths: np.ndarray
    entries: np.ndarray
    spare_lengths: np.ndarray
    spare: np.ndarray
    word_lengths: np.ndarray
    word_bins: np.ndarray
    stem_lengths: np.ndarray
    stem_bins: np.ndarray


_KINDS = Block(*map(np.dtype, ("?", "<i4", "<i4", "<i4", "<u2", "<i4", "<i4", "<i4", "<u2")))
_BLOCK = ", ".join(f"{name} binary" for name in Block._fields)


def packed(lengths: np.ndarray, bins: np.ndarray, toxic: np.ndarray, texts: list[str | None] | None) -> Block:
    """The rows with these bins, written by the words of their texts: a word stands for all bins that it has by itself, once for each text that holds it.

    Whatever the words are, entries less spare ones are the bins of the row.
    """
    count = len(lengths)
    codes: dict[str, int] = {}
    held = [{codes.setdefault(w, len(codes)) for w in words(t)} for t in texts] if texts else [()] * count
    word_lengths, word_bins = hashed_sets(list(codes), SHAPES["word_char_35"])
    sizes = np.fromiter(map(len, held), np.int64, count)
    code, row = np.fromiter(chain.from_iterable(held), np.int64, sizes.sum()), np.repeat(np.arange(count), sizes)
    starts = np.cumsum(word_lengths) - word_lengths
    new, spare = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends, told = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(sizes))
    for a in range(0, count, CHUNK):
        b = min(a + CHUNK, count)
        part = code[told[a] : told[b]]
        own = word_lengths[part]
        said = np.repeat(row[told[a] : told[b]], own) << 16 | word_bins[each(starts[part], own)]
        rest = np.repeat(np.arange(a, b), lengths[a:b]) << 16 | bins[ends[a] : ends[b]]
        keys = np.sort(np.concatenate([said << 1, rest << 1 | 1]))
        if not len(keys):
            continue
        first = np.flatnonzero(np.append(True, keys[1:] >> 1 != keys[:-1] >> 1))
        last = np.append(first[1:], len(keys))
        missing = 2 * (keys[last - 1] & 1) - (last - first)  # 1 if no word has it, below 0 if words have it too often
        keys = keys[first] >> 1
        new.append(keys[missing > 0])
        spare.append(np.repeat(keys[missing < 0], -missing[missing < 0]))
    new, spare = np.concatenate(new), np.concatenate(spare)
    whose = np.concatenate([row, new >> 16])
    order = np.argsort(whose, kind="stable")
    entries = np.concatenate([BINS + code, new & 0xFFFF])[order]
    none = np.zeros(0, np.int64)
    return Block(toxic, np.bincount(whose, minlength=count), entries, np.bincount(spare >> 16, minlength=count), spare & 0xFFFF, word_lengths, word_bins, none, none)


def told(texts: list[str | None], toxic: np.ndarray) -> Block:
    """What `packed` makes of texts and their `word_char_35` bins, without writing these down for each text."""
    count = len(texts)
    found = word_parts([nfkc_text(t).lower() if t else "" for t in texts])
    held = distinct(found.text << 32 | found.code)
    row, code = held >> 32, held & 0xFFFFFFFF
    starts = np.cumsum(found.sizes) - found.sizes
    ends, paired = np.searchsorted(row, np.arange(count + 1)), np.searchsorted(found.pair_text, np.arange(count + 1))
    new, spare = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, count, CHUNK):
        b = min(a + CHUNK, count)
        part, pairs = slice(ends[a], ends[b]), slice(paired[a], paired[b])
        own = found.sizes[code[part]]
        said = np.repeat(((row[part] - a) << 17).astype(np.uint32), own) | found.bins[each(starts[code[part]], own)] << 1
        rest = ((found.pair_text[pairs] - a) << 17 | found.pair_bins[pairs] << 1 | 1).astype(np.uint32)
        keys = np.sort(np.concatenate([said, rest]))  # a bin's words before its pairs
        again = np.append(False, keys[1:] >> 1 == keys[:-1] >> 1)
        pair = (keys & 1).astype(bool)
        new.append((keys[pair & ~again] >> 1) + (a << 16))
        spare.append((keys[~pair & again] >> 1) + (a << 16))
    new, spare = np.concatenate(new).astype(np.int64), np.concatenate(spare).astype(np.int64)
    words_of, pairs_of = np.bincount(row, minlength=count), np.bincount(new >> 16, minlength=count)
    lengths = words_of + pairs_of
    begin = np.cumsum(lengths) - lengths
    entries = np.empty(len(code) + len(new), np.int64)
    entries[each(begin, words_of)] = BINS + len(found.stem_sizes) + code
    entries[each(begin + words_of, pairs_of)] = new & 0xFFFF
    return Block(toxic, lengths, entries, np.bincount(spare >> 16, minlength=count), spare & 0xFFFF, found.sizes_in_stems, found.stems, found.stem_sizes, found.stem_bins)


def _written(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(block, _KINDS)], list(Block._fields))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (text, toxic), one a row."""
    texts: list[str | None] = []
    toxic: list[bool] = []
    size = 0
    for whole in batches:
        for a in range(0, len(whole), CHUNK):
            batch = whole.slice(a, CHUNK)
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
            size += sum(len(t or "") for t in texts[-len(batch) :])
            if len(texts) >= HELD or size >= LONG:
                yield _written(told(texts, np.array(toxic)))
                texts, toxic, size = [], [], 0
    if texts:
        yield _written(told(texts, np.array(toxic)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (bins, toxic) or (bins, toxic, text), one a row."""
    parts: list[tuple] = []

    def block() -> pa.RecordBatch:
        lengths, bins, toxic, texts = zip(*parts)
        found = packed(np.concatenate(lengths), np.concatenate(bins), np.concatenate(toxic), list(chain.from_iterable(texts)) if texts[0] is not None else None)
        parts.clear()
        return _written(found)

    for whole in batches:
        for a in range(0, len(whole), CHUNK):
            batch = whole.slice(a, CHUNK)
            bins, toxic = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            parts.append((np.diff(bins.offsets.to_numpy()).astype(np.int64), bins.flatten().to_numpy().astype(np.int64), toxic, texts))
            if sum(len(p[0]) for p in parts) >= HELD or sum(len(p[1]) for p in parts) >= LONG:
                yield block()
    if parts:
        yield block()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(len(batch)):
            found = Block(*(np.frombuffer(batch.column(i)[k].as_buffer(), kind) for i, kind in enumerate(_KINDS)))
            # numpy looks up and counts by whole machine words, and would widen the numbers again for every model
            yield Block(found.toxic, *(x.astype(np.int64) for x in found[1:]))


def _sums(values: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of the values at each row's places, few enough rows at a time to stay in a core's cache."""
    out = np.zeros(len(lengths), values.dtype)
    ends = np.append(0, np.cumsum(lengths))
    step = max(1, CACHED * len(lengths) // max(1, len(index)))
    for a in range(0, len(lengths), step):
        part = lengths[a : a + step]
        some = np.flatnonzero(part)
        if len(some):
            out[a + some] = np.add.reduceat(np.take(values, index[ends[a] : ends[a + len(part)]], mode="clip"), ends[a + some] - ends[a])
    return out


def _columns(block: Block) -> list[np.ndarray]:
    """The first, second and third bins of the stems; those of most bins come first."""
    return np.split(block.stem_bins, np.cumsum([np.count_nonzero(block.stem_lengths >= n) for n in (1, 2)]))


def scored(block: Block, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's bins and of the bias."""
    known = weights[:BINS]
    if len(block.stem_lengths):
        first, *more = _columns(block)
        stems = np.take(weights, first)
        for column in more:
            stems[: len(column)] += np.take(weights, column)
        known = np.concatenate([known, stems])
    if len(block.word_lengths):
        known = np.concatenate([known, _sums(known, block.word_bins, block.word_lengths)])
    score = weights[BINS] * BIAS + _sums(known, block.entries, block.lengths)
    return score - _sums(weights, block.spare, block.spare_lengths) if len(block.spare) else score


def summed(block: Block, values: np.ndarray) -> np.ndarray:
    """The sum per bin of the values of the rows that have it, and behind them the sum for the bias."""
    stems, words_ = len(block.stem_lengths), len(block.word_lengths)
    every = np.bincount(block.entries, np.repeat(values, block.lengths), BINS + stems + words_)
    if words_:
        every, own = every[: BINS + stems], every[BINS + stems :]
        every += np.bincount(block.word_bins, np.repeat(own, block.word_lengths), len(every))
    if stems:
        every, own = every[:BINS], every[BINS:]
        every += np.bincount(block.stem_bins, np.concatenate([own[: len(c)] for c in _columns(block)]), BINS)
    out = np.append(every, values.sum() * BIAS)
    if len(block.spare):
        out[:BINS] -= np.bincount(block.spare, np.repeat(values, block.spare_lengths), BINS)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: bytes of the documents per label and bin, behind them those per label."""
    out = np.zeros((2, _SIZE), np.int64)
    for block in _blocks(batches):
        for label in (0, 1):
            out[label] += np.rint(summed(block, (block.toxic == label).astype(float))).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "sums"])


def _files(spark, path: str) -> list[str]:
    """The files of a table, the largest first, if they lie in a mounted folder, else none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        return []
    found = [(-f.getLen(), f.getPath().toUri().getPath()) for f in system.listStatus(target) if f.getPath().getName().endswith(".parquet")]
    return [name for _, name in sorted(found)]


def _opened(run, files: list[str], cores: int):
    """`run` on the rows of every `cores`-th file from the one whose number comes in."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pq.ParquetFile(name) for batch in batches for first in batch.column(0).to_pylist() for name in files[first::cores])
        yield from run(part for found in tables for k in range(found.num_row_groups) for part in found.read_row_group(k, use_threads=False).to_batches())

    return opened


class Rows:
    """The labelled rows of (bins, label), (bins, label, text) or (label, text), written once as every pass reads them; rows without bins or with another label are left out.

    Texts alone stand for their bins of `word_char_35`, a null one for none. With their texts, rows of `word_char_35` take about a third of the entries, as bins of a word that many texts share are written once per block.
    Where the shared folder is a mounted one, the Python workers read its files themselves, which spares each pass the way through the JVM. `counts` [label, bin] has the documents per bin, the last one being the bias, which all rows have.
    """

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.work = Workspace(spark, "logistic")
        text = [c for c in ("text",) if c in rows.columns]
        used, toxic = rows.where("label in ('toxic', 'clean')"), (F.col("label") == "toxic").alias("toxic")
        self.path = f"{self.work.root}/rows"
        if "bins" in rows.columns:
            blocks = used.where("bins is not null").select(F.col("bins").cast("array<int>").alias("bins"), toxic, *text).mapInArrow(_packed, _BLOCK)
        else:
            blocks = used.select("text", toxic).mapInArrow(_told, _BLOCK)
        blocks.write.option("compression", "none").parquet(self.path)  # read again in every pass
        self.cores = spark.sparkContext.defaultParallelism
        self.files = _files(spark, self.path)
        if self.files:
            parts = min(self.cores, len(self.files))
            self.read = spark.range(0, parts, 1, parts)
        else:
            # a core sums all its rows before it sends anything, so a pass sends one gradient per core, however many files there are
            self.read = spark.read.schema(_BLOCK).parquet(self.path).coalesce(self.cores)
        found = self.over(_counted).toLocalIterator()
        self.counts = sum((np.frombuffer(r["sums"], np.int64).reshape(2, _SIZE) for r in found), np.zeros((2, _SIZE), np.int64))

    def over(self, run) -> DataFrame:
        """(block, sums) of what `run` makes of the batches of each core."""
        return self.read.mapInArrow(_opened(run, self.files, self.cores) if self.files else run, "block int, sums binary")

    def drop(self) -> None:
        target = self.work.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.work.spark._jsc.hadoopConfiguration()).delete(target, True)


def _pass(points, costs: np.ndarray):
    """Values and gradients of the loss of every point, (block, values) per partition; `points` has a `value` or is the name of a file; `costs` [setting, label]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.load(points) if isinstance(points, str) else points.value
        total = np.zeros(weights.shape)
        loss = np.zeros(len(weights))
        for block in _blocks(batches):
            sign, label = np.where(block.toxic, 1.0, -1.0), block.toxic.astype(int)
            score = np.zeros((len(weights) + 1, len(sign)))
            for k in range(0, len(weights), 2):
                # two models are looked up at once, as parts of complex numbers
                two = scored(block, weights[k] + 1j * weights[k + 1] if k + 1 < len(weights) else weights[k])
                score[k], score[k + 1] = two.real, two.imag
            for k in range(len(weights)):
                margin = sign * score[k]
                cost = costs[k][label]
                loss[k] += (cost * np.logaddexp(0, -margin)).sum()
                total[k] += summed(block, -cost * sign / (1 + np.exp(np.minimum(margin, 500))))
        bounds = np.linspace(0, _SIZE, BLOCKS + 1).astype(int)
        blobs = [total[:, a:b].tobytes() for a, b in zip(bounds, bounds[1:])] + [loss.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS + 1), pa.int32()), pa.array(blobs, pa.binary())], ["block", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(blob)
            sums[block] = sums[block] + own if block in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])


def _left(run, folder: str):
    """`run`, its sums left in a file of the mounted folder, whose name is sent: megabytes from each core go through the JVM many times slower."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            name = f"{folder}/{uuid.uuid4().hex}.sums"
            with open(name, "wb") as out:
                for blob in batch.column(1):
                    out.write(blob.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([name.encode()], pa.binary())], ["block", "sums"])

    return left


def _passed(own: Rows, points: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and gradients of the loss at the points, over all rows."""
    few = own.cores <= BLOCKS
    bounds = np.linspace(0, _SIZE, BLOCKS + 1).astype(int)
    if own.files and few:
        folder = os.path.dirname(os.path.dirname(own.files[0]))
        name = f"{folder}/{uuid.uuid4().hex}.npy"
        np.save(name, points)
        whole = np.zeros(points.size + len(points))
        for r in own.over(_left(_pass(name, costs), folder)).collect():  # one name per core
            found = r["sums"].decode()
            whole += np.fromfile(found)
            os.remove(found)
        os.remove(name)
        ends = np.append(bounds * len(points), len(whole))
        parts = [whole[a:b] for a, b in zip(ends, ends[1:])]
    else:
        shared = own.work.spark.sparkContext.broadcast(points)
        sent = own.over(_pass(shared, costs))
        if not few:  # fewer gradients are summed on the driver
            sent = sent.repartition(BLOCKS, "block").mapInArrow(_added, "block int, sums binary")
        sums: dict[int, np.ndarray] = {}
        for r in sent.collect():
            part = np.frombuffer(r["sums"])
            sums[r["block"]] = sums[r["block"]] + part if r["block"] in sums else part
        shared.destroy()
        parts = [sums[b] for b in range(BLOCKS + 1)]
    return parts[BLOCKS], np.concatenate([p.reshape(len(points), -1) for p in parts[:BLOCKS]], 1)


def fit(rows: DataFrame | Rows, settings: list[Setting], ratios: np.ndarray | None = None, accuracy: float = EPSILON) -> list[np.ndarray]:
    """The weights of every setting (the last one is the bias) on rows of (bins, label); `ratios` are the values of bins in scaled settings.

    Rows without a label are left out. A class that has no rows raises ValueError. All settings share each pass; passes go on until the
    last of them is as accurate as asked for.
    """
    own = rows if isinstance(rows, Rows) else Rows(rows)
    counts = own.counts[:, BINS]
    if not counts.all():
        raise ValueError("rows of both labels are needed")
    costs = np.array([[s.cost * (counts.sum() / (2 * counts[c]) if s.balanced else 1.0) for c in (0, 1)] for s in settings])
    plain = np.ones(_SIZE)
    shared = plain if ratios is None else np.append(ratios, 1.0)
    values = [shared if s.scaled else plain for s in settings]
    memory = max(5, min(MEMORY, MEMORIES // len(settings)))
    talks = [minimised(accuracy, 1 / np.sqrt(1 + CURVED * (c @ own.counts) * v * v), memory) for c, v in zip(costs, values)]
    asked: dict[int, np.ndarray] = {k: next(t) for k, t in enumerate(talks)}
    out: dict[int, np.ndarray] = {}
    while asked:
        order = list(asked)
        loss, slope = _passed(own, np.stack([asked[k] * values[k] for k in order]), costs[order])
        for i, k in enumerate(order):
            x = asked.pop(k)
            try:
                asked[k] = talks[k].send((loss[i] + 0.5 * x @ x, slope[i] * values[k] + x))
            except StopIteration as done:
                out[k] = done.value
    if own is not rows:
        own.drop()
    return [out[k] for k in range(len(settings))]


def blended(weights: np.ndarray, ratios: np.ndarray, active: np.ndarray, beta: float = 1.0) -> np.ndarray:
    """Weights of a model fitted on bins scaled by naive Bayes ratios: (1 - beta) * mean |w| + beta * w of the kept bins, times the ratio; 0 for other bins."""
    out = np.zeros(_SIZE)
    if len(active):
        out[active] = ((1 - beta) * np.abs(weights[active]).mean() + beta * weights[active]) * ratios[active]
    out[BINS] = weights[BINS]
    return out
