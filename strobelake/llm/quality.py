"""Quality by co-training: one classifier sees the words of a text, the other its record alone.

The record view is a naive Bayes classifier over language, source and stated length, and never sees
the text. The text view is a logistic model over counts of signs, cases and repetition
and over a naive Bayes score of the hashed words, the words learned from other labelled rows
than the model. In each round every document without a training
label is scored by both views; each view's surest ones of either label, as many as a share of
all, taken by a cut in a histogram of its calibrated scores and never under ``SURE``, teach the other
view: their marks are counted, and their gradients and Hessians summed for one Newton step. Views
are calibrated on labelled rows that neither learns from, so that a view that tells little
teaches nothing; in the end a logistic model combines
them on further labelled rows of its own, and every document is scored.

Labelled rows are a sample of at most ``MAX_TRAIN_ROWS``, chosen by the hash of their
doc_id; what is taken from unlabelled documents covers all of them, in sums of fixed size, and
weighs at most ``WEIGHT`` of what the labelled rows weigh, so that it works alike at every size.

Defined cases: a null text counts as empty, as one without words; null lang, source or n_chars are values of
their own; labels that are null, held out or without document are not used; a
doc_id labelled twice counts as bad if any label does; rows that repeat a labelled doc_id all
teach, and calibrate as one, by the least of their scores; scores that tie fall in one bin and
are taken together or not at all; very long texts are read whole; without labels of both kinds
every score is the share of good ones (0.5 without any); an empty table gives an empty result; columns other
than doc_id, text, lang, source and n_chars are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import materialize, release, table
from strobelake.llm.decontaminate import word_codes
from strobelake.llm.pieces import distinct_pieces, joined, text_blocks
from strobelake.llm.toxicity import fit_logistic, held_out

MAX_TRAIN_ROWS = 10_000
#: Rounds, and the share of all unlabelled documents that each view labels in the first round, twice that in the second, and so on.
ROUNDS, EACH_ROUND = 3, 0.05
BLOCK_BYTES = 2_000_000
_SIGNS = b"%&$*#|!?\".,:;-=+_<>{}[]()/\\@"
#: Hashed words and counts of the text view; of the record view hashed languages, sources and both, then bins of n_chars.
WORDS, COUNTS = 1 << 16, 38
LANGS, SOURCES = 1 << 10, 1 << 12
RECORD_MARKS = LANGS + 2 * SOURCES + 66
#: Bins of the histogram of logits and the greatest one it tells apart; the least logit that labels; added to each count of a mark.
CUTS, REACH, SURE, PRIOR = 4000, 20.0, 2.0, 1.0
#: What all new labels of a view weigh at most against its labelled rows, and the ridge of the text view.
WEIGHT, RIDGE = 0.25, 1.0


def text_view(texts: list[bytes]) -> np.ndarray:
    """Shares of signs, cases and repeated words in each text."""
    data, bounds = joined(texts)
    rows = len(texts)
    size = np.maximum(np.diff(bounds), 1)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    count = lambda mask: np.bincount(owner[mask], minlength=rows).astype(float)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(begins)
    finishes = ~blank
    finishes[:-1] &= blank[1:] | (owner[1:] != owner[:-1])
    ends = np.flatnonzero(finishes) + 1
    words = count(begins)
    n = np.maximum(words, 1)
    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    columns = [np.log1p(words), upper / np.maximum(upper + lower, 1), count((data >= 48) & (data <= 57)) / size, count(data >= 128) / size, (size - count(blank)) / n]
    histogram = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256)
    columns += [np.minimum(histogram[:, c] / n, 3) for c in _SIGNS]
    distinct, top, again = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    if len(starts):
        index, wanted = distinct_pieces(data, starts, ends)
        whose = owner[starts]
        _, first, times = np.unique(whose.astype(np.int64) * len(wanted) + index, return_index=True, return_counts=True)
        distinct = np.bincount(whose[first], minlength=rows).astype(float)
        np.maximum.at(top, whose[first], times)
        same = np.flatnonzero((index[1:] == index[:-1]) & (whose[1:] == whose[:-1]))
        again = np.bincount(whose[1:][same], minlength=rows).astype(float)
    columns += [distinct / n, distinct / np.sqrt(n), top / n, again / n, words == 0]
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)


def word_marks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed distinct words of all texts one after another, bounds of the texts in them)."""
    codes, bounds = word_codes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    words = np.unique(owner * WORDS + (codes % np.uint64(WORDS)).astype(np.int64))
    return words % WORDS, np.append(0, np.cumsum(np.bincount(words // WORDS, minlength=len(texts))))


def record_marks(langs: list, sources: list, chars: list) -> np.ndarray:
    """Four marks of each record: language, source, both, and the size of n_chars."""
    code = lambda x, kind: zlib.crc32(b"" if x is None else kind + str(x).encode("utf-8", "replace"))
    out = np.zeros((len(langs), 4), dtype=np.int64)
    for row, (lang, source, n) in enumerate(zip(langs, sources, chars)):
        a, b = code(lang, b"l"), code(source, b"s")
        size = 65 if n is None else 64 if n < 0 else int(n).bit_length()
        out[row] = a % LANGS, LANGS + b % SOURCES, LANGS + SOURCES + (31 * a + b) % SOURCES, LANGS + 2 * SOURCES + size
    return out


@dataclass
class Features:
    """Of some documents: their words, one after another with the bounds of each, their counts and their record marks."""

    words: np.ndarray
    bounds: np.ndarray
    counts: np.ndarray
    record: np.ndarray


def word_scores(weights: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the words' weights over the root of their number."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(owner, weights=weights[words], minlength=len(bounds) - 1) / np.sqrt(np.maximum(np.diff(bounds), 1))


def log_odds(bad: np.ndarray, good: np.ndarray, bads: float, goods: float) -> np.ndarray:
    """Each mark's weight, from how many bad and good documents have it."""
    return np.log((good + PRIOR) / (goods + 2 * PRIOR)) - np.log((bad + PRIOR) / (bads + 2 * PRIOR))


def sure(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of words, of counts (standardised) and the words' score with a constant, and of record marks; each view's (slope, shift); how they combine."""

    words: np.ndarray | None = None
    record: np.ndarray | None = None
    prior: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    text: np.ndarray | None = None
    scales: list[tuple[float, float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def inputs(self, x: Features) -> np.ndarray:
        """What the text view's logistic model takes."""
        return np.hstack([np.clip((x.counts - self.mean) / self.spread, -8, 8), word_scores(self.words, x.words, x.bounds)[:, None], np.ones((len(x.counts), 1))])

    def raw(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """Each view's own logit."""
        return self.inputs(x) @ self.text, self.record[x.record].sum(axis=1) + self.prior

    def logits(self, raw: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        return [np.clip(slope * z + shift, -12, 12) for z, (slope, shift) in zip(raw, self.scales)]

    def scores(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, record view, both) of each document."""
        if self.text is None:
            flat = np.full(len(x.record), sure(self.bias))
            return flat, flat, flat
        a, b = self.logits(self.raw(x))
        return sure(a), sure(b), sure(self.weights[0] * a + self.weights[1] * b + self.bias)


def _records(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Features]]:
    langs, sources, chars = (batch.column(k).to_pylist() for k in (2, 3, 4))
    for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
        yield low, high, Features(*word_marks(texts), text_view(texts), record_marks(langs[low:high], sources[low:high], chars[low:high]))


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


_MARKS = ("words", "counts", "record")


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, label, fold, words, counts, record) of (doc_id, text, lang, source, n_chars, label, fold)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, x in _features(batch):
                some = batch.slice(low, high - low)
                rows = np.arange(len(x.record) + 1)
                lists = [_lists(x.words.astype(np.int32), x.bounds), _lists(x.counts.ravel().astype(np.float32), COUNTS * rows), _lists(x.record.ravel().astype(np.int32), 4 * rows)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(5), some.column(6), *lists], names=["doc_id", "label", "fold", *_MARKS])
        release()

    return docs.mapInArrow(run, "doc_id long, label int, fold int, words array<int>, counts array<float>, record array<int>")


def _read(batch: pa.RecordBatch, at: int) -> Features:
    words, counts, record = (batch.column(at + k) for k in range(3))
    bounds = words.offsets.to_numpy().astype(np.int64)
    return Features(words.flatten().to_numpy(), bounds - bounds[0], counts.flatten().to_numpy().astype(np.float64).reshape(-1, COUNTS), record.flatten().to_numpy().reshape(-1, 4))


def _sums(rows: DataFrame, columns: list[str], size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all rows of what ``add`` adds to an array of ``size`` numbers: one array a task, summed by place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = rows.select(*columns).mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _given(model: Model, x: Features, cuts: list[tuple[float, float]]) -> list[np.ndarray]:
    """The labels (1, 0, or -1 for none) that each view gives."""
    return [np.where(z >= high, 1, np.where(z <= low, 0, -1)) for z, (low, high) in zip(model.logits(model.raw(x)), cuts)]


def _count(rows: DataFrame, model: Model | None, cuts: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bad and good documents by word, by record mark, and in all for the text view and for the record view: by label, or by what the other view gives."""
    size = WORDS + RECORD_MARKS + 2

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x = _read(batch, 1)
        by_text = by_record = batch.column(0).fill_null(-1).to_numpy()
        if model is not None:
            by_text, by_record = _given(model, x, cuts)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(x.bounds))
        for y, part in enumerate(total.reshape(2, size)):
            part[:WORDS] += np.bincount(x.words[by_record[owner] == y], minlength=WORDS)
            part[WORDS:-2] += np.bincount(x.record[by_text == y].ravel(), minlength=RECORD_MARKS)
            part[-2:] += (by_record == y).sum(), (by_text == y).sum()

    out = _sums(rows, ["label", *_MARKS], 2 * size, add).reshape(2, size)
    return out[:, :WORDS], out[:, WORDS:-2], out[:, -2], out[:, -1]


def _newton_terms(rows: DataFrame, teacher: Model, cuts: list[tuple[float, float]], model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient, Hessian, documents) of the text view's likelihood over what the teacher's record view labels."""
    d = COUNTS + 2

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x = _read(batch, 0)
        given = _given(teacher, x, cuts)[1]
        z = model.inputs(x)[given >= 0]
        p = sure(z @ model.text)
        total[:d] += z.T @ (given[given >= 0] - p)
        total[d : d + d * d] += (z.T @ (z * (p * (1 - p))[:, None])).ravel()
        total[-1] += len(z)

    out = _sums(rows, list(_MARKS), d + d * d + 1, add)
    return out[:d], out[d:-1].reshape(d, d), out[-1]


def _surest(rows: DataFrame, model: Model, share: float, good: float) -> list[tuple[float, float]]:
    """For each view the scores up to which and from which documents are its surest bad and good ones: ``share`` of all, good ones as often as ``good``, and sure enough."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for part, z in zip(total.reshape(2, CUTS), model.logits(model.raw(_read(batch, 0)))):
            part += np.bincount(_bin(z), minlength=CUTS)

    return [cut_scores(own, share, good) for own in _sums(rows, list(_MARKS), 2 * CUTS, add).reshape(2, CUTS)]


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + REACH) * (CUTS / (2 * REACH))), 0, CUTS - 1).astype(np.int64)


def cut_scores(counts: np.ndarray, share: float, good: float) -> tuple[float, float]:
    """Whole bins from either end while they hold no more than asked for and are by ``SURE`` beyond both zero and the logit of ``good``, which says nothing of a document."""
    step, prior = 2 * REACH / CUTS, np.log(good / (1 - good))
    low, high = (max(0, round((REACH - SURE - far) / step)) for far in (max(0.0, -prior), max(0.0, prior)))
    low = int(np.searchsorted(np.cumsum(counts[:low]), share * (1 - good) * counts.sum(), side="right"))
    high = int(np.searchsorted(np.cumsum(counts[::-1][:high]), share * good * counts.sum(), side="right"))
    return np.nextafter(low * step - REACH, -np.inf) if counts[:low].any() else -np.inf, (CUTS - high) * step - REACH if counts[CUTS - high :].any() else np.inf


def _newton(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text view's weights on labelled rows, and the Hessian there with its ridge."""
    weights, bias = fit_logistic(x[:, :-1], y, ridge=RIDGE)
    w = np.append(weights, bias)
    p = sure(x @ w)
    return w, x.T @ (x * (p * (1 - p))[:, None]) + np.diag([RIDGE] * (x.shape[1] - 1) + [1e-6])


def co_train(rows: DataFrame, rounds: int = ROUNDS, share: float = EACH_ROUND) -> Model | None:
    """Both views after ``rounds`` of labelling for each other, from rows of ``marks``; None without labels of both kinds to learn from."""
    words, record, n_words, n_record = _count(rows.where("fold = 0"), None, [])
    own = rows.where("fold = 1").select("doc_id", "label", *_MARKS).groupBy("doc_id").agg(F.min(F.struct("label", *_MARKS)).alias("r")).select("r.*")
    own = own.orderBy(F.xxhash64("words", "counts", "record")).toArrow().combine_chunks()  # at most MAX_TRAIN_ROWS rows
    batches = own.to_batches()
    y = own.column("label").to_numpy().astype(float)
    if not n_words.all() or len(set(y)) < 2:
        return None
    x = _read(batches[0], 1)
    mean, spread = x.counts.mean(axis=0), np.maximum(x.counts.std(axis=0), 1e-6)
    prior = float(np.log(n_record[1] / n_record[0]))

    def fitted(words: np.ndarray, record: np.ndarray, n_words: np.ndarray, n_record: np.ndarray) -> tuple[Model, np.ndarray]:
        model = Model(log_odds(*words, *n_words), log_odds(*record, *n_record), prior, mean, spread)
        model.text, hessian = _newton(model.inputs(x), y)
        return model, hessian

    trial = rows.where("fold = 2")
    model, _ = fitted(words, record, n_words, n_record)
    model = calibrate(model, *_logits(trial, model))
    rest, good = rows.where("label is null"), n_words[1] / n_words.sum()
    for turn in range(1, rounds + 1):
        cuts = _surest(rest, model, turn * share, good)
        more = _count(rest, model, cuts)
        weigh = lambda n, most: min(1.0, WEIGHT * most / n) if n else 0.0
        for_text, for_record = weigh(more[2].sum(), n_words.sum()), weigh(more[3].sum(), n_record.sum())
        after, hessian = fitted(words + for_text * more[0], record + for_record * more[1], n_words + for_text * more[2], n_record + for_record * more[3])
        gradient, curve, n = _newton_terms(rest, model, cuts, after)
        weight = weigh(n, len(y))
        step = np.linalg.solve(hessian + weight * curve, weight * gradient)
        after.text = after.text + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        model = calibrate(after, *_logits(trial, after))
    return model


def _logits(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(each view's own logits, labels) of labelled rows, one for each doc_id: at most MAX_TRAIN_ROWS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, model.raw(_read(batch, 2)))], names=["doc_id", "label", "a", "b"])

    seen = rows.select("doc_id", "label", *_MARKS).mapInArrow(run, "doc_id long, label int, a double, b double")
    seen = seen.groupBy("doc_id").agg(F.min(F.struct("a", "b", "label")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    return np.stack([seen.column(c).to_numpy() for c in ("a", "b")], axis=1), seen.column("label").to_numpy().astype(float)


def calibrate(model: Model, raw: np.ndarray, y: np.ndarray) -> Model:
    """Each view's slope and shift; a view that tells nothing gives all the share of good ones."""
    model.scales = []
    for k in (0, 1):
        slope, shift = fit_logistic(raw[:, k : k + 1], y) if len(set(y)) == 2 else ([1.0], 0.0)
        model.scales.append((float(slope[0]), float(shift)) if slope[0] > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))))
    return model


def combine(model: Model, raw: np.ndarray, y: np.ndarray) -> Model:
    """The weights of the views' calibrated logits."""
    model.weights, model.bias = [0.5, 0.5], 0.0
    if len(set(y)) == 2:
        weights, model.bias = fit_logistic(np.stack(model.logits((raw[:, 0], raw[:, 1])), axis=1), y)
        model.weights = weights.tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    own = named.groupBy("doc_id").agg((F.min("label") > 0).cast("int").alias("label"))
    chosen = own.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    parts = F.array(*[F.lit(k) for k in (0, 0, 1, 1, 2, 3)])  # to learn words and records from, to fit the text view, to calibrate, to combine
    chosen = chosen.withColumn("fold", F.get(parts, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(6)).cast("int")))
    rows = _records(docs).join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "label", "fold")  # max_rows bounds what is broadcast
    rows = materialize(marks(rows), "quality-marks")
    model = co_train(rows, rounds)
    if model is None:
        kinds = rows.where("label is not null").agg(F.avg("label")).first()[0]
        return Model(bias=0.0 if kinds is None else float(np.clip(np.log(max(kinds, 1e-9) / max(1 - kinds, 1e-9)), -12, 12)))

    return combine(model, *_logits(rows.where("fold = 3"), model))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, text_score, record_score, score, kept) for every row; scores are of good quality."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, x in _features(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, model.scores(x))], names=["doc_id", "text_score", "record_score", "score"])
        release()

    scored = _records(docs).mapInArrow(run, "doc_id long, text_score double, record_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "record_score", "score", (F.col("score") >= threshold).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
