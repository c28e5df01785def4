"""Toxicity: a learned lexicon trie, Levenshtein automata for misspelt terms, and context windows.

The lexicon (whole words and word stems) is chosen by its association with the toxic
label in a bounded sample of labelled training rows. A word matches a whole term within
one edit, and a stem within one edit of a beginning of the word: the word's Levenshtein
automaton, a pair of bit vectors over its positions, walks the lexicon trie, for a batch
of words at once. Words at one edit that clean training texts use themselves are no
misspellings, and an entry takes no edits where rare words at one edit from it, each in one
training text, are as typical of clean texts. The window around each hit tells quotation or report from abuse, and a
logistic model turns weighted, unquoted and quoted hits into a score.

Words of one or two letters are no terms. Of training rows with one label that share two of three
min-hashes of their three-word runs one stays, so that near copies count once; rows with
different labels never become one. The least association alone decides how many entries there are.

Defined cases: a null text counts as empty and gets the score of a text without
hits; bytes that are no UTF-8 count as U+FFFD; a null doc_id is not held out; rows that repeat are scored alike; labels that
are null or whose document is missing are ignored, a doc_id labelled twice counts
as toxic if any label does, one that has several texts teaches with the first in order; without labels of both kinds every score is the share of
toxic training rows (0 without any); of entries that are equally associated terms go before stems, longer before
shorter ones, then by their letters; very long texts are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import map_rows, materialize, release, table
from strobelake.llm.pieces import text_blocks

#: Training rows used at most, chosen by the hash of their doc_id.
MAX_TRAIN_ROWS = 12_000
STEM_LENGTHS = range(3, 9)
_WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
_QUOTES = re.compile("[\"“”„«»‟]")
#: Words that report what others said.
_REPORT = frozenset(("said", "says", "wrote", "writes", "called", "quote", "quoted", "quoting", "reported", "according", "cited", "dit", "écrit", "sagte", "schrieb", "zitat", "dijo", "escribió", "cita"))
WINDOW_WORDS, WINDOW_CHARS = 6, 80
FUZZY_WEIGHT = 0.7
#: Features of a text.
WIDTH = 9
#: When a shorter stem goes first: its toxic rows and its association against the longer one's.
WIDER_ROWS, WIDER_SHARE = 1.5, 0.5
#: Letters of the entries that an automaton of 64 bits reads.
AUTOMATON = 60
#: Words that a Python worker remembers, and bytes of text looked at together.
SEEN_WORDS, BLOCK_BYTES = 300_000, 2_000_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def one_edit(a: str, b: str) -> int:
    """0 for equal words, 1 for words at one edit, 2 beyond."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 1 if a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :] else 2


class Trie:
    """Terms and stems as nested dictionaries; the keys "" and "stem" hold the entry that ends there.

    A term takes whole words, a stem every word that begins with it; the entries ``strict`` without an edit.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), strict: Iterable[str] = ()):
        self.root: dict = {}
        terms = set(terms)
        self.terms, self.stems, self.strict = sorted(t for t in terms if len(t) <= AUTOMATON), frozenset(stems), frozenset(strict)
        self.long = sorted(terms.difference(self.terms))
        for entries, key in ((self.terms, ""), (sorted(self.stems), "stem")):
            for entry in entries:
                node = self.root
                for c in entry:
                    node = node.setdefault(c, {})
                node[key] = entry
        entries = [*self.terms, *self.stems]
        self.alphabet = sorted({c for t in entries for c in t})
        lengths = [len(t) for t in entries]
        self.low, self.high = (min(lengths) - 1, max(lengths) + 1) if lengths else (1, 0)

    def near(self, words: list[str]) -> Iterator[tuple[str, str, int]]:
        """(word, entry, edits) for every entry at no more than one edit from a word, or from a beginning of it for stems.

        Bit i of a state says that i letters of the word are read; r0 with no edit, r1
        with one at most. A letter of the trie advances both.
        """
        for entry in self.long:
            for word in words:
                if abs(len(word) - len(entry)) < 2 and (edits := one_edit(word, entry)) < 2 - (entry in self.strict):
                    yield word, entry, edits
        words = [w for w in words if self.low <= len(w) and (self.stems or len(w) <= self.high)]
        if not words or not self.high:
            return
        letters = np.array(words, dtype=f"<U{self.high}").view("<u4").reshape(len(words), self.high)
        powers = (1 << np.arange(self.high)).astype(np.int64)
        masks = {c: ((letters == ord(c)) @ powers) for c in self.alphabet}
        size = np.array([len(w) for w in words])
        ends = np.where(size <= self.high, 1 << np.minimum(size, self.high), 0).astype(np.int64)  # longer words end no term
        within = (2 << np.minimum(size, self.high)).astype(np.int64) - 1
        start = np.ones(len(words), dtype=np.int64)
        stack = [(self.root, np.arange(len(words)), start, (start | start << 1) & within)]
        while stack:
            node, at, r0, r1 = stack.pop()
            for c, below in node.items():
                if c in ("", "stem"):
                    wanted = within[at] if c else ends[at]
                    exact = (r0 & wanted) != 0
                    for k in at[exact].tolist():
                        yield words[k], below, 0
                    if below not in self.strict:
                        for k in at[((r1 & wanted) != 0) & ~exact].tolist():
                            yield words[k], below, 1
                    continue
                m = masks[c][at]
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1) | r0 | (r0 << 1) | n0 | (n0 << 1)
                n1 &= within[at]
                live = np.flatnonzero(n1)
                if len(live):
                    stack.append((below, at[live], n0[live], n1[live]))

    def within_one(self, words: list[str]) -> dict[str, tuple[str, int]]:
        """word -> (entry, edits): the fewest edits, then terms before stems, then the first entry."""
        found: dict[str, tuple[int, bool, str]] = {}
        for word, entry, edits in self.near(words):
            found[word] = min((edits, entry in self.stems, entry), found.get(word, (9, True, "")))
        return {word: (entry, edits) for word, (edits, _, entry) in found.items()}


@dataclass
class Model:
    """What scoring needs; small at any size of the corpus."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    usual: frozenset[str] = frozenset()
    strict: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0


class Scorer:
    """Finds hits and their features; remembers a bounded number of words."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], usual: frozenset[str] = frozenset(), strict: frozenset[str] = frozenset()):
        self.trie, self.weights, self.stems, self.usual = Trie(terms, stems, strict), {**stems, **terms}, stems, usual
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[float, float, bool]] = {}

    def learn(self, words: set[str]) -> None:
        """Keep (weight, share of a hit, is it by a stem) of the words that hit."""
        if len(self.seen) > SEEN_WORDS:
            self.seen.clear()
            self.hits.clear()
        fresh = [w for w in words - self.seen if len(w) > 2]
        self.seen |= words
        for word, (entry, edits) in self.trie.within_one(fresh).items():
            if edits == 0 or word not in self.usual:
                share = FUZZY_WEIGHT if edits else 1.0
                self.hits[word] = (self.weights[entry] * share, share, entry in self.stems)

    def features(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        out = np.zeros((len(texts), WIDTH))
        hits = self.hits
        for row, (text, words) in enumerate(zip(texts, split)):
            places = [i for i, w in enumerate(words) if w in hits]
            if not places:
                continue
            plain, quoted, stem, stems, stem_quoted, near = 0.0, 0.0, 0.0, 0.0, 0.0, 0
            lowered = text.lower()
            open_quote = len(_QUOTES.findall(lowered)) > 1
            starts = [m.start() for m in _WORD.finditer(lowered)] if open_quote else []
            for i in places:
                weight, share, is_stem = hits[words[i]]
                around = words[max(0, i - WINDOW_WORDS) : i + WINDOW_WORDS + 1]
                told = not _REPORT.isdisjoint(around)
                if open_quote:
                    before, after = lowered[max(0, starts[i] - WINDOW_CHARS) : starts[i]], lowered[starts[i] : starts[i] + WINDOW_CHARS]
                    told = told or bool(len(_QUOTES.findall(before)) % 2 and _QUOTES.search(after))
                near += "you" in around or "your" in around
                if not is_stem:
                    plain, quoted = (plain, quoted + weight) if told else (plain + weight, quoted)
                elif told:
                    stem_quoted += weight
                else:
                    stem, stems = stem + weight, stems + share
            n = len(words)
            out[row] = (math.log1p(plain), math.sqrt(plain / n), math.log1p(quoted), math.log1p(stems), math.log1p(stem), math.sqrt(stems / n), math.log1p(n) * (stems > 0), near > 0, math.log1p(stem_quoted))
        return out


def association(toxic: float, clean: float, toxic_rows: int, clean_rows: int) -> float:
    """Signed log-likelihood ratio of a term's presence."""
    total = toxic_rows + clean_rows
    g = 0.0
    for a, rows in ((toxic, toxic_rows), (clean, clean_rows)):
        for seen, share in ((a, (toxic + clean) / total), (rows - a, 1 - (toxic + clean) / total)):
            if seen > 0 and share > 0:
                g += 2 * seen * math.log(seen / (rows * share))
    return g if toxic * clean_rows > clean * toxic_rows else -g


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, toxic, clean): in how many texts of each label a word or stem occurs; summed within a task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in words_of(text) if len(w) > 2}
            terms = {"w" + w for w in words}
            terms.update("s" + w[:n] for w in words for n in STEM_LENGTHS if len(w) > n)
            counts[bool(label)].update(terms)
    terms = [t for t in counts[1] | counts[0]]
    for at in range(0, len(terms), 50_000):
        some = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in some], pa.string()), pa.array([t[1:] for t in some], pa.string()), pa.array([counts[1][t] for t in some], pa.int64()), pa.array([counts[0][t] for t in some], pa.int64())], names=["kind", "term", "toxic", "clean"])


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three min-hashes of three-word runs, by which copies in the sample are found."""
    for batch in batches:
        lows: list[list[int]] = [[], [], []]
        for text in batch.column(2).to_pylist():
            words = text.lower().split()
            runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            for seed in range(3):
                lows[seed].append(min(xxhash.xxh64_intdigest(r, seed) for r in runs) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in lows)], names=["doc_id", "toxic", "text", "m0", "m1", "m2"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(toxic, text) of at most ``max_rows`` labelled documents that are not held out, copies left out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # max_rows bounds what is broadcast
    sketched = rows.mapInArrow(_sketch, "doc_id long, toxic int, text string, m0 long, m1 long, m2 long")
    for pair in (("m0", "m1"), ("m0", "m2"), ("m1", "m2")):
        first = F.min(F.struct("doc_id", "toxic", "text", "m0", "m1", "m2"))
        sketched = sketched.groupBy(*[F.col(m).alias(f"k{m}") for m in pair], (F.col("toxic") > 0).alias("label")).agg(first.alias("r")).select("r.*")
    return materialize(sketched.select("toxic", "text"), "toxic-training")


def log_likelihood(toxic: Column, clean: Column, toxic_rows: int, clean_rows: int) -> Column:
    """``association`` of a term that toxic texts have more often, as a column."""
    share = (toxic + clean) / (toxic_rows + clean_rows)
    part = lambda seen, rows, of: F.when((seen > 0) & (of > 0), 2 * seen * F.log(seen / (rows * of))).otherwise(0.0)
    return part(toxic, toxic_rows, share) + part(toxic_rows - toxic, toxic_rows, 1 - share) + part(clean, clean_rows, share) + part(clean_rows - clean, clean_rows, 1 - share)


def lexicon(rows: DataFrame, toxic_rows: int, clean_rows: int, least: float = 20.0) -> tuple[dict[str, float], dict[str, float], tuple[frozenset[str], frozenset[str]]]:
    """(terms, stems, (usual, strict)): the most associated ones, none the beginning of another, with weights from 0 to 1, the clean words at one edit from them, and the entries that take no edit.

    A shorter stem goes before one that it begins if it has at least half as many toxic rows again and is not much less associated.
    """
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "kind string, term string, toxic long, clean long")
    counts = counts.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counts.where((F.col("toxic") >= 4) & (F.col("toxic") * clean_rows > 2 * F.col("clean") * toxic_rows))
    top = likely.where(log_likelihood(F.col("toxic"), F.col("clean"), toxic_rows, clean_rows) >= WIDER_SHARE * least).collect()  # words of at most max_rows texts
    scored = sorted(((association(r["toxic"], r["clean"], toxic_rows, clean_rows), r["kind"], r["term"], r["toxic"], r["clean"]) for r in top), key=lambda x: (-x[0], x[1] != "w", -len(x[2]), x[2]))
    terms: dict[str, float] = {}
    stems: dict[str, float] = {}
    by_stem = {x[2]: x for x in scored if x[1] == "s"}
    taken: set[str] = set()  # entries, and all their beginnings in begun
    begun: set[str] = set()
    for g, kind, term, toxic, clean in scored:
        shorter = [by_stem[term[:n]] for n in STEM_LENGTHS if n < len(term) and term[:n] in by_stem]
        wider = [x for x in shorter if x[3] >= WIDER_ROWS * toxic and x[0] >= WIDER_SHARE * g]
        if wider:
            g, kind, term, toxic, clean = max(wider, key=lambda x: x[0])
        beginnings = [term[:n] for n in range(1, len(term) + 1)]
        if g < least or term in begun or not taken.isdisjoint(beginnings):
            continue
        taken.add(term)
        begun.update(beginnings)
        p = (toxic / toxic_rows) / (toxic / toxic_rows + (clean + 0.5) / clean_rows)
        (terms if kind == "w" else stems)[term] = p

    def near(strict: frozenset[str]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(terms, stems, strict)
            for batch in batches:
                found: dict[str, list[str]] = {}
                exact = set()
                for word, entry, edits in trie.near(batch.column(0).to_pylist()):
                    exact.update([word] * (edits == 0))
                    found.setdefault(word, []).append(entry)
                found = {w: e for w, e in found.items() if w not in exact}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.list_(pa.string()))], names=["term", "entries"])

        own = words.select("term").mapInArrow(run, "term string, entries array<string>")
        return own.join(words, "term")

    def typical(toxic: Column, clean: Column) -> Column:
        return (clean >= 2) & (toxic * clean_rows <= 2 * clean * toxic_rows)

    words = materialize(counts.where(F.col("kind") == "w").select("term", "toxic", "clean"), "toxic-words")
    # words of a single training row stand for those that no training row has
    others = near(frozenset()).where(F.col("toxic") + F.col("clean") == 1).select(F.explode("entries").alias("entry"), "toxic", "clean")
    others = others.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strict = frozenset(r["entry"] for r in others.where(typical(F.col("toxic"), F.col("clean"))).collect())  # some of the entries
    usual = frozenset(r["term"] for r in near(strict).where(typical(F.col("toxic"), F.col("clean"))).select("term").collect())  # words of the training rows at one edit from an entry
    return terms, stems, (usual, strict)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a ridge penalty on the weights."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    rows = training_rows(docs, labels, max_rows)
    n = dict(rows.groupBy(F.col("toxic") > 0).count().collect())
    toxic_rows, clean_rows = n.get(True, 0), n.get(False, 0)
    if not toxic_rows or not clean_rows:
        return Model(bias=math.inf if toxic_rows else -math.inf)
    terms, stems, (usual, strict) = lexicon(rows, toxic_rows, clean_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, stems, usual, strict)
        for batch in batches:
            x = scorer.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").collect()  # at most max_rows rows of WIDTH numbers
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["toxic"] > 0) for r in seen])
    order = np.lexsort((*x.T, y))
    weights, bias = fit_logistic(x[order], y[order])
    return Model(terms, stems, usual, strict, weights.tolist(), bias)


def _probability(scorer: Scorer, texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(scorer.features([t.decode() for t in texts]) @ weights + bias)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    weights, bias = np.array(model.weights or [0.0] * WIDTH), model.bias
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.stems, model.usual, model.strict)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(_probability(scorer, texts, weights, bias))], names=["doc_id", "score"])
        release()

    scored = chosen.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def harmless(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, in all their columns."""
    at = docs.columns.index("text")
    weights, bias = np.array(model.weights or [0.0] * WIDTH), model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.stems, model.usual, model.strict)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(at).cast(pa.string()), BLOCK_BYTES):
                yield batch.slice(low, high - low).filter(pa.array(_probability(scorer, texts, weights, bias) < threshold))
        release()

    return map_rows(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
