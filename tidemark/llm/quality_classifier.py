"""Quality classifier (operator 9) by co-training.

Two views of a document that share no feature. The text view has its content: hashed words of letters and their endings, and
repeats. The metadata view has the fields of its record (language, source, n_chars) and the layout of its page: lines, blank
lines, their lengths, shares of marks, digits and capitals; no word of the text. Each view has a logistic regression, first
fitted on labelled rows. In every round each model scores all unlabelled documents; those it is most sure of, as many of
either label as among the labels, become training rows of the other. The views are then calibrated on labelled rows that were
held out, and combined by a logistic regression over their calibrated logits, fitted on other rows that were held out.
Every document is scored.

Fitted on bounded samples: at most `max_labelled` labelled rows, chosen by a hash of doc_id, and at most `per_round` rows a view and round, the
surest of all by a distributed top-k. Candidates for these and the final scores cover all rows and whole texts.

Defined results: a null text is empty; null metadata are a value of their own; with no labels, or labels of one
kind, every score is the smoothed share of good labels; a doc_id labelled twice counts with its least label;
rows that repeat a document train once and are scored each; equally sure rows are taken in the order of a hash; extra columns are ignored; a row
without a doc_id is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, body_of, slices, small_batches, staged, text_bytes, texts
from tidemark.llm.hashing import mix, run_hashes, runs

WORDS, ENDINGS = 512, 512
TEXT_SIZE = WORDS + ENDINGS + 2
LANGS, SOURCES = 16, 64
_KINDS = (b"|", b"!?", b"#$%&*", b"<>{}[]=_/\\~^@+", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LAYOUT = 7 + len(_KINDS)
META_SIZE = LANGS + SOURCES + LAYOUT
MAX_LABELLED, ROUNDS, PER_ROUND, SURE = 4000, 3, 200, 0.95
_LETTER, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, len(_KINDS))
for _k, _own in enumerate(_KINDS):
    _KIND[list(_own)] = _k


def text_view(column: pa.Array) -> np.ndarray:
    """One row for each text: log frequency of hashed words of letters and of their endings, share of words that repeat the one before, log number of words."""
    b, edges = text_bytes(column)
    b, rows = _LOWER[b], len(column)
    start, end = runs(_LETTER[b], edges)
    words = run_hashes(b, start, end)
    doc = np.searchsorted(edges, start, side="right") - 1
    n = np.maximum(1, np.bincount(doc, minlength=rows))
    ending = mix(b[end - 1].astype(np.uint64) | b[np.maximum(end - 2, start)].astype(np.uint64) << np.uint64(8)) if len(start) else words
    out = np.zeros((rows, TEXT_SIZE), np.float32)
    for at, size, h in ((0, WORDS, words), (WORDS, ENDINGS, ending)):
        cell = doc * size + (h % np.uint64(size)).astype(np.int64)
        out[:, at : at + size] = np.bincount(cell, minlength=rows * size).reshape(-1, size)
    again = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out[:, : WORDS + ENDINGS] = np.log1p(out[:, : WORDS + ENDINGS] * (100 / n[:, None]))
    out[:, -2] = 4 * np.bincount(doc[1:][again], minlength=rows) / n
    out[:, -1] = np.log1p(n) / 8
    return out


def meta_view(column: pa.Array, lang: list, source: list, n_chars: list) -> np.ndarray:
    """One row for each document: language and source hashed, log n_chars, and the layout: lines, blank lines, mean and spread of line lengths, shares of kinds of marks, digits and capitals, words in the space."""
    b, edges = text_bytes(column)
    n = len(column)
    out, rows = np.zeros((n, META_SIZE), np.float32), np.arange(n)
    slot = lambda x, size: zlib.crc32(repr(x).encode()) % size
    out[rows, [slot(x, LANGS) for x in lang]] = 1
    out[rows, [LANGS + slot(x, SOURCES) for x in source]] = 1
    sizes = np.maximum(1, np.diff(edges))
    total = lambda test: np.diff(np.concatenate([[0], np.cumsum(test)])[edges])
    start, end = runs(b != 10, edges)
    doc = np.searchsorted(edges, start, side="right") - 1
    filled = np.maximum(1, np.bincount(doc, minlength=n))
    length = np.log1p(end - start)
    mean = np.bincount(doc, length, n) / filled
    feeds = total(b == 10)
    words, _ = runs(~_BLANK[b], edges)
    cell = _KIND[b] + np.repeat(rows, np.diff(edges)) * (len(_KINDS) + 1)
    kinds = np.bincount(cell, minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, :-1]
    layout = (
        np.log1p([0 if x is None else max(0, x) for x in n_chars]) / 8, np.log1p(feeds) / 4, np.maximum(0, feeds + 1 - filled) / (feeds + 1), mean / 4,
        np.sqrt(np.maximum(0, np.bincount(doc, length**2, n) / filled - mean**2)) / 2, *(4 * kinds / sizes[:, None]).T,
        np.diff(np.searchsorted(words, edges)) * 5 / sizes, 1.0 * (sizes < 200),
    )
    out[:, LANGS + SOURCES :] = np.stack(layout, axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights and, last, intercept of a logistic regression with an L2 penalty, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    prior: float
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    calibration: list[np.ndarray] = field(default_factory=list)
    combined: np.ndarray | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the views, and the combined score."""
        if self.text is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        views = np.stack([logit(c, logit(w, x)[:, None]) for c, w, x in zip(self.calibration, (self.text, self.meta), (text, meta), strict=True)], axis=1)
        return _sigmoid(views[:, 0]), _sigmoid(views[:, 1]), _sigmoid(logit(self.combined, views))


def finish(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, text: np.ndarray, meta: np.ndarray, prior: float) -> Model:
    """Calibrate each view on the first half of held-out rows, combine on the second; both on all where a half has labels of one kind."""
    first = np.arange(len(y)) % 2 == 0
    one, two = (first, ~first) if min(y[first].sum(), (1 - y[first]).sum(), y[~first].sum(), (1 - y[~first]).sum()) > 0 else (first | True, first | True)
    raw = [logit(w, v)[:, None] for w, v in zip((text, meta), views, strict=True)]
    calibration = [fit(r[one], y[one]) for r in raw]
    logits = np.stack([logit(c, r) for c, r in zip(calibration, raw, strict=True)], axis=1)
    return Model(prior, text, meta, calibration, fit(logits[two], y[two]))


_IN = ("doc_id", "body", "text", "lang", "source", "n_chars")


def _both_views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = part.column("text")
    return text_view(text), meta_view(text, *(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def _views_of(docs: DataFrame, keys: DataFrame, on: list[str]):
    """Rows doc_id, body, good, text, meta of the documents in keys(on, good), each once, on the driver: a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            views = [pa.array([r.tobytes() for r in v], pa.binary()) for v in _both_views(part)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "body", "good")), *views], names=["doc_id", "body", "good", "text", "meta"])

    picked = attach(docs, staged(keys.select(*on, "good"), "sample-ids"), on, row_bytes=40, how="inner").select(*_IN, "good").dropDuplicates(["doc_id", "body"])
    return picked.mapInArrow(run, "doc_id long, body long, good int, text binary, meta binary").toPandas().sort_values(["doc_id", "body"])


def _matrices(rows) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows[c]), np.float32).reshape(-1, n) for c, n in (("text", TEXT_SIZE), ("meta", META_SIZE)))


def surest(scores: DataFrame, taken: DataFrame, view: str, label: int, n: int, sure: float) -> DataFrame:
    """doc_id, body and good of the n documents that a view is surest to have a label, of those not taken: a distributed top-k."""
    p = F.col(view) if label else 1 - F.col(view)
    free = scores.join(F.broadcast(taken.filter(F.col("view") == view).select("doc_id", "body")), ["doc_id", "body"], "left_anti") if taken is not None else scores
    return free.filter(p > sure).orderBy(p.desc(), F.xxhash64("doc_id", "body", F.lit(9)), "doc_id").limit(n).select("doc_id", "body", F.lit(label).alias("good"))


def _scores(docs: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """doc_id, body and what each view's model says of every document, repeated rows once."""
    given = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = [pa.array(_sigmoid(logit(w, x)), pa.float64()) for w, x in zip(given.value, _both_views(part), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), *p], names=["doc_id", "body", "text", "meta"])

    return docs.select(*_IN).mapInArrow(run, "doc_id long, body long, text double, meta double").dropDuplicates(["doc_id", "body"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).filter("doc_id IS NOT NULL AND good IS NOT NULL")
    known = staged(known.groupBy("doc_id").agg(F.min("good").alias("good")), "labels")
    rows = _views_of(docs, known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(max_labelled), ["doc_id"])
    views, y = _matrices(rows), rows["good"].to_numpy(np.float64)
    prior, held = (y.sum() + 1) / (len(y) + 2), np.arange(len(y)) % 4 == 3
    if not len(y) or min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return Model(prior)
    sets = [(v[~held], y[~held]) for v in views]
    unlabelled = attach(docs, known.select("doc_id"), "doc_id", row_bytes=24, how="left_anti")
    taken = None
    for _ in range(rounds):
        scores = staged(_scores(unlabelled, [fit(*s) for s in sets]), "view-scores")
        for pupil, teacher in ((1, "text"), (0, "meta")):
            share = ((1, prior), (0, 1 - prior))  # as many of either kind as among the labels
            parts = [surest(scores, taken, teacher, good, max(1, int(per_round * part)), sure) for good, part in share]
            chosen = staged(parts[0].unionByName(parts[1]), "pseudo-labels")
            new = _views_of(unlabelled, chosen, ["doc_id", "body"])
            sets[pupil] = np.vstack([sets[pupil][0], _matrices(new)[pupil]]), np.concatenate([sets[pupil][1], new["good"].to_numpy(np.float64)])
            mine = chosen.select("doc_id", "body", F.lit(teacher).alias("view"))
            taken = mine if taken is None else taken.unionByName(mine)  # rounds * per_round rows a view at most
    return finish(tuple(v[held] for v in views), y[held], fit(*sets[0]), fit(*sets[1]), prior)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, **bounds: float) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept (score >= threshold) of each row of docs(doc_id, text, lang, source, n_chars)."""
    spark = docs.sparkSession
    small_batches(spark)
    fields = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    docs = texts(docs, *fields, F.col("n_chars").cast("long").alias("n_chars")).withColumn("body", body_of())
    model = spark.sparkContext.broadcast(train(docs, labels, label, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = model.value.score(*_both_views(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s, pa.float64()) for s in scores)], names=["doc_id", "text_score", "meta_score", "score"])

    scored = docs.select(*_IN).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)
