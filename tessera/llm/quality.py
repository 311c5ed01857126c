"""Quality classifier by co-training (operator 9).

Two views of a document: its text's content (words, symbols, shapes), and its page metadata (source,
language, stated length). Each view has a logistic classifier. From a bounded sample of
labelled documents both are trained, then for some rounds each gives the pool documents it
is surest of, with the label it gives them, to the training set of the *other* view. The
final views are calibrated on labelled documents that neither was trained on, combined,
and applied to every document.

Only the fitting is on a sample (``LABELLED`` and ``POOL`` documents, chosen by a hash of
their id); all whole texts are scored.

Defined results: a null text is empty; a null source, language or length is a value of its
own; an empty text has the score that its (empty) features give; repeated rows score alike;
with fewer than ``LEAST`` labelled documents of either class every document gets the labels'
mean (1 without labels) and is kept; several labels for one document are averaged; of rows that
share an id one (with the least text) is learnt from, and all are scored; an empty table gives no rows; columns other
than those named are passed by.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.common import real_ids, with_ids

#: Bounds of the samples that the classifiers are fitted on.
LABELLED, POOL = 8_000, 8_000
#: Least labelled documents of a class; rounds; share of the pool that a view hands over in a round.
LEAST, ROUNDS, SHARE = 8, 5, 0.05
#: A document is rejected if its probability of good quality is under this.
THRESHOLD = 0.5
SOURCES, LANGS, LENGTHS, WORDS = 256, 16, 16, 128
#: How much each column of the views is held back, and each word bucket: a few labels tell less of single words than of a text's form.
PENALTY, WORD_PENALTY = 3.0, 1000.0
_MARKS = b".,;:!?\"'()"
VIEWS = ("text", "source", "lang", "n_chars")


def word_view(words: list[bytes]) -> np.ndarray:
    """Which words a text uses: square roots of their counts in hashed buckets, as a direction."""
    counts = Counter(w.strip(_MARKS).lower() for w in words)
    buckets = np.fromiter((zlib.crc32(w) % WORDS for w in counts), np.int64, len(counts))
    out = np.bincount(buckets, np.sqrt(np.fromiter(counts.values(), float, len(counts))), WORDS)
    return out / max(1e-9, np.linalg.norm(out))


def text_view(text: str | None) -> np.ndarray:
    """The words, shares of byte classes and of each ASCII symbol, and the shapes of words and lines."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = raw.split(b"\n")
    again = sum(map(operator.eq, words, words[1:]))
    symbols = counts[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]]
    shares = np.array([counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum(), counts[128:].sum(), counts[32], counts[10], counts[:32].sum()])
    tail = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,") for w in words)
    shape = [np.log1p(len(words)), lengths.mean(), lengths.std(), len(set(words)) / max(1, len(words)), tail / max(1, len(words)), np.sqrt(again / max(1, len(words))), len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), (lengths == 1).mean(), lengths.max(), not words]
    return np.concatenate([np.sqrt(shares / n), np.log1p(1000 * symbols / n), shape, word_view(words)]).astype(np.float64)


def metadata_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(SOURCES + LANGS + LENGTHS + 1)
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    known = n_chars is not None and n_chars == n_chars
    size = np.log2(1 + max(0.0, float(n_chars))) if known else 0.0
    out[SOURCES + LANGS + (min(LENGTHS - 1, 1 + int(size)) if known else 0)] = 1
    out[-1] = size / 10
    return out


def _views(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(t) for t in df.text])
    lengths = pd.to_numeric(df.n_chars).astype("float64")
    return text, np.array([metadata_view(*x) for x in zip(df.source, df.lang, lengths, strict=True)])


class Model:
    """Both views' scalers and weights, their calibration, and how they are combined."""

    def __init__(self, scales, weights, calibration, combined):
        self.scales, self.weights, self.calibration, self.combined = scales, weights, calibration, combined

    def __call__(self, views) -> tuple[np.ndarray, list[np.ndarray]]:
        each = [a * linear.predict(s(v), w) + b for v, s, w, (a, b) in zip(views, self.scales, self.weights, self.calibration, strict=True)]
        return linear.sigmoid(linear.predict(np.stack(each, 1), self.combined)), [linear.sigmoid(z) for z in each]


def co_train(views, y: np.ndarray, pool, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Fit on labelled ``views`` (text, metadata) with ``y`` and the pool's; every fourth labelled row of either class is held out to calibrate."""
    apart = np.where(y, np.cumsum(y), np.cumsum(~y)) % 4 == 0
    scales = [linear.Scale(v, p) for v, p in zip(views, pool, strict=True)]
    # rows of a view are told by their numbers, the labelled ones first: the samples are held once, however many sets they are in
    rows_of = [lambda at, v=v: linear.Rows(scales[v], [views[v], pool[v]], at) for v in (0, 1)]
    labelled, many = len(y), len(pool[0])
    unlabelled = labelled + np.arange(many)
    sets = [(np.flatnonzero(~apart), y[~apart].astype(float)) for v in (0, 1)]
    free = [np.ones(many, bool), np.ones(many, bool)]  # pool rows that view v has not been given yet
    good = y[~apart].mean()
    penalties = [np.full(v.shape[1], PENALTY) for v in views]
    penalties[0][-WORDS:] = WORD_PENALTY
    fitted = lambda: [linear.fit(rows_of[v](sets[v][0]), sets[v][1], l2=penalties[v]) for v in (0, 1)]
    weights = fitted()
    for _ in range(rounds):
        sure = [linear.predict(rows_of[v](unlabelled), weights[v]) for v in (0, 1)]
        for v in (0, 1):
            other = 1 - v
            rows = np.flatnonzero(free[other])
            order = rows[np.argsort(sure[v][rows], kind="stable")]
            given = int(share * many)
            bad, fine = order[: round(given * (1 - good))], order[len(order) - round(given * good) :]
            bad, fine = bad[sure[v][bad] < -1], fine[sure[v][fine] > 1]  # confident ones only
            taken = np.concatenate([bad, fine])
            free[other][taken] = False
            sets[other] = (np.concatenate([sets[other][0], labelled + taken]), np.concatenate([sets[other][1], np.zeros(len(bad)), np.ones(len(fine))]))
        weights = fitted()
    held = np.flatnonzero(apart)
    calibration, odds = [], [linear.predict(rows_of[v](held), weights[v]) for v in (0, 1)]
    for v in (0, 1):
        a, b = linear.fit(odds[v][:, None], y[apart].astype(float), l2=0.5)
        calibration.append((a, b))
    each = np.stack([a * odds[v] + b for v, (a, b) in enumerate(calibration)], 1)
    return Model(scales, weights, calibration, linear.fit(each, y[apart].astype(float), l2=0.5))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | float:
    """A model from (doc_id, text, source, lang, n_chars) and (doc_id, quality); the labels' mean if they are too few."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in VIEWS)).where("doc_id is not null")
    order = [F.xxhash64("doc_id"), "doc_id"]
    seen = rows.select("doc_id").distinct()
    chosen = seen.join(known, "doc_id").orderBy(*order).limit(labelled).unionByName(seen.join(known, "doc_id", "left_anti").orderBy(*order).limit(pool), allowMissingColumns=True)
    # one row an id, so that the two limits bound what is broadcast and what comes to the driver
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*VIEWS)).alias("one")).select("doc_id", "y", "one.*")
    width = len(text_view("")), len(metadata_view(None, None, None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                a, b = _views(df)
                yield pd.DataFrame({"doc_id": df.doc_id, "y": df.y.astype("float64"), "v": [x.tobytes() for x in np.hstack([a, b]).astype("<f4")]})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), ("v", pa.binary())])
        model = fitted(pa.Table.from_batches([b.cast(schema) for b in batches], schema), width)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    # one task fits: the bounded sample neither passes through the driver nor stays there, the model alone does
    made = rows.mapInPandas(run, "doc_id long, y double, v binary").repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(made.model) if made else 1.0  # a plan that is known to be empty has no task


def fitted(got: pa.Table, width: tuple[int, int]) -> Model | float:
    """The model from (doc_id, y, v): both views of a document, of these widths, as 4-byte floats. They are copied once."""
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy()
    order = np.lexsort((ids, np.isnan(y)))  # the labelled ones first
    place, x, at = np.argsort(order), np.empty((len(ids), sum(width)), "<f4"), 0
    for batch in got.to_batches():
        v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<f4")
        x[place[at : at + len(batch)]] = v.reshape(len(batch), sum(width))
        at += len(batch)
    y = y[order]
    many = int((~np.isnan(y)).sum())
    good = y[:many] >= 0.5
    if min(good.sum(), (~good).sum()) < LEAST:
        return float(y[:many].mean()) if many else 1.0
    return co_train([x[:many, : width[0]], x[:many, width[0] :]], good, [x[many:, : width[0]], x[many:, width[0] :]])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score, text_score, metadata_score, keep of every row of ``docs``."""
    model = train(docs, labels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                p, each = model(_views(df)) if isinstance(model, Model) else (np.full(len(df), model), [np.full(len(df), model)] * 2)
                keep = p >= THRESHOLD if isinstance(model, Model) else np.ones(len(df), bool)
                yield pd.DataFrame({"doc_id": df.doc_id, "no_id": df.no_id, "quality_score": p, "text_score": each[0], "metadata_score": each[1], "keep": keep})

    made = with_ids(docs, *VIEWS).mapInPandas(run, "doc_id long, no_id boolean, quality_score double, text_score double, metadata_score double, keep boolean")
    return real_ids(made).select("doc_id", "quality_score", "text_score", "metadata_score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    model = train(docs, labels)
    if not isinstance(model, Model):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows pass as Arrow has them: in pandas, integers beside a null would be floats
            if batch.num_rows:
                df = pd.DataFrame({c: batch.column(c).cast(pa.string()).to_pandas() for c in VIEWS})
                yield batch.filter(pa.array(model(_views(df))[0] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
