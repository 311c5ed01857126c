"""Toxicity by weak supervision (operator 8).

Voters are lexicons of words, patterns of word beginnings, and patterns of writing
style; each fires or not on a document. Lexicons and patterns are what the labelled documents' counts tell apart, over all of those that may be
learnt from. A generative label model with the true label hidden estimates each voter's accuracy
by expectation maximisation; its correlations are a tree that links every voter to the one that
it depends on most given the label. It is fitted on how often each combination of votes occurs in all documents that may be learnt
from, labelled or not: a table of at most two to the number of voters. Its posteriors are the training labels of a
linear classifier over the lexicons' and patterns' single entries, which scores all documents.

Only the classifier is fitted on a sample (``LABELLED`` labelled documents and ``FREE`` others, chosen by a hash of their id);
all whole texts are scored. Labels, language, source and id are never inputs of a score.

Defined results: a null text is empty; an empty text has the score of no entry; repeated rows
score alike; a null doc_id counts as one not held out, without a label; with fewer than
``LEAST`` toxic or other labelled documents every score is the labels' mean (0 without labels);
several labels for one document are averaged; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.common import crc_mod, materialise, real_ids, small, with_ids

#: Bounds of the sample that the classifier is fitted on.
LABELLED, FREE = 12_000, 6_000
LEAST = 8
#: An entry's documents must be toxic with at least this share and more often than the others by this log-likelihood ratio; at most so many make the lexicons and patterns.
SHARE, RATIO, ENTRIES = 0.6, 9.0, 1_500
#: How far a label is trusted.
TRUST = 0.98
#: Entries that a worker counts before it starts anew.
HELD = 200_000
#: Lengths of word beginnings; voters that the entries are dealt over.
BEGINNINGS, LEXICONS, PATTERNS, STYLES = (4, 5, 6), 8, 5, 3
THRESHOLD = 0.3
_WORD, _SHOUT = re.compile(r"[^\W\d_]+"), re.compile(r"\b[A-Z]{4,}\b")


def entries(text: str | None) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


def sketch(text: str | None) -> int:
    """The least of two hashes of a text's runs of four words: the same for most near copies, and seldom for texts that only share a passage."""
    words = _WORD.findall((text or "").lower())
    runs = np.fromiter((zlib.crc32(" ".join(w).encode()) for w in zip(words, words[1:], words[2:], words[3:])), np.uint32)
    if not len(runs):
        return zlib.crc32(" ".join(words).encode())
    return int(runs.min()) << 31 ^ int((runs * np.uint32(0x9E3779B1)).min())


def style(text: str | None) -> tuple[bool, bool, bool]:
    """Voters on how a text is written: shouting, repeated marks, second person."""
    text = text or ""
    shouted = len(_SHOUT.findall(text))
    return shouted > 5, "!!" in text or "??" in text, " you " in text.lower()


class LabelModel:
    """P(label, votes) with each vote given the label and one other vote: a tree over the voters."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, given: np.ndarray, many: np.ndarray | None = None, rounds: int = 100):
        """``votes``: n x m booleans. ``start``: first guesses of P(label = 1). ``given``: log odds known from elsewhere. ``many``: how often each row occurs."""
        self.votes = votes.astype(int)
        self.many = np.ones(len(votes)) if many is None else many.astype(float)
        self.labels = np.clip(start, 0.01, 0.99)
        for _ in range(rounds):
            self._learn(self.labels)
            before, self.labels = self.labels, linear.sigmoid(self.log_odds(self.votes) + given)
            if np.abs(before - self.labels).max() < 1e-4:
                break

    def _learn(self, p: np.ndarray) -> None:
        v, weight = self.votes, np.stack([1 - p, p]) * self.many
        m = v.shape[1]
        total = weight.sum(1)
        self.prior = np.clip(total[1] / total.sum(), 1e-4, 1 - 1e-4)
        ones = weight @ v
        one = (ones + 0.5) / (total[:, None] + 1)  # P(vote j | label): the accuracies
        both = np.stack([(v * w[:, None]).T @ v for w in weight])
        information = np.zeros((m, m))  # between two votes, given the label
        for y in (0, 1):
            for a in (0, 1):
                for b in (0, 1):
                    cell = {(1, 1): both[y], (1, 0): ones[y][:, None] - both[y], (0, 1): ones[y][None, :] - both[y], (0, 0): total[y] - ones[y][:, None] - ones[y][None, :] + both[y]}[a, b]
                    pa = one[y] if a else 1 - one[y]
                    pb = one[y] if b else 1 - one[y]
                    joint = (np.maximum(cell, 0) + 0.25) / (total[y] + 1)
                    information += total[y] / total.sum() * joint * np.log(joint / (pa[:, None] * pb[None, :]))
        # the strongest tree, grown from voter 0
        self.parent, inside = np.full(m, -1), [0]
        outside = set(range(1, m))
        while outside:
            i, j = max(((i, j) for i in inside for j in sorted(outside)), key=lambda ij: information[ij])
            self.parent[j] = i
            inside.append(j)
            outside.remove(j)
        # P(vote j = 1 | label, parent's vote)
        self.table = np.zeros((2, 2, m))
        for y in (0, 1):
            for j in range(m):
                k = self.parent[j]
                if k < 0:
                    self.table[y, :, j] = one[y, j]
                else:
                    self.table[y, 1, j] = (both[y, k, j] + 2 * one[y, j]) / (ones[y, k] + 2)
                    self.table[y, 0, j] = (ones[y, j] - both[y, k, j] + 2 * one[y, j]) / (total[y] - ones[y, k] + 2)
        self.accuracy = one

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        votes = votes.astype(int)
        above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        columns = np.arange(votes.shape[1])
        z = np.log(self.prior / (1 - self.prior))
        for y, sign in ((1, 1), (0, -1)):
            p = np.clip(self.table[y, above, columns], 1e-6, 1 - 1e-6)
            z = z + sign * np.log(np.where(votes, p, 1 - p)).sum(1)
        return z


def dense(found: list[list[int]], sizes: np.ndarray, width: int) -> np.ndarray:
    """The classifier's inputs: which entries occur, how many words and beginnings, the text's length."""
    out = np.zeros((len(found), width + 3))
    for i, f in enumerate(found):
        out[i, f] = 1
        out[i, width] = np.log1p(len(f))
        out[i, width + 1] = len(f) > 1
    out[:, width + 2] = np.log1p(sizes) / 10
    return out


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def __call__(self, texts) -> np.ndarray:
        n = len(self.voters.index)
        w = self.weights
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            f = self.voters.found(text)
            out[i] = w[f].sum() + w[n] * np.log1p(len(f)) + w[n + 1] * (len(f) > 1) + w[n + 2] * np.log1p(len(text or "")) / 10 + w[-1]
        return linear.sigmoid(out)


class Voters:
    """Which voters fire on a text: its entries are dealt over lexicons and patterns by their rank, words and beginnings apart."""

    def __init__(self, chosen: list[str]):
        self.index = {e: i for i, e in enumerate(chosen)}
        words, starts = [i for i, e in enumerate(chosen) if e[-1] != "*"], [i for i, e in enumerate(chosen) if e[-1] == "*"]
        self.voter = np.zeros(len(chosen), int)
        self.voter[words] = np.arange(len(words)) % LEXICONS
        self.voter[starts] = LEXICONS + np.arange(len(starts)) % PATTERNS

    def found(self, text: str | None) -> list[int]:
        return sorted(self.index[e] for e in entries(text) & self.index.keys())

    def votes(self, text: str | None, found: list[int]) -> int:
        """The votes as bits."""
        bits = 0
        for i in found:
            bits |= 1 << int(self.voter[i])
        for i, fires in enumerate(style(text)):
            bits |= int(fires) << (LEXICONS + PATTERNS + i)
        return bits


def as_votes(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(LEXICONS + PATTERNS + STYLES)) & 1 == 1


def label_model(bits: np.ndarray, y: np.ndarray, many: np.ndarray) -> LabelModel:
    """Fitted on combinations of votes, each ``many`` times with label ``y`` (1, 0 or NaN: none)."""
    votes, known = as_votes(bits), ~np.isnan(y)
    base = float((y[known] * many[known]).sum() / many[known].sum())
    start = np.where(known, np.where(np.nan_to_num(y) > 0.5, 0.95, 0.05), np.where(votes[:, : LEXICONS + PATTERNS].any(1), 0.8, base / 2))
    return LabelModel(votes, start, given(y), many)


def given(y: np.ndarray) -> np.ndarray:
    """Log odds of a row's own label, which is one more voter."""
    return np.where(np.isnan(y), 0.0, np.where(np.nan_to_num(y) > 0.5, 1, -1) * linear.logit(np.array(TRUST)))


def lexicon(counted: DataFrame, base: float) -> list[str]:
    """The entries of ``counted`` (entry, toxic, n) whose documents are toxic more often than ``base`` says, the surest first."""
    share = F.col("toxic") / F.col("n")
    ratio = F.col("toxic") * F.log(share / F.lit(max(base, 1e-6))) + F.when(share < 1, (F.col("n") - F.col("toxic")) * F.log((1 - share) / F.lit(max(1 - base, 1e-6)))).otherwise(0.0)
    return [r.entry for r in counted.where(F.col("toxic") > 0).where((share >= SHARE) & (ratio >= RATIO)).select("entry", ratio.alias("ratio")).orderBy(F.desc("ratio"), "entry").limit(ENTRIES).collect()]


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model | float:
    """A model from (doc_id, text) and (doc_id, toxic), learnt from rows that are not ``held_out``."""
    free = docs.where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text")
    known = small(materialise(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("y")), "labels"))
    labelled = free.join(known, "doc_id")

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"doc_id": df.doc_id, "y": df.y, "sketch": [sketch(t) for t in df.text]})

    # of copies and near copies one is learnt from: their shared words are no evidence
    sketches = labelled.mapInPandas(sketched, "doc_id long, y double, sketch long")
    kept = materialise(sketches.groupBy("sketch").agg(F.min(F.struct("doc_id", "y")).alias("one")).select("one.*").distinct(), "kept")
    many, toxic = kept.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not many or min(toxic, many - toxic) < LEAST:
        return float(toxic / many) if many else 0.0

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, n = Counter(), Counter()

        def counts() -> pd.DataFrame:
            return pd.DataFrame({"entry": pd.Series(list(n), dtype=object), "toxic": [toxic[e] for e in n], "n": list(n.values())})

        for df in frames:
            for text, y in zip(df.text, df.y, strict=True):
                e = entries(text)
                n.update(e)
                if y > 0.5:
                    toxic.update(e)
            if len(n) > HELD:
                yield counts()
                n.clear(), toxic.clear()
        yield counts()

    counted = labelled.join(small(kept.select("doc_id")), "doc_id", "left_semi").mapInPandas(count, "entry string, toxic long, n long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    chosen = lexicon(counted, toxic / many)
    voters = Voters(chosen)

    def combinations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for df in frames:
            y = np.where(df.y.isna(), -1, df.y > 0.5).astype(int).tolist()
            n.update((voters.votes(t, voters.found(t)), k) for t, k in zip(df.text, y, strict=True))
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["bits", "y", "n"])

    # at most two to the number of voters, for each kind of label
    seen = free.join(known, "doc_id", "left").select("text", "y").mapInPandas(combinations, "bits long, y long, n long").groupBy("bits", "y").agg(F.sum("n").alias("n")).toPandas().sort_values(["bits", "y"])
    model = label_model(seen.bits.to_numpy(), np.where(seen.y < 0, np.nan, seen.y), seen.n.to_numpy())

    order = [F.xxhash64("doc_id"), "doc_id"]
    others = free.where("doc_id is not null").select("doc_id").distinct().join(known, "doc_id", "left_anti").orderBy(*order).limit(FREE)
    sample = kept.orderBy(*order).limit(LABELLED).unionByName(others, allowMissingColumns=True)
    # one row an id, so that the two limits bound what is broadcast and what comes to the driver
    rows = free.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def looked_at(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:  # only what the fit looks at goes to the driver
            found = [voters.found(t) for t in df.text]
            yield pd.DataFrame({"doc_id": df.doc_id, "y": df.y.astype("float64"), "found": found, "size": [len(t or "") for t in df.text], "bits": [voters.votes(t, f) for t, f in zip(df.text, found, strict=True)]})

    got = rows.mapInPandas(looked_at, "doc_id long, y double, found array<int>, size long, bits long").toArrow().to_pandas().sort_values("doc_id")
    posterior = linear.sigmoid(model.log_odds(as_votes(got.bits.to_numpy())) + given(got.y.to_numpy(float)))
    return Model(voters, linear.fit(dense([list(f) for f in got.found], got["size"].to_numpy(), len(chosen)), posterior, l2=0.5, rounds=12))


def score(docs: DataFrame, model: Model | float, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                p = model(df.text.tolist()) if isinstance(model, Model) else np.full(len(df), model)
                yield pd.DataFrame({"doc_id": df.doc_id, "no_id": df.no_id, "score": p, "predicted": (p >= threshold).astype("int32")})

    made = real_ids(with_ids(docs, "text").mapInPandas(run, "doc_id long, no_id boolean, score double, predicted int"))
    return made.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    return score(docs, train(docs.select("doc_id", "text"), labels, held_out), held_out)
