"""Harmonic packing of tokenised documents into training sequences (operator 1).

A length falls into class k if k pieces of it fill a sequence: 1/(k+1) < length /
capacity <= 1/k. A bin of class k holds exactly k pieces, so workers fill bins
without looking at any other length. A piece that would leave more than
``slack`` of its class's share empty is first cut to the next smaller class's
exact share. What remains of a class after its last whole bin (fewer than k
pieces a class, a number that does not depend on the input) is packed by
first fit, largest first, in one small task.

Defined results: a null text is empty; an empty text still has its end token;
texts of any length are cut; repeated documents (also with one doc_id) are packed
each; a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, real_ids, tokenizer, with_ids

CAPACITY, END = 2048, 1
#: Share of a piece that may be left empty rather than cut off; pieces shorter than SHORT are never cut.
SLACK, SHORT = 0.01, 48
#: Chunks whose ids a worker keeps; then it starts anew.
CACHE = 1_000_000
#: ASCII marks that the tokenizer keeps together and apart from letters (not the apostrophe, which may begin an ending).
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin-1 in lower case, with its two other white-space characters as blanks.
_FOLD = bytes(ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256)).replace(b"\x85", b" ").replace(b"\xa0", b" ")


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK, short: int = SHORT) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of ``length`` tokens, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if share - rest <= slack * rest or rest < short:
            out.append((k, rest))
            break
        out.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    return out


class Words:
    """Ids of texts, by white-space separated chunks: no token of this vocabulary spans two.

    Latin-1 texts are lower-cased and split as bytes, by tables that agree with the tokenizer's
    normaliser. Plain words are encoded many at once: each ends with the one token that bears the
    mark of a word's end. Marks after a word are one token run of their own. Other chunks are encoded alone.
    """

    def __init__(self, path: str):
        self.encoder, self.ids = tokenizer(path), {}
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails: dict[bytes, bytes] = {}

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(chunks, add_special_tokens=False)]

    def _plain(self, words: str) -> list[bytes]:
        ids = np.asarray(self.encoder.encode(words, add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != words.count(" ") + 1:
            return self._alone(words.split(" "))
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.ids) + len(chunks) > CACHE:
            self.ids.clear()
            self.tails.clear()
        known, odd = self.ids, []
        chunks = chunks.difference(known)
        plain: dict[bytes, list[bytes]] = {c: [] for c in chunks if c.isalpha()}
        for chunk in chunks.difference(plain):
            word = chunk.rstrip(_MARKS)
            if word.decode("latin-1").isalpha():
                plain.setdefault(word, []).append(chunk)
            else:
                odd.append(chunk)
        new = [w for w in plain if w not in known]
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            known.update(zip(some, self._plain(b" ".join(some).decode("latin-1")), strict=True))
        for word, uses in plain.items():
            for chunk in uses:
                if chunk not in known:
                    tail = chunk[len(word) :]
                    if tail not in self.tails:
                        self.tails[tail] = self._alone([tail.decode()])[0]
                    known[chunk] = known[word] + self.tails[tail]
        for at in range(0, len(odd), 2048):
            some = odd[at : at + 2048]
            known.update(zip(some, self._alone([c.decode("latin-1") for c in some]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            try:
                line = t.encode("latin-1")
            except UnicodeEncodeError:
                line = b"<|"
            # outside Latin-1, and where a special token may stand, the tokenizer takes the whole text
            split.append(None if b"<|" in line else line.translate(_FOLD).split())
        found = [words and list(map(self.ids.get, words)) for words in split]
        gaps = [words and [i for i, ids in enumerate(f) if ids is None] for words, f in zip(split, found, strict=True)]
        self.learn({words[i] for words, gap in zip(split, gaps, strict=True) if gap for i in gap})
        out = []
        for t, words, f, gap in zip(texts, split, found, gaps, strict=True):
            if words is None:
                out += self._alone([t])
                continue
            for i in gap:
                f[i] = self.ids[words[i]]
            out.append(b"".join(f))
        return out


def in_blocks(texts: Iterable[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= chars:
            yield block
            block, size = [], 0
    yield block


@functools.cache
def worker_words(path: str) -> Words:
    """One cache a Python worker, over all of its tasks."""
    return Words(path)


def _pieces(path: str, capacity: int, slack: float, short: int):
    shapes: dict[int, list[tuple[int, int]]] = {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = worker_words(path), np.asarray([END], "<u4").tobytes()
        for df in frames:
            docs, nulls, starts, classes, lengths, ids, totals = [], [], [], [], [], [], []
            coded = chain.from_iterable(map(words.encode, in_blocks(t or "" for t in df.text)))
            for doc, null, data in zip(df.doc_id, df.no_id, coded, strict=True):
                data += end
                n, at = len(data) // 4, 0
                shape = shapes.get(n) or shapes.setdefault(n, cuts(n, capacity, slack, short))
                for k, length in shape:
                    docs.append(doc), nulls.append(null), starts.append(at), classes.append(k), lengths.append(length), totals.append(n)
                    ids.append(data[4 * at : 4 * (at + length)])
                    at += length
                if len(shapes) > 100_000:
                    shapes.clear()
            yield pd.DataFrame({"doc_id": docs, "no_id": nulls, "start": starts, "length": lengths, "klass": classes, "doc_tokens": totals, "ids": ids})

    return run


def _first_fit(capacity: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "klass", "nth"], ascending=[False, True, True], kind="stable")
        free: list[int] = []
        bins, offsets = [], []
        for length in df.length:
            at = next((i for i, room in enumerate(free) if room >= length), len(free))
            if at == len(free):
                free.append(capacity)
            bins.append(at), offsets.append(capacity - free[at])
            free[at] -= length
        return pd.DataFrame({"klass": df.klass, "nth": df.nth, "bin": bins, "offset": offsets}).astype("int64")

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: float = SLACK, short: int = SHORT, of_ids: Column | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids, doc_tokens, sequence_id, offset, class.

    ``ids``: the piece's token ids, unsigned 32-bit little-endian, as binary; or, in their stead,
    ``of_ids``, an expression over them, which is evaluated where they are made, so that they are not written.
    """
    # tokenised once: the places below are counted from the written table
    schema = "doc_id long, no_id boolean, start long, length long, klass int, doc_tokens long, ids binary"
    made = with_ids(docs, "text").mapInPandas(_pieces(tokenizer_path, capacity, slack, short), schema)
    ids = F.col("ids") if of_ids is None else of_ids
    made = real_ids(made).select("doc_id", "start", "length", "klass", "doc_tokens", ids)
    pieces = materialise(made.withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id()), "pieces")
    # a piece's rank in its class: those of earlier parts, then its rank within the part's own class
    keys = pieces.select("klass", "part", "local", "length", "doc_id", "start")
    here = Window.partitionBy("part", "klass").orderBy("local")
    keys = keys.withColumn("rank", F.row_number().over(here) - 1)
    counts = keys.groupBy("part", "klass").agg(F.count(F.lit(1)).alias("many"))
    before = F.sum("many").over(Window.partitionBy("klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("many").over(Window.partitionBy("klass"))
    counts = counts.select("part", "klass", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))
    ranked = keys.join(counts, ["part", "klass"]).withColumn("nth", F.col("before") + F.col("rank"))
    whole = F.expr("total - total % klass")
    # whole bins take the classes' first numbers; the rest of all classes share the numbers after them
    bins = counts.groupBy("klass").agg(F.expr("max(total) div klass").alias("bins"))
    first = bins.select("klass", F.coalesce(F.sum("bins").over(Window.orderBy("klass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("bins").over(Window.partitionBy()).alias("all_bins"))
    ranked = ranked.join(F.broadcast(first), "klass")  # at most one row a class, and there are at most ``capacity``
    full = ranked.where(F.col("nth") < whole)
    # inside a bin, earlier pieces decide the offset
    within = Window.partitionBy("klass", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("bin", F.expr("nth div klass")).withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    full = full.select("part", "local", (F.col("first") + F.col("bin")).alias("sequence_id"), "offset")
    left = ranked.where(F.col("nth") >= whole)
    fitted = left.select("klass", "nth", "length").groupBy().applyInPandas(_first_fit(capacity), "klass int, nth long, bin long, offset long")
    left = left.join(fitted, ["klass", "nth"]).select("part", "local", (F.col("all_bins") + F.col("bin")).alias("sequence_id"), "offset")
    placed = full.unionByName(left)
    return pieces.withColumnRenamed("klass", "class").join(placed, ["part", "local"]).drop("part", "local")
