"""Language-model scores by Brown class-based n-grams (operator 3).

Exchange clustering assigns words to classes, so that classes predict the next class
well. The most frequent words are clustered one by one on the driver, and the others in groups that
share their ending and final mark. That gives each word its class as a context. From there every single word of the
training documents, however rare, is exchanged by its own counts after each context (one-sided, as in predictive clustering), in
sweeps over all words at once; a sweep that doesn't raise the likelihood is not kept. The probability of a word after another is that of its class
after the other's context class, times that of the word in its class; both are smoothed, and a class keeps some mass for a word never
seen, which stands in the class of its ending.

Word counts are exact over all training documents and all of their words. What a worker or the
driver holds is bounded: ``CLUSTERED`` words and ``ENDINGS`` endings are clustered on the driver from their
bigram counts over all training documents, all other words are exchanged where their counts lie, and the ``HEAD`` most frequent words'
probabilities are broadcast. Other words' counts meet their uses in a join.

Defined results: a null text is empty and has its end only; a null doc_id is trained on and not
held out; repeated rows are each scored and counted; without training documents the
base score of every token is 0 and so is the score; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, materialise, real_ids, with_ids

#: Words and endings that are clustered, classes, and the most sweeps of the exchange.
CLUSTERED, ENDINGS, CLASSES, SWEEPS = 600, 400, 64, 12
#: Sweeps over all the other words, and words that are looked at at once in one.
WHOLE, SOME = 2, 2_000
#: How often a word comes after a context.
_AFTER = np.dtype([("s", "u1"), ("n", "<u4")])
#: Words whose probabilities are broadcast.
HEAD = 200_000
#: Words that a worker remembers or counts before it starts anew; characters that are worked on at once.
KEPT, BLOCK = 400_000, 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Stands for a document's end; no word holds a blank.
END = b" "
_MARKS = b".,;:!?"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of what is not ASCII white space, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def ending(word: bytes) -> bytes:
    """A word's last two bytes before a final mark, and that mark."""
    bare = word.rstrip(_MARKS)
    return bare[-2:] + b" " + word[len(bare) :][:1]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Some rows and their words at a time."""
    for df in frames:
        first, split, size = 0, [], 0
        for at, text in enumerate(df.text):
            split.append(words_of(text))
            size += len(text or "")
            if size >= BLOCK or at + 1 == len(df):
                yield df[first : at + 1], split
                first, split, size = at + 1, [], 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c): how often each word, and the end, occurs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for _, split in _blocks(frames):
            counts.update(chain.from_iterable(split))
            counts[END] += len(split)
            if len(counts) > KEPT:
                yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                counts.clear()
        yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})

    return docs.mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Words and endings that are clustered: END is unit 0, then words, then endings, then any other ending."""

    def __init__(self, words: list[bytes], endings: list[bytes]):
        self.of_word = {END: 0} | {w: i + 1 for i, w in enumerate(words)}
        self.of_ending = {e: len(words) + 1 + i for i, e in enumerate(endings)}
        self.other = len(words) + len(endings) + 1
        self.many = self.other + 1

    def __call__(self, word: bytes) -> int:
        unit = self.of_word.get(word)
        return self.of_ending.get(ending(word), self.other) if unit is None else unit


class _Lookup(dict):
    """``dict.__missing__`` with a bound on what is remembered."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word):
        if len(self) > KEPT:
            self.clear()
        value = self[word] = self.find(word)
        return value


def bigrams(docs: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a; a document begins after an end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _Lookup(units)
        total = np.zeros(units.many**2, np.int64)
        for _, split in _blocks(frames):
            ids = np.fromiter(chain.from_iterable(chain(map(look.__getitem__, w), (0,)) for w in split), np.int64)
            before = np.concatenate([[0], ids[:-1]])  # a document's end stands before the next one's first word
            total += np.bincount(before * units.many + ids, minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"a": (at // units.many).astype(np.int32), "b": (at % units.many).astype(np.int32), "n": total[at]})

    return docs.mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, from the units' bigram counts. Unit 0, the end, stays alone in class 0.

    Every unit in turn goes to the class that raises the class bigrams' likelihood most, until none moves.
    """
    h = lambda x: x * np.log(np.maximum(x, 1))
    many = len(n)
    order = np.argsort(-n.sum(1), kind="stable")
    order = order[order != 0]
    label = np.zeros(many, int)
    label[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[label]
    n = n.astype(float)
    after, before = n @ member, n.T @ member  # unit x class: what follows a unit, what precedes it
    big = member.T @ after
    left, right = big.sum(1), big.sum(0)
    rows, columns, itself = n.sum(1), n.sum(0), n.diagonal()
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old = label[u]
            # take the unit out of its class; what it has with itself is not with a class
            out, into, own = after[u].copy(), before[u].copy(), itself[u]
            out[old] -= own
            into[old] -= own
            big[old] -= out
            big[:, old] -= into
            big[old, old] -= own
            left[old] -= rows[u]
            right[old] -= columns[u]
            # the gain of putting it into each class
            gain = (h(big + out) - h(big)).sum(1) + (h(big + into[:, None]) - h(big)).sum(0)
            diagonal = big.diagonal()
            gain += h(diagonal + out + into + own) - h(diagonal) - (h(diagonal + out) - h(diagonal)) - (h(diagonal + into) - h(diagonal))
            gain -= h(left + rows[u]) - h(left) + h(right + columns[u]) - h(right)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            big[new] += out
            big[:, new] += into
            big[new, new] += own
            left[new] += rows[u]
            right[new] += columns[u]
            if new != old:
                moved += 1
                label[u] = new
                after[:, old] -= n[:, u]
                after[:, new] += n[:, u]
                before[:, old] -= n[u]
                before[:, new] += n[u]
        if not moved:
            break
    return label


def transitions(big: np.ndarray) -> np.ndarray:
    """log10 P(class after context class): the counts, mixed with the classes' own shares (Witten-Bell)."""
    share = (big.sum(0) + 0.5) / (big.sum() + 0.5 * len(big))
    total, kinds = big.sum(1, keepdims=True), (big > 0).sum(1, keepdims=True)
    return np.log10((big + kinds * share + 1e-3 * share) / (total + kinds + 1e-3))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(big: np.ndarray) -> float:
    """Of the classes after their contexts, but for what no exchange of classes changes."""
    return float(_xlogx(big).sum() - _xlogx(big.sum(0)).sum())


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def contexts(docs: DataFrame, units: Units, label: np.ndarray, classes: int) -> DataFrame:
    """(word, ctx): how often each word that is no unit of its own comes after each context class, in pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, seeds, met = _Numbers({END: 0}), np.array([-1]), []

        def held() -> pd.DataFrame:
            keys, n = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 2
            keys, where = np.unique(keys, return_inverse=True)
            after = np.empty(len(keys), _AFTER)
            after["s"], after["n"] = keys % classes, np.bincount(where, n, len(keys))
            ids = keys // classes
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            words, raw, edges = list(number), after.tobytes(), (np.append(first, len(ids)) * _AFTER.itemsize).astype(int).tolist()
            return pd.DataFrame({"word": [words[i] for i in ids[first].tolist()], "ctx": [raw[a:z] for a, z in zip(edges, edges[1:])]})

        for _, split in _blocks(frames):
            ids = np.fromiter(chain.from_iterable(chain(map(number.__getitem__, w), (0,)) for w in split), np.int64)
            # a word that is a unit is marked by the complement of its class
            new = list(islice(number, len(seeds), None))
            kinds = label[np.fromiter(map(units, new), np.int64, len(new))]
            seeds = np.concatenate([seeds, np.where(np.fromiter(map(units.of_word.__contains__, new), bool, len(new)), -1 - kinds, kinds)])
            seed = seeds
            apart, seed = seed >= 0, np.where(seed < 0, -1 - seed, seed)
            before = seed[np.concatenate([[0], ids[:-1]])]  # a document's end stands before the next one's first word
            met.append(np.unique((ids * classes + before)[apart[ids]], return_counts=True))
            if len(number) > KEPT:
                yield held()
                number, seeds, met = _Numbers({END: 0}), np.array([-1]), []
        yield held()

    return docs.mapInPandas(run, "word binary, ctx binary").groupBy("word").agg(F.collect_list("ctx").alias("ctx"))


def ending_classes(words: pd.Series, units: Units, label: np.ndarray) -> np.ndarray:
    """The class of each word's ending, in which it stands before the first sweep."""
    return label[np.fromiter(map(units, map(bytes, words)), np.int64, len(words))]


def _tables(df: pd.DataFrame, classes: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Some words at a time, and how often each comes after each context class."""
    for at in range(0, len(df), SOME):
        some = df[at : at + SOME]
        after = np.frombuffer(b"".join(some.ctx), _AFTER)
        row = np.repeat(np.arange(len(some)), some.ctx.map(len).to_numpy() // _AFTER.itemsize)
        yield some, np.bincount(row * classes + after["s"], after["n"], len(some) * classes).reshape(-1, classes)


def best(n: np.ndarray, kind: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each word, with ``n`` uses after each context, that is in class ``kind`` of ``big``, all others staying."""
    row, s = np.nonzero(n)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    uses, total, at = n.sum(1), big.sum(0), np.arange(len(n))
    with_it = lambda x, more: _xlogx(x + more) - _xlogx(x)
    gain = np.add.reduceat(_xlogx(big[s] + n[row, s][:, None]) - _xlogx(big)[s], first, axis=0) - with_it(total[None, :], uses[:, None])
    # in its own class a word is counted already
    own = with_it(big[s, kind[row]] - n[row, s], n[row, s])
    gain[at, kind] = np.add.reduceat(own, first) - with_it(total[kind] - uses, uses)
    gain[:, 0] = -np.inf  # the end's
    new = gain.argmax(1)
    return np.where(gain[at, new] > gain[at, kind] + 1e-9, new, kind)


def chosen(df: pd.DataFrame, big: np.ndarray, classes: int) -> pd.DataFrame:
    """``df`` (word, kind, ctx) with the uses and the best class of each word. Words of one class with the same uses, as most rare ones are, are worked out once."""
    cases: dict[tuple[bytes, int], int] = {}
    where = np.fromiter((cases.setdefault(x, len(cases)) for x in zip(map(bytes, df.ctx), df.kind.tolist(), strict=True)), np.int64, len(df))
    once = pd.DataFrame(list(cases), columns=["ctx", "kind"])
    got = [(best(n, some.kind.to_numpy(), big), n.sum(1).astype(np.int64)) for some, n in _tables(once, classes)]
    kind, c = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"word": df.word, "c": c[where], "kind": kind[where], "ctx": df.ctx})


def sweep(words: DataFrame, units: Units, label: np.ndarray, big: np.ndarray, classes: int) -> DataFrame:
    """``words``, of ``contexts`` or of a sweep before, with the uses and the best class of each; all move at once."""
    first = "kind" not in words.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if first:  # not in a pass of its own: each task would keep two Python workers
                df = pd.DataFrame({"word": df.word, "kind": ending_classes(df.word, units, label), "ctx": [b"".join(map(bytes, x)) for x in df.ctx]})
            yield chosen(df, big, classes)

    return words.mapInPandas(run, "word binary, c long, kind int, ctx binary")


def unmoved(words: DataFrame, units: Units, label: np.ndarray) -> DataFrame:
    """``words`` (word, c) of a sweep that is not kept, with the classes of their endings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df.assign(kind=ending_classes(df.word, units, label))

    return words.select("word", "c").mapInPandas(run, "word binary, c long, kind int")


def class_bigrams(words: DataFrame, classes: int) -> np.ndarray:
    """How often each class of ``words`` comes after each context class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((classes, classes), np.int64)  # class, context
        for df in frames:
            if len(df):
                after = np.frombuffer(b"".join(df.ctx), _AFTER)
                kind = np.repeat(df.kind.to_numpy(), df.ctx.map(len).to_numpy() // _AFTER.itemsize)
                total += np.bincount(kind * classes + after["s"], after["n"], classes**2).astype(np.int64).reshape(classes, classes)
        k, s = np.nonzero(total)
        yield pd.DataFrame({"s": s.astype(np.int32), "k": k.astype(np.int32), "n": total[k, s]})

    got = words.mapInPandas(run, "s int, k int, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    big = np.zeros((classes, classes))
    big[got.s, got.k] = got.n
    return big


class Model:
    """Everything but the counts of words outside the head: bounded by the constants above."""

    def __init__(self, units: Units, label: np.ndarray, moves: np.ndarray, head: dict[bytes, int], c: np.ndarray, kind: np.ndarray, totals: np.ndarray, types: np.ndarray, discount: float, n: int, v: int):
        self.units, self.label, self.moves, self.head = units, label, moves, head
        self.totals, self.types, self.discount, self.n, self.v = totals, types, discount, n, v
        self.kind = kind  # a head word's class; as a context it has that of its unit
        self.seed = np.array([label[units(w)] for w in head])
        self.base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        self.emit = np.log10(np.maximum(c - discount, 1e-12) / np.maximum(totals[kind], 1e-12))

    def code(self, word: bytes) -> int:
        """A head word's number, or -1 - class."""
        at = self.head.get(word)
        return -1 - int(self.label[self.units(word)]) if at is None else at


def train(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and the counts and classes of all words of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs), "counts")
    n, v, ones, twos = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    if not n:
        return None, counts
    order = [F.desc("c"), "word"]
    most = counts.where(F.col("word") != F.lit(END)).orderBy(*order).limit(CLUSTERED).toArrow().to_pandas()
    words = [bytes(w) for w in most.word]
    # endings of the words that are not clustered themselves, weighed by their uses

    def endings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, found = {END, *words}, Counter()
        for df in frames:
            for w, c in zip(df.word, df.c, strict=True):
                if (w := bytes(w)) not in known:
                    found[ending(w)] += c
        yield pd.DataFrame({"e": list(found), "c": list(found.values())})

    common = counts.mapInPandas(endings, "e binary, c long").groupBy("e").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(ENDINGS).toArrow().to_pandas()
    units = Units(words, [bytes(e) for e in common.e])
    pairs = bigrams(docs, units).toArrow().to_pandas()  # at most units.many ** 2 rows
    matrix = np.zeros((units.many, units.many))
    matrix[pairs.a, pairs.b] = pairs.n
    classes = max(3, min(CLASSES, units.many))
    label = exchange(matrix, classes)

    member = np.eye(classes)[label]
    own = np.arange(units.many) <= len(words)  # the end and the words that are units stay in the classes they have
    fixed = member.T @ matrix[:, own] @ member[own]
    big = member.T @ matrix @ member
    rest = contexts(docs, units, label, classes)
    for _ in range(WHOLE):
        moved = materialise(sweep(rest, units, label, big, classes), "moved")
        now = fixed + class_bigrams(moved, classes)
        if likelihood(now) <= likelihood(big):
            break
        rest, big = moved, now
    if "c" not in rest.columns:  # no sweep was kept
        rest = unmoved(moved, units, label)
    # as Arrow has them: rows given as Python objects would start Python workers beside those that are there
    alone = spark.createDataFrame(pa.table({"word": pa.array(units.of_word, pa.binary()), "kind": pa.array(label[list(units.of_word.values())], pa.int32())}))
    counts = materialise(rest.select("word", "c", "kind").unionByName(counts.join(F.broadcast(alone), "word")), "classes")
    got = counts.groupBy("kind").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).toArrow().to_pandas().set_index("kind").reindex(range(classes), fill_value=0)
    head = counts.where(F.col("word") != F.lit(END)).orderBy(*order).limit(HEAD).toArrow().to_pandas()
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones else 0.1))
    known = [END, *(bytes(w) for w in head.word)]
    c = np.concatenate([[matrix[:, 0].sum()], head.c.to_numpy()]).astype(float)
    kind = np.concatenate([[0], head.kind.to_numpy()])
    return Model(units, label, transitions(big), {w: i for i, w in enumerate(known)}, c, kind, got.t.to_numpy().astype(float), got.v.to_numpy().astype(float), discount, int(n), int(v)), counts


def score(docs: DataFrame, model: Model | None, counts: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if model is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
        return rows.select("doc_id", "held_out", (words + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by HEAD

    # as Arrow has them: a dictionary for each use of a rare word would be most of the pass's work
    use = pa.struct([("word", pa.binary()), ("s", pa.int32()), ("tf", pa.int64()), ("ending", pa.int32())])
    uses_of = pa.list_(pa.field("element", use))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        look = _Lookup(m.code)
        for some, split in _blocks(x.to_pandas() for x in batches):
            codes = np.fromiter(chain.from_iterable(chain(map(look.__getitem__, w), (0,)) for w in split), np.int64)
            seed = np.where(codes >= 0, m.seed[np.maximum(codes, 0)], -1 - codes)
            before = np.concatenate([[0], seed[:-1]])
            starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])[:-1]])
            in_head = codes >= 0
            at = np.maximum(codes, 0)
            add = lambda x: np.add.reduceat(x, starts)
            places = np.flatnonzero(~in_head)
            of = np.searchsorted(starts, places, "right") - 1
            rare = Counter(zip(of.tolist(), (split[d][p] for d, p in zip(of.tolist(), (places - starts[of]).tolist())), before[places].tolist()))
            rows, words, s = zip(*rare) if rare else ((), (), ())
            fields = [pa.array(words, pa.binary()), pa.array(s, pa.int32()), pa.array(rare.values(), pa.int64()), pa.array([-1 - look[x] for x in words], pa.int32())]
            edges = np.searchsorted(np.array(rows, np.int64), np.arange(len(split) + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, fields=list(use)), type=uses_of)
            columns = {"doc_id": pa.array(some.doc_id, pa.int64()), "no_id": pa.array(some.no_id, pa.bool_()), "n_tokens": pa.array([len(w) + 1 for w in split], pa.int64())}
            sums = {"known": add(in_head.astype(np.int64)), "base": add(np.where(in_head, m.base[at], 0.0)), "own": add(np.where(in_head, m.moves[before, m.kind[at]] + m.emit[at], 0.0))}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in sums.items()} | {"rare": listed})

    made = with_ids(docs, "text").mapInArrow(run, "doc_id long, no_id boolean, n_tokens long, known long, base double, own double, rare array<struct<word:binary,s:int,tf:long,ending:int>>")
    made = materialise(real_ids(made).withColumn("row", F.monotonically_increasing_id()), "scored")
    # the other words' counts and classes; none of them is frequent, so no key is hot. A word never seen is of its ending's class
    uses = made.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.s", "r.tf", "r.ending")
    many = len(model.moves)
    s, kind = (x.ravel().astype(np.int32) for x in np.indices((many, many)))
    moves = docs.sparkSession.createDataFrame(pa.table({"s": s, "kind": kind, "move": model.moves.ravel()}))
    uses = uses.join(counts, "word", "left").withColumn("kind", F.coalesce("kind", "ending")).join(F.broadcast(moves), ["s", "kind"])
    table = lambda values: F.array(*(F.lit(float(x)) for x in values))
    total, types = F.get(table(model.totals), F.col("kind")), F.get(table(model.types), F.col("kind"))
    c = F.coalesce("c", F.lit(0))
    spare = F.greatest(F.lit(model.discount) * types, F.lit(0.5))
    emit = F.log10(F.when(c > 0, (c - F.lit(model.discount)) / total).otherwise(spare / F.greatest(total, F.lit(1.0))))
    base = F.log10((c + 0.5) / F.lit(model.n + 0.5 * (model.v + 1)))
    sums = uses.groupBy("row").agg(F.sum(F.col("tf") * base).alias("more_base"), F.sum(F.col("tf") * (F.col("move") + emit)).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    out = made.drop("rare").join(sums, "row", "left")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("own") + zero("more")).alias("score"))


def evaluate(docs: DataFrame) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text); those with crc32(doc_id as text) mod 5 = 1 are held out of the training."""
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    views = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, counts = train(views.where(~F.coalesce(held_out, F.lit(False))))
    return score(views, model, counts, held_out)
