"""Removal of repeated strings with a logarithmic family of suffix arrays (operator 6).

A byte goes if a string of ``length`` bytes that covers it starts earlier too. The suffixes
of all documents are dealt over shards so that equal strings meet: each string of
``length`` bytes has an anchor, the place inside it whose shorter string has the least hash, and
the anchor's hash names the shard. Neighbouring strings with one anchor make a segment. Of equal segments (by a 128-bit
cryptographic digest) only the first goes on, first among those of a task's batch, then in the shard. The
suffixes of the distinct segments that share an anchor come in batches in the order of their documents. A batch's suffixes, cut to
``length`` bytes, are sorted by their bytes into a suffix array; it is merge-scanned against the levels that exist for
suffixes that started earlier, and becomes a level; a level that is as large as the one below is merged with it, so there are
logarithmically many. Suffixes are compared byte by byte.

Only suffixes whose anchor occurs twice can repeat: anchors alone are counted first, and the others are not sent.
Anchors that a sample of documents shows to be very frequent aren't counted (they occur twice), and their strings are dealt
and compared by their own digests instead, so that they spread over all shards; the sample decides the way, not the result.
Texts are dealt by document to fetch the suffixes and to cut the texts. The number of shards and of document buckets follows the bytes of
the input, and a task holds one at a time.

Defined results: a null or short text has nothing removed; matches lie inside one document and may overlap;
strings are judged on the input; a null doc_id comes after all others; rows that share a doc_id count in the order of
their texts' hashes, and rows that share text too as one document, each with its result; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import real_ids, shuffle_parts, with_ids

LENGTH = 100
#: Bytes that are hashed at once, suffixes in a batch and in the families held at once (unless one anchor has more), bytes gathered before they are sent.
BLOCK, BATCH, CHUNK, SEND = 1 << 20, 1 << 15, 1 << 18, 12_000_000
#: Bytes of text in a shard or a bucket of documents, about; there is at least one for each shuffle partition.
SHARD = 16_000_000
#: Documents in the sample that shows frequent anchors, and distinct segments there that make an anchor frequent.
SAMPLE, FREQUENT = 4_000, 8
LAST = 2**63 - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _A) ^ (np.arange(1, 257, dtype=np.uint64) * _B >> np.uint64(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair."""
    x = a * _A
    x += b
    x ^= x >> _C
    x *= _B
    return x


def hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the strings of ``n`` bytes that start at every place: two that overlap make one of any length."""
    level, size = _BYTES[data], 1
    while 2 * size <= n:
        level, size = _join(level[:-size], level[size:]), 2 * size
    return _join(level[: len(data) - n + 1], level[n - size : len(data) - size + 1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first, many) of the anchors of a text: ``many`` strings from place ``first`` on have the anchor."""
    inner = max(4, length * 32 // 100)
    width = length - inner + 1
    low = np.uint64(BLOCK.bit_length())
    for start in range(0, len(data) - length + 1, BLOCK - length):
        part = data[start : start + BLOCK]
        if len(part) < length:
            break
        h = hashes(part, inner)
        # the low bits give way to the place: of equal hashes the leftmost counts
        at = _least((h >> low << low) | np.arange(len(h), dtype=np.uint64), width) & np.uint64((1 << int(low)) - 1)
        at = at.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        if start + BLOCK <= len(data):  # the last strings of a full block belong to the next one as well
            limit = BLOCK - length
            first = first[first < limit]
            many = np.diff(np.concatenate([first, [limit]]))
        else:
            many = np.diff(np.concatenate([first, [len(at)]]))
        yield h[at[first]], first + start, many


class Family:
    """Suffix arrays of geometric sizes; each is a sorted array of distinct cut suffixes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Whether each of a batch's suffixes, in the order of their start, started earlier; the batch becomes a level."""
        array, first, where = np.unique(suffixes, return_index=True, return_inverse=True)
        seen = np.zeros(len(array), bool)
        for level in self.levels:  # a merge scan of two sorted arrays, leaping over what lies between
            at = np.searchsorted(level, array)
            seen |= level[np.minimum(at, len(level) - 1)] == array
        repeated = np.ones(len(suffixes), bool)
        repeated[first] = False
        repeated |= seen[where]
        if not seen.all():
            self.levels.append(array[~seen])
        while len(self.levels) > 1 and len(self.levels[-1]) >= len(self.levels[-2]):
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(np.sort(np.concatenate([a, b]), kind="stable"))  # two runs: one merge
        return repeated


def _packed(*columns: np.ndarray, blob: bytes = b"") -> bytes:
    """Columns of 64-bit integers of one length, and bytes, compressed."""
    import zstandard

    head = struct.pack("<qq", len(columns), len(columns[0]))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).astype("<i8", copy=False).tobytes() for c in columns) + blob)


def _unpacked(data: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    k, n = struct.unpack_from("<qq", raw)
    return [np.frombuffer(raw, "<i8", n, 16 + 8 * n * i) for i in range(k)], raw[16 + 8 * n * k :]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _joined(did: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents, those that touch made one."""
    if not len(did):
        return did, tie, start, end
    order = np.lexsort((start, tie, did))
    did, tie, start, end = (c[order] for c in (did, tie, start, end))
    group = np.cumsum(_fresh(did, tie)) << 40  # a text's size is under 2**31
    reach = np.maximum.accumulate(group + end)
    new = np.concatenate([[True], group[1:] + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(did) - 1]])
    return did[first], tie[first], start[first], reach[last] - group[last]


def _digests(pieces: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in pieces), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


#: Rows between the steps: for a shard or a bucket of documents (ROWS; STRINGS by digest), or for documents by way of a shard's step (ON).
ROWS, ON, TEXT, STRINGS = 0, 1, 2, 3
_COLUMNS = ["bucket", "kind", "data"]


def _anchor_rows(length: int, shards: int, buckets: int, frequent: np.ndarray):
    """Documents -> for each shard, (anchor hash, document, tie); frequent anchors go on to their documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def sent() -> pd.DataFrame:
            h, d, t = (np.concatenate(x) for x in zip(*held, strict=True))
            known = np.isin(h, frequent)
            on = _to_documents([(d[known], t[known], _signed(h[known]))], buckets, ON)
            h, d, t = h[~known], d[~known], t[~known]
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, ROWS, _packed(_signed(h)[p], d[p], t[p])) for s in range(shards) if len(p := order[ends[s] : ends[s + 1]])]
            return pd.concat([on, pd.DataFrame(rows, columns=_COLUMNS)])

        for df in frames:
            for did, tie, text in zip(df.did, df.tie, df.text, strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                if len(data) < length:
                    continue
                found, counts = np.unique(np.concatenate([a[0] for a in anchors(data, length)]), return_counts=True)
                found = np.concatenate([found, found[counts > 1]])  # twice in one document is twice
                held.append((found, np.full(len(found), did), np.full(len(found), tie)))
                size += len(data)
                if size >= SEND:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


def frequent_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Sorted hashes of anchors that have many distinct segments in a sample of documents."""
    many = max(1, docs.count() // SAMPLE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for text in df.text:
                raw = (text or "").encode()
                for h, first, n in anchors(np.frombuffer(raw, np.uint8), length):
                    own = _digests(raw[a : a + k + length - 1] for a, k in zip(first.tolist(), n.tolist(), strict=True))[0]
                    yield pd.DataFrame({"h": _signed(h), "segment": own}).drop_duplicates()

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(many)) == 0).select("text").distinct()
    got = some.mapInPandas(run, "h long, segment long").distinct().groupBy("h").count().where(F.col("count") >= FREQUENT).select("h").toPandas()
    return np.sort(got.h.to_numpy(np.int64).view(np.uint64))


def _to_documents(rows: list[tuple[np.ndarray, ...]], buckets: int, kind: int = ROWS) -> pd.DataFrame:
    """Rows whose first column is the document, packed for each of the documents' buckets."""
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else []
    if not columns or not len(columns[0]):
        return pd.DataFrame({"bucket": np.zeros(0, np.int64), "kind": np.zeros(0, np.int64), "data": []})
    bucket = columns[0] % buckets
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return pd.DataFrame([(b, kind, _packed(*(c[p] for c in columns))) for b in range(buckets) if len(p := order[ends[b] : ends[b + 1]])], columns=_COLUMNS)


def _by_shard(work):
    """A mapInPandas function over sorted rows: ``work`` gets one shard's data of a kind at a time; what goes on to documents is passed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, []
        for df in frames:
            yield df[df.kind == ON]
            for row in df[df.kind != ON].itertuples(index=False):
                if (row.bucket, row.kind) != shard and held:
                    full, held = held, []
                    yield work(full, shard[1])
                shard = row.bucket, row.kind
                held.append(row.data)
        if held:
            yield work(held, shard[1])

    return run


def _repeated_anchors(buckets: int):
    """A shard's anchors -> those that occur twice, for each bucket of documents: (document, tie, hash)."""

    def work(held: list[bytes], _: int) -> pd.DataFrame:
        h, d, t = (np.concatenate(c) for c in zip(*(_unpacked(x)[0] for x in held), strict=True))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return _to_documents([(d[twice], t[twice], h[twice])], buckets)

    return _by_shard(work)


def _with_documents(frames: Iterator[pd.DataFrame], key: int) -> Iterator[tuple[pd.Series, list[np.ndarray]]]:
    """Documents' rows in sorted frames, each with its rows from the packed data that came before it in its bucket."""
    bucket, packed, table = None, [], None
    for df in frames:
        for row in df.itertuples(index=False):
            if row.bucket != bucket:
                bucket, packed, table = row.bucket, [], None
            if row.kind != TEXT:
                packed.append(row.data)
                continue
            if table is None:
                columns = [np.concatenate(c) for c in zip(*(_unpacked(x)[0] for x in packed), strict=True)] if packed else []
                if columns:
                    order = np.lexsort((columns[1], columns[0]))
                    columns = [c[order] for c in columns]
                table, packed = columns, []
            if not table:
                yield row, []
                continue
            a, b = np.searchsorted(table[0], row.did), np.searchsorted(table[0], row.did, "right")
            mine = table[1][a:b] == row.tie
            yield row, [c[a:b][mine] for c in table[key:]]


def _suffix_rows(length: int, shards: int, buckets: int, frequent: np.ndarray):
    """Documents with their repeated anchors -> for each shard, distinct segments: (key, document, tie, first, many) and their bytes.

    Strings of frequent anchors go as their digests: (digest, digest, document, tie, first). Segments and strings that the
    batch has earlier go on to their documents as spans.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        pieces: list[bytes] = []
        size = 0

        def sent() -> pd.DataFrame:
            key, own, did, tie, first, many = (np.concatenate(c) for c in zip(*held, strict=True))
            d0, d1 = _digests(iter(pieces))
            key = np.where(own, d0, key)
            order = np.lexsort((first, tie, did, d1, d0))
            new = _fresh(d0[order], d1[order])
            again = order[~new]
            on = _to_documents([_joined(did[again], tie[again], first[again], first[again] + many[again] + length - 1)], buckets, ON)
            up = np.sort(order[new])
            shard = (key[up].view(np.uint64) % np.uint64(shards)).astype(np.int64)
            rows = []
            for s in np.unique(shard):
                p = up[shard == s]
                p, q = p[~own[p]], p[own[p]]
                if len(p):
                    rows.append((s, ROWS, _packed(key[p], did[p], tie[p], first[p], many[p], blob=b"".join(pieces[i] for i in p.tolist()))))
                if len(q):
                    rows.append((s, STRINGS, _packed(d0[q], d1[q], did[q], tie[q], first[q])))
            return pd.concat([on, pd.DataFrame(rows, columns=_COLUMNS)])

        for row, found in _with_documents(frames, 2):
            if not found or not len(found[0]):
                continue
            raw, wanted = row.text.encode(), np.unique(found[0])
            for h, first, many in anchors(np.frombuffer(raw, np.uint8), length):
                ours = np.isin(_signed(h), wanted)
                h, first, many = h[ours], first[ours], many[ours]
                own = np.isin(h, frequent)  # their strings are dealt one by one
                n = np.where(own, many, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first, many, own, h = np.repeat(first, n) + step, np.repeat(np.where(own, 1, many), n), np.repeat(own, n), np.repeat(h, n)
                if len(h):
                    held.append((_signed(h), own, np.full(len(h), row.did), np.full(len(h), row.tie), first, many))
                    new = [raw[a : a + k + length - 1] for a, k in zip(first.tolist(), many.tolist(), strict=True)]
                    pieces += new
                    size += sum(map(len, new))
                if size >= SEND:
                    yield sent()
                    held, pieces, size = [], [], 0
        if held:
            yield sent()

    return run


def _shard_spans(length: int, buckets: int):
    """A shard's segments or strings -> spans to remove, for each bucket of documents: (document, tie, start, end)."""

    def strings(held: list[bytes]) -> pd.DataFrame:
        d0, d1, did, tie, first = (np.concatenate(c) for c in zip(*(_unpacked(x)[0] for x in held), strict=True))
        order = np.lexsort((first, tie, did, d1, d0))
        again = order[~_fresh(d0[order], d1[order])]
        return _to_documents([_joined(did[again], tie[again], first[again], first[again] + length)], buckets)

    def work(held: list[bytes], kind: int) -> pd.DataFrame:
        if kind == STRINGS:
            return strings(held)
        parts = [_unpacked(x) for x in held]
        key, did, tie, first, many = (np.concatenate(c) for c in zip(*(c for c, _ in parts), strict=True))
        raw = b"".join(blob for _, blob in parts)
        del parts
        sizes = many + length - 1
        place = np.cumsum(sizes) - sizes
        d0, d1 = _digests(raw[a : a + n] for a, n in zip(place.tolist(), sizes.tolist(), strict=True))
        order = np.lexsort((first, tie, did, d1, d0))
        new = _fresh(d0[order], d1[order])
        again, ones = order[~new], order[new]
        out = [(did[again], tie[again], first[again], first[again] + sizes[again])]
        # distinct segments of an anchor that has more than one, in chunks of whole anchors
        ones = ones[np.argsort(key[ones], kind="stable")]
        group = np.cumsum(_fresh(key[ones])) - 1
        counts = np.bincount(group, minlength=1)
        ones = ones[counts[group] > 1]
        starts = np.flatnonzero(_fresh(key[ones])) if len(ones) else np.zeros(0, int)
        total = np.concatenate([[0], np.cumsum(many[ones])])
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
        at = 0
        while at < len(ones):
            ends = np.append(starts[starts > at], len(ones))
            to = int(ends[max(0, np.searchsorted(total[ends], total[at] + CHUNK, "right") - 1)])
            rows, at = ones[at:to], to
            rows = rows[np.lexsort((first[rows], tie[rows], did[rows]))]
            out += _family_spans(rows, did, tie, first, many, place, windows, length)
        return _to_documents([_joined(*(np.concatenate(c) for c in zip(*out, strict=True)))], buckets)

    return _by_shard(work)


def _family_spans(rows: np.ndarray, did: np.ndarray, tie: np.ndarray, first: np.ndarray, many: np.ndarray, place: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[np.ndarray, ...]]:
    """Spans of the suffixes of some segments, in their documents' order, that started earlier."""
    family, out = Family(), []
    row = np.repeat(rows, many[rows])
    step = np.arange(len(row)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows])
    for at in range(0, len(row), BATCH):
        r, k = row[at : at + BATCH], step[at : at + BATCH]
        gone = family.add(np.ascontiguousarray(windows[place[r] + k]).view(f"S{length}").ravel())
        r, k = r[gone], k[gone]
        out.append((did[r], tie[r], first[r] + k, first[r] + k + length))
    return out


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with their spans -> what is left of each."""
    rows, size = [], 0
    for row, found in _with_documents(frames, 2):
        raw = (row.text or "").encode()
        none = np.zeros(0, np.int64)
        start, end = found if found else (none, none)
        _, _, start, end = _joined(np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start, end)
        kept, at = [], 0
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        rows.append((row.did, row.no_id, len(raw), int((end - start).sum()), len(start), b"".join(kept)))
        size += len(raw)
        if size >= SEND:
            yield _results(rows)
            rows, size = [], 0
    yield _results(rows)


def _results(rows: list[tuple]) -> pd.DataFrame:
    doc, no_id, n, removed, spans, kept = zip(*rows, strict=True) if rows else ((),) * 6
    longs = {c: np.array(v, np.int64) for c, v in (("doc_id", doc), ("n_bytes", n), ("n_removed", removed), ("n_spans", spans))}
    return pd.DataFrame(longs | {"no_id": np.array(no_id, bool), "kept": list(kept)})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) of every row of ``docs`` (doc_id, text)."""
    parts = shuffle_parts(docs.sparkSession)
    rows = with_ids(docs, "text").withColumn("did", F.when(F.col("no_id"), F.lit(LAST)).otherwise(F.col("doc_id")))
    by_id = rows.groupBy("did").agg((F.count(F.lit(1)) > 1).alias("many"), F.sum(F.octet_length("text")).alias("bytes"))
    shared_ids, size = by_id.agg(F.max("many"), F.sum("bytes")).first()
    shards = buckets = max(parts, -(-(size or 0) // SHARD))
    tie = F.coalesce(F.xxhash64("text"), F.lit(0)) if shared_ids else F.lit(0).cast("long")
    rows = rows.select("did", "no_id", tie.alias("tie"), "text")
    sharded = rows.where(F.octet_length("text") >= length)
    frequent = frequent_anchors(sharded, length)
    if shared_ids:
        sharded = sharded.dropDuplicates(["did", "tie"])
    packed = "bucket long, kind int, data binary"
    by_bucket = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")

    def meet(data: DataFrame, texts: DataFrame) -> DataFrame:
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        left = data.select("bucket", "kind", "data", zero.alias("did"), F.lit(False).alias("no_id"), zero.alias("tie"), none.alias("text"))
        right = texts.select(F.pmod("did", F.lit(buckets)).alias("bucket"), F.lit(TEXT).alias("kind"), F.lit(None).cast("binary").alias("data"), "did", "no_id", "tie", "text")
        return by_bucket(left.unionByName(right))

    twice = by_bucket(sharded.select("did", "tie", "text").mapInPandas(_anchor_rows(length, shards, buckets, frequent), packed)).mapInPandas(_repeated_anchors(buckets), packed)
    suffixes = meet(twice, sharded).mapInPandas(_suffix_rows(length, shards, buckets, frequent), packed)
    spans = by_bucket(suffixes).mapInPandas(_shard_spans(length, buckets), packed)
    out = meet(spans, rows).mapInPandas(_cut, "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return real_ids(out).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
