"""Removal of repeated substrings with difference-cover suffix arrays.

A string of `length` bytes that also starts earlier is repeated. Every string has one anchor, the smallest hash
among its 24-byte grams, which depends on its bytes alone; strings with equal bytes so meet under the same
anchor, and anchors deal the work out. A document's strings with the same anchor are neighbours and form a span.

1. All spans are listed as (anchor, hash of the span, document, place). Of equal spans the first stays, all
   others are repeated as a whole (within a document, as in periodic text, at once); an anchor that occurs once, or
   whose spans are all equal, is done.
2. The bytes of the remaining spans go to their anchor's task. Each string reaches far to one side of its anchor, so
   spans that agree with no other on either side are done. Of the others a suffix array is built by the
   difference-cover algorithm: suffixes at places 1 and 2 modulo 3 are sorted by triples and named, names are
   recursed on until they differ, the remaining suffixes are sorted by one character and a name, and both
   orders are merged. Neighbours in the array are compared by their first `length` bytes; of each run of equal
   ones the first in order of documents stays.
3. Each document's repeated strings are united to spans of bytes, removed from its text.

An anchor with more than `most_spans` different spans has its strings dealt out one by one under a hash of their
own, so that no task holds an unbounded group. Nothing is sampled: step 1 only settles spans whose outcome is
known, and equal hashes of spans are 128 bits with the anchor's.

Null texts count as empty; texts shorter than `length` are kept whole. Rows that share an id follow one another in an
order of their texts' hashes, so that of equal rows one keeps its text. A row without an id is kept whole. Longer texts
than PIECE are read in pieces, but lie in memory twice. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import common

GRAM = 24
MOST_SPANS = 2000
#: Bytes of spans that one suffix array covers, roughly; whole anchors only.
ARRAY_BYTES = 1 << 17
#: Windows whose least grams are found at once; the numbers they need fit into a core's cache.
BLOCK = 1 << 14
#: Bytes of texts that are worked on at once, so that all arrays stay in the cache; a longer text is read piece by piece.
PIECE = 1 << 18
#: Places of the nth row of an id begin at nth << ROW.
ROW = 40


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers below 2**20, fewer than 2**20 of them, by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n >= 1 << 20 or n and t.max() >= 1 << 20:
        raise ValueError(f"{n} symbols up to {t.max()} do not fit into packed triples")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    # Sample: places 1 and 2 modulo 3; one more place of the first kind where it keeps the halves apart.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = (s[sample] << 42) | (s[sample + 1] << 21) | s[sample + 2]
    order = np.argsort(triple)
    new = np.empty(len(order), bool)
    new[0] = True
    sorted_ = triple[order]
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(name)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    ranked = sample[order]
    ranked = ranked[ranked < n]
    # The rest: by character and the rank of what follows.
    rest = np.arange(0, n, 3)
    key = (s[rest] << 21) | rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    # Merge: for each sampled suffix the number of remaining ones before it.
    far = (s[rest] << 42) | (s[rest + 1] << 21) | rank[rest + 2]
    ahead = np.empty(len(ranked), np.int64)
    first = ranked % 3 == 1
    i = ranked[first]
    ahead[first] = np.searchsorted(key, (s[i] << 21) | rank[i + 1])
    i = ranked[~first]
    ahead[~first] = np.searchsorted(far, (s[i] << 42) | (s[i + 1] << 21) | rank[i + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(ranked)) + ahead
    free = np.ones(n, bool)
    free[place] = False
    out[place] = ranked
    out[np.flatnonzero(free)] = rest
    return out


def anchored(body: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Spans of all texts: text, place in it, number of strings, anchor, hash of the span, place of the anchor in the span."""
    last = len(body) - length + 1  # strings start below
    empty = np.zeros(0, np.int64)
    if last <= 0:
        return empty, empty, empty, empty, empty, empty
    running = common.running_hash(body)
    value, place = _least_grams(running, last, length - GRAM + 1)
    # A span ends where the least gram changes, and with its text; strings that would leave their text are none.
    new = np.ones(last, bool)
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[at[:-1][at[:-1] < last]] = True
    lo = np.flatnonzero(new)
    text = np.searchsorted(at, lo, "right") - 1
    n = np.minimum(np.append(lo[1:], last), at[text + 1] - length + 1) - lo
    some = n > 0
    if not some.any():
        return empty, empty, empty, empty, empty, empty
    lo, text, n = lo[some], text[some], n[some]
    anchor = place[lo]
    span = common.span_hash(running, lo, lo + n + length - 1)
    span = common.mix(span ^ ((anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return text, lo - at[text], n, value[anchor].view(np.int64), span.view(np.int64), anchor - lo


def _repeats(text: np.ndarray, anchor: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Spans that equal an earlier one of the same text."""
    by = np.lexsort((np.arange(len(text)), span, anchor, text))
    same = np.zeros(len(by), bool)
    same[1:] = (text[by][1:] == text[by][:-1]) & (anchor[by][1:] == anchor[by][:-1]) & (span[by][1:] == span[by][:-1])
    out = np.zeros(len(by), bool)
    out[by] = same
    return out


def _least_grams(running: np.ndarray, last: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each of the first `last` windows of grams the place of its least hash.

    Worked on by blocks that fit into a cache. A hash's low bits give way to its place in the block, so that one
    minimum finds both; of hashes that agree in all higher bits the first counts, whatever text they lie in.
    """
    _, down = common.POWERS.upto(len(running))
    value, place = np.empty(last + window - 1, np.uint64), np.empty(last, np.int64)
    bits = np.uint64((BLOCK + window).bit_length())  # the same for all texts
    low = (np.uint64(1) << bits) - np.uint64(1)
    for a in range(0, last, BLOCK):
        b = min(a + BLOCK, last)
        e = b + window - 1
        v = common.mix((running[a + GRAM : e + GRAM] - running[a:e]) * down[a:e] + np.uint64(GRAM))
        value[a:e] = v
        v = (v & ~low) | np.arange(e - a, dtype=np.uint64)
        wide = 1
        while wide * 2 <= window:
            v = np.minimum(v[wide:], v[:-wide])
            wide *= 2
        if wide < window:
            v = np.minimum(v[window - wide :], v[: wide - window])
        place[a:b] = (v & low).view(np.int64) + a
    return value, place


def spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text, nth to anchor, span, doc_id, lo, n, off, again.

    Rows that are marked again are strings known to be repeated, neighbours united, under an anchor of their own.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = common.text_bytes(b.column(1))
            ids, rows = b.column(0).to_numpy(), b.column(2).to_numpy() << ROW
            x = y = 0
            while (x := y) < len(ids):
                y = max(x + 1, int(np.searchsorted(at, at[x] + PIECE, "right")) - 1)
                for p in range(at[x], max(at[x] + 1, at[y] - length + 1), PIECE if y - x == 1 else len(body) + 1):
                    upto = min(at[y], p + PIECE + length - 1) if y - x == 1 else at[y]
                    text, lo, n, anchor, span, off = anchored(body[p:upto], np.clip(at[x : y + 1] - p, 0, upto - p), length)
                    lo = lo + (p - at[x] if y - x == 1 else 0) + rows[x:y][text]
                    again = _repeats(text, anchor, span)
                    yield out(ids[x:y][text[~again]], anchor[~again], span[~again], lo[~again], n[~again], off[~again], False)
                    if again.any():
                        t, a, m = text[again], lo[again], n[again]
                        new = np.ones(len(t), bool)
                        new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1] + m[:-1])
                        first = np.flatnonzero(new)
                        t, a, m = t[first], a[first], np.add.reduceat(m, first)
                        key = common.mix(ids[x:y][t].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)).view(np.int64)
                        yield out(ids[x:y][t], key, a, a, m, np.zeros(len(a)), True)

    def out(ids, anchor, span, lo, n, off, again: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(span), pa.array(ids), pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int16)), pa.array(np.full(len(ids), again))], ["anchor", "span", "doc_id", "lo", "n", "off", "again"])

    return common.map_arrow(docs, listed, "anchor long, span long, doc_id long, lo long, n int, off short, again boolean")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, nth and the compressed bytes of the text, for shuffles."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([press.compress(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "nth", "packed"])

    return common.map_arrow(docs, small, "doc_id long, nth long, packed binary")


def _fields(lists: pa.ListArray) -> Iterator[Iterator[tuple]]:
    """For each row of lists of structs the structs' fields as tuples; a null list is empty."""
    each = zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True)
    for n in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
        yield islice(each, n)


def span_bytes(docs: DataFrame, asked: DataFrame, length: int, most_spans: int) -> DataFrame:
    """key, doc_id, lo, off, body: the bytes of the asked spans; of anchors with very many spans, string by string."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            keys, ids, los, offs, bodies = [], [], [], [], []
            each = _fields(b.column(3))
            for doc, nth, z, want in zip(*(c.to_pylist() for c in b.columns[:3]), each, strict=True):
                text, base = press.decompress(z), nth << ROW
                for anchor, lo, n, off, spans in want:
                    lo -= base
                    if spans <= most_spans:
                        keys.append(anchor)
                        ids.append(doc)
                        los.append(lo + base)
                        offs.append(off)
                        bodies.append(text[lo : lo + n + length - 1])
                        continue
                    for p in range(lo, lo + n):
                        own = text[p : p + length]
                        keys.append(int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True))
                        ids.append(doc)
                        los.append(p + base)
                        offs.append(-1)
                        bodies.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(los, pa.int64()), pa.array(offs, pa.int16()), pa.array(bodies, pa.binary())], ["key", "doc_id", "lo", "off", "body"])

    want = asked.groupBy("doc_id", F.shiftright("lo", ROW).alias("nth")).agg(F.collect_list(F.struct("anchor", "lo", "n", "off", "spans")).alias("want"))
    return common.map_arrow(packed(docs).join(want, ["doc_id", "nth"]), cut, "key long, doc_id long, lo long, off short, body binary")


def agreeing(bodies: list[bytes], keys: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Spans that may share a string with another of their key.

    A string has length - GRAM bytes beside its anchor's gram, so half of them or more lie on one side of it; on
    that side the spans of equal strings agree. Strings dealt out one by one (off < 0) may if their key has different
    ones; equal ones were counted when they were read.
    """
    half = (length - GRAM) // 2
    sizes = np.array([len(x) for x in bodies])
    at = np.concatenate([[0], np.cumsum(sizes)])
    running = common.running_hash(np.frombuffer(b"".join(bodies), np.uint8))
    keep = np.zeros(len(bodies), bool)
    i = np.flatnonzero(offs < 0)
    if len(i):
        _, where, count = np.unique(keys[i], return_inverse=True, return_counts=True)
        keep[i] = count[where] > 1
    anchor = at[:-1] + offs
    for has, start, stop in ((offs >= half, anchor - half, anchor), (sizes >= offs + GRAM + half, anchor + GRAM, anchor + GRAM + half)):
        i = np.flatnonzero(has & (offs >= 0))
        if len(i):
            side = common.mix(common.span_hash(running, start[i], stop[i]) ^ common.mix(keys[i].view(np.uint64)))
            _, where, count = np.unique(side, return_inverse=True, return_counts=True)
            keep[i[count[where] > 1]] = True
    return keep


def repeated_in(bodies: list[bytes], ids: np.ndarray, los: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, from, to: bytes of the given spans covered by strings that start earlier among them."""
    sizes = np.array([len(x) for x in bodies])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    body = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    t = body.astype(np.int64) + 2
    t[at[1:] - 1] = 1
    order = suffix_array(t)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    order = order[order + length < at[owner[order] + 1]]  # strings that fit into their span
    # Adjacent prefixes: equal hashes first, then the bytes themselves.
    running = common.running_hash(body)
    prefix = common.span_hash(running, order, order + length)
    same = np.zeros(len(order), bool)
    same[1:] = prefix[1:] == prefix[:-1]
    hit = np.flatnonzero(same)
    view = np.lib.stride_tricks.sliding_window_view(body, length)
    for a in range(0, len(hit), 1 << 14):
        h = hit[a : a + (1 << 14)]
        same[h] = (view[order[h]] == view[order[h - 1]]).all(1)
    run = np.cumsum(~same)
    doc, place = ids[owner[order]], los[owner[order]] + order - at[owner[order]]
    by = np.lexsort((place, doc, run))
    again = np.ones(len(by), bool)
    again[:1] = False
    again[1:] = run[by][1:] == run[by][:-1]
    again = order[by[again]]
    again.sort()
    if not len(again):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.ones(len(again), bool)
    new[1:] = again[1:] != again[:-1] + 1
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(again)))
    o = owner[again[first]]
    start = los[o] + again[first] - at[o]
    return ids[o], start, start + n + length - 1


def repeated_spans(bytes_: DataFrame, length: int) -> DataFrame:
    """doc_id, lo, hi of repeated strings: a suffix array for each run of whole anchors."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, keys, ids, los, offs, held, group, last = [], [], [], [], [], 0, 0, None

        def out() -> pa.RecordBatch:
            keep = np.flatnonzero(agreeing(bodies, np.array(keys, np.int64), np.array(offs, np.int64), length))
            z = np.zeros(0, np.int64)
            found = repeated_in([bodies[i] for i in keep], np.array(ids)[keep], np.array(los)[keep], length) if len(keep) else (z, z, z)
            for x in (bodies, keys, ids, los, offs):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["doc_id", "lo", "hi"])

        for b in batches:
            done: list[tuple[int, int]] = []
            for key, doc, lo, off, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last:
                    if held >= ARRAY_BYTES // 2:
                        yield out()
                        held = 0
                    last, group = key, len(bodies)
                elif len(body) == length and bodies and len(bodies) > group and bodies[-1] == body:
                    done.append((doc, lo))  # a string by itself, as the one before it, which starts earlier
                    continue
                bodies.append(body)
                keys.append(key)
                ids.append(doc)
                los.append(lo)
                offs.append(off)
                held += len(body) + 1
            if done:
                d, p = np.array(done).T
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(p + length)], ["doc_id", "lo", "hi"])
        if bodies:
            yield out()

    dealt = bytes_.repartition("key").sortWithinPartitions("key", "doc_id", "lo")
    return common.map_arrow(dealt, arrays, "doc_id long, lo long, hi long")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for nth, z, gone in zip(*(c.to_pylist() for c in b.columns[1:3]), _fields(b.column(3)), strict=True):
                text, digest, done, removed, n, base = press.decompress(z), hashlib.sha256(), 0, 0, 0, nth << ROW
                for lo, hi in sorted(gone):
                    lo, hi = lo - base, min(hi - base, len(text))
                    if hi <= done and n:
                        continue
                    if lo > done or not n:
                        digest.update(text[done:lo])
                        n += 1
                        removed += hi - lo
                    else:
                        removed += hi - done
                    done = hi
                digest.update(text[done:])
                rows.append((len(text), removed, n, digest.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    lists = gone.groupBy("doc_id", F.shiftright("lo", ROW).alias("nth")).agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    joined = packed(docs).join(lists, ["doc_id", "nth"], "left").select("doc_id", "nth", "packed", "gone")
    return common.map_arrow(joined, kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with nth: 0, but a number for each row of an id that repeats. Only such rows are moved and sorted."""
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    zero = F.lit(0).cast("long").alias("nth")
    if again.isEmpty():
        return rows.select("doc_id", "text", zero)
    again = common.stored(again, "repeated-ids")
    held = common.stored(rows.join(again, "doc_id", "left_semi").withColumn("m", F.monotonically_increasing_id()), "repeated-rows")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "m"))
    numbers = held.select("doc_id", F.xxhash64("text").alias("h"), "m").select("m", (place - 1).cast("long").alias("nth"))
    return rows.join(again, "doc_id", "left_anti").select("doc_id", "text", zero).union(held.join(numbers, "m").select("doc_id", "text", "nth"))


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", most_spans: int = MOST_SPANS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = numbered(rows)
    named = rows.where(F.col("doc_id").isNotNull())
    by = Window.partitionBy("anchor")
    first = F.coalesce(F.lag("span").over(by.orderBy("span", "doc_id", "lo")) != F.col("span"), F.lit(True))
    each = spans(named, length).withColumn("first", first)
    each = each.withColumn("all", F.count("*").over(by)).withColumn("spans", F.sum(F.col("first").cast("int")).over(by))
    met = common.stored(each.where("again or all > 1 and (not first or spans > 1)").drop("all", "span"), "spans")
    whole = met.where("again or not first").select("doc_id", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    asked = met.where("first and not again").select("anchor", "doc_id", "lo", "n", "off", "spans")
    found = repeated_spans(span_bytes(named, asked, length, most_spans), length)
    return without(rows, whole.union(found))
