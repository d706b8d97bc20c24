"""Token-ID output as Arrow files of fixed-size-list batches.

Documents are dealt by ranges of their id; each task encodes its range in order and streams the ids, cut into
equal-length sequences, to one Arrow file of record batches (ids: fixed-size list, mask: fixed-size list of
booleans, false on the padding of the last sequence). A second Arrow file beside it has a row per document. A
reader maps the file and reaches sequence k at batch k // batch, row k % batch without copying or decoding.

Files go to the shared folder under names that no other attempt uses; the manifest, a table written by Spark's
commit protocol, names those that count, so a lost executor or a repeated task leaves orphans at most.

Null and empty texts have the end id only. Ties of ids are kept, in order of their texts. Null ids come first.
An empty table gives no files and no rows. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import common

SEQUENCE, BATCH_SEQUENCES = 2048, 256
#: Distinct pieces after which a worker process begins its memo anew: some 20 MB.
MEMO_PIECES = 300_000
END_ID = 2


def _open(uri: str, mode: str):
    """A file of the shared folder: local and mapped where it is a mounted path, else by Arrow's file systems."""
    if urlparse(uri).scheme in ("", "file"):
        path = urlparse(uri).path
        if mode == "r":
            return pa.memory_map(path, "r")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return pa.OSFile(path, "wb")
    system, path = pa.fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


#: The pre-tokenizer's pattern that is known here (a fixed value of the vocabulary's format).
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, DIGIT, MARK, STRANGE = range(5)


def _kinds() -> np.ndarray:
    """Kinds of bytes: the four blanks that every definition of white space has, ASCII, bytes beyond as letters."""
    t = np.full(256, STRANGE, np.uint8)
    t[33:127] = MARK
    t[48:58] = DIGIT
    t[65:91] = t[97:123] = t[128:] = LETTER
    t[[32, 9, 10, 13]] = BLANK
    return t


_KIND = _kinds()


class Pieces:
    """The pieces of texts that lie on end, as the known pre-tokenizer cuts them, in lower case.

    A word between blanks that has anything but ASCII and the letters of Latin-1, or the beginning of a special token,
    is odd: a piece as it is, which the tokenizer must cut itself.
    """

    def __init__(self, body: np.ndarray, at: np.ndarray, special: list[bytes]):
        x = np.insert(body, at, 32)  # a blank before each text, and the last
        kind = _KIND[x]
        blank = kind == BLANK
        after = np.flatnonzero(x[:-1] == 0xC3) + 1
        strange = (kind == STRANGE) | (x >= 0xC0) & (x != 0xC3)
        strange[after[(x[after] & 0xDF) == 0x97]] = True  # the two signs among the letters of Latin-1
        for mark in special:
            own = np.ones(len(x) - len(mark) + 1, bool)
            for k, c in enumerate(mark):
                own &= x[k : len(own) + k] == c
            strange[: len(own)] |= own
        low = common.fold(x)
        after = after[x[after] <= 0x9E]
        low[after] = x[after] + 0x20
        start = np.zeros(len(x), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start &= ~blank
        # Contractions: an apostrophe by itself takes the letters that follow it.
        mark = np.flatnonzero(x == 39)
        mark = mark[(kind[mark - 1] != MARK) & (kind[mark + 1] == LETTER)]
        one, two = low[mark + 1], low[np.minimum(mark + 2, len(x) - 1)]
        takes = np.isin(one, list(b"stmd")) + 2 * (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        mark, takes = mark[takes > 0], takes[takes > 0]
        start[mark + 1] = False
        start[mark + 1 + takes] |= ~blank[mark + 1 + takes]
        inside = None
        if strange.any():
            first, last = np.flatnonzero(~blank[1:] & blank[:-1]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            n = np.concatenate([[0], np.cumsum(strange)])
            odd = n[last] > n[first]
            edge = np.zeros(len(x) + 1, np.int8)
            edge[first[odd]], edge[last[odd]] = 1, -1
            inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            start[inside] = False
            start[first[odd]] = True
            low[inside] = x[inside]
        self.body, self.start = low, np.flatnonzero(start)
        self.end = np.flatnonzero(~blank[:-1] & (start[1:] | blank[1:])) + 1
        self.odd = inside[self.start] if inside is not None else np.zeros(len(self.start), bool)
        self.first = np.searchsorted(self.start, at + np.arange(len(at)))

    def hashes(self) -> np.ndarray:
        h = common.span_hash(common.running_hash(self.body), self.start, self.end)
        return np.maximum(h ^ self.odd, np.uint64(1))

    def joined(self, which: np.ndarray) -> str:
        """The given pieces with a blank after each."""
        n = self.end[which] - self.start[which] + 1
        at = np.repeat(self.start[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = self.body[at]
        out[np.cumsum(n) - 1] = 32
        return out.tobytes().decode()


class Memo:
    """Hashes of pieces to their ids: an open table of 64-bit hashes, and all ids on end."""

    def __init__(self, kind: np.dtype, end_id: int):
        self.hash = np.zeros(0, np.uint64)
        self.ids, self.at = np.array([end_id], kind), np.array([0, 1])  # piece 0 is the end
        self._place(1 << 16)

    def __len__(self) -> int:
        return len(self.hash)

    def _place(self, slots: int) -> None:
        self.key, self.value = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self._put(np.arange(len(self.hash)))

    def _put(self, which: np.ndarray) -> None:
        last = len(self.key) - 1
        slot = (self.hash[which] & np.uint64(last)).astype(np.int64)
        while len(which):
            free = self.key[slot] == 0
            self.key[slot[free]] = self.hash[which[free]]  # of those that meet here one stays
            won = self.key[slot] == self.hash[which]
            self.value[slot[won]] = which[won] + 1
            which, slot = which[~won], (slot[~won] + 1) & last

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each piece; 0 if it is not known."""
        out, left, last = np.zeros(len(h), np.int32), np.arange(len(h)), len(self.key) - 1
        slot = (h & np.uint64(last)).astype(np.int64)
        while len(left):
            key = self.key[slot]
            hit = key == h[left]
            out[left[hit]] = self.value[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & last
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Pieces that are not known, each once, with their ids on end and how many each has."""
        new = np.arange(len(self.hash), len(self.hash) + len(h))
        self.hash = np.concatenate([self.hash, h])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
        if 2 * len(self.hash) > len(self.key):
            self._place(1 << (4 * len(self.hash)).bit_length())
        else:
            self._put(new)


class Encoder:
    """Ids of whole texts.

    Where the vocabulary's pre-tokenizer is the known one, texts are cut into its pieces, and each piece is encoded by
    the library once while the memo lasts: all new ones of a block in one call, since the last id of every piece tells
    that a word ends there. Pieces are known by a 64-bit hash. Texts under any other pre-tokenizer are encoded whole.
    """

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(vocabulary)
        # The same merges for pieces that are cut and in lower case already.
        self.merges = Tokenizer(self.model.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.dtype("<u2") if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.end_id = end_id
        steps = json.loads(self.model.to_str())
        cut, form = steps.get("pre_tokenizer") or {}, steps.get("normalizer") or {}
        patterns = [x.get("pattern", {}).get("Regex") for x in cut.get("pretokenizers", [])]
        suffix = steps["model"].get("end_of_word_suffix")
        self.apart = bool(suffix) and patterns == [_APART, None] and [x["type"] for x in form.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        # Special tokens are taken out before any cut; their beginnings make a word odd.
        self.special = sorted({x["content"].encode()[:2] for x in steps.get("added_tokens") or []})
        self.ends = np.zeros(self.model.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for w, i in self.model.get_vocab(with_added_tokens=False).items() if suffix and w.endswith(suffix)]] = True
        self.memo = Memo(self.kind, end_id)

    def _library(self, texts: list[str], model=None) -> tuple[np.ndarray, np.ndarray]:
        each = [x.ids for x in (model or self.model).encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)

    def _learn(self, pieces: Pieces, h: np.ndarray, new: np.ndarray) -> None:
        """new: a place of each unknown piece."""
        plain, odd = new[~pieces.odd[new]], new[pieces.odd[new]]
        for which in (plain, odd):
            if not len(which):
                continue
            if which is plain:
                ids, _ = self._library([pieces.joined(which)], self.merges)
                last = np.flatnonzero(self.ends[ids])
                n = np.diff(last, prepend=-1)
                if len(n) != len(which):
                    raise ValueError(f"{len(which)} pieces were encoded as {len(n)}")
            else:
                ids, n = self._library([pieces.body[a:b].tobytes().decode() for a, b in zip(pieces.start[which], pieces.end[which], strict=True)])
            self.memo.add(h[which], ids, n)

    def block(self, body: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end and how many each text has; the end id follows those that ends marks."""
        if len(self.memo) > MEMO_PIECES:
            self.memo = Memo(self.kind, self.end_id)
        pieces = Pieces(body, at, self.special)
        h = pieces.hashes()
        known = self.memo.find(h)
        new = np.flatnonzero(known == 0)
        if len(new):
            self._learn(pieces, h, new[np.unique(h[new], return_index=True)[1]])
            known[new] = self.memo.find(h[new])
        which = np.insert(known.astype(np.int64), pieces.first[1:][ends], 0)
        n = self.memo.at[which + 1] - self.memo.at[which]
        stop = np.cumsum(n)
        ids = self.memo.ids[np.repeat(self.memo.at[which] - stop + n, n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], stop])[pieces.first + np.concatenate([[0], np.cumsum(ends)])]
        return ids, np.diff(bounds)

    def encode(self, column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of all texts on end, in blocks, and how many each text has, the end id included."""
        if not self.apart:
            ids, n = self._library([t or "" for t in column.to_pylist()])
            return [np.insert(ids, np.cumsum(n), self.end_id).astype(self.kind)], n + 1
        body, at = common.text_bytes(column)
        out, counts = [], np.zeros(len(at) - 1, np.int64)
        for i, j, cuts in common.blocks(body, at, _KIND == BLANK):
            ids, n = self.block(body[cuts[0] : cuts[-1]], cuts - cuts[0], cuts[1:] == at[i + 1 : j + 1])
            out.append(ids)
            counts[i:j] += n
        return out, counts


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """One per worker process, so that its memo outlives a task."""
    if (vocabulary, end_id) not in _encoders:
        _encoders[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _encoders[vocabulary, end_id]


class SequenceFile:
    """Writes ids on end into sequences of one length."""

    def __init__(self, uri: str, kind: np.dtype, length: int):
        self.kind, self.length, self.held, self.n = kind, length, bytearray(), 0
        item = {2: pa.uint16(), 4: pa.uint32()}[kind.itemsize]
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = _open(uri, "w")
        self.out = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held += ids.tobytes()
        self.n += len(ids)
        step = self.length * BATCH_SEQUENCES * self.kind.itemsize
        while len(self.held) >= step:
            self._put(np.frombuffer(bytes(self.held[:step]), self.kind), self.length * BATCH_SEQUENCES)
            del self.held[:step]

    def _put(self, flat: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.length)
        self.out.write_batch(pa.record_batch([ids, mask], schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.frombuffer(bytes(self.held), self.kind)
            self._put(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        self.out.close()
        self.sink.close()


def write_sequences(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Write the files; returns the manifest: path, part, n_docs, n_ids, ordered by part as the documents are by id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encoder, part, ids, counts = None, None, 0, [], []
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                part, encoder = b.column(2)[0].as_py(), encoder_of(vocabulary, end_id)
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                out = SequenceFile(f"{path}.arrow", encoder.kind, length)
            ids.append(b.column(0))
            flat, n = encoder.encode(b.column(1))
            counts.append(n)
            for x in flat:
                out.add(x)
        if out is None:
            return
        out.close()
        index = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_tokens": pa.array(np.concatenate(counts), pa.int64())})
        sink = _open(f"{path}.docs.arrow", "w")
        with pa.ipc.new_file(sink, index.schema) as f:
            f.write_table(index)
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([len(index)], pa.int64()), pa.array([out.n], pa.int64())], ["path", "part", "n_docs", "n_ids"])

    return common.stored(common.map_arrow(rows, written, "path string, part int, n_docs long, n_ids long"), "manifest")


def flat_ids(path: str) -> Iterator[np.ndarray]:
    """The real ids of a file, batch by batch: views of the mapped file, not copies."""
    with _open(f"{path}.arrow", "r") as source:
        f = pa.ipc.open_file(source)
        for i in range(f.num_record_batches):
            b = f.get_batch(i)
            ids, mask = b.column("ids").flatten(), b.column("mask").flatten()
            yield ids.to_numpy(zero_copy_only=True)[: mask.true_count]


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Random access: ids and mask of sequence k."""
    source = _open(f"{path}.arrow", "r")
    b = pa.ipc.open_file(source).get_batch(k // BATCH_SEQUENCES)
    row = k % BATCH_SEQUENCES
    return b.column("ids")[row].values.to_numpy(zero_copy_only=True), b.column("mask")[row].values.to_numpy(zero_copy_only=False)


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, path."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(f"{path}.docs.arrow", "r") as source:
                    index = pa.ipc.open_file(source).read_all()
                counts = index.column("n_tokens").to_numpy()
                stops = np.cumsum(counts)
                sums, doc, crc, at = np.zeros(len(counts), np.int64), 0, 0, 0
                for ids in flat_ids(path):
                    wide, done = ids.astype("<u4"), 0
                    while done < len(wide):
                        upto = min(len(wide), int(stops[doc]) - at)
                        crc = zlib.crc32(wide[done:upto], crc)
                        done = upto
                        if at + done == stops[doc]:
                            sums[doc], doc, crc = crc, doc + 1, 0
                    at += len(wide)
                assert doc == len(counts) and (not len(counts) or at == stops[-1]), f"{path} and its index differ"
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(base + stops - counts), pa.array(counts), pa.array(sums), pa.array([path] * len(counts), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    n = max(1, manifest.count())
    return common.map_arrow(files.select("path", "base").repartition(n), read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def token_output(docs: DataFrame, vocabulary: str, folder: str | None = None, **how) -> DataFrame:
    """Encode, write, read back: one row per document from the files. folder: unset, a new one in the shared folder."""
    folder = folder or common.scratch(docs.sparkSession, "token-files")
    return read_back(write_sequences(docs, vocabulary, folder, **how))
