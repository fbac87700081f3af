"""Token ids in files, entropy-coded by a range variant of asymmetric numeral systems.

The frequencies of all ids are counted over the corpus and make one table that every block shares. A
block holds whole documents of at least BLOCK ids and is coded on its own: its ids are dealt in turn
to LANES coder states that advance together, and their output words are interleaved in one stream.
Checkpoints keep the states and the place in the stream every CHECKPOINT steps, so that a block can
be decoded from several places at once. Its last four bytes are a checksum of all before.

Files are written by Spark's committer on any storage: a block is one record, ended by a newline,
and files follow the order of the ids. They are read as whole files; each block gives its length.
Beside them lie the table of shares and the first position of each part (one task's files).

    magic "TRB1", length of the block u32, part u32, first id's position in the part u64, ids u64,
    documents u32, lanes u32, checkpoints u32, stream words u32,
    per document: doc_id i64, is null u8, ids u32 (three arrays),
    per checkpoint: stream words before it u32, then all states u64 per checkpoint,
    stream words u32, CRC-32 of the block so far u32
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replenish.session import scratch_path

END = 1
SCALE = 20
BLOCK = 1 << 18
LANES = 1024
CHECKPOINT = 128
BLOCKS_A_FILE = 32
MAGIC = b"TRB1"
HEAD = struct.Struct("<4sIIQQIIII")
_LOW = np.uint64(1 << 31)
# characters of the pieces whose ids a worker keeps (16 more for each), of text that goes to the model at a time, and bytes of texts that are split at a time
_PIECES, _NEW, _TEXTS = 25_000_000, 1 << 18, 1 << 24


class Table:
    """Shares of 2^scale for every id that occurs, at least one each."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, scale: int = SCALE):
        self.scale, self.ids, self.shares = scale, ids, shares
        starts = np.cumsum(shares) - shares
        size = int(ids.max()) + 1 if len(ids) else 1
        self.share, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.share[ids], self.start[ids] = shares, starts
        self.at = np.repeat(ids, shares).astype(np.uint32)


def shares_of(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts brought to the sum 2^scale: one each, the rest in proportion, remainders to the largest fractions."""
    spare = (1 << scale) - len(counts)
    if spare < 0:
        raise ValueError("more ids than shares")
    exact = counts / counts.sum() * spare
    whole = np.floor(exact).astype(np.int64)
    order = np.argsort(-(exact - whole), kind="stable")
    whole[order[: spare - int(whole.sum())]] += 1
    return whole + 1


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT):
    """(checkpoint places, checkpoint states, stream); the first checkpoint is the start."""
    scale = np.uint64(table.scale)
    state = np.full(lanes, _LOW, np.uint64)
    steps = -(-len(ids) // lanes)
    pieces, places, states = [], [], []
    for step in range(steps - 1, -1, -1):
        own = ids[step * lanes : (step + 1) * lanes]
        m = len(own)
        share, start, x = table.share[own], table.start[own], state[:m]
        full = x >= share << (np.uint64(63) - scale)
        pieces.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        whole = x // share
        state[:m] = (whole << scale) + (x - whole * share) + start
        if step % every == 0:
            places.append(len(pieces))
            states.append(state.copy())
    pieces.reverse()
    before = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.uint32)
    stream = np.concatenate(pieces) if pieces else np.empty(0, np.uint32)
    at = before[[steps - p for p in reversed(places)]] if places else np.empty(0, np.uint32)
    kept = np.array(states[::-1]) if states else np.empty((0, lanes), np.uint64)
    return at, kept, stream


def decode(n: int, table: Table, places, states, stream, every: int = CHECKPOINT, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from checkpoint ``first`` up to checkpoint ``last`` (the end if None)."""
    if not n:
        return np.empty(0, np.uint32)
    lanes = states.shape[1]
    scale, mask = np.uint64(table.scale), np.uint64((1 << table.scale) - 1)
    stop = n if last is None or last >= len(places) else min(n, last * every * lanes)
    at, state = int(places[first]), states[first].copy()
    out = np.empty(stop - first * every * lanes, np.uint32)
    for done in range(0, len(out), lanes):
        m = min(lanes, len(out) - done)
        x = state[:m]
        slot = x & mask
        own = table.at[slot]
        out[done : done + m] = own
        x = table.share[own] * (x >> scale) + slot - table.start[own]
        need = np.flatnonzero(x < _LOW)
        x[need] = (x[need] << np.uint64(32)) | stream[at : at + len(need)]
        at += len(need)
        state[:m] = x
    return out


def pack(part: int, start: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    places, states, stream = encode(ids, table)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join((
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), counts.astype("<u4").tobytes(),
        places.astype("<u4").tobytes(), states.astype("<u8").tobytes(), stream.astype("<u4").tobytes(),
    ))
    size = HEAD.size + len(body) + 4
    head = HEAD.pack(MAGIC, size, part, start, len(ids), len(doc_ids), LANES, len(places), len(stream))
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


def unpack(raw: memoryview, table: Table):
    """(part, start, doc_ids, counts, ids) of a block, after its checksum was found right."""
    magic, size, part, start, n, docs, lanes, points, words = HEAD.unpack_from(raw)
    if magic != MAGIC or len(raw) < size or zlib.crc32(raw[: size - 4]) != struct.unpack_from("<I", raw, size - 4)[0]:
        raise ValueError("damaged block")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    places, states, stream = take("<u4", points), take("<u8", points * lanes), take("<u4", words)
    ids = decode(n, table, places, states.reshape(points, lanes), stream)
    return part, start, [None if z else int(d) for d, z in zip(doc_ids, nulls)], counts, ids


def blocks(raw: memoryview):
    """The blocks of a file."""
    at = 0
    while at < len(raw):
        size = HEAD.unpack_from(raw, at)[1]
        yield raw[at : at + size]
        at += size + 1


# how a tokenizer cuts texts that drops white space and splits there before anything else
_SEPARABLE = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# a word of Latin letters that normalization only lower-cases, and marks, which are one piece if no letter follows
_PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-/:-@\\[-`{-~]*)$"
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _weight(pieces) -> int:
    return sum(map(len, pieces)) + 16 * len(pieces)


def _runs(sizes, most: int):
    """(start, stop) of runs of rows, each of about so much in all."""
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(sizes)])


class _Encoder:
    """Ids of texts by the tokenizers library, as bytes.

    A tokenizer that drops white space gives a text the ids of its parts between spaces and line ends,
    so each distinct part of many texts is looked at once, as a word and marks or else whole, and pieces
    known to the worker need no new encoding. New words go to the model many at a time, without the
    patterns that would only find each whole; the last id of each has the end-of-word mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.separable = json.loads(self.whole.to_str())["pre_tokenizer"] == _SEPARABLE
        self.known: dict[str, bytes] = {}
        self.size = 0
        mark = getattr(self.whole.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        # ASCII letters stand for themselves, other letters for their bytes
        self.ascii, self.latin = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn_some(self, tokenizer, new: list[str]) -> None:
        if tokenizer is not None:
            ids = np.array(self._ids(tokenizer, [" ".join(new)])[0], self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(new) and stops[-1] == len(ids):
                raw, stops = ids.tobytes(), (stops * ids.itemsize).tolist()
                self.known.update(zip(new, [raw[i:j] for i, j in zip([0, *stops], stops)]))
                return
        self.known.update(zip(new, map(self._bytes, self._ids(self.whole, new))))

    def _learn(self, new: list[str]) -> None:
        plain, latin, rest = [], [], []
        for piece in new:
            if piece.isascii():
                (plain if piece.isalpha() else rest).append(piece)
            else:
                (latin if _LATIN.fullmatch(piece) else rest).append(piece)
        for tokenizer, own in ((self.ascii, plain), (self.latin, latin), (None, rest)):
            for at, stop in _runs([len(piece) + 1 for piece in own], _NEW) if own else ():
                self._learn_some(tokenizer, own[at:stop])

    def _parts(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts."""
        found = pc.extract_regex(parts, _PLAIN)
        word, marks = pc.utf8_lower(pc.struct_field(found, "word")), pc.struct_field(found, "marks")
        pieces = pa.concat_arrays([pc.coalesce(word, parts), marks.fill_null("")]).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        new = [piece for piece in names if piece not in self.known]
        if self.size + _weight(new) > _PIECES:
            # what these texts use stays
            self.known = {piece: self.known[piece] for piece in names if piece in self.known}
            self.size = _weight(self.known)
        self.size += _weight(new)
        self._learn(new)
        ids = pa.array([self.known[piece] for piece in names], pa.binary()).take(pieces.indices)
        return pc.binary_join_element_wise(ids[: len(parts)], ids[len(parts) :], b"")

    def encode(self, texts: pa.Array) -> pa.Array:
        if not self.separable:
            own = texts.to_pylist()
            runs = _runs([len(text) for text in own], _NEW)
            return pa.array([self._bytes(ids) for at, stop in runs for ids in self._ids(self.whole, own[at:stop])], pa.binary())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        stops = np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy())), dtype=np.int32)
        ids = self._parts(parts.dictionary).take(parts.indices)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(stops), ids), b"")

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string())).to_pylist()


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One for each worker, so that the next task finds the words of the last one."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _tokenize(path: str, end: int):
    def rows(batches):
        encoder = _encoder(path)
        tail = np.array([end], encoder.kind).tobytes()
        for whole in batches:
            for at, stop in _runs(pc.binary_length(whole.column(2)).fill_null(0).to_numpy(), _TEXTS):
                batch = whole.slice(at, stop - at)
                ids = pc.binary_join_element_wise(encoder.encode(batch.column(2).cast(pa.string()).fill_null("")), tail, b"")
                counts = pc.divide(pc.binary_length(ids).cast(pa.int64()), len(tail))
                wide = pa.array([len(tail)] * len(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, wide, ids], names=["doc_id", "tie", "n", "wide", "ids"])

    return rows


def _values(raw: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{wide}")


def _count_ids(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for wide in set(batch.column(0).to_pylist()):
            own = np.bincount(_values(b"".join(x for w, x in zip(*(c.to_pylist() for c in batch.columns)) if w == wide), wide), minlength=len(total))
            own[: len(total)] += total
            total = own
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "count"])


def _coder(table, block: int):
    def rows(batches):
        own, part = Table(*table.value), TaskContext.get().partitionId()
        doc_ids, counts, ids, size, before = [], [], [], 0, 0

        def done():
            packed = pack(part, before, doc_ids, np.array(counts), np.concatenate(ids), own)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

        for batch in batches:
            for doc_id, n, wide, raw in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids.append(doc_id)
                counts.append(n)
                ids.append(_values(raw, wide))
                size += n
                if size >= block:
                    yield done()
                    before += size
                    doc_ids, counts, ids, size = [], [], [], 0
        if doc_ids:
            yield done()

    return rows


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, block: int = BLOCK) -> None:
    """Tokenize every text, add the end id to each and write the files in ascending order of doc_id.

    Null ids come first, a null text has the end id only, rows with equal ids follow by their texts'
    hashes. The vocabulary bounds the table of shares; the table of parts has a row a task.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    tokens = keyed.mapInArrow(_tokenize(tokenizer, end), "doc_id long, tie long, n long, wide int, ids binary")
    kept = scratch_path(spark, "token-ids")
    tokens.write.option("compression", "zstd").parquet(kept)
    tokens = spark.read.schema(tokens.schema).parquet(kept)
    counts = tokens.select("wide", "ids").mapInArrow(_count_ids, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    seen = counts.orderBy("id").toPandas()
    ids = seen["id"].to_numpy(np.int64)
    shares = shares_of(seen["count"].to_numpy(np.int64)) if len(ids) else np.zeros(0, np.int64)
    rows = list(zip(ids.tolist(), shares.tolist()))
    spark.createDataFrame(rows, "id long, share long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, shares))
    ordered = tokens.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    coded = ordered.select("doc_id", "n", "wide", "ids").mapInArrow(_coder(shared, block), "block binary")
    coded.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", BLOCKS_A_FILE).text(f"{path}/blocks")
    sizes = _files(spark, path).mapInArrow(_sizes, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    first = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    sizes.select("part", first.alias("first")).coalesce(1).write.parquet(f"{path}/parts")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")


def _sizes(batches):
    for batch in batches:
        for raw in batch.column(0):
            heads = [HEAD.unpack_from(b) for b in blocks(memoryview(raw.as_buffer()))]
            yield pa.RecordBatch.from_arrays([pa.array([h[2] for h in heads], pa.int64()), pa.array([h[4] for h in heads], pa.int64())], names=["part", "n"])


def _reader(shared, take):
    def rows(batches):
        ids, shares, first = shared.value
        own = Table(ids, shares)
        for batch in batches:
            for raw in batch.column(0):
                for block in blocks(memoryview(raw.as_buffer())):
                    part, start, *rest = unpack(block, own)
                    yield take(first[part] + start, *rest)

    return rows


def _digests(start, doc_ids, counts, ids) -> pa.RecordBatch:
    ends = np.cumsum(counts, dtype=np.int64)
    starts = ends - counts
    raw = memoryview(ids.astype("<u4").tobytes())
    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())],
        names=["doc_id", "start", "n_tokens", "ids_crc32"],
    )


def _documents(start, doc_ids, counts, ids) -> pa.RecordBatch:
    ends = np.cumsum(counts, dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends - counts + start), lists], names=["doc_id", "start", "ids"])


def _read(spark: SparkSession, path: str, take, schema: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/table").orderBy("id").collect()
    pair = np.array([r["id"] for r in rows], np.int64), np.array([r["share"] for r in rows], np.int64)
    first = {r["part"]: r["first"] for r in spark.read.parquet(f"{path}/parts").collect()}
    return _files(spark, path).mapInArrow(_reader(spark.sparkContext.broadcast((*pair, first)), take), schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files."""
    return _read(spark, path, _documents, "doc_id long, start long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return _read(spark, path, _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write files under the shared folder and return what reading them gives."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path)
    return digests(docs.sparkSession, path)
