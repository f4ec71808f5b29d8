"""Training-order materialisation of token sequences.

Documents become token ids, documents are cut into sequences of LENGTH ids, and
a keyed Feistel network over the sequence numbers, with cycle walking to stay
below their count, gives every sequence one global slot.  Sequences are dealt to
ranges of slots, sorted, and written as records of one fixed stride, so
the training order is a sequential read and any slot is found by arithmetic:
shard = slot // per_shard, byte = (slot % per_shard) * stride.  A range holds
many shards, and Spark's writer begins a new file after each: shard s is file
s % shards_per_range of range s // shards_per_range.

A record is: doc_id (int64), part (int32), n (int32), LENGTH ids (uint16, or uint32
for a vocabulary that needs it), a line feed; all little-endian, unused ids are
PAD.  Spark's own writer commits the shards, so a lost executor's range is
written anew and no partial file is seen, in any file system that Spark can
write.  Two passes read the documents: the first counts the sequences of each
input split, the second numbers and writes them, and fails if a split differs.
The number of splits is held for both, however many executors are there.  Where
each split begins is a table of 16 bytes a split, added up and joined by Spark;
the driver holds no row of it.

Texts hold no control tokens: what looks like one is encoded as the plain text
that it is (op 9 follows the tokenizers library, which makes it the token).

Edge cases: a null or empty text has no ids and no sequence; a document of any
length is cut whole; no sequences, or an empty table, give no shards; a null
doc_id is written as -1; repeated rows are written as often as they occur; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_hexdigest

from ._common import Scratch, stream, table

#: Fixed value: the pre-tokenizer pattern of byte-level BPE in its possessive form, which cuts texts alike and runs faster.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LENGTH, PAD, ROUNDS = 512, 0, 6
#: Sequences of one shard (about 8 MB), and most shards that one task sorts and writes (about 256 MB).
PER_SHARD, PER_RANGE = 8192, 32
_NAME = re.compile(r"part-([0-9]+)-.*-c([0-9]+)(?:\.[a-z]+)?$")


def record_type(length: int = LENGTH, width: int = 2) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("ids", f"<u{width}", (length,)), ("end", "u1")])


def shard_of(path: str, per_range: int) -> int:
    """The shard that a file's name tells: range and file of the range, each of any number of digits."""
    m = _NAME.search(path)
    return int(m[1]) * per_range + int(m[2])


class Feistel:
    """A keyed permutation of 0 .. size - 1."""

    def __init__(self, size: int, key: int, rounds: int = ROUNDS):
        self.size = size
        self.half = max(1, -(-max(1, size - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._mix(right, k)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (outside := np.flatnonzero(out >= self.size)).size:
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of `slot`."""
        return self._walk(slot, self.keys[::-1])


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(enc, text: str) -> list[int]:
    return enc.encode_ordinary(text)


class Written:
    """Where the shards are, and how to read them; `about` is what the manifest says."""

    def __init__(self, spark: SparkSession, path: str, about: dict):
        self.spark, self.path, self.about = spark, path, about
        self.size, self.per_shard, self.per_range, self.stride = (about[k] for k in ("sequences", "per_shard", "shards_per_range", "stride"))
        self.kind = record_type(about["length"], about["id_bytes"])

    @staticmethod
    def open(spark: SparkSession, path: str) -> "Written":
        """What an earlier run has written."""
        return Written(spark, path, json.loads(spark.read.text(f"{path}/manifest").first()[0]))

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/shards")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = {}
        if fs.exists(folder):
            for s in fs.listStatus(folder):
                if s.getLen() and _NAME.search(name := s.getPath().getName()):
                    found[shard_of(name, self.per_range)] = s.getPath()
        return fs, found

    def read(self, first: int, count: int) -> np.ndarray:
        """Records of the slots first .. first + count - 1, by seeking: what a resumed reader does."""
        fs, files = self._files()
        parts = []
        stop = min(self.size, first + count)
        while first < stop:
            shard, at = divmod(first, self.per_shard)
            n = min(stop - first, self.per_shard - at)
            f = fs.open(files[shard])
            try:
                f.seek(at * self.stride)
                raw = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f, n * self.stride)
            finally:
                f.close()
            parts.append(np.frombuffer(bytes(raw), self.kind))
            first += n
        return np.concatenate(parts) if parts else np.empty(0, self.kind)

    def index(self) -> DataFrame:
        """slot, shard, byte_offset, doc_id, part, n_tokens, ids_xxh3 (of the ids' bytes) of every record, read back from the shards."""
        schema = "slot long, shard int, byte_offset long, doc_id long, part int, n_tokens int, ids_xxh3 string"
        if not self.size:
            return self.spark.createDataFrame([], schema)
        kind, per_shard, per_range, stride, width = self.kind, self.per_shard, self.per_range, self.stride, self.about["id_bytes"]
        # Records are of one width and hold any byte, so files are cut by length, not by line.
        raw = self.spark.read.format("binaryFile").load(f"{self.path}/shards").where("length > 0").select("path", "content")

        def run(batches):
            for b in batches:
                for path, content in zip(b["path"], b["content"]):
                    shard = shard_of(path, per_range)
                    r = np.frombuffer(content, kind)
                    at = np.arange(len(r))
                    n = r["n"].tolist()
                    start, whole = kind.fields["ids"][1], memoryview(content)
                    digests = [xxh3_64_hexdigest(whole[i * stride + start : i * stride + start + width * k]) for i, k in enumerate(n)]
                    yield {"slot": shard * per_shard + at, "shard": np.full(len(r), shard, np.int32), "byte_offset": at * stride, "doc_id": r["doc_id"].copy(), "part": r["part"].copy(), "n_tokens": r["n"].copy(), "ids_xxh3": digests}

        return stream(raw, run, schema, 2)


@contextmanager
def _same_splits(spark: SparkSession):
    """Holds the number that file splits are sized by, which else follows the executors that are there."""
    key = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(key, None)
    if old is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)


def materialise(docs: DataFrame, path: str, key: int = 20240229, length: int = LENGTH, per_shard: int = PER_SHARD, tokens: str | None = None) -> Written:
    """Writes the sequences of docs (doc_id, text) to `path`/shards in training order, and `path`/manifest."""
    spark = docs.sparkSession
    tokens = tokens or tokenizer_path()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text")
    width = 2 if tokenizer(tokens).n_vocab <= 1 << 16 else 4
    code, kind = "H" if width == 2 else "I", record_type(length, width)
    scratch = Scratch(spark, "trainorder")

    def count(batches):
        enc, total = tokenizer(tokens), 0
        for b in batches:
            total += sum(-(-len(_encode(enc, t)) // length) for t in b["text"] if t)
        yield {"split": [TaskContext.get().partitionId()], "n": [total]}

    with _same_splits(spark):
        counts = scratch.keep(stream(rows, count, "split int, n long").groupBy("split").agg(F.sum("n").alias("n")), "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        shards = -(-total // per_shard)
        # Ranges of many shards, but enough of them for all cores.
        per_range = max(1, min(PER_RANGE, shards // (3 * spark.sparkContext.defaultParallelism)))
        about = {"sequences": total, "length": length, "id_bytes": width, "stride": kind.itemsize, "per_shard": per_shard, "shards_per_range": per_range, "pad": PAD, "key": hashlib.sha256(str(key).encode()).hexdigest()[:16], "rounds": ROUNDS}
        order = Feistel(max(total, 1), key)
        body = np.dtype([(n, *kind.fields[n][:1]) for n in kind.names if n != "end"])

        def write(batches):
            enc = tokenizer(tokens)
            at = stop = None
            for b in batches:
                if at is None:
                    at, stop = b["first"][0], b["stop"][0]
                docs_ids = [(d, np.frombuffer(array(code, _encode(enc, t)), f"u{width}")) for d, t in zip(b["doc_id"], b["text"]) if t]
                if not docs_ids:
                    continue
                lens = np.array([len(ids) for _, ids in docs_ids])
                parts = -(-lens // length)
                n = int(parts.sum())
                r = np.zeros(n, body)
                r["doc_id"] = np.repeat([d for d, _ in docs_ids], parts)
                begin = np.cumsum(parts) - parts
                r["part"] = np.arange(n) - np.repeat(begin, parts)
                r["n"] = np.minimum(length, np.repeat(lens, parts) - length * r["part"])
                flat = np.full(n * length, PAD, f"<u{width}")
                for (_, ids), i in zip(docs_ids, (begin * length).tolist()):
                    flat[i : i + len(ids)] = ids
                r["ids"] = flat.reshape(n, length)
                slots = order.slot(np.arange(at, at + n))
                at += n
                ends = np.arange(n + 1, dtype=np.int32) * body.itemsize
                value = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(r.tobytes())])
                yield {"slot": slots, "range": (slots // (per_shard * per_range)).astype(np.int32), "value": value}
            if at != stop:
                raise RuntimeError("a split held other rows when it was read again")

        if total:
            stops = F.sum("n").over(Window.orderBy("split"))
            begins = counts.select("split", (stops - F.col("n")).alias("first"), stops.alias("stop"))
            # One short row for each input split, so about a millionth of the input: a side to broadcast, which leaves the splits as they are.
            begun = rows.withColumn("split", F.spark_partition_id()).join(F.broadcast(begins), "split").select("doc_id", "text", "first", "stop")
            made = stream(begun, write, "slot long, range int, value binary", 128)
            dealt = made.repartitionById(-(-shards // per_range), F.col("range")).sortWithinPartitions("slot")
            # The text writer puts the bytes down as they are and ends each record with the line feed.
            out = dealt.select(F.col("value").cast("string").alias("value")).write
            out.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", per_shard).text(f"{path}/shards")
    scratch.drop(counts)
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return Written(spark, path, about)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "trainorder").path("out")
    return materialise(table(spark, sf_dir, "documents"), path).index()
