"""Token-id output: documents compressed one by one with a shared dictionary.

A zstandard dictionary is trained on serialized id arrays of a bounded sample.
Each document's ids are compressed alone with it, so one short document can be
read without its neighbours.  A *shard* is one binary value:

    magic "TIDS1", id width in bytes (2 or 4), SHA-256 of the dictionary,
    document count n,
    n+1 byte offsets of the frames, n token counts, n ids (all little-endian 64-bit),
    n zstandard frames.

A reader checks the dictionary's hash before it decompresses anything.  Shards
hold ascending id ranges and are written, with the dictionary in a table of
one row beside them, as Parquet rows (shard, part, shard bytes) through
Spark's committer, so retried or lost tasks leave no half-written file and any
store that Spark writes to will do.

Shards come from quantiles of the ids, so the texts are never shuffled: they
are encoded where they are read, and only compressed frames move, once.

Defined cases: null text has only the end id; null ids sort first; rows of
equal id follow each other in no set order among themselves (each is still
encoded and counted); an empty table gives no shard and no rows; very long
texts are encoded whole, and a shard is closed when it holds ``SHARD_BYTES``,
so one document may make a shard of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.ranks import prefix_sum
from ragspark.sources.scratch import new_dir
from ragspark.llm.common import cut_words, lean, slices

MAGIC = b"TIDS1"
END_ID = 1
SHARD_BYTES = 32 << 20        # compressed bytes after which a shard is closed
DICT_BYTES = 64 << 10
SAMPLE_ROWS = 2_000           # expected documents in the dictionary's sample
SAMPLE_IDS = 2_048            # ids of a sampled document
LEVEL = 3
_MEMO_ROWS = 600_000
_LINE = 200               # new words encoded by one call
_MEMO_BYTES = 48
_SPACES = bytes.maketrans(b"\n", b" ")


class WordEncoder:
    """Whole texts through the tokenizers library, remembering words.

    The vocabulary's tokens never cross white space, so a text is cut at spaces
    and line breaks and each distinct piece is encoded once; a piece that holds
    any other white space is encoded by the library as it stands."""

    def __init__(self, blob: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core; the library's threads only wait
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(blob)
        self.tokenizer.encode_special_tokens = False
        self.width = 2 if max(self.tokenizer.get_vocab(True).values()) < 1 << 16 else 4
        suffix = (json.loads(blob).get("model") or {}).get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocab = self.tokenizer.get_vocab(True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _pack(self, ids) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        """Serialized ids of distinct words: many words to a line.  Where the
        vocabulary marks tokens that end a word, a line of letters-only words is
        cut at these marks if there are as many as words; any other line is cut by
        the places of its tokens."""
        out, rest = [b""] * len(words), list(range(len(words)))
        if self.ends is not None:
            plain, rest = [], []
            for k, w in enumerate(words):
                (plain if w.isalpha() else rest).append(k)
            lines = [plain[i:i + _LINE] for i in range(0, len(plain), _LINE)]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join([words[k] for k in x]) for x in lines],
                                                                       add_special_tokens=False)):
                ids = np.array(e.ids, f"<u{self.width}")
                cut = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
                if len(cut) == len(line):          # every word has one at least, so each has one
                    raw = ids.tobytes()
                    for k, a, b in zip(line, [0, *cut], cut):
                        out[k] = raw[a:b]
                else:
                    rest += line
        lines = [rest[i:i + _LINE] for i in range(0, len(rest), _LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join([words[k] for k in x]) for x in lines],
                                                              add_special_tokens=False)):
            ids, starts = self._pack(e.ids), np.array([a for a, _ in e.offsets], np.int64)
            ends = np.cumsum([len(words[k]) + 1 for k in line])
            cut = (np.searchsorted(starts, ends) * self.width).tolist()
            for k, a, b in zip(line, [0, *cut], cut):
                out[k] = ids[a:b]
        return out

    def batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Serialized ids of each text, with the end id.  The batch's distinct
        words are looked up and, where new, encoded once; the ids are then
        gathered for all texts together."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words, place, first = cut_words(texts, _SPACES)
        ids = list(map(self.memo.get, words))
        for k in [k for k, x in enumerate(ids) if x is None]:
            ids[k] = self.older.get(words[k])
            if ids[k] is not None:
                self.memo[words[k]] = ids[k]
        new = [k for k, x in enumerate(ids) if x is None]
        fresh = b" ".join([words[k] for k in new]).decode().split(" ") if new else []
        for k, x in zip(new, self._encode(fresh)):
            ids[k] = x
            if len(words[k]) <= _MEMO_BYTES:
                self.memo[words[k]] = x
        ids.append(self._pack([END_ID]))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        begin, table = np.cumsum(size) - size, np.frombuffer(b"".join(ids), f"<u{self.width}")
        said = np.insert(place, first[1:], len(words))               # an end after each text
        n = size[said]
        upto = np.cumsum(n)
        raw = table[np.repeat(begin[said] - (upto - n), n) + np.arange(n.sum())].tobytes()
        cut = np.concatenate(([0], upto[first[1:] + np.arange(len(texts))] * self.width)).tolist()
        if len(self.memo) > _MEMO_ROWS:
            self.older, self.memo = self.memo, {}
        return [raw[a:b] for a, b in zip(cut, cut[1:])]


_BY_KEY: dict[str, WordEncoder] = {}


def _encoder(blob: str) -> WordEncoder:
    key = hashlib.sha256(blob.encode()).hexdigest()
    if key not in _BY_KEY:
        _BY_KEY[key] = WordEncoder(blob)
    return _BY_KEY[key]


def _window(ids: bytes, width: int) -> bytes:
    """``SAMPLE_IDS`` ids from a place chosen by the ids' checksum."""
    room = len(ids) // width - SAMPLE_IDS
    at = zlib.crc32(ids) % (room + 1) * width if room > 0 else 0
    return ids[at:at + SAMPLE_IDS * width]


def train_dictionary(docs: DataFrame, blob: str, id_col: str = "doc_id", text_col: str = "text",
                     n_docs: int | None = None) -> bytes:
    """A zstandard dictionary from ``SAMPLE_IDS`` ids of about ``SAMPLE_ROWS``
    documents, chosen by a hash of the id, each from a place in the document that
    its content chooses (empty if the sample is too small to train on).  It only
    affects sizes, never contents."""
    n = docs.count() if n_docs is None else n_docs
    point = F.pmod(F.xxhash64(F.col(id_col), F.lit(19)), F.lit(1 << 30)) / float(1 << 30)
    sent = docs.sparkSession.sparkContext.broadcast(blob)

    @lean
    def run(batches):
        enc = _encoder(sent.value)
        for b in batches:
            for i, j in slices(b.column(0)):
                ids = enc.batch(b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([_window(x, enc.width) for x in ids], pa.binary())], names=["s"])
    sample = docs.where(point < min(1.0, SAMPLE_ROWS / max(1, n))).select(F.col(text_col).cast("string").alias("t"))
    got = sorted(r["s"] for r in sample.mapInArrow(run, "s binary").collect())     # bounded: SAMPLE_ROWS x SAMPLE_IDS
    try:
        return zstandard.train_dictionary(DICT_BYTES, got).as_bytes()
    except zstandard.ZstdError:                  # too few or too short samples
        return b""


def write_shard(ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dict_hash: bytes) -> bytes:
    """One shard's bytes; a null id is stored as the least 64-bit integer."""
    n = len(ids)
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<i8")
    keys = np.array([-1 << 63 if i is None else i for i in ids], "<i8")
    return b"".join([MAGIC, struct.pack("<B", width), dict_hash, struct.pack("<q", n), offsets.tobytes(),
                     np.array(counts, "<i8").tobytes(), keys.tobytes(), *frames])


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, shard: bytes, dictionary: bytes):
        if shard[:5] != MAGIC:
            raise ValueError("not a token shard")
        self.width = shard[5]
        if shard[6:38] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        n, = struct.unpack_from("<q", shard, 38)
        at = 46
        self.offsets = np.frombuffer(shard, "<i8", n + 1, at)
        self.counts = np.frombuffer(shard, "<i8", n, at + 8 * (n + 1))
        self.ids = np.frombuffer(shard, "<i8", n, at + 8 * (2 * n + 1))
        self.body, self.shard = at + 8 * (3 * n + 1), shard
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        """Token ids of the i-th document as unsigned 32-bit integers."""
        a, b = self.body + self.offsets[i], self.body + self.offsets[i + 1]
        raw = self.zstd.decompress(self.shard[a:b], max_output_size=int(self.counts[i]) * self.width + 1)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, compress and write all documents below ``path`` (``/shards``, ``/dictionary``).
    ``vocabulary`` (a tokenizers file) is read on the driver and broadcast."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        blob = f.read()
    n = docs.count()
    dictionary = train_dictionary(docs, blob, id_col, text_col, n)
    spark.createDataFrame([(bytearray(hashlib.sha256(dictionary).digest()), bytearray(dictionary))],
                          "sha256 binary, dictionary binary").write.parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(max(8 * parts, n // 65_536), 1 << 16)           # id ranges; a large one is cut by SHARD_BYTES
    steps = [(i + 1) / shards for i in range(shards)]
    cut = docs.agg(F.percentile_approx(id_col, steps, max(10_000, 20 * shards)).alias("q")).first()["q"]
    bounds = np.array(sorted(set(cut or [])), np.int64)          # one number per shard
    sent = spark.sparkContext.broadcast((blob, dictionary, bounds))

    @lean
    def encode(batches):
        blob, dictionary, bounds = sent.value
        enc = _encoder(blob)
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)
                                        if dictionary else None, write_checksum=False)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for i, j in slices(texts):
                ids = keys.slice(i, j - i)
                known = np.array([bounds[0] if x is None else x for x in ids.to_pylist()] if len(bounds) else [0] * (j - i))
                raw = enc.batch(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(bounds, known), pa.int64()), ids,
                     pa.array([len(x) // enc.width for x in raw], pa.int64()), pa.array([zstd.compress(x) for x in raw], pa.binary())],
                    names=["shard", "id", "n", "frame"])

    @lean
    def pack(batches):
        blob, dictionary, _ = sent.value
        width, digest = _encoder(blob).width, hashlib.sha256(dictionary).digest()
        now, part, held, size = None, 0, [], 0

        def flush():
            shard = write_shard([x[0] for x in held], [x[1] for x in held], [x[2] for x in held], width, digest)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array([sum(x[1] for x in held)], pa.int64()),
                 pa.array([shard], pa.binary())], names=["shard", "part", "n_tokens", "bytes"])
        for b in batches:
            for shard, *doc in zip(*(c.to_pylist() for c in b.columns)):
                if held and (shard != now or size >= SHARD_BYTES):
                    yield flush()
                    part = part + 1 if shard == now else 0
                    held, size = [], 0
                elif shard != now:
                    part = 0
                now = shard
                held.append(doc)
                size += len(doc[2])
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    frames = rows.mapInArrow(encode, "shard bigint, id bigint, n bigint, frame binary")
    dealt = frames.repartition(parts, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first())
    dealt.mapInArrow(pack, "shard bigint, part int, n_tokens bigint, bytes binary").write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: (id, start, n_tokens, ids_crc32); ``start``
    counts the ids of all documents before it."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    sent = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    starts = prefix_sum(shards.select("shard", "part", "n_tokens"), ["shard", "part"], "n_tokens", "_start", exclusive=True)

    @lean
    def run(batches):
        for b in batches:
            for shard, part, data in zip(*(c.to_pylist() for c in b.columns)):
                r = ShardReader(data, sent.value)
                crc = [zlib.crc32(r.document(i).tobytes()) for i in range(len(r))]
                before = np.cumsum(r.counts) - r.counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(r), pa.int64()), pa.array([part] * len(r), pa.int32()),
                     pa.array([None if x == -1 << 63 else x for x in r.ids.tolist()], pa.int64()),
                     pa.array(before, pa.int64()), pa.array(r.counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "part", "id", "before", "n_tokens", "ids_crc32"])
    rows = shards.select("shard", "part", "bytes").mapInArrow(
        run, "shard bigint, part int, id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts.select("shard", "part", "_start"), ["shard", "part"]).select(
        F.col("id").alias(id_col), (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a fresh folder below ``spark.checkpoint.dir`` and read back."""
    path = new_dir(docs.sparkSession, "token-files")
    write(docs, path, vocabulary, id_col, text_col)
    return read(docs.sparkSession, path, id_col)
