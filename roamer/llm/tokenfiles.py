"""Op 4: token-id shards with a minimal perfect hash index for keyed access.

A shard file holds, in this order: the raw little-endian ids of its documents one after the other
(2 bytes an id where the vocabulary allows, else 4), the record offsets in ids, the record keys, and
the index: a minimal perfect hash of the keys (bit levels with word ranks), and for each of its slots
a 32-bit fingerprint of the key, the first record and the number of records. A JSON footer, its
length and a magic word end the file. A key is found by a constant number of hashes, bit tests and
one rank, checked against the fingerprint, and read with one slice of the payload.

Documents are range-partitioned by id on their text (smaller than its ids), sorted, tokenised in
order and streamed to shards of a bounded size; the manifest (a row a shard) is materialised, and
running sums over it give every shard the number of ids before it.

Defined results: null text is the end id alone; rows with equal ids are neighbours, ordered by a hash
of their text, and one key finds them all; null ids come first and are read by scan, not by key; a
key that is not there is absent (but for a fingerprint clash, one in 2**32); an empty table writes no
shard and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, id_text, open_store, register, shared_folder, small_batches, table, utf8_views, write_whole
from roamer.llm.tokens import encoder, tokenizer_path

MAGIC = b"RTOKENS1"
SHARD_BYTES = 64 << 20
GAMMA = 1.6
LEVELS = 48
END_ID = 1


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of (key, seed), the splitmix construction."""
    z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _place(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
    return (((_mix(keys, seed) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Distinct int64 keys -> 0 .. n-1. Each level is a bit array in which the keys that hit a place
    alone set its bit; the others go on to the next. A key's number is the rank of its bit."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.ranks, self.rest = sizes, words, ranks, rest
        self.bits = int(sum(sizes))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.asarray(keys, np.int64)
        while len(left) and len(sizes) < LEVELS:
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(levels) if levels else np.empty(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, (np.cumsum(counts) - counts).astype("<u4"), np.sort(left))

    def __len__(self) -> int:
        return (int(self.ranks[-1]) + int(np.bitwise_count(self.words[-1])) if len(self.words) else 0) + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; -1 only where a foreign key meets no bit."""
        keys = np.asarray(keys, np.int64)
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for seed, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = base + _place(keys[todo], seed, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + np.bitwise_count(below)
            todo, base = todo[~hit], base + size
        if len(todo) and len(self.rest):
            k = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[k] == keys[todo]
            out[todo[same]] = len(self) - len(self.rest) + k[same]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys, np.int64), LEVELS + 7) & np.uint64(0xFFFFFFFF)).astype("<u4")


def shard_bytes(keys: list, ids: list[np.ndarray], width: int) -> list:
    """The file's parts for records in ascending key order (None first)."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    nulls = sum(k is None for k in keys)
    known = np.asarray(keys[nulls:], "<i8")
    distinct, first, count = np.unique(known, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    prints, firsts, counts = (np.zeros(len(distinct), "<u4") for _ in range(3))
    prints[slot], firsts[slot], counts[slot] = fingerprints(distinct), first + nulls, count
    sections = {"payload": np.concatenate(ids).astype(f"<u{width}") if ids else np.empty(0, f"<u{width}"),
                "offsets": offsets, "keys": known, "words": mph.words, "ranks": mph.ranks, "rest": mph.rest.astype("<i8"),
                "prints": prints, "firsts": firsts, "counts": counts}
    raw = {k: v.tobytes() for k, v in sections.items()}
    footer = json.dumps({"width": width, "nulls": nulls, "sizes": mph.sizes, "lengths": {k: len(v) for k, v in raw.items()},
                         "crc32": zlib.crc32(raw["payload"])}).encode()
    return [*raw.values(), footer, struct.pack("<Q", len(footer)), MAGIC]


class Shard:
    """A shard opened for keyed access; the payload stays in the file until it is read."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        size, magic = struct.unpack("<Q8s", self.file.read_at(16, end - 16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        spec = json.loads(self.file.read_at(size, end - 16 - size))
        self.width, self.nulls, at = spec["width"], spec["nulls"], 0
        place = {}
        for name, n in spec["lengths"].items():
            place[name], at = (at, n), at + n
        get = lambda name, kind: np.frombuffer(self.file.read_at(place[name][1], place[name][0]), kind)
        self.offsets, self.keys = get("offsets", "<u8").astype(np.int64), get("keys", "<i8")
        self.mph = PerfectHash(spec["sizes"], get("words", "<u8"), get("ranks", "<u4"), get("rest", "<i8"))
        self.prints, self.firsts, self.counts = get("prints", "<u4"), get("firsts", "<u4"), get("counts", "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; (0, 0) where it is absent."""
        slot = self.mph.slots(keys)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ok = (slot >= 0) & (self.prints[slot] == fingerprints(keys))
        return np.where(ok, self.firsts[slot], 0).astype(np.int64), np.where(ok, self.counts[slot], 0).astype(np.int64)

    def ids(self, record: int) -> np.ndarray:
        a, b = self.offsets[record], self.offsets[record + 1]
        return np.frombuffer(self.file.read_at(int(b - a) * self.width, int(a) * self.width), f"<u{self.width}").astype("<u4")


def write_token_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID,
                       shard_size: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; the materialised manifest: part, shard, uri, n_docs, n_tokens, first_id, last_id, base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path), TaskContext.get().partitionId(), 0
        width = 2 if max(enc.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{number:05d}.tok"
            write_whole(uri, shard_bytes(keys, ids, width))
            known = [k for k in keys if k is not None]
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "uri": uri, "n_docs": len(keys), "n_tokens": sum(map(len, ids)),
                                                "first_id": known[0] if known else None, "last_id": known[-1] if known else None}], schema=schema)

        for big in batches:
            for batch in small_batches(big, "text"):
                data, off, _ = utf8_views(batch.column("text"))
                flat, sizes = enc.encode_many(np.frombuffer(data, np.uint8), off)
                flat = flat.astype(f"<u{width}")
                for key, a, n in zip(batch.column("doc_id").to_pylist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                    keys.append(key)
                    ids.append(np.append(flat[a:a + n], flat.dtype.type(end_id)))
                    held += len(ids[-1]) * width
                    if held >= shard_size:
                        yield flush()
                        keys, ids, held, number = [], [], 0, number + 1
        if keys:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    # The hash splits rows that share an id between neighbouring partitions.
    ordered = (id_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    manifest = cut(ordered.mapInArrow(run, "part int, shard int, uri string, n_docs long, n_tokens long, first_id long, last_id long"))
    # A row a shard of many MB: this window is small whatever the number of documents.
    return manifest.withColumn("base", F.expr("sum(n_tokens) over (order by part, shard) - n_tokens"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document, found through the index of its shard: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                s = Shard(uri)
                distinct = np.unique(s.keys)
                first, count = s.find(distinct)
                rows = [(None, r) for r in range(s.nulls)]
                rows += [(int(k), r) for k, a, n in zip(distinct, first, count) for r in range(a, a + n)]
                got = [(k, base + int(s.offsets[r]), int(s.offsets[r + 1] - s.offsets[r]), zlib.crc32(s.ids(r).tobytes())) for k, r in rows]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A task a shard, whatever the size of the list.
    shards = manifest.select("uri", "base").repartition(max(1, manifest.count()), "uri")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str) -> DataFrame:
    """Ids of the asked documents (doc_id, ids), by key: shards whose range holds a key are opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[str, Shard] = {}
        for batch in batches:
            out = []
            for uri, key in zip(batch.column("uri").to_pylist(), batch.column("key").to_pylist()):
                if uri not in open_shards:
                    open_shards.clear()
                    open_shards[uri] = Shard(uri)
                s = open_shards[uri]
                (a,), (n,) = s.find(np.array([key]))
                out += [(key, s.ids(r).tolist()) for r in range(a, a + n)]
            yield pa.record_batch([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    wanted = keys.select(F.col(key_col).cast("long").alias("key")).dropna().distinct()
    ends = manifest.agg(F.min("first_id").alias("a"), F.max("last_id").alias("b"), F.count("*").alias("n")).first()
    # Equal ranges of ids, about as many as shards: an equi-join on the range, then the exact test.
    step = max(1, (ends["b"] - ends["a"] + 1) // ends["n"]) if ends["a"] is not None else 1
    spread = manifest.filter("first_id is not null").withColumn("range", F.explode(F.expr(f"sequence(first_id div {step}, last_id div {step})")))
    near = (wanted.withColumn("range", F.expr(f"key div {step}")).join(spread, "range")
            .filter(F.col("key").between(F.col("first_id"), F.col("last_id"))))
    return near.select("uri", "key").repartition("uri").sortWithinPartitions("uri").mapInArrow(run, "doc_id long, ids array<long>")


@register("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_token_shards(docs, shared_folder(spark, "token-files"), tokenizer_path()))
