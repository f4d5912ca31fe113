"""Op 5: repeated byte strings from the LCP interval tree of a sparse suffix array.

Every string of ``length`` bytes holds an anchor: the least hash among its 96-byte grams, leftmost on
ties. Equal strings have equal anchors at equal places, so repeats meet by anchor. Neighbouring
strings with one anchor form a span (about 550 bytes a 150 strings); only (anchor, digest, place) of
spans is shuffled, and of anchors seen once nothing goes on. Spans with equal digests repeat as a
whole. Where an anchor has different spans, one of each digest fetches its bytes, and the suffixes
that start at the anchor are sorted: an enhanced suffix array of the anchor's occurrences. A stack scan of its
LCP values gives the interval tree, whose intervals are the sets of occurrences with a common right
extension. In an interval the left extensions are sorted and scanned in the same way: a set whose
left neighbours differ cannot be extended to the left, and if its right extension ends at the interval's
depth, it is a maximal repeat, given with all its occurrences. Anchors with very many different
spans (text around a boilerplate line) are not brought together: their strings of ``length`` bytes
meet by digest, packed and dealt over buckets; where groups are asked for, aggregates over hashes of
their strings give the same maximal repeats.

Matches never cross documents, and one document may repeat itself. A repeat found around an anchor
reaches as far as the spans of that anchor do; the union over anchors covers exactly the bytes
covered by strings that start at two or more places.

Defined results: null text is empty; texts under ``length`` bytes have no strings; repeated rows are
documents of their own and repeat each other; rows with equal ids and different texts are kept apart
by a hash of the text; null ids stay; an empty table gives no rows; other columns are ignored
(``remove_repeats`` keeps them). Where a cut goes through a character, ``remove_repeats`` drops the
rest of that character, so that texts stay valid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, give_back, marked, near_ids, register, shared_folder, small_batches, split_ids, table, utf8_views
from roamer.llm.shingles import prefix_hash, span_hash

LENGTH = 400
GRAM = 96
MAX_GROUP = 1024
BUCKET_SPANS = 4000
SEGMENT = 8 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def anchored_spans(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, start, size, anchor, key) of the spans of a batch of texts; places are within the text."""
    base, n = offsets[0], len(raw)
    offsets = offsets - base
    if n < length:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    prefix = prefix_hash(raw)
    at = np.arange(n - gram + 1)
    key = span_hash(prefix, at, at + gram)
    low = sliding_min((key >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), length - gram + 1)
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(n - length + 1)
    # Strings that lie in one text.
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    begin, text, anchor = start[first], text[first], anchor[first]
    return text, begin - offsets[text], start[last] + length - begin, anchor - begin, key[anchor]


def _pieces(data: memoryview, off: np.ndarray, length: int):
    """Runs of whole texts, or parts of a very long text that overlap by ``length`` - 1 bytes:
    (first text, bytes, offsets, place of the first byte in its text)."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > SEGMENT:
            for a in range(int(off[i]), int(off[i + 1]) - length + 1, SEGMENT):
                b = min(a + SEGMENT + length - 1, int(off[i + 1]))
                yield i, data[a:b], np.array([0, b - a]), a - int(off[i])
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= SEGMENT:
            j += 1
        yield i, data[off[i]:off[j]], off[i:j + 1], 0
        i = j


_SPAN = [("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("anchor", pa.int32())]
_SPAN_DDL = "doc_id long, mark long, key long, digest long, start long, size int, anchor int"


def _spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for big in batches:
            for batch in small_batches(big, "text", 1 << 20):
                data, off, _ = utf8_views(batch.column("text"))
                for i, part, offsets, shift in _pieces(data, off, length):
                    text, start, size, anchor, key = anchored_spans(np.frombuffer(part, np.uint8), offsets, length, gram)
                    if not len(text):
                        continue
                    a = (offsets[text] - offsets[0] + start).tolist()
                    digest = b"".join(hashlib.blake2b(part[x:x + y], digest_size=8).digest() for x, y in zip(a, size.tolist()))
                    rows = pa.array(text + i)
                    yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("mark").take(rows), pa.array(key.view(np.int64)),
                                           pa.array(np.frombuffer(digest, np.int64)), pa.array(start + shift), pa.array(size.astype(np.int32)), pa.array(anchor.astype(np.int32))],
                                          schema=pa.schema(_SPAN))
        give_back()

    return docs.mapInArrow(run, _SPAN_DDL)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the LCP interval tree, by one stack scan.

    ``lcp[i]`` belongs to the suffixes i and i + 1; an interval is a largest run of suffixes that
    share ``depth`` bytes.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(spans: list[tuple[bytes, int]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats around one anchor: (left extension, right extension, all occurrences).

    ``spans`` has distinct (bytes, place of the anchor). Occurrences are numbers of spans.
    """
    right = [s[a:] for s, a in spans]
    left = [s[:a][::-1] for s, a in spans]
    if len(spans) == 2:
        a, b = _common(*left), _common(*right)
        if a + b >= length:
            yield a, b, [0, 1]
        return
    order = sorted(range(len(spans)), key=right.__getitem__)
    lcp = [_common(right[x], right[y]) for x, y in zip(order, order[1:])]
    by_left = sorted(range(len(spans)), key=left.__getitem__)
    place = {m: i for i, m in enumerate(by_left)}
    rank = {m: i for i, m in enumerate(order)}
    reach = max(map(len, left))
    for depth, first, last in lcp_intervals(lcp):
        if depth + reach < length:
            continue
        # The interval's occurrences by their left extensions, and the same scan over those.
        inside = sorted(order[first:last + 1], key=place.__getitem__)
        common = [_common(left[x], left[y]) for x, y in zip(inside, inside[1:])]
        for ext, a, b in lcp_intervals(common):
            if ext + depth < length:
                continue
            found = inside[a:b + 1]
            ranks = [rank[m] for m in found]
            if min(lcp[min(ranks):max(ranks)]) == depth:  # else all go on to the right alike
                yield ext, depth, found


def _scan(t: pa.Table, length: int, every: bool) -> pa.Table:
    """Maximal repeats of all anchors of a bucket: a row an occurrence if ``every``, else a row a span:
    all its repeats hold the anchor, so they cover one run, from the first start to the last end."""
    groups: dict[int, list[int]] = {}
    keys, digests = t.column("key").to_pylist(), t.column("digest").to_pylist()
    raw, anchors = t.column("raw").to_pylist(), t.column("anchor").to_pylist()
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    out = []
    for k, rows in groups.items():
        reach: dict[int, tuple[int, int]] = {}
        for n, (a, b, found) in enumerate(maximal_repeats([(raw[i], anchors[i]) for i in rows], length)):
            if every:
                out += [(k, digests[rows[m]], n, anchors[rows[m]] - a, anchors[rows[m]] + b) for m in found]
                continue
            for m in found:
                x, y = reach.get(m, (0, 0))
                reach[m] = max(x, a), max(y, b)
        out += [(k, digests[rows[m]], -1, anchors[rows[m]] - a, anchors[rows[m]] + b) for m, (a, b) in reach.items()]
    return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(_FOUND, zip(*out) if out else [[]] * 5)})


_FOUND = [("key", pa.int64()), ("digest", pa.int64()), ("repeat", pa.int32()), ("first", pa.int32()), ("stop", pa.int32())]
_FOUND_DDL = "key long, digest long, repeat int, first int, stop int"


def _crowded(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """The same for anchors with very many spans: strings meet by digest in packed buckets, and a
    span is covered from its first repeated string to the end of its last (all hold the anchor)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, digest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "digest"))
            data, off, _ = utf8_views(batch.column("raw"))
            raw, anchor = np.frombuffer(data, np.uint8), batch.column("anchor").to_numpy(zero_copy_only=False)
            count = np.diff(off) - length + 1
            own = np.repeat(np.arange(len(key)), count)
            at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            begin = off[own] - off[0] + at
            h = span_hash(prefix_hash(raw[off[0]:off[-1]]), begin, begin + length)
            h ^= (anchor[own] - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key[own].view(np.uint64)
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(buckets + 1))
            for x in range(buckets):
                o = order[cuts[x]:cuts[x + 1]]
                if len(o):
                    yield pa.record_batch([pa.array([x], pa.int64()), pa.array([h[o].tobytes()]), pa.array([key[own[o]].tobytes()]), pa.array([digest[own[o]].tobytes()]),
                                           pa.array([at[o].astype(np.int32).tobytes()])], names=["bucket", "h", "keys", "digests", "at"])

    def meet(t: pa.Table) -> pa.Table:
        h, key, digest, at = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
                              for c, kind in (("h", np.uint64), ("keys", np.int64), ("digests", np.int64), ("at", np.int32)))
        _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = count[inv] > 1
        key, digest, at = key[twice], digest[twice], at[twice]
        order = np.lexsort((at, digest, key))
        key, digest, at = key[order], digest[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])) if len(key) else np.empty(0, np.int64)
        last = np.concatenate([new[1:], [len(key)]]) - 1 if len(key) else new
        return pa.table({"key": key[new], "digest": digest[new], "repeat": np.full(len(new), -1, np.int32), "first": at[new], "stop": (at[last] + length).astype(np.int32)})

    packed = rows.select("key", "digest", "raw", "anchor").mapInArrow(pack, "bucket long, h binary, keys binary, digests binary, at binary")
    return packed.groupBy("bucket").applyInArrow(meet, _FOUND_DDL)


_PLACE_DDL = "key long, digest long, e int, r int, h long, left int, right int"


def _places(raw: bytes, anchor: int, e: np.ndarray, r: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the bytes from ``e`` before the anchor to ``r`` after it, and the bytes on both sides (-1: the span ends)."""
    text = np.frombuffer(raw, np.uint8).astype(np.int32)
    a, b = anchor - e, anchor + r
    edged = np.concatenate([[-1], text, [-1]])
    return span_hash(prefix, a, b).view(np.int64), edged[a], edged[b + 1]


def _place_batch(keys, digests, rows: list) -> pa.RecordBatch:
    own = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
    cols = [np.concatenate(c) if rows else np.empty(0, np.int64) for c in (zip(*rows) if rows else [[]] * 5)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([keys.take(pa.array(own)), digests.take(pa.array(own)), *[pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cols, kinds)]],
                           names=["key", "digest", "e", "r", "h", "left", "right"])


_PLACE = ["key", "e", "r", "h"]


def _open_ends(places: DataFrame) -> DataFrame:
    """(key, e, r, h, left_open, right_open) of strings that several spans have: whether their neighbours
    on that side differ, or a span ends there."""
    differs = lambda c: ((F.min(c) != F.max(c)) | (F.min(c) < 0))
    return (places.groupBy(*_PLACE).agg(F.count("*").alias("n"), differs("left").alias("left_open"), differs("right").alias("right_open"))
            .filter("n > 1").drop("n"))


def _crowded_groups(rows: DataFrame, length: int) -> DataFrame:
    """Maximal repeats with all occurrences for anchors with very many spans, by aggregates only.

    The strings of ``length`` bytes that meet say where a repeat may end: it starts where such a string's
    left neighbours differ and stops where one's right neighbours do. Of each span, the strings between
    such ends meet again; those whose neighbours differ on both sides are the maximal repeats.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, anchor in zip(batch.column("raw").to_pylist(), batch.column("anchor").to_pylist()):
                e = anchor - np.arange(len(raw) - length + 1)
                prefix = prefix_hash(np.frombuffer(raw, np.uint8))
                rows.append((e, length - e, *_places(raw, anchor, e, length - e, prefix)))
            yield _place_batch(batch.column("key"), batch.column("digest"), rows)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, digest, raw, anchor, starts, stops = (batch.column(c)[i].as_py() for c in ("key", "digest", "raw", "anchor", "starts", "stops"))
                e, r = (x.ravel() for x in np.meshgrid(np.array(starts, np.int64), np.array(stops, np.int64)))
                e, r = e[e + r >= length], r[e + r >= length]
                if len(e):
                    found = _places(raw, anchor, e, r, prefix_hash(np.frombuffer(raw, np.uint8)))
                    yield _place_batch(pa.array([key], pa.int64()), pa.array([digest], pa.int64()), [(e, r, *found)])

    rows = rows.select("key", "digest", "raw", "anchor")
    seen = rows.mapInArrow(windows, _PLACE_DDL)
    ends = cut(_open_ends(seen).filter("left_open or right_open"))
    ends = (seen.join(ends, _PLACE).groupBy("key", "digest")
            .agg(F.collect_set(F.when(F.col("left_open"), F.col("e"))).alias("starts"), F.collect_set(F.when(F.col("right_open"), F.col("r"))).alias("stops"))
            .filter("size(starts) > 0 and size(stops) > 0"))
    strings = cut(rows.join(cut(ends), ["key", "digest"]).mapInArrow(between, _PLACE_DDL))
    repeats = cut(_open_ends(strings).filter("left_open and right_open").drop("left_open", "right_open"))
    return (strings.join(repeats, _PLACE).join(rows.select("key", "digest", "anchor"), ["key", "digest"])
            .select("key", "digest", F.xxhash64("e", "r", "h").alias("repeat"), (F.col("anchor") - F.col("e")).alias("first"), (F.col("anchor") + F.col("r")).alias("stop")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP,
                   groups: bool = False) -> DataFrame:
    """(doc_id, mark, first, stop) of what repeats, a row a span; overlapping, not merged.

    ``docs`` comes from ``marked``. With ``groups``: a row an occurrence, also key, whole and repeat, which
    together number a repeat that is maximal within the spans of its anchor: ``whole`` is the digest where spans
    repeat as a whole and no other span has all their bytes, else null; ``repeat`` numbers the others.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "repeat-spans")
    _spans(docs, length, gram).write.parquet(path)
    spans = spark.read.schema(_SPAN_DDL).parquet(path)
    keys = spans.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("n > 1")
    keys = cut(keys.select("key", (F.col("d0") != F.col("d1")).alias("mixed")))
    shared = cut(spans.join(keys, "key"))
    kinds = shared.groupBy("key", "digest", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "start", "size", "anchor")).alias("one"))
    kinds = cut(kinds)
    whole = kinds.filter("n > 1").select("key", "digest")

    # The bytes of one span of each digest, where an anchor has several.
    mixed = kinds.filter("mixed").select("key", "digest", "one.*")
    # Small sides are materialised before a join, so that Spark can split the other side's hot keys.
    load = cut(mixed.groupBy("key").agg(F.count("*").alias("m")))
    mixed = mixed.join(load, "key").withColumn("crowded", F.col("m") > max_group)
    wanted = mixed.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "digest", "start", "size", "anchor", "crowded")).alias("spans"))
    wanted = cut(wanted)
    near = near_ids(docs, wanted)
    fetched = (near.join(wanted, _same(near, wanted)).select("text", "spans")
               .select(F.col("text").cast("binary").alias("t"), F.explode("spans").alias("s"))
               .select("s.key", "s.digest", "s.anchor", "s.crowded", F.expr("substring(t, cast(s.start as int) + 1, s.size)").alias("raw")))
    # Rows of one (id, text) that is there twice fetch the same bytes.
    fetched = cut(fetched.groupBy("key", "digest").agg(F.first("anchor").alias("anchor"), F.first("crowded").alias("crowded"), F.first("raw").alias("raw")))
    n = fetched.agg(F.count(F.when(~F.col("crowded"), 1)).alias("few"), F.count(F.when(F.col("crowded"), 1)).alias("many")).first()
    few = max(1, -(-n["few"] // BUCKET_SPANS))
    found = (fetched.filter("not crowded").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(few)))
             .groupBy("bucket").applyInArrow(lambda t: _scan(t, length, groups), _FOUND_DDL))
    if groups:
        found = found.withColumn("repeat", F.col("repeat").cast("long"))
    if n["many"]:
        many = fetched.filter("crowded")
        found = found.unionByName(_crowded_groups(many, length) if groups else _crowded(many, length, max(8, n["many"] // BUCKET_SPANS)))
    if not groups:
        # Buckets of crowded anchors may each know a part of a span's reach.
        found = cut(found.groupBy("key", "digest").agg(F.min("first").alias("first"), F.max("stop").alias("stop")))
    else:
        found = cut(found)
        # A whole span that lies in other spans too is among the repeats found, with all occurrences.
        full = found.join(kinds.select("key", "digest", "one.size"), ["key", "digest"]).filter("first = 0 and stop = size")
        whole = whole.join(full.select("key", "digest").distinct(), ["key", "digest"], "left_anti")
    more = ["key", "whole", "repeat"] if groups else []
    out = ["doc_id", "mark", "first", "stop", *more]
    none = F.lit(None).cast("long")
    a = shared.join(whole, ["key", "digest"]).select("doc_id", "mark", F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("stop"),
                                                     "key", F.col("digest").alias("whole"), none.alias("repeat"))
    b = shared.drop("mixed").join(found, ["key", "digest"]).withColumns({"first": F.col("start") + F.col("first"), "stop": F.col("start") + F.col("stop"), "whole": none})
    return a.select(out).unionByName(b.select(out))


def _cut_texts(docs: DataFrame, length: int, gram: int, max_group: int) -> DataFrame:
    """(doc_id, mark, n_removed, n_spans, kept_sha256, kept) of every distinct document that repeats."""
    runs = repeated_spans(docs, length, gram, max_group).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "stop")).alias("runs"))
    runs = cut(runs)
    near = near_ids(docs, runs)
    rows = near.join(runs, _same(near, runs)).select(near["doc_id"], near["mark"], "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text"):
                data, off, _ = utf8_views(batch.column("text"))
                out = []
                for i, spans in enumerate(batch.column("runs").to_pylist()):
                    text, at, kept, removed, n = data[off[i]:off[i + 1]], 0, [], 0, 0
                    first, stop = np.array([(s["first"], s["stop"]) for s in spans]).T
                    order = np.argsort(first, kind="stable")
                    first, far = first[order], np.maximum.accumulate(stop[order])
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > far[:-1]]))
                    ends = far[np.concatenate([new[1:], [len(far)]]) - 1]
                    for a, b in zip(first[new].tolist(), ends.tolist()):
                        kept.append(bytes(text[at:a]))
                        removed, n, at = removed + b - a, n + 1, b
                    kept.append(bytes(text[at:]))
                    rest = b"".join(kept)
                    out.append((removed, n, hashlib.sha256(rest).hexdigest(), "".join(k.decode(errors="ignore") for k in kept)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]],
                                      names=["doc_id", "mark", "n_removed", "n_spans", "kept_sha256", "kept"])
        give_back()

    done = rows.mapInArrow(run, "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return done.dropDuplicates(["doc_id", "mark"])


def repeat_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = marked(docs)
    whole = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select("doc_id", "mark", F.length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"))
    cuts = _cut_texts(docs, length, gram, max_group).drop("kept")
    return base.join(cuts, _same(base, cuts), "left").select(
        base["doc_id"], "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """The documents with all their columns, their text without the repeated bytes; n_chars, where
    it is a column, is counted anew."""
    cuts = _cut_texts(marked(docs), length, gram, max_group).select("doc_id", F.col("mark").alias("__m"), F.col("kept").alias("__kept"))
    cuts = cut(cuts)
    near, far = split_ids(docs, cuts)
    cuts = cuts.withColumnRenamed("doc_id", "__d")
    joined = near.join(cuts, near["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(near["text"]) == F.col("__m")), "left")
    out = {"text": F.coalesce("__kept", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return far.unionByName(joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns]))


@register("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))
