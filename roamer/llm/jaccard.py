"""Op 10: exact Jaccard join of 5-word shingle sets, with set-relation skipping.

Links are pairs of documents with 100 * intersection >= 80 * union. The join keeps to classes of equal
sets, and skips work by relations between sets, on two levels.

Index. Tokens are counted, and ordered: rare ones by hash, frequent ones (in LOCAL_HITS sets or more, a
list of bounded size) last by count. So a rare token's list stays short, however large the table, and
the pairs of all such lists grow with the input. Linked sets share a token of their prefixes, the first fifth. Prefix postings are dealt
to buckets of the token space as packed arrays; in a bucket, an index list is sorted by position and
cut into blocks, and blocks whose positions and sizes cannot meet the bound are skipped. Postings
without a partner, most of them, end there.

Answers. In every list the set with the least hash leads; pairs of a leader and a member that share
enough prefix tokens are compared exactly. Members are held as differences to their leader: the
overlap of two members follows from the leader's size and the two differences alone, so members that
the leader does not link get their answers from their differences, and members that are connected
already are not compared. Sets of frequent tokens' lists are compared once more in chunks of their
longest list; those that still lie outside the largest component of their family (lists that overlap)
are compared with the family in tiles, again by differences. Sets outside the largest component of a
rare token's list are compared with the others of that list, counted by shared prefix tokens first. No
list is turned into all its pairs, and every link between components is found. Of these pairs, parity
sketches (four bits a token; differing bits bound the difference from below) drop those that cannot
be links, each set is compared with its closest first, and only pairs still apart then are compared.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing; equal rows
are one class; documents with equal ids are told apart by their sets; a null id stays and is never the
smallest unless alone; ties of the order are broken by hash; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, give_back, marked, near_ids, register, small_batches, split_ids, table, utf8_views
from roamer.llm.components import components
from roamer.llm.shingles import parity_sketch, set_key, shingle_sets, sketch_distance

#: Frequent tokens: in so many sets or more; at most so many are broadcast (16 bytes each), the most frequent ones.
LOCAL_HITS = 16
MAX_FREQUENT = 1_000_000
#: Tokens that one task counts.
COUNT_TOKENS = 2_000_000
BUCKET_POSTINGS = 400_000
#: Tokens that a task holds before it counts or packs them.
HELD_TOKENS = 1_000_000
BLOCK = 64
SHORT_LIST = 32
CHUNK_SETS = 256
CHUNK_SHINGLES = 400_000


def prefix_size(n):
    """Linked sets overlap in at least four fifths of each, so their prefixes of this size share a token."""
    return n - (4 * n + 4) // 5 + 1


def _sets(batches: Iterator[pa.RecordBatch]):
    give_back()
    for big in batches:
        for batch in small_batches(big, "text", 1 << 20):
            data, off, _ = utf8_views(batch.column("text"))
            yield batch, shingle_sets(np.frombuffer(data, np.uint8), off)
    give_back()


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, sketch) a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary())])
        for batch, sets in _sets(batches):
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) or None for s in sets], pa.binary()),
                                   pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, mark long, n long, node binary, sketch binary")


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """(code, hits) of the tokens in LOCAL_HITS sets or more. A code is a token's first 32 + ``bits`` bits, the
    first ``bits`` of them its bucket; two tokens with one code, about 1 in 2,000, count together. Sets that
    several tasks hold count in each: as counts only order tokens, no link depends on them."""
    least = LOCAL_HITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0

        def pack() -> pa.RecordBatch:
            code, c = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            c = np.minimum(c, 65535).astype(np.uint16)
            cuts = np.searchsorted(code, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            rows = [(k, code[x:y].astype(np.uint32).tobytes(), c[x:y].tobytes()) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "codes", "hits"])

        for _, sets in _sets(batches):
            for s in sets:
                if len(s) and (k := set_key(s)) not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
            if size > HELD_TOKENS:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()
        held = []
        give_back()

    def add(key: tuple, t: pa.Table) -> pa.Table:
        code = np.concatenate([np.frombuffer(c, np.uint32) for c in t.column("codes").to_pylist()])
        hits = np.concatenate([np.frombuffer(c, np.uint16) for c in t.column("hits").to_pylist()])
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.add.reduceat(hits[order].astype(np.int64), first)
        keep = total >= least
        del hits, order, t
        give_back()
        return pa.table({"code": pa.array(code[first][keep].astype(np.int64) + (key[0].as_py() << 32)), "hits": pa.array(total[keep])})

    return docs.mapInArrow(run, "bucket int, codes binary, hits binary").groupBy("bucket").applyInArrow(add, "code long, hits long")


def _frequent(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted codes, their counts, bits) of frequent tokens: all in LOCAL_HITS sets or more, or the
    MAX_FREQUENT most frequent."""
    bits = min(24, max(4, (total // COUNT_TOKENS).bit_length()))
    found = cut(_counted(docs, bits))
    if found.count() > MAX_FREQUENT:
        top = 1 << 16
        room, least = MAX_FREQUENT, top
        for h, c in sorted(found.groupBy(F.least("hits", F.lit(top)).alias("h")).count().collect(), reverse=True):
            if (room := room - c) < 0:
                break
            least = h
        found = found.filter(F.col("hits") >= least).limit(MAX_FREQUENT)
    rows = found.toPandas()
    codes = rows["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], rows["hits"].to_numpy(np.int64)[order], bits


def _hot(tokens: np.ndarray, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are frequent, and the place of each in the list."""
    if not len(frequent):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    code = tokens >> np.uint64(32 - bits)
    at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
    return frequent[at] == code, at


def _ordered(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The set's tokens, rare ones by hash, then frequent ones by count."""
    hot, at = _hot(tokens, frequent, bits)
    if not hot.any():
        return tokens
    order = np.lexsort((tokens[hot], counts[at[hot]]))
    return np.concatenate([tokens[~hot], tokens[hot][order]])


_POSTING = [("token", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("pos", pa.int32())]


def _postings(docs: DataFrame, buckets: int, spread) -> DataFrame:
    """Packed rows (bucket, tokens, at, pos, nodes, sizes); frequent tokens come as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, bits = spread.value
        seen: set[bytes] = set()
        held, size = [], 0
        schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("at", pa.binary()), ("pos", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])

        def pack() -> pa.RecordBatch:
            n = np.array([len(p) for _, _, p in held])
            tok = np.concatenate([p for _, _, p in held])
            own = np.repeat(np.arange(len(held), dtype=np.int32), n)
            pos = (np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            nodes = np.frombuffer(b"".join(k for k, _, _ in held), np.uint8).reshape(-1, 16)
            sizes = np.array([s for _, s, _ in held], np.int32)
            b = (tok % np.uint64(buckets)).astype(np.int32)
            b[_hot(tok, frequent, bits)[0]] = -1
            order = np.lexsort((tok, b))
            tok, own, pos, b = tok[order], own[order], pos[order], b[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
            rows = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                used, at = np.unique(own[x:y], return_inverse=True)
                rows.append((int(b[x]), tok[x:y].tobytes(), at.astype(np.int32).tobytes(), pos[x:y].tobytes(), nodes[used].tobytes(), sizes[used].tobytes()))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for _, sets in _sets(batches):
            for s in sets:
                if len(s) and (k := set_key(s)) not in seen:
                    seen.add(k)
                    held.append((k, len(s), _ordered(s, frequent, counts, bits)[:prefix_size(len(s))]))
                    size += len(held[-1][2])
            if size > HELD_TOKENS:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return docs.mapInArrow(run, "bucket int, tokens binary, at binary, pos binary, nodes binary, sizes binary")


def _could_link(nx, px, ny, py):
    """Whether a shared token at these positions leaves room for the overlap that a link needs."""
    most = np.minimum(px, py) + 1 + np.minimum(nx - px - 1, ny - py - 1)
    return (9 * most >= 4 * (nx + ny)) & (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny))


def _alive(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which postings of one list (sorted by position) have a partner. Blocks are compared block by
    block; a block is skipped where its ranges rule every pair out, or when all are known to live."""
    m, live = len(n), np.zeros(len(n), bool)
    for a in range(0, m, BLOCK):
        x = slice(a, a + BLOCK)
        for b in range(a, m, BLOCK):
            y = slice(b, b + BLOCK)
            if live[x].all() and live[y].all():
                continue
            # Later blocks lie further right: their least position bounds what any pair can reach.
            if 9 * (int(p[x].max()) + 1 + int((n[y] - p[y]).max()) - 1) < 4 * (int(n[x].min()) + int(n[y].min())):
                continue
            ok = _could_link(n[x][:, None], p[x][:, None], n[y][None, :], p[y][None, :])
            if a == b:
                np.fill_diagonal(ok, False)
            live[x] |= ok.any(1)
            live[y] |= ok.any(0)
    return live


def _live_postings(batches: list[tuple], bucket: int) -> pa.Table:
    """The postings of one bucket that have a partner, with their list's leader."""
    tok, node, n, pos = [], [], [], []
    for tokens, at, p, nodes, sizes in batches:
        at = np.frombuffer(at, np.int32)
        tok.append(np.frombuffer(tokens, np.uint64))
        node.append(np.frombuffer(nodes, "V16")[at])
        n.append(np.frombuffer(sizes, np.int32)[at])
        pos.append(np.frombuffer(p, np.int32))
    tok, node, n, pos = map(np.concatenate, (tok, node, n, pos))
    _, first, inv, cnt = np.unique(tok, return_index=True, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(cnt[inv] > 1)
    tok, node, n, pos = tok[keep], node[keep], n[keep].astype(np.int64), pos[keep].astype(np.int64)
    # A set that several tasks held counts once.
    halves = node.view(np.uint64).reshape(-1, 2) if len(node) else np.empty((0, 2), np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0], tok))
    tok, node, n, pos, halves = tok[order], node[order], n[order], pos[order], halves[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (halves[1:] != halves[:-1]).any(1)
    tok, node, n, pos = tok[new], node[new], n[new], pos[new]
    order = np.lexsort((pos, tok))
    tok, node, n, pos = tok[order], node[order], n[order], pos[order]
    cuts = np.concatenate([[0], np.flatnonzero(tok[1:] != tok[:-1]) + 1, [len(tok)]]) if len(tok) else np.array([0])
    size = np.diff(cuts)
    live = np.zeros(len(tok), bool)
    two = cuts[:-1][size == 2]
    live[two] = live[two + 1] = _could_link(n[two], pos[two], n[two + 1], pos[two + 1])
    for a, m in zip(cuts[:-1][size > 2], size[size > 2]):
        live[a:a + m] = _alive(n[a:a + m], pos[a:a + m])
    tok, node, n, pos = tok[live], node[live], n[live], pos[live]
    # The least node of a list leads it; nodes are hashes.
    halves = node.view(np.uint64).reshape(-1, 2) if len(node) else halves[:0]
    order = np.lexsort((halves[:, 1], halves[:, 0], tok))
    first = np.flatnonzero(np.concatenate([[True], tok[order][1:] != tok[order][:-1]])) if len(tok) else order
    lead = np.empty(len(tok), np.int64)
    lead[order] = np.repeat(order[first], np.diff(np.concatenate([first, [len(tok)]])))
    cols = [pa.array(tok.view(np.int64)), _binary(node), n, pos, _binary(node[lead]), n[lead], pos[lead], np.full(len(tok), bucket)]
    return pa.Table.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], names=[f.split()[0] for f in _LIVE.split(", ")]).cast(_LIVE_SCHEMA)


def _binary(nodes: np.ndarray) -> pa.Array:
    """16-byte keys as an Arrow column, without Python objects."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(nodes), [None, pa.py_buffer(nodes.tobytes())]).cast(pa.binary())


_LIVE = "token long, node binary, n int, pos int, hub binary, hn int, hp int, bucket int"
_LIVE_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in _LIVE.split(", ")])


def _index(packed: DataFrame) -> DataFrame:
    """All postings that have a partner, with their list's leader; bucket is -1 for frequent tokens."""

    def bucket(key: tuple, t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("tokens", "at", "pos", "nodes", "sizes")]
        return _live_postings(list(zip(*cols)), key[0].as_py())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tokens, at, p, nodes, sizes in zip(*(b.column(c).to_pylist() for c in ("tokens", "at", "pos", "nodes", "sizes"))):
                at = np.frombuffer(at, np.int32)
                yield pa.record_batch([pa.array(np.frombuffer(tokens, np.int64)), _binary(np.frombuffer(nodes, "V16")[at]),
                                       pa.array(np.frombuffer(sizes, np.int32)[at]), pa.array(np.frombuffer(p, np.int32))], names=["token", "node", "n", "pos"])

    rare = packed.filter("bucket >= 0").groupBy("bucket").applyInArrow(bucket, _LIVE)
    hot = packed.filter("bucket < 0").mapInArrow(unpack, "token long, node binary, n int, pos int")
    hot = cut(hot.groupBy("token", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
    lead = cut(hot.groupBy("token").agg(F.min(F.struct(F.col("node").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hp"))).alias("l")))
    hot = hot.join(lead.select("token", "l.hub", "l.hn", "l.hp"), "token").withColumn("bucket", F.lit(-1))
    return rare.unionByName(hot.select(*rare.columns))


def _fits(nx: str, px: str, ny: str, py: str) -> Column:
    return F.expr(f"9 * (least({px}, {py}) + 1 + least({nx} - {px} - 1, {ny} - {py} - 1)) >= 4 * ({nx} + {ny}) "
                  f"and 5 * least({nx}, {ny}) >= 4 * greatest({nx}, {ny})")


def _enough(shared: str, nx: str, ny: str) -> Column:
    """Prefix tokens that two sets must share: what a link needs less the longer rest behind a prefix."""
    return F.expr(f"{shared} >= (4 * ({nx} + {ny}) + 8) div 9 - (greatest((4 * {nx} + 4) div 5, (4 * {ny} + 4) div 5) - 1)")


def _texts(docs: DataFrame, sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of one document of each wanted class."""
    reps = sig.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    near = near_ids(docs, reps)
    found = near.join(reps, near["doc_id"].eqNullSafe(reps["doc_id"])).select("node", "text")

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without texts that share a representative's id but not its set."""
        for batch, sets in _sets(batches):
            same = [set_key(s) == k for s, k in zip(sets, batch.column("node").to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    return found.mapInArrow(of_class, found.schema)


def _compare(pairs: DataFrame, docs: DataFrame, sig: DataFrame) -> DataFrame:
    """Links (a, b) among each hub and its partners; pairs has hub, node, n (the node's set size)."""
    pairs = cut(pairs)
    texts = _texts(docs, sig, pairs.select("node").union(pairs.select(F.col("hub").alias("node"))))
    # Small sides are materialised before a join, so that Spark can split the other side's hot keys.
    load = cut(pairs.groupBy("hub").agg((F.expr(f"count(*) div {CHUNK_SETS} + sum(n) div {CHUNK_SHINGLES}") + 1).alias("chunks")))
    members = pairs.join(load, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node")
    hubs = load.select("hub", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), F.col("hub").alias("node"))
    rows = members.unionByName(hubs).join(texts, "node").select("hub", "chunk", "node", "text")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_pylist()
        one = list({k: i for i, k in enumerate(nodes)}.values())  # a repeated row fetches its text twice
        data, off, _ = utf8_views(t.column("text").take(pa.array(one)))
        links = _answers(key[0].as_py(), [nodes[i] for i in one], shingle_sets(np.frombuffer(data, np.uint8), off))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return rows.groupBy("hub", "chunk").applyInArrow(run, "a binary, b binary")


def _answers(hub: bytes, nodes: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links that connect what is linked within one group, the hub's answers first.

    x is the hub, x - y and y - x a member's differences. For members y and z,
    |y & z| = |x| - |x - y| - |x - z| + |(x - y) & (x - z)| + |(y - x) & (z - x)|.
    """
    if hub not in nodes:
        return []
    x = sets[nodes.index(hub)]
    rest = [(k, s) for k, s in zip(nodes, sets) if k != hub]
    links, sides, owners, linked, sizes = [], [], [], [], []
    for i, (k, s) in enumerate(rest):
        inside = np.isin(s, x, assume_unique=True, kind="sort")
        shared = int(np.count_nonzero(inside))
        gone = np.setdiff1d(x, s[inside], assume_unique=True)
        sides.append((gone, s[~inside]))
        sizes.append(len(s))
        linked.append(9 * shared >= 4 * (len(x) + len(s)))
        if linked[-1]:
            links.append((hub, k))
    root = list(range(len(rest) + 1))  # the last stands for the hub

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, yes in enumerate(linked):
        if yes:
            root[i] = len(rest)
    open_sets = [i for i, yes in enumerate(linked) if not yes]
    if not open_sets or len(rest) < 2:
        return links
    # Differences of all members as one list: which side, token, member. The side tells x - y from y - x.
    flat = [np.unique(np.concatenate([g[s] for g in sides]), return_inverse=True)[1] for s in (0, 1)]
    owners = [np.repeat(np.arange(len(rest)), [len(g[s]) for g in sides]) for s in (0, 1)]
    begin = [np.concatenate([[0], np.cumsum([len(g[s]) for g in sides])]) for s in (0, 1)]
    marked_ = [np.zeros(int(f.max(initial=-1)) + 1, bool) for f in flat]
    missing, sizes = np.array([len(g[0]) for g in sides]), np.array(sizes)
    for i in open_sets:
        both = len(x) - missing[i] - missing
        for s in (0, 1):
            own = flat[s][begin[s][i]:begin[s][i + 1]]
            marked_[s][own] = True
            both = both + np.bincount(owners[s][marked_[s][flat[s]]], minlength=len(rest))
            marked_[s][own] = False
        for j in np.flatnonzero(9 * both >= 4 * (sizes[i] + sizes)):
            if (a := find(i)) != (b := find(int(j))):
                root[a] = b
                links.append((rest[i][0], rest[int(j)][0]))
    return links


def _leader_pairs(live: DataFrame) -> DataFrame:
    """(hub, node, n): members with their list's leader, where they share enough prefix tokens."""
    hits = live.filter(F.col("node") != F.col("hub")).filter(_fits("n", "pos", "hn", "hp"))
    return hits.groupBy("hub", "node", "hn", "n").agg(F.count("*").alias("shared")).filter(_enough("shared", "n", "hn")).select("hub", "node", "n")


def _bucket_outside(t: pa.Table) -> pa.Table:
    """Of one bucket, pairs of a set outside the largest component of a list with sets of other
    components in it, and how many lists they share so."""
    tok, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "pos"))
    names, node = _codes(t.column("node"))
    label = _codes(t.column("label"))[1]
    order = np.lexsort((label, tok))
    tok, n, pos, node, label = tok[order], n[order], pos[order], node[order], label[order]
    cuts = np.concatenate([[0], np.flatnonzero(tok[1:] != tok[:-1]) + 1, [len(tok)]])
    mixed = label[cuts[:-1]] != label[cuts[1:] - 1]
    total, held, size = {}, [], 0
    sizes = np.zeros(len(names), np.int64)
    sizes[node] = n

    def count() -> None:
        pair, c = np.unique(np.concatenate(held), return_counts=True)
        for k, v in zip(pair.tolist(), c.tolist()):
            total[k] = total.get(k, 0) + v

    def take(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held, size
        ok = (label[i] != label[j]) & _could_link(n[i], pos[i], n[j], pos[j])
        x, y = node[i[ok]], node[j[ok]]
        held.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
        size += len(x)
        if size > HELD_TOKENS:
            count()
            held, size = [], 0

    start, many = cuts[:-1][mixed], np.diff(cuts)[mixed]
    for m in np.unique(many[many <= SHORT_LIST]):  # short lists of one length together
        i, j = np.triu_indices(m, 1)
        lists = start[many == m]
        step = max(1, HELD_TOKENS // len(i))
        for k in range(0, len(lists), step):
            part = lists[k:k + step, None]
            take((part + i).ravel(), (part + j).ravel())
    for a, m in zip(start[many > SHORT_LIST], many[many > SHORT_LIST]):
        x = np.arange(a, a + m)
        groups, inv, sizes_of = np.unique(label[x], return_inverse=True, return_counts=True)
        top = inv == int(np.argmax(sizes_of))
        for i in x[~top]:  # each set outside, with the largest component and with the sets behind it
            j = x[top | (x > i)]
            take(np.full(len(j), i), j)
    if held:
        count()
    pair = np.fromiter(total, np.int64, len(total))
    i, j = pair // max(1, len(names)), pair % max(1, len(names))
    return pa.table({"hub": _binary(names[i]), "node": _binary(names[j]), "hn": pa.array(sizes[i], pa.int32()), "n": pa.array(sizes[j], pa.int32()),
                     "shared": pa.array(np.fromiter(total.values(), np.int64, len(total)), pa.int64())})


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 16-byte keys, and each row's number among them."""
    coded = pa.concat_arrays([c.cast(pa.binary()) for c in column.chunks]).dictionary_encode()
    return np.frombuffer(b"".join(coded.dictionary.to_pylist()), "V16"), coded.indices.to_numpy().astype(np.int64)


def _mixed(named: DataFrame) -> DataFrame:
    """(token, top, size) of lists with sets of several components: the largest one's label, and all sets."""
    return cut(named.groupBy("token", "label").agg(F.count("*").alias("c"))
               .groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("size"))
               .filter("k > 1").select("token", F.col("top.label").alias("top"), "size"))


def _neighbour_pairs(live: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, node, n): every set of a frequent token's mixed list, once, with the leader of a chunk of
    the longest such list. Their differences to the leader answer for all sets of the chunk, so a dense
    group of near copies is connected here, by as many comparisons as it has sets."""
    hot = live.filter("bucket < 0").select("token", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = hot.join(_mixed(hot), "token").groupBy("node", "n").agg(F.max(F.struct("size", "token")).alias("l"))
    dealt = cut(own.select("node", "n", F.col("l.token").alias("token"), F.expr(f"pmod(xxhash64(node), l.size div {CHUNK_SETS} + 1)").alias("chunk")))
    lead = cut(dealt.groupBy("token", "chunk").agg(F.min("node").alias("hub")))
    return dealt.join(lead, ["token", "chunk"]).filter("node <> hub").select("hub", "node", "n")


def _outside_pairs(live: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, hn, node, n): sets outside the largest component of a rare token's list, with the list's sets of
    other components, where they share enough prefix tokens in such lists and may share any number of frequent ones."""
    named = live.select("bucket", "token", "node", "n", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rare = named.filter("bucket >= 0").groupBy("bucket").applyInArrow(_bucket_outside, "hub binary, node binary, hn int, n int, shared long")
    return rare.groupBy("hub", "node", "hn", "n").agg(F.sum("shared").alias("shared")).filter(_enough("shared", "n", "hn"))


def _family_links(live: DataFrame, labels: DataFrame, docs: DataFrame, sig: DataFrame) -> DataFrame | None:
    """Links among sets that meet in frequent tokens' lists and still lie in several components.

    Sets of lists that overlap are a family: near copies of one text meet in many lists, and a join of the lists would
    make each pair once a list. Instead a family's sets are dealt into tiles by component (its largest one, or outside of
    it) and by size, and each tile of outsiders is compared whole with every tile of about its size, by differences to one
    of them: a row a set and pair of tiles, whatever the number of pairs.
    """
    hot = live.filter("bucket < 0").select("token", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hot = cut(hot.join(_mixed(hot).select("token"), "token"))
    if hot.isEmpty():
        return None
    # Nodes have 16 bytes, tokens 8: one kind of name for both.
    family = components(hot.select(F.col("node").alias("a"), F.unhex(F.lpad(F.hex("token"), 16, "0")).alias("b")))
    nodes = hot.select("node", "n", "label").distinct().join(family.select("node", F.col("label").alias("family")), "node")
    top = cut(nodes.groupBy("family", "label").agg(F.count("*").alias("c")).groupBy("family").agg(F.max(F.struct("c", "label")).alias("t")).select("family", F.col("t.label").alias("top")))
    # Linked sets differ in size by a factor of 5/4 at most, so their bands are next to each other.
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")
    placed = cut(nodes.join(top, "family").select("family", "node", "n", (F.col("label") != F.col("top")).alias("out"), band.alias("band")))
    tiles = cut(placed.groupBy("family", "out", "band").agg((F.expr(f"count(*) div {CHUNK_SETS} + sum(n) div {CHUNK_SHINGLES}") + 1).alias("parts")))
    number = F.xxhash64("family", "out", "band", "part")
    each = tiles.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select("family", "out", "band", number.alias("tile"))
    near = each.select("family", "out", F.col("tile").alias("other"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    meet = each.filter("out").select("family", "band", "tile").join(near.withColumnRenamed("out", "o"), ["family", "band"]).filter("not o or tile <= other")
    meet = cut(meet.select("tile", "other", F.xxhash64("tile", "other").alias("pair")))
    members = placed.join(tiles, ["family", "out", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", number.alias("tile"))
    sides = cut(meet.select("pair", "tile").union(meet.filter("tile <> other").select("pair", F.col("other").alias("tile"))))
    rows = cut(members.join(sides, "tile").select("pair", "node"))
    texts = _texts(docs, sig, rows.select("node"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_pylist()
        one = list({k: i for i, k in enumerate(nodes)}.values())
        data, off, _ = utf8_views(t.column("text").take(pa.array(one)))
        names = [nodes[i] for i in one]
        links = _answers(min(names), names, shingle_sets(np.frombuffer(data, np.uint8), off))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return rows.join(texts, "node").groupBy("pair").applyInArrow(run, "a binary, b binary")


def _close_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (hub, node, n, gap) whose parity sketches leave a link possible."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = [sketch_distance(x, y) for x, y in zip(b.column("s1").to_pylist(), b.column("s2").to_pylist())]
            out = b.drop_columns(["s1", "s2"]).append_column("gap", pa.array(gap, pa.int64()))
            yield out.filter(pc.less_equal(pc.multiply(out.column("gap"), 9), pc.add(out.column("hn"), out.column("n")).cast(pa.int64())))

    one = sketches.join(pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("s"))
    rows = (pairs.join(one.select(F.col("node").alias("hub"), F.col("s").alias("s1")), "hub")
            .join(one.select("node", F.col("s").alias("s2")), "node").select("hub", "hn", "node", "n", "s1", "s2"))
    return rows.mapInArrow(run, "hub binary, hn int, node binary, n int, gap long")


def _closest(pairs: DataFrame) -> DataFrame:
    """For every set of the pairs, the one with the partner that its sketch puts closest."""
    both = pairs.select("hub", "node", "n", "gap").union(pairs.select("node", "hub", "hn", "gap"))
    best = both.groupBy("node").agg(F.min_by(F.struct("hub", "n"), F.struct(F.col("gap") / F.col("n"), F.col("hub"))).alias("b"))
    return best.select("b.hub", "node", "b.n").withColumn("n", F.col("n").cast("int"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of labels (which stand for earlier links) and more links."""
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, label) of every row: the mark is a hash of its text, node the key of its
    set, label that of its component (both null for a set without shingles)."""
    spark = docs.sparkSession
    sig = cut(_signatures(docs))
    sketches = sig.filter("node is not null").select("node", "sketch")
    sig = sig.select("doc_id", "mark", "n", "node")
    total = sig.agg(F.sum("n")).first()[0] or 0
    spread = spark.sparkContext.broadcast(_frequent(docs, total))
    live = cut(_index(_postings(docs, max(16, total // 5 // BUCKET_POSTINGS), spread)))
    links = cut(_compare(_leader_pairs(live), docs, sig))
    labels = cut(components(links))
    labels = cut(_merge(labels, _compare(_neighbour_pairs(live, labels), docs, sig)))
    families = _family_links(live, labels, docs, sig)
    if families is not None:
        labels = cut(_merge(labels, cut(families)))
    close = cut(_close_pairs(cut(_outside_pairs(live, labels)), sketches))
    # First every set with its closest; most of the rest is connected then and need not be compared.
    labels = cut(_merge(labels, _compare(_closest(close), docs, sig)))
    apart = close.join(labels.select(F.col("node").alias("hub"), F.col("label").alias("l1")), "hub", "left").join(
        labels.select("node", F.col("label").alias("l2")), "node", "left").filter("l1 is null or l2 is null or l1 <> l2")
    merged = _merge(labels, _compare(apart.select("hub", "node", "n"), docs, sig))
    return sig.join(cut(merged), "node", "left").withColumn("label", F.coalesce("label", "node"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    named = _classes(marked(docs))
    named = cut(named)
    least = cut(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")))
    return (named.join(least, "label", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the least id (null ids last). Texts without
    words stay; repeated rows are one.

    Only documents that go or are there twice are looked for by a join; the others are not shuffled.
    """
    named = cut(_classes(marked(docs)))
    best = cut(named.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark")).alias("w")))
    rows = named.groupBy("doc_id", "mark", "label").agg(F.count("*").alias("c")).join(best, "label", "left")
    stays = F.col("label").isNull() | (F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("mark") == F.col("w.mark")))
    touched = cut(rows.withColumn("stays", stays).filter("c > 1 or not stays").select("doc_id", "mark", "stays"))
    near, far = split_ids(docs, touched)
    keyed = near.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__m": F.xxhash64("text")})
    gone = touched.filter("not stays").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__k"), F.col("mark").alias("__m")).distinct()
    left = keyed.join(gone, ["__k", "__m"], "left_anti").dropDuplicates(["__k", "__m"]).select(*docs.columns)
    return far.unionByName(left)


@register("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
