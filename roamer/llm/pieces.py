"""Op 6: sampled SentencePiece segmentations by forward filtering, backward sampling.

The lattice of a text has a node at every byte and an edge for every vocabulary piece (and byte
pieces for characters that the vocabulary lacks). Forward filtering sums path weights up to every
node; backward sampling draws, from the end, one incoming edge a node in proportion to its share of
the sum, so a whole segmentation is an exact draw from the distribution over all of them. The draw at
a byte depends on the seed, the row key and the byte's place alone: results do not depend on
partitioning, batches or retries.

No piece spans certain pairs of neighbouring bytes (a letter and a space, say), so the lattice falls
into independent units at those places. A unit's filtered lattice is kept once a worker, in flat
arrays, and all units of a batch take their backward steps together, vectorised. The cache is
cleared when it is full, so memory is bounded.

Piece weights: a unigram model's scores are log-probabilities; a merge model's are ranks, taken as a
Zipf law. ``alpha`` sharpens (above 1) or flattens (below 1) the distribution.

Defined results: null and empty texts have no pieces and decode to the empty text; rows with equal keys
draw alike; a null key is a key of its own; an empty table gives no rows; other columns are ignored.
Decoding is lossless for every text: the escape character itself is always written as bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import id_text, register, small_batches, table, utf8_views
from roamer.llm.shingles import mix64, prefix_hash, span_hash

ALPHA = 0.5
SEED = 20260
CACHE_UNITS = 1_000_000
CACHE_EDGES = 30_000_000
CACHED_BYTES = 64
ESCAPE = "▁"
#: Multiplies a piece's weight once a byte: no path's share changes, and short units stay in range.
_LIFT = 4.0


class Lattice:
    """Pieces of a model as bytes (with plain spaces), and the filtered lattices of units seen."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.piece: dict[bytes, int] = {}
        self.byte_piece = [-1] * 256
        scores = [sp.get_score(i) for i in range(n)]
        merges = min(scores) < -1000  # ranks, not log-probabilities
        self.log_weight = [0.0] * n
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                b = int(text[1:-1], 16)
                self.byte_piece[b], self.bytes_of[i] = i, bytes([b])
            else:
                self.bytes_of[i] = text.replace(ESCAPE, " ").encode()
                self.piece[self.bytes_of[i]] = i
            rank = -scores[i] if -1e6 < scores[i] <= 0 else float(n)
            self.log_weight[i] = alpha * (-math.log(rank + 2) if merges else scores[i])
        for b in self.byte_piece:
            if merges and b >= 0:
                self.log_weight[b] = -alpha * math.log(n)
        self.weight = [math.exp(w) * _LIFT ** len(t) for w, t in zip(self.log_weight, self.bytes_of)]
        self.longest = max(map(len, self.piece))
        spans = np.zeros(65536, bool)
        for t in self.piece:
            for x, y in zip(t, t[1:]):
                spans[x * 256 + y] = True
        self.spans = spans
        size = np.array([len(t) for t in self.bytes_of])
        self.weights = np.array(self.weight)
        order = [self.piece[t] for t in self.piece]
        joined = np.frombuffer(b"".join(self.piece), np.uint8)
        stop = np.cumsum(size[order])
        hashes = span_hash(prefix_hash(joined), stop - size[order], stop)
        by_hash = np.argsort(hashes)
        self.hashes, self.hashed = hashes[by_hash], np.array(order)[by_hash]
        self.lead = np.array([1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 0 for b in range(256)])
        self.size = size
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.cumsum(size) - size
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        # A unit's first node (it has a node a byte and one more), a node's first edge, an edge's running
        # share of its node's sum, and its piece. Capacity doubles; ``filled`` says how much is used.
        self.base, self.edge = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.int32)
        self.share, self.drawn = np.zeros(1 << 14, np.float32), np.zeros(1 << 14, np.int32)
        self.filled = [0, 0, 0]  # units, nodes, edges

    def _store(self, sizes: np.ndarray, degree: np.ndarray, share: np.ndarray, drawn: np.ndarray) -> None:
        """Append units of these sizes; ``degree`` has the edges of every node, first nodes have none."""
        u, n, e = self.filled
        for name, need in (("base", u + len(sizes)), ("edge", n + len(degree)), ("share", e + len(share)), ("drawn", e + len(share))):
            held = getattr(self, name)
            if need > len(held):
                grown = np.zeros(max(need, 2 * len(held)), held.dtype)
                grown[:len(held)] = held
                setattr(self, name, grown)
        self.base[u:u + len(sizes)] = n + np.cumsum(sizes + 1) - sizes - 1
        self.edge[n:n + len(degree)] = e + np.cumsum(degree) - degree
        self.share[e:e + len(share)], self.drawn[e:e + len(share)] = share, drawn
        self.filled = [u + len(sizes), n + len(degree), e + len(share)]

    def _edges(self, raw: np.ndarray, place: np.ndarray):
        """(end byte, piece) of every edge of units that lie end to end; ``place`` is a byte's number in
        its unit. An edge's end is the byte behind it, counted in ``raw``."""
        prefix, n = prefix_hash(raw), len(raw)
        ends, found, known = [], [], np.zeros(n, bool)
        for size in range(1, min(self.longest, int(place.max()) + 1) + 1):
            last = np.flatnonzero(place >= size - 1)
            first = last - size + 1
            h = span_hash(prefix, first, last + 1)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = (self.hashes[at] == h) & (self.size[self.hashed[at]] == size)
            first, last, p = first[hit], last[hit], self.hashed[at[hit]]
            if not len(p):
                continue
            k = np.arange(size)
            same = (raw[first[:, None] + k] == self.flat[self.first[p][:, None] + k]).all(1)
            first, last, p = first[same], last[same], p[same]
            ends.append(last)
            found.append(p)
            char = first[self.lead[raw[first]] == size]  # a whole character of the vocabulary
            for i in range(size if size <= 4 else 0):
                known[char + i] = True
        lone = np.flatnonzero(~known)
        ends.append(lone)
        found.append(np.asarray(self.byte_piece)[raw[lone]])
        return np.concatenate(ends), np.concatenate(found)

    def build(self, units: list[bytes]) -> None:
        """Filter new units of bounded size forward, all at once: byte by byte over all units."""
        sizes = np.array([len(u) for u in units])
        raw = np.frombuffer(b"".join(units), np.uint8)
        unit = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end, piece = self._edges(raw, place)
        order = np.lexsort((end, place[end]))
        end, piece = end[order], piece[order]
        node = end + unit[end] + 1  # a unit's nodes: one more than its bytes
        forward = np.zeros(len(raw) + len(units))
        forward[np.cumsum(sizes + 1) - sizes - 1] = 1
        part = np.empty(len(end))
        steps = np.searchsorted(place[end], np.arange(int(sizes.max()) + 1))
        for a, b in zip(steps[:-1], steps[1:]):
            if b > a:
                part[a:b] = forward[node[a:b] - self.size[piece[a:b]]] * self.weights[piece[a:b]]
                first = np.flatnonzero(np.concatenate([[True], node[a + 1:b] != node[a:b - 1]]))
                forward[node[a:b][first]] = np.add.reduceat(part[a:b], first)
        part /= forward[node]
        # Likely edges first: most draws end at the first comparison.
        order = np.lexsort((-part, node))
        node, piece, part = node[order], piece[order], part[order]
        run = np.cumsum(part)
        degree = np.bincount(node, minlength=len(forward))
        stop = np.cumsum(degree)
        run -= np.repeat(np.concatenate([[0], run])[stop - degree], degree)
        run[stop[degree > 0] - 1] = 1
        self._store(sizes, degree, run, piece)

    def add_long(self, unit: bytes) -> int:
        """A unit too long to keep, filtered in the log domain; its number."""
        raw = np.frombuffer(unit, np.uint8)
        end, piece = self._edges(raw, np.arange(len(raw)))
        order = np.argsort(end, kind="stable")
        end, piece = end[order].tolist(), piece[order].tolist()
        logs, degree, share, drawn, k = [0.0], [0], [], [], 0
        for i in range(len(unit)):
            here = []
            while k < len(end) and end[k] == i:
                here.append((logs[i + 1 - len(self.bytes_of[piece[k]])] + self.log_weight[piece[k]], piece[k]))
                k += 1
            here.sort(reverse=True)
            top = here[0][0]
            parts = [math.exp(x - top) for x, _ in here]
            total, run = sum(parts), 0.0
            logs.append(top + math.log(total))
            degree.append(len(here))
            for x, (_, p) in zip(parts, here):
                run += x / total
                share.append(run)
                drawn.append(p)
            share[-1] = 1.0
        self._store(np.array([len(unit)]), np.array(degree), np.array(share), np.array(drawn))
        return self.filled[0] - 1

    def units(self, raw: np.ndarray) -> np.ndarray:
        """Where units begin: between neighbouring bytes that no piece spans."""
        pair = raw[:-1].astype(np.int32) * 256 + raw[1:]
        return np.concatenate([[0], np.flatnonzero(~self.spans[pair]) + 1])

    def sample(self, texts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled piece ids of each text; ``keys`` are 64-bit row keys."""
        if len(self.index) > CACHE_UNITS or self.filled[2] > CACHE_EDGES:
            self.clear()
        at, start, owner, new, long_units = [], [], [], [], []
        index, held = self.index, self.filled[0]
        get = index.get
        for t, text in enumerate(texts):
            if not text:
                continue
            s = b" " + text
            cuts = self.units(np.frombuffer(s, np.uint8))
            ends = [*cuts[1:].tolist(), len(s)]
            for a, b in zip(cuts.tolist(), ends):
                u = s[a:b]
                k = get(u)
                if k is None:
                    if b - a > CACHED_BYTES:
                        long_units.append((len(at), u))
                        k = -1
                    else:
                        k = index[u] = held + len(new)
                        new.append(u)
                at.append(k)
            start.append(cuts)
            owner.append(np.full(len(cuts), t))
        if not at:
            return [np.empty(0, np.uint32) for _ in texts]
        if new:
            self.build(new)
        for i, u in long_units:
            at[i] = self.add_long(u)
        base, edge, share, drawn = self.base, self.edge, self.share, self.drawn
        at, start, owner = np.asarray(at), np.concatenate(start), np.concatenate(owner)
        stop = np.concatenate([start[1:], [0]])
        tail = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]]))
        stop[tail] = [len(texts[t]) + 1 for t in owner[tail].tolist()]
        size = stop - start
        live, place = np.arange(len(at)), size.copy()  # place: the node, as bytes into the unit
        steps = []
        while len(live):
            node = base[at[live]] + place[live]
            h = mix64(keys[owner[live]] + (start[live] + place[live]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
            e = edge[node]
            more = np.flatnonzero(u >= share[e])
            while len(more):
                e[more] += 1
                more = more[(u[more] >= share[e[more]]) & (share[e[more]] < 1)]
            p = drawn[e]
            steps.append((live, p))
            place[live] -= self.size[p]
            live = live[place[live] > 0]
        count = np.zeros(len(at), np.int64)
        for units, _ in steps:
            count[units] += 1
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for k, (units, p) in enumerate(steps):  # the last piece was drawn first
            out[first[units] + count[units] - 1 - k] = p
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        edges = np.concatenate([first, [len(out)]])
        return [out[edges[cuts[t]]:edges[cuts[t + 1]]] for t in range(len(texts))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids."""
        ids = np.asarray(ids, np.int64)
        n = self.size[ids]
        total = int(n.sum())
        if not total:
            return b""
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.first[ids] - begin, n) + np.arange(total)].tobytes()[1:]


@lru_cache(maxsize=2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix64(mix64(known + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)) ^ null)


def encode_sampled(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit integers."""
    return _run(docs, path, alpha, seed, lambda ids, text, lat: (ids.astype("<u4").tobytes(),), [("ids", "binary", pa.binary())])


def _run(docs, path, alpha, seed, result, fields) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, alpha)
        for big in batches:
            for batch in small_batches(big, "text", 1 << 20):
                data, off, _ = utf8_views(batch.column("text"))
                texts = [bytes(data[off[i]:off[i + 1]]) for i in range(batch.num_rows)]
                rows = [result(ids, t, lat) for ids, t in zip(lat.sample(texts, row_keys(batch.column("doc_id"), seed)), texts)]
                yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, (_, _, k) in zip(zip(*rows), fields)]],
                                      names=["doc_id", *[f for f, _, _ in fields]])

    return id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} {k}" for f, k, _ in fields))


def decode(encoded: DataFrame, path: str, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, text) of ``encode_sampled`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, alpha)
        for batch in batches:
            texts = [lat.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def sampled_digest(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 and whether the pieces decode to the text."""
    return _run(docs, path, alpha, seed, lambda ids, text, lat: (len(text), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lat.decode(ids) == text),
                [("n_bytes", "long", pa.int64()), ("n_pieces", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("lossless", "boolean", pa.bool_())])


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op6_sampled_pieces")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_digest(table(spark, sf_dir, "documents"), model_path())
