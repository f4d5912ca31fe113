"""Op 1: best-fit packing of whole documents with swap-based local search.

Documents are tokenised where they lie; only piece lengths travel. Pieces of exactly the sequence
length are sequences by themselves. The others are dealt to groups of a bounded number of tokens and
pieces; each group is packed best-fit decreasing and then improved: the emptiest bin gives one or two
documents for none, one or two of another bin, each exchange raising the sum of squared fills, until
the bin is empty or no exchange helps; then the next. A group ends at its lower bound, or when every
underfull bin has been the victim since the last exchange. The emptiest bins of every group are opened again and packed together in a second round, so that rounding losses of the groups meet.

Defined results: null or empty text is the one id ``end_id``; repeated rows (same id, same text) are
packed as documents of their own; a null doc_id is carried through; ties are broken by the row's
place in the materialised piece table; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, give_back, id_text, register, small_batches, table, utf8_views
from roamer.llm.tokens import encoder, tokenizer_path

SEQUENCE_TOKENS = 4096
END_ID = 1
GROUP_BINS = 2048
GROUP_PIECES = 50_000
REOPENED_BINS = 16


def token_pieces(docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for big in batches:
            for batch in small_batches(big, "text"):
                data, off, _ = utf8_views(batch.column("text"))
                keys = batch.column("doc_id")
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                flat, sizes = enc.encode_many(np.frombuffer(data, np.uint8), off)
                for i, (a, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist())):
                    ids = np.append(flat[a:a + n], np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(ids), size)):
                        part = ids[at:at + size].tobytes()
                        row.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(part)
                cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(cols + ([pa.array(raw, pa.binary())] if with_ids else []), schema=schema)
        give_back("encoder")

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return id_text(docs).mapInArrow(run, ddl)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each length: longest first, each into the fullest bin it fits in.

    Open bins are kept by free space; a big integer's set bits say which free spaces exist.
    """
    bins = np.empty(len(lengths), np.int64)
    by_free: dict[int, list[int]] = {}
    present, n = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        want = int(lengths[i])
        above = present >> want
        if above:
            free = want + (above & -above).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                present &= ~(1 << free)
        else:
            free, b, n = size, n, n + 1
        left = free - want
        if left:
            by_free.setdefault(left, []).append(b)
            present |= 1 << left
        bins[i] = b
    return bins


class _Search:
    """Local search over the underfull bins of one group.

    ``sums[b]`` are 0 and the lengths that one or two pieces of bin ``b`` have together. For the bin that gives,
    the victim, bins at least as full are in ``room``: ``room[t, b]`` is the free space of bin ``b`` if it has the
    sum ``t``, else -1, and ``top[t]`` the most of any bin. Of emptier bins, ``below[s]`` counts the sums
    that end at ``s`` with the bin's free space added.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, size: int):
        self.len, self.bin, self.size = lengths, bins, size
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.squares: list[int] = []
        self.total = int((self.fill ** 2).sum())
        order = np.argsort(bins, kind="stable")
        cuts = np.searchsorted(bins[order], np.arange(len(self.fill) + 1))
        self.under = np.flatnonzero((self.fill > 0) & (self.fill < size))
        self.place = {b: i for i, b in enumerate(self.under.tolist())}
        self.items = {b: order[cuts[b]:cuts[b + 1]].tolist() for b in self.place}
        self.room = np.full((size, len(self.under)), -1, np.int32)
        self.has = np.zeros((size, len(self.under)), bool)
        self.top, self.below = np.full(size, -1, np.int64), np.zeros(size + 1, np.int64)
        self.side = np.zeros(len(self.under), np.int8)  # 0: nowhere, 1: in room, 2: in below
        self.sums = {b: self._sums(b) for b in self.place}
        for b, i in self.place.items():
            self.has[self.sums[b], i] = True

    def _sums(self, b: int) -> np.ndarray:
        if not self.items[b]:
            return np.zeros(1, np.int64)
        x, n = np.unique(self.len[self.items[b]], return_counts=True)
        i, j = np.triu_indices(len(x), 1)
        return np.unique(np.concatenate([[0], x, 2 * x[n > 1], x[i] + x[j]]))

    def _pieces(self, b: int, total: int) -> list[int]:
        """One or two pieces of ``b`` that have ``total`` together; none for 0."""
        seen: dict[int, int] = {}
        if not total:
            return []
        own = self.items[b]
        x = self.len[own].tolist()
        if total in x:
            return [own[x.index(total)]]
        for i, n in zip(own, x):
            if total - n in seen:
                return [seen[total - n], i]
            seen[n] = i
        raise AssertionError("no such sum")

    def _side(self, b: int, side: int) -> None:
        i, t, free = self.place[b], self.sums[b], int(self.size - self.fill[b])
        if self.side[i] == 1:
            self.room[t, i] = -1
            lost = t[self.top[t] == free]
            self.top[lost] = self.room[lost].max(axis=1)
        elif self.side[i] == 2:
            self.below[t + free] -= 1
        if side == 1 and free:
            self.room[t, i] = free
            self.top[t] = np.maximum(self.top[t], free)
        elif side == 2:
            self.below[t + free] += 1
        self.side[i] = side

    def _face(self, victim: int) -> None:
        """Put every bin on its side of ``victim``."""
        fill = self.fill[self.under]
        want = np.where((fill == 0) | (fill == self.size), 0, np.where(fill >= self.fill[victim], 1, 2))
        want[self.place[victim]] = 0
        for i in np.flatnonzero(want != self.side).tolist():
            self._side(int(self.under[i]), int(want[i]))

    def _swap(self, victim: int, give: int, other: int, take: int) -> None:
        """Pieces of sum ``give`` go to ``other``, pieces of sum ``take`` come back."""
        out, back = self._pieces(victim, give), self._pieces(other, take)
        self.total -= int(self.fill[victim]) ** 2 + int(self.fill[other]) ** 2
        self._side(other, 0)
        for b in (victim, other):
            self.has[self.sums[b], self.place[b]] = False
        self.items[victim] = [i for i in self.items[victim] if i not in out] + back
        self.items[other] = [i for i in self.items[other] if i not in back] + out
        self.bin[out], self.bin[back] = other, victim
        self.fill[victim] -= give - take
        self.fill[other] += give - take
        for b in (victim, other):
            self.sums[b] = self._sums(b) if self.fill[b] < self.size else np.zeros(1, np.int64)
            self.has[self.sums[b], self.place[b]] = True
        self.total += int(self.fill[victim]) ** 2 + int(self.fill[other]) ** 2
        self.squares.append(self.total)

    def _exchange(self, victim: int) -> int:
        """The exchange that shifts most tokens from ``victim`` into a bin at least as full, into the one it fills
        best; else one with an emptier bin that ends fuller than ``victim`` was. The partner, or -1."""
        self._face(victim)
        g, own = self.sums[victim][1:], int(self.size - self.fill[victim])
        # The least t that some bin has and that with its free space reaches g.
        t = np.searchsorted(np.maximum.accumulate(np.arange(self.size) + self.top), g)
        gain = np.where(t < g, g - t, 0)
        k = int(np.argmax(gain)) if len(gain) else -1
        if k >= 0 and gain[k] > 0:
            give, take, free = int(g[k]), int(t[k]), self.room[t[k]]
            fits = np.flatnonzero(free >= gain[k])
            other = int(self.under[fits[np.argmin(free[fits])]])
        else:
            upto = np.concatenate([[0], np.cumsum(self.below)])
            some = np.flatnonzero(upto[g + own] > upto[g])
            if not len(some):
                return -1
            give = int(g[some[0]])
            end = give + int(np.flatnonzero(self.below[give:give + own])[0])
            at = np.flatnonzero(self.side == 2)
            start = end - (self.size - self.fill[self.under[at]])
            i = int(np.flatnonzero((start >= 0) & self.has[start, at])[0])
            other, take = int(self.under[at[i]]), int(start[i])
        self._swap(victim, give, other, take)
        return other

    def run(self, steps: int | None = None) -> np.ndarray:
        """Empty bins until the count is the lower bound or no bin has an exchange that raises the sum of
        squared fills. Each exchange raises it, so the search ends; ``steps`` can bound the exchanges for trials."""
        need, used, done = -(-int(self.len.sum()) // self.size), np.count_nonzero(self.fill), 0
        tried, raised = np.zeros(len(self.under), bool), False
        while used > need and (steps is None or done < steps):
            fill = self.fill[self.under]
            open_bins = np.flatnonzero((fill > 0) & (fill < self.size) & ~tried)
            if not len(open_bins):
                if not raised:  # every bin has been a victim since the last change
                    break
                tried[:], raised = False, False
                continue
            at = int(open_bins[np.argmin(fill[open_bins])])
            victim, other = int(self.under[at]), 0
            while self.fill[victim] and other >= 0 and (steps is None or done < steps):
                other = self._exchange(victim)
                if other >= 0:
                    tried[self.place[other]], raised, done = False, True, done + 1
            if self.fill[victim]:
                tried[at] = True
            else:
                used -= 1
        return self.bin


def pack_lengths(lengths: np.ndarray, size: int = SEQUENCE_TOKENS, steps: int | None = None) -> np.ndarray:
    """Bin numbers (from 0, gapless) for one group of lengths, none over ``size``."""
    lengths = np.asarray(lengths, np.int64)
    bins = _Search(lengths, best_fit_decreasing(lengths, size), size).run(steps)
    return np.unique(bins, return_inverse=True)[1]


_PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, " \
          "offset long, open boolean"


def _pack_groups(pieces: DataFrame, groups: int, level: int, size: int, reopened: int) -> DataFrame:
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        give_back()
        g = g.sort_values("row", kind="stable").reset_index(drop=True)
        g["bin"] = pack_lengths(g["length"].to_numpy(), size)
        g = g.sort_values(["bin", "row"], kind="stable")
        ends = g.groupby("bin")["length"].cumsum()
        g["offset"] = ends - g["length"]
        fill = g.groupby("bin")["length"].transform("sum")
        g["sequence_id"] = (level << 56) + (int(key[0]) << 24) + g["bin"]
        under = g.loc[fill < size, ["bin"]].assign(fill=fill).drop_duplicates().sort_values(["fill", "bin"])
        g["open"] = g["bin"].isin(set(under["bin"].head(reopened)))
        return g[["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]]

    keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
    return keyed.groupBy("grp").applyInPandas(run, _PACKED)


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                   group_bins: int = GROUP_BINS, group_pieces: int = GROUP_PIECES,
                   reopened: int = REOPENED_BINS) -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(token_pieces(docs, path, size, end_id)).withColumn("row", F.monotonically_increasing_id())
    full = F.col("length") == size
    s = pieces.agg(F.sum(F.when(~full, F.col("length"))).alias("t"), F.count(F.when(~full, 1)).alias("n")).first()
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.filter(full).withColumns({"sequence_id": F.lit(1 << 62) + F.col("row"), "offset": F.lit(0).cast("long")})
    if not s["n"]:
        return whole.select(out)
    groups = max(-(-s["t"] // (group_bins * size)), -(-s["n"] // group_pieces))
    first = _pack_groups(pieces.filter(~full), groups, 0, size, reopened if groups > 1 else 0)
    if groups == 1:
        return whole.select(out).unionByName(first.select(out))
    first = cut(first)
    again = max(1, -(-groups * reopened // group_bins))
    second = _pack_groups(first.filter("open").drop("sequence_id", "offset", "open"), again, 1, size, 0)
    return whole.select(out).unionByName(first.filter(~F.col("open")).select(out)).unionByName(second.select(out))


def sequences(docs: DataFrame, packed: DataFrame, path: str, size: int = SEQUENCE_TOKENS,
              end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids): at most ``size`` ids a group.

    Pieces find their place by (doc_id, piece, ids_crc32); needs doc_ids that are unique and not null.
    """
    ids = token_pieces(docs, path, size, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    return (packed.join(ids, ["doc_id", "piece", "ids_crc32"])
            .groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids")))


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
