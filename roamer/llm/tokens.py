"""Token ids of whole texts with the tokenizers library, sped up by a bounded table of chunks.

White space never belongs to a token of a tokenizer whose pre-tokeniser drops it, so a text's ids
are the ids of its white-space separated chunks, one after the other. The chunks of some MB of text are
found, hashed and looked up together; every distinct chunk goes through the library once per worker.
The table holds hashes, bytes and ids in arrays (some 50 bytes a chunk) and is cleared when it is full, so
memory is bounded. Chunks that it finds are compared byte by byte; within one batch, chunks of equal
64-bit hash, length and byte sum are one.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

from roamer.llm.common import KEPT
from roamer.llm.shingles import _CODES, _LOWER, _SPACE, prefix_hash, span_hash

TABLE_ENTRIES = 1_500_000
KEPT_PARTS = 100_000
CACHED_BYTES = 64
#: Bytes of text that are worked on at once.
SEGMENT = 2 << 20

#: A chunk that is one run of Latin letters and then a run of marks: two pre-tokens, without the
#: characters that contractions, special tokens, digits and composition need.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stays, other bytes follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: 256 + i for i, b in enumerate(rest)}


class ChunkEncoder:
    """bytes -> ids; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        pre = json.dumps(spec.get("pre_tokenizer"))
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        # Chunks are independent where the pre-tokeniser removes white space.
        self.by_chunk = '"Removed"' in pre and "\\\\s" in pre
        # Plain Latin runs may go straight to the model where only case and composition are normalised.
        self.plain = self.by_chunk and set(norm) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in norm \
            and "ByteLevel" in pre and "[\\\\p{L}]+" in pre
        self.chars = _byte_chars()
        # Where case is dropped, chunks that differ by ASCII case have the same ids.
        self.codes = _LOWER if self.plain else _CODES
        self.fold = np.arange(256, dtype=np.uint8)
        if self.plain:
            self.fold[65:91] += 32
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[bytes, bytes] = {}
        self.keys = [np.empty(0, np.uint64), np.empty(0, np.uint64)]  # sorted: most entries, and those added of late
        self.rows = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ids, self.ends = _Growing(np.uint32), _Growing(np.int64)
        self.text, self.stops = _Growing(np.uint8), _Growing(np.int64)

    def _part(self, piece: bytes) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            if piece.isascii():
                word = piece.decode("ascii")
            else:
                word = piece.decode().lower().encode().decode("latin-1").translate(self.chars)
            if len(self.parts) >= KEPT_PARTS:
                self.parts.clear()
            got = self.parts[piece] = array("I", [t.id for t in self.lib.model.tokenize(word)]).tobytes()
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids (as bytes) of one chunk."""
        if self.plain and len(chunk) <= CACHED_BYTES and (m := _PLAIN.fullmatch(chunk)):
            letters, marks = m.groups()
            return self._part(letters.lower()) + (self._part(marks) if marks else b"")
        return array("I", self.lib.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The table's row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for known, rows in zip(self.keys, self.rows):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = rows[at[hit]]
        return out

    def _insert(self, keys: np.ndarray, rows: np.ndarray) -> None:
        for level, full in ((1, len(self.keys[0]) // 8 + 4096), (0, None)):
            k, r = np.concatenate([self.keys[level], keys]), np.concatenate([self.rows[level], rows])
            order = np.argsort(k)
            self.keys[level], self.rows[level] = k[order], r[order]
            if full is None or len(k) <= full:
                return
            keys, rows = self.keys[1], self.rows[1]
            self.keys[1], self.rows[1] = keys[:0], rows[:0]

    def _segment(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that lie between the offsets."""
        word = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
        after = np.concatenate([word[1:], [False]]) & ~edge[1:]
        start, stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        h = span_hash(prefix_hash(raw, self.codes), start, stop)
        folded = self.fold[raw]
        sums = np.concatenate([[0], np.cumsum(folded, dtype=np.int64)])
        sums = sums[stop] - sums[start]
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        if (sums[first[at]] != sums).any() or ((stop - start)[first[at]] != stop - start).any():
            return self._plainly(raw, offsets)
        if len(self.ends) + len(keys) > TABLE_ENTRIES:
            self._clear()
        rows = self._find(keys)
        a, n = start[first], (stop - start)[first]
        held = np.flatnonzero(rows >= 0)
        ends, stops, text = self.ends.view(), self.stops.view(), self.text.view()
        if len(held):
            begin = np.where(rows[held] > 0, stops[rows[held] - 1], 0)
            same = stops[rows[held]] - begin == n[held]
            ok = held[same]
            spread = lambda x, m: np.repeat(x - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            equal = text[spread(begin[same], n[ok])] == folded[spread(a[ok], n[ok])]
            if not (same.all() and equal.all()):  # a key of another chunk
                return self._plainly(raw, offsets)
        new = np.flatnonzero(rows < 0)
        if len(new):
            got = [self._chunk(raw[x:x + m].tobytes()) for x, m in zip(a[new].tolist(), n[new].tolist())]
            rows[new] = len(self.ends) + np.arange(len(new))
            self.ends.add(len(self.ids) + np.cumsum([len(g) // 4 for g in got]))
            self.ids.add(np.frombuffer(b"".join(got), np.uint32))
            self.stops.add(len(self.text) + np.cumsum(n[new]))
            self.text.add(np.concatenate([folded[x:x + m] for x, m in zip(a[new].tolist(), n[new].tolist())]))
            self._insert(keys[new], rows[new])
            ends = self.ends.view()
        begin = np.where(rows > 0, ends[rows - 1], 0)
        size = (ends[rows] - begin)[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids.view()[np.repeat(begin[at] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, offsets)])

    def _plainly(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_segment`` without the table."""
        got = [self.lib.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([np.asarray(g, np.uint32) for g in got]) if got else np.empty(0, np.uint32), np.array([len(g) for g in got], np.int64)

    def encode_many(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all texts, number of ids of each); texts lie between the offsets.

        A long text is worked on in parts cut at white space, so memory does not grow with it
        (a part is longer than ``SEGMENT`` only where one chunk is)."""
        if not self.by_chunk:
            return self._plainly(raw, offsets)
        ids, sizes, i, n = [], np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, side="right")) - 1)
            at, end = int(offsets[i]), int(offsets[j])
            if end - at <= SEGMENT:
                got, sizes[i:j] = self._segment(raw[at:end], offsets[i:j + 1] - at)
                ids.append(got)
            else:  # one long text
                while at < end:
                    to = min(at + SEGMENT, end)
                    while to < end and not _SPACE[raw[to]]:
                        gaps = np.flatnonzero(_SPACE[raw[to:min(to + SEGMENT, end)]])
                        to = to + int(gaps[0]) if len(gaps) else min(to + SEGMENT, end)
                    got, size = self._segment(raw[at:to], np.array([0, to - at]))
                    ids.append(got)
                    sizes[i] += size[0]
                    at = to
            i = j
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), sizes

    def encode(self, text: bytes) -> np.ndarray:
        """uint32 ids of one whole text."""
        return self.encode_many(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


class _Growing:
    """An array whose capacity doubles."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.data[:self.n]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process; Spark reuses its Python workers between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path)


KEPT["encoder"] = encoder.cache_clear


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
