"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes when it is covered by a string of SPAN bytes that also starts in a document with a smaller
id. All suffixes of all documents would be far too many to sort at once, so they are dealt to buckets by
content: each start of a SPAN-byte string has an anchor, the GRAM in the string with the smallest hash,
and equal strings have equal anchors at equal places. Consecutive starts with one anchor are a segment,
which travels as one row of bytes.

1. Texts are dealt to buckets of documents, which all later steps read from that one exchange, and cut to
   segments. One that equals, byte by byte, one of a smaller document of its bucket is wholly covered. The
   anchors of the others are counted over all buckets, and each bucket learns which of its own stand in another
   document too: only their segments travel. An anchor with very many segments is split: there each start
   travels alone, to the bucket of its whole string.
2. A bucket of anchors is sorted block by block. Segments that are equal byte by byte count as one; the suffixes
   of the rest are sorted one bucket (anchor, offset) at a time. Sample positions after a difference cover get
   ranks by the DEPTH bytes that follow, by doubling; a bucket is then sorted by the bytes before the next sample
   position, ties by its rank, and the few bytes that are left. Suffixes that are equal over SPAN bytes are a
   run, whose least id owns it: hashes only deal rows out, and every removal rests on compared bytes.
3. Covered ranges meet their texts, are joined and taken out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a string, of an anchor, and starts that share an anchor at most.
SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: Difference cover modulo PERIOD: any two residues have a common shift under PERIOD into it.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: Bytes that a cover rank stands for (two doublings of 8).
DEPTH = 32
#: Width of a segment's row: the anchor starts at WINDOW - 1, so that starts of equal strings have equal residues.
ROW = 96
#: Text bytes behind one bucket of anchors, and of one bucket of documents.
ANCHOR_BYTES, DOC_BYTES = 16_000_000, 12_000_000
#: Rows that are sorted at once (an anchor's rows stay together), and rows beyond which an anchor is split.
BLOCK_ROWS, HOT_ROWS = 20_000, 20_000

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
#: Bits of an anchor's hash, and of a gram's place in a chunk.
_H, _LOW = _U((1 << 48) - 1), _U((1 << 20) - 1)
#: Starts in a piece of a long text, and bytes of a chunk of pieces, whose places fit the bits of _LOW.
_PIECE, _CHUNK = 1 << 19, 1 << 20
#: Shift from each residue to the cover.
_SHIFT = [next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k, m = 1, x
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = w - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor (48 bits), digest, first start, last start and anchor's place of each segment of a text."""
    return _segments([b.tobytes()])[1:]


def _segments(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of the text, then the columns of ``segments``, of many texts of SPAN bytes and more."""
    out, chunk, size = [], [], 0
    for i, body in enumerate(bodies):
        for base in range(0, len(body) - SPAN + 1, _PIECE):
            piece = body[base : base + _PIECE + SPAN - 1] if len(body) > _PIECE else body
            if size + len(piece) > _CHUNK:
                out.append(_of_chunk(chunk))
                chunk, size = [], 0
            chunk.append((i, base, piece))
            size += len(piece)
    if chunk:
        out.append(_of_chunk(chunk))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))


def _of_chunk(chunk: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(c[2] for c in chunk), dtype=np.uint8)
    size = np.array([len(c[2]) for c in chunk])
    ahead = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(chunk)), size)[: len(b) - SPAN + 1]
    valid = np.arange(len(piece)) - ahead[piece] <= size[piece] - SPAN  # the string ends in its own text
    h, power, k = b.astype(np.uint64) + _U(1), _P, 1
    with np.errstate(over="ignore"):
        while k < GRAM:
            h = h[:-k] * power + h[k:]
            power, k = power * power, 2 * k
        wide = _mix(h[:-GRAM] * power + h[GRAM:])  # hashes of 2 * GRAM bytes
        gram = _mix(h)
        key = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)  # of equal hashes the leftmost
        low = _sliding_min(key, WINDOW)
        change = low[1:] != low[:-1]
        first = np.flatnonzero(valid & np.concatenate(([True], change | ~valid[:-1])))
        last = np.flatnonzero(valid & np.concatenate((change | ~valid[1:], [True])))
        place = (low[first] & _LOW).astype(np.int64)
        gap = SPAN - 2 * GRAM
        digest = wide[first]
        for more in (wide[first + gap], wide[last], wide[last + gap], (last - first).astype(np.uint64) * _U(64) + (place - first).astype(np.uint64)):
            digest = _mix(digest * _P + more)
    at = piece[first]
    shift = np.array([c[1] for c in chunk])[at] - ahead[at]
    return np.array([c[0] for c in chunk])[at], gram[place] & _H, digest, first + shift, last + shift, place + shift


def _words_of(body: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as integers."""
    return np.ndarray(shape=(len(body) - 7,), dtype="<u8", buffer=body, strides=(1,))


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (8 or more) at the places a and b are equal."""
    out = np.ones(len(a), dtype=bool)
    for k in range(0, int(size.max(initial=0)), 8):
        step = np.minimum(k, size - 8)
        out &= words[a + step] == words[b + step]
    return out


def _string_hash(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48 bits of a hash of the SPAN bytes at each place."""
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in (*range(0, SPAN - 8, 8), SPAN - 8):
            h = _mix(h * _P + words[at + k])
    return h & _H


def _pack(body: bytes, *columns: np.ndarray) -> bytes:
    """Integer columns, of which the first is packed by its differences, and bytes: byte planes, then zstandard."""
    import zstandard

    out = [len(columns[0]).to_bytes(8, "little")]
    for i, c in enumerate(columns):
        c = c.astype(np.int64)
        if i == 0:
            c = np.diff(c, prepend=0)
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join((*out, body)))


def _unpack(blob: bytes, n_columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns, and the bytes behind them."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8, count=8 * n * n_columns).reshape(n_columns, 8, n)
    out = [np.ascontiguousarray(p.T).view(np.int64).reshape(-1) for p in planes]
    out[0] = np.cumsum(out[0])
    return out, np.frombuffer(raw, dtype=np.uint8, offset=8 + 8 * n * n_columns)


def _deal(keys: np.ndarray, *columns: np.ndarray):
    """(key, columns of its rows) for each key, in order; rows keep their order."""
    if not len(keys):
        return
    by = np.argsort(keys, kind="stable")
    keys, columns = keys[by], [c[by] for c in columns]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    for s, e in zip(edge, np.append(edge[1:], len(keys)), strict=True):
        yield int(keys[s]), [c[s:e] for c in columns]


def _ahead(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of the given sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _bucket(ids: np.ndarray, copies: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(ids.astype(np.uint64) * _P + copies.astype(np.uint64)) % _U(n)).astype(np.int64)


def _leads(same: np.ndarray) -> np.ndarray:
    """The place of the first row of each run, where same[i] says that row i goes on the run of row i - 1."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


def _joined(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranges in order, those of a document that touch as one; ends must rise with starts."""
    by = np.lexsort((start, copy, doc))
    doc, copy, start, end = doc[by], copy[by], start[by], end[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return [doc[at], copy[at], start[at], end[np.append(at[1:], len(end))[: len(at)] - 1]]


BLOBS = "key long, blob binary"
#: What a bucket of documents learns about its anchors: alone in one document, in several, in very many rows.
ALONE, SHARED, HOT = 0, 1, 2


def _squeeze(n_doc: int):
    """Texts, compressed, with their bucket of documents; what is too short to hold a string is left out."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("z", pa.binary())])
        for b in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if len(r[2]) >= SPAN]
            ids, copies = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(ids, copies, n_doc)), pa.array(ids), pa.array(copies), pa.array([z.compress(r[2]) for r in rows], pa.binary())], schema=schema)

    return run


class Bucket:
    """The segments of a bucket of documents, in order of anchor, content and id; those that the bucket itself settles are marked.

    The order rests on the texts alone, not on the order in which they arrive.
    """

    def __init__(self, texts: pd.DataFrame):
        import zstandard

        z = zstandard.ZstdDecompressor()
        rows = sorted(zip(texts["doc"], texts["copy"], texts["z"], strict=True), key=lambda r: r[:2])
        self.ids, self.copies = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
        bodies = [z.decompress(r[2]) for r in rows]
        size = np.array([len(b) for b in bodies])
        self.base = np.cumsum(size) - size
        which, h, g, first, last, place = _segments(bodies)
        self.text = b"".join(bodies)
        self._order(which, h.astype(np.int64), g, first, last, place)

    def _order(self, which, h, g, first, last, place):
        d = self.ids[which]
        by = np.lexsort((which, d, g, h))
        which, h, g, first, last, place, d = (x[by] for x in (which, h, g, first, last, place, d))
        again = np.zeros(len(h), dtype=bool)
        if len(h):
            long, ahead = last - first, place - first
            again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (long[1:] == long[:-1]) & (ahead[1:] == ahead[:-1])
        lead = _leads(again)
        at = np.flatnonzero(again & (d > d[lead]))  # only larger ids are settled
        of, there = lead[at], first + self.base[which]
        self.settled = np.zeros(len(h), dtype=bool)
        if len(at):
            self.settled[at[_same(_words_of(self.text), there[at], there[of], (last - first)[at] + SPAN)]] = True
        self.which, self.h, self.g, self.first, self.last, self.place = which, h, g, first, last, place

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of what is not settled, in order, with their rows, and whether those are of several documents."""
        open_ = ~self.settled
        h, d = self.h[open_], self.ids[self.which[open_]]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
        several = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at) if len(h) else np.empty(0, dtype=bool)
        return h[at], np.diff(np.append(at, len(h))), several

    def split(self, hot: np.ndarray) -> None:
        """Each start of the segments of hot anchors becomes a row of its own, under the hash of its string."""
        if not len(hot):
            return
        these = np.isin(self.h, hot)
        n = (self.last - self.first + 1)[these]
        start, alone = np.repeat(self.first[these], n) + _ahead(n), np.repeat(self.which[these], n)
        strings = _string_hash(_words_of(self.text), start + self.base[alone])
        more = (alone, strings.astype(np.int64), strings, start, start, np.repeat(self.place[these], n))
        mine = (self.which, self.h, self.g, self.first, self.last, self.place)
        self._order(*(np.concatenate((x[~these], y)) for x, y in zip(mine, more, strict=True)))

    def ranges(self) -> list[np.ndarray]:
        """doc, copy, start, end of what is settled here."""
        i = self.settled
        return _joined(self.ids[self.which[i]], self.copies[self.which[i]], self.first[i], self.last[i] + SPAN)

    def rows(self, wanted: np.ndarray, n_anchor: int):
        """(bucket of anchors, packed rows) of the rows to ship."""
        letters = np.frombuffer(self.text, dtype=np.uint8)
        rest = np.flatnonzero(wanted)
        for k, (i,) in _deal(self.h[rest] % n_anchor, rest):
            which, first, long = self.which[i], self.first[i], (self.last - self.first)[i]
            body = letters[np.repeat(first + self.base[which], long + SPAN) + _ahead(long + SPAN)].tobytes()
            yield k, _pack(body, self.h[i], self.ids[which], self.copies[which], first, long, (self.place - self.first)[i])


def _ask(n_anchor: int):
    """The anchors of a bucket of documents, packed by bucket of anchors."""

    def run(texts: pd.DataFrame) -> pd.DataFrame:
        h, n, several = Bucket(texts).anchors()
        src = int(texts["key"].iloc[0])
        return pd.DataFrame([(k, src, _pack(b"", *c)) for k, c in _deal(h % n_anchor, h, n, several)], columns=["key", "src", "blob"])

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """For each bucket of documents that asked, what its anchors are, in its own order."""
    import zstandard

    parts = [_unpack(x, 3)[0] for x in rows["blob"]]
    h, n, several = (np.concatenate([p[i] for p in parts]) for i in range(3))
    which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    by = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    asked = np.diff(np.append(at, len(h)))
    state = np.where((asked > 1) | (np.maximum.reduceat(several[by], at) > 0), np.where(np.add.reduceat(n[by], at) > HOT_ROWS, HOT, SHARED), ALONE).astype(np.uint8)
    out = np.empty(len(h), dtype=np.uint8)
    out[by] = np.repeat(state, asked)
    z, edge = zstandard.ZstdCompressor(level=1), np.searchsorted(which, np.arange(len(parts) + 1))
    return pd.DataFrame({"key": rows["src"], "part": rows["key"], "blob": [z.compress(out[s:e].tobytes()) for s, e in zip(edge, edge[1:], strict=False)]})


def _ship(n_anchor: int):
    """The rows of a bucket of documents whose anchors are shared, by bucket of anchors, and what it settles itself (key from n_anchor on)."""

    def run(key, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        out = []
        if len(texts):
            z = zstandard.ZstdDecompressor()
            bucket = Bucket(texts)
            answers = {k: np.frombuffer(z.decompress(x), dtype=np.uint8) for k, x in zip(told["part"], told["blob"], strict=True)}
            known, state = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint8)]
            for k, (h,) in _deal((h := bucket.anchors()[0]) % n_anchor, h):
                known.append(h)
                state.append(answers[k])
            known, state = np.concatenate(known), np.concatenate(state)
            alone = known[state == ALONE]
            bucket.split(known[state == HOT])
            out = list(bucket.rows(~bucket.settled & ~np.isin(bucket.h, alone), n_anchor))
            ranges = bucket.ranges()
            if len(ranges[0]):
                out.append((n_anchor + int(key[0]), _pack(b"", *ranges)))
            del bucket
            common.tidy()
        return pd.DataFrame(out, columns=["key", "blob"])

    return run


def _unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Heads (anchor, doc, copy, first, last, place) and rows of ROW bytes with the anchor at WINDOW - 1."""
    (h, d, c, first, long, place), body = _unpack(blob, 6)
    size = long + SPAN
    out = np.zeros((len(h), ROW), dtype=np.uint8)
    out[np.repeat(np.arange(len(h)), size), np.repeat(WINDOW - 1 - place, size) + _ahead(size)] = body
    return np.stack([h, d, c, first, first + long, first + place], axis=1), out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, equal ones alike."""
    by = np.lexsort(keys[::-1])
    step = np.zeros(len(by), dtype=bool)
    for k in keys:
        k = k[by]
        step[1:] |= k[1:] != k[:-1]
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.cumsum(step)
    return out


class CoverRanks:
    """Ranks of the sample positions of rows of text by the DEPTH bytes that follow, for positions that a suffix can ask for."""

    def __init__(self, rows: np.ndarray):
        n, most = len(rows), WINDOW + PERIOD - 2  # the last position that a shift from a start can reach
        sampled = [c for c in range(most + PERIOD + 1) if c % PERIOD in COVER]
        self.columns = [c for c in sampled if c <= most]
        self.at = {c: i for i, c in enumerate(sampled)}
        half = _dense(*(np.stack([_word(rows, c + k) for c in sampled], axis=1).ravel() for k in (0, 8))).reshape(n, -1)
        after = np.stack([half[:, self.at[c + PERIOD]] for c in self.columns], axis=1)
        self.rank = _dense(half[:, [self.at[c] for c in self.columns]].ravel(), after.ravel()).reshape(n, -1)


def _word(rows: np.ndarray, c: int) -> np.ndarray:
    """The 8 bytes from column c on, as integers in the order of the bytes."""
    return np.ascontiguousarray(rows[:, c : c + 8]).view(">u8").reshape(-1).astype(np.uint64)


def sorted_out(head: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts) of the suffixes whose SPAN bytes a smaller document of the same anchor has too.

    One bucket at a time: the suffixes at one offset from their anchors. Within it the anchor, the bytes up to
    the next sample position, its rank and the last bytes decide; equal ones form a run, whose least id owns them.
    """
    anchor, doc, _, first, last, place = head.T
    cover = CoverRanks(text)
    rows, starts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for c in range(WINDOW):
        start = place - (WINDOW - 1 - c)
        here = np.flatnonzero((start >= first) & (start <= last))
        if len(here) < 2:
            continue
        d = _SHIFT[c % PERIOD]
        before = [x for x in (0, 8) if x < d]
        behind = [x for x in (DEPTH, SPAN - 16) if d + DEPTH < x + 8 and (x >= SPAN - 16 or d + DEPTH < SPAN - 16)] + [SPAN - 8]
        keys = [anchor[here], *(_word(text, c + x)[here] for x in before), cover.rank[here, cover.at[c + d]], *(_word(text, c + x)[here] for x in behind)]
        by = np.lexsort([doc[here], *keys[::-1]])
        same = np.ones(len(by), dtype=bool)
        same[0] = False
        for k in keys:
            k = k[by]
            same[1:] &= k[1:] == k[:-1]
        ids = doc[here][by]
        mine = here[by[ids > ids[_leads(same)]]]
        rows.append(mine)
        starts.append(start[mine])
    return np.concatenate(rows), np.concatenate(starts)


def covered(head: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """doc, copy, start, end of the covered ranges of the rows of one bucket of anchors."""
    by = np.lexsort((head[:, 1], head[:, 0]))
    head, text = head[by], text[by]
    at = np.flatnonzero(np.concatenate(([True], head[1:, 0] != head[:-1, 0])))
    end = np.append(at[1:], len(head))
    several = np.flatnonzero(head[at, 1] < head[end - 1, 1])  # anchors of two documents and more
    out, block, size = [], [], 0
    for a in several.tolist():
        block.append(np.arange(at[a], end[a]))
        size += end[a] - at[a]
        if size >= BLOCK_ROWS or a == several[-1]:
            i = np.concatenate(block)
            out.append(_of_block(head[i], text[i]))
            block, size = [], 0
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 4


def _of_block(head: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    mixed = np.zeros(len(head), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(0, ROW, 8):
            mixed = _mix(mixed * _P + _word(text, c))
    by = np.lexsort((head[:, 1], mixed, head[:, 0]))
    head, text, mixed = head[by], text[by], mixed[by]
    anchor, doc, copy, first, last, place = head.T
    same = np.zeros(len(head), dtype=bool)
    same[1:] = (mixed[1:] == mixed[:-1]) & (anchor[1:] == anchor[:-1])
    lead = _leads(same)
    at = np.flatnonzero(doc > doc[lead])
    of = lead[at]
    at = at[(text[at] == text[of]).all(1) & ((last - first)[at] == (last - first)[of]) & ((place - first)[at] == (place - first)[of])]
    rest = np.ones(len(head), dtype=bool)
    rest[at] = False
    rest = np.flatnonzero(rest)
    edge = np.flatnonzero(np.concatenate(([True], anchor[rest][1:] != anchor[rest][:-1])))
    n = np.diff(np.append(edge, len(rest)))
    rest = rest[np.repeat(np.minimum.reduceat(doc[rest], edge) < np.maximum.reduceat(doc[rest], edge), n)] if len(rest) else rest
    i, start = sorted_out(head[rest], text[rest]) if len(rest) else (np.empty(0, dtype=np.int64),) * 2
    i = rest[i]
    return _joined(np.concatenate((doc[at], doc[i])), np.concatenate((copy[at], copy[i])), np.concatenate((first[at], start)), np.concatenate((last[at] + SPAN, start + SPAN)))


def _meet(n_anchor: int, n_doc: int):
    """The covered ranges of a bucket of anchors, packed by bucket of documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = int(rows["key"].iloc[0])
        if key >= n_anchor:
            return pd.DataFrame({"key": key - n_anchor, "blob": rows["blob"]})
        parts = [_unpack_rows(x) for x in rows["blob"]]
        head, text = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        del parts
        got = covered(head, text)
        del head, text
        common.tidy()
        return pd.DataFrame([(k, _pack(b"", *c)) for k, c in _deal(_bucket(got[0], got[1], n_doc), *got)], columns=["key", "blob"])

    return run


def cut_out(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    depth = np.zeros(len(b) + 1, dtype=np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    return int(gone.sum()), runs, b[~gone].tobytes()


def _remove(key, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    out = []
    if len(texts) and len(found):
        cols = [_unpack(x, 4)[0] for x in found["blob"]]
        d, c, s, e = (np.concatenate([x[i] for x in cols]) for i in range(4))
        by = np.lexsort((c, d))
        d, c, s, e = d[by], c[by], s[by], e[by]
        edge = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]))))
        where = {(int(d[lo]), int(c[lo])): (lo, hi) for lo, hi in zip(edge, np.append(edge[1:], len(d)), strict=True)}
        z = zstandard.ZstdDecompressor()
        for doc, copy, blob in zip(texts["doc"], texts["copy"], texts["z"], strict=True):
            if (at := where.get((doc, copy))) is None:
                continue
            raw = z.decompress(blob)
            n, runs, left = cut_out(np.frombuffer(raw, dtype=np.uint8), s[slice(*at)], e[slice(*at)])
            out.append((int(doc), hashlib.sha256(raw).hexdigest(), n, runs, hashlib.sha256(left).hexdigest(), left))
    return pd.DataFrame(out, columns=["doc", "was", "n_removed", "n_spans", "kept_sha256", "kept"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, was (SHA-256 of the text), n_removed, n_spans, kept_sha256, kept (bytes), for the documents that lose bytes.

    Null texts are empty; rows without an id take no part (nor do texts under SPAN bytes, which hold no
    string). Rows that repeat with their id and text are one document; the texts of an id that repeats with
    several are documents of their own, none of which covers another, as none has the smaller id.
    """
    df = common.ids_and_bytes(docs, id_col, text_col).where("id is not null")
    several = not df.groupBy("id").count().where("count > 1").isEmpty()
    df = df.select("id", (F.xxhash64("body") if several else F.lit(0).cast("long")).alias("copy"), "body")
    if several:
        df = df.dropDuplicates(["id", "copy"])
    total = df.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_anchor, n_doc = 64 + total // ANCHOR_BYTES, 64 + total // DOC_BYTES
    texts = df.mapInArrow(_squeeze(n_doc), "key long, doc long, copy long, z binary").groupBy("key")
    asked = texts.applyInPandas(_ask(n_anchor), "key long, src long, blob binary")
    told = asked.groupBy("key").applyInPandas(_answer, "key long, part long, blob binary")
    found = texts.cogroup(told.groupBy("key")).applyInPandas(_ship(n_anchor), BLOBS).groupBy("key").applyInPandas(_meet(n_anchor, n_doc), BLOBS)
    return texts.cogroup(found.groupBy("key")).applyInPandas(_remove, "doc long, was string, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (see ``removals`` for the odd cases)."""
    hit = removals(docs).select(F.col("doc").alias("d"), "was", "n_removed", "n_spans", "kept_sha256")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return base.join(hit, (base["doc_id"] == hit["d"]) & (base["sha"] == hit["was"]), "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))


SQL = f"""
with t as (select doc_id, coalesce(encode(text), ''::blob) as b from documents),
s as (select doc_id, p, b[p + 1:p + {SPAN}] as g from (select doc_id, b, unnest(range(0, octet_length(b) - {SPAN - 1})) as p from t)),
o as (select g, min(doc_id) as owner from s group by 1 having min(doc_id) < max(doc_id)),
h as (select distinct doc_id, p from s join o using (g) where owner < doc_id),
n as (select *, p > lag(p) over w + {SPAN} or lag(p) over w is null as new from h window w as (partition by doc_id order by p)),
r as (select doc_id, min(p) as s, max(p) + {SPAN} as e from (select *, count(*) filter (where new) over (partition by doc_id order by p) as k from n) group by doc_id, k),
c as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as prior, lead(s) over (partition by doc_id order by s) is null as final from r),
k as (
  select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans,
    string_agg(hex(b[prior + 1:s]) || case when final then hex(b[e + 1:]) else '' end, '' order by s) as kept
  from c join t using (doc_id) group by doc_id
)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(case when kept is null then b else unhex(kept) end) as kept_sha256
from t left join k using (doc_id)
"""
