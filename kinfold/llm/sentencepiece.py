"""SentencePiece encoding by batched Viterbi in numpy, and decoding.

The best-scoring split of a text into pieces is searched unit by unit (a run of space marks and
what follows). Units of equal length advance together: hashes of all substrings up to the longest
piece probe the sorted piece keys, and for each end position one vectorised maximum over the start
positions stores the backpointer. Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, piece_model
from .piece_model import SPACE
from .token_counts import cut

#: What an unknown character scores below the worst piece, as the public library has it.
UNKNOWN_PENALTY = 10.0
#: Units kept in a worker's memory, and characters of one numpy block.
CACHE_UNITS, BLOCK_CHARS = 400_000, 60_000
#: Bytes of text whose units are looked up at once.
SLICE_BYTES = 4_000_000

_BASE, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) + _BASE)


def zipf(pieces: piece_model.Pieces) -> list[float]:
    """Log-probabilities by Zipf's law from the places of the scores, for tables whose scores are merge ranks."""
    place = {s: i for i, s in enumerate(sorted({pieces.scores[i] for i in pieces.normal}, reverse=True))}
    return [-math.log(place.get(s, 0) + 2.0) for s in pieces.scores]


class Encoder:
    """Viterbi over one piece table; ``scores`` by id (default: the Zipf scores)."""

    def __init__(self, pieces: piece_model.Pieces, scores: list[float] | None = None, cache: int = CACHE_UNITS):
        self.pieces = pieces
        scores = zipf(pieces) if scores is None else scores
        strings = [pieces.strings[i] for i in pieces.normal]
        self.widest = max(map(len, strings), default=1)
        self.powers = np.empty(self.widest + 1, dtype=np.uint64)
        self.powers[0] = 1
        with np.errstate(over="ignore"):
            for i in range(self.widest):
                self.powers[i + 1] = self.powers[i] * _BASE
        keys = np.array([self._key(s) for s in strings], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(pieces.normal, dtype=np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, dtype=bool)  # most probes end here, before the binary search
        self.maybe[self.keys & _LOW] = True
        self.scores = np.array([scores[i] for i in self.ids], dtype=np.float64)
        self.unknown = float(self.scores.min(initial=0.0)) - UNKNOWN_PENALTY
        self.joined = frozenset(a + b for w in strings for a, b in zip(w, w[1:], strict=False))
        self.cache_size = cache
        self.cache: dict[str, bytes] = {}
        self.plain = [b"" if i == pieces.unk else s.replace(SPACE, " ").encode() for i, s in enumerate(pieces.strings)]
        for b, i in enumerate(pieces.byte_ids):
            if i != pieces.unk:
                self.plain[i] = bytes([b])

    def _key(self, s: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in _letters(np.array([ord(c) for c in s], dtype=np.uint64)):
                h = h * _BASE + x
            return int(_mix(np.array([h + np.uint64(len(s))], dtype=np.uint64))[0])

    def segments(self, unit: str) -> list[str]:
        """Parts that no piece can cross: between them stand two characters that are neighbours in no piece."""
        out, start, joined = [], 0, self.joined
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in joined:
                out.append(unit[start:i])
                start = i
        out.append(unit[start:])
        return out

    def best(self, words: list[str]) -> list[bytes]:
        """The ids (int32) of each word's best split."""
        by: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            n = len(w)
            by.setdefault(n if n <= 64 else 1 << (n - 1).bit_length(), []).append(at)
        out: list[bytes] = [b""] * len(words)
        for n, places in by.items():
            step = max(1, BLOCK_CHARS // n)
            for k in range(0, len(places), step):
                part = places[k : k + step]
                for at, ids in zip(part, self._block([words[i] for i in part], n), strict=True):
                    out[at] = ids
        return out

    def _block(self, words: list[str], n: int) -> list[bytes]:
        """Words of n characters (longer ones: of up to n, padded) advance together."""
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(w if len(w) == n else w.ljust(n, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
        rows, wide = len(words), min(self.widest, n)
        hashes = np.zeros((rows, n + 1), dtype=np.uint64)
        letters = _letters(codes)
        for j in range(n):
            hashes[:, j + 1] = hashes[:, j] * _BASE + letters[:, j]
        # piece[:, j, r] ends at j and has wide - r characters, so that starts rise with r
        piece = np.full((rows, n + 1, wide), -1, dtype=np.int32)
        gain = np.full((rows, n + 1, wide), -np.inf)
        for w in range(1, wide + 1):
            probe = _mix(hashes[:, w:] - hashes[:, :-w] * self.powers[w] + np.uint64(w)).ravel()
            here = np.flatnonzero(self.maybe[probe & _LOW])
            probe = probe[here]
            at = np.searchsorted(self.keys, probe)
            at[at == len(self.keys)] = 0
            same = self.keys[at] == probe
            here, at = here[same], at[same]
            if w == 1:
                gain[:, w:, wide - w] = self.unknown
            row, col = np.divmod(here, n + 1 - w)
            piece[row, col + w, wide - w] = self.ids[at]
            gain[row, col + w, wide - w] = self.scores[at]
        total = np.full((rows, wide + n + 1), -np.inf)
        total[:, wide] = 0.0
        back = np.zeros((rows, n + 1), dtype=np.int32)
        every = np.arange(rows)
        for j in range(1, n + 1):
            sums = total[:, j : j + wide] + gain[:, j]
            back[:, j] = best = sums.argmax(axis=1)  # of equal sums the earliest start, as the library does
            total[:, wide + j] = sums[every, best]
        ids = np.empty((rows, n), dtype=np.int32)
        end, col = size.copy(), np.full(rows, n)
        live = np.flatnonzero(end > 0)
        while len(live):
            e = end[live]
            r = back[live, e]
            col[live] -= 1
            got = piece[live, e, r]
            ids[live, col[live]] = np.where(got >= 0, got, -1 - codes[live, e - 1].astype(np.int64))
            end[live] = e - (wide - r)
            live = live[end[live] > 0]
        odd = (ids < 0) & (np.arange(n) >= col[:, None])
        odd = odd.any(axis=1)
        return [self._with_bytes(ids[i, col[i] :]) if odd[i] else ids[i, col[i] :].tobytes() for i in range(rows)]

    def _with_bytes(self, ids: np.ndarray) -> bytes:
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i >= 0 else [self.pieces.byte_ids[b] for b in chr(-1 - i).encode()]
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids (int32 bytes) of whole texts; an empty text has none."""
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        units = [cut(t) if t else [] for t in texts]
        new = [u for u in set().union(*units) if u not in cache]
        parts = {u: self.segments(u) for u in new}
        todo = [s for s in set().union(*parts.values()) if s not in cache]
        got = dict(zip(todo, self.best(todo), strict=True))
        cache.update(got)
        cache.update({u: cache[ss[0]] if len(ss) == 1 else b"".join([cache[s] for s in ss]) for u, ss in parts.items()})
        out = [b"".join(map(cache.__getitem__, us)) for us in units]
        for u in [u for u in (*new, *todo) if len(u) > 64]:
            cache.pop(u, None)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank in front that encoding adds goes."""
        body = b"".join(map(self.plain.__getitem__, ids))
        return (body[1:] if body[:1] == b" " else body).decode("utf-8", "replace")


_worker: dict[int, Encoder] = {}


def worker_encoder(proto: bytes) -> Encoder:
    """One encoder for a Python worker; its cache lives on from task to task."""
    key = hash(proto)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Encoder(piece_model.load(proto))
    return _worker[key]


def _slices(bodies: list[bytes]):
    start = size = 0
    for i, b in enumerate(bodies):
        size += len(b)
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(bodies):
        yield start, len(bodies)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and pieces (array of ids) for every row, whole texts. Null texts have no pieces."""
    proto = piece_model.model_bytes(model)

    def make():
        encoder = worker_encoder(proto)

        def run(ids, bodies):
            out: list[np.ndarray] = []
            for s, e in _slices(bodies):
                out += [np.frombuffer(x, dtype=np.int32) for x in encoder.encode([b.decode("utf-8", "replace") for b in bodies[s:e]])]
            return ids, out

        return run

    return common.map_rows(common.ids_and_bytes(docs, id_col, text_col), make, "doc_id long, pieces array<int>", pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32()))]))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows made by ``encode`` (null pieces: empty text)."""
    proto = piece_model.model_bytes(model)

    def make():
        encoder = worker_encoder(proto)

        def run(ids, pieces):
            return ids, [encoder.decode(p or []) for p in pieces]

        return run

    return common.map_rows(encoded.select("doc_id", "pieces"), make, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


DIGEST = "doc_id long, n_bytes long, n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean"


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: sizes, digests of the ids (int32, little endian) and of the decoded text.

    round_trip: the decoded text is the text, save that U+2581 (the space mark itself) comes back as a
    blank. Null texts are empty; null ids stay null; repeated rows stay. Narrow: no shuffle.
    """
    proto = piece_model.model_bytes(model)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("pieces_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def make():
        encoder = worker_encoder(proto)

        def run(ids, bodies):
            out = []
            for s, e in _slices(bodies):
                texts = [b.decode("utf-8", "replace") for b in bodies[s:e]]
                for b, t, x in zip(bodies[s:e], texts, encoder.encode(texts), strict=True):
                    back = encoder.decode(np.frombuffer(x, dtype=np.int32).tolist())
                    out.append((len(b), len(x) // 4, common.sha(x), common.sha(back.encode()), back == t.replace(SPACE, " ")))
            return [ids, *zip(*out, strict=True)] if out else [[]] * 6

        return run

    return common.map_rows(common.ids_and_bytes(docs, id_col, text_col), make, DIGEST, arrow)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, encoded and decoded.

    The one piece file at hand is a merge table: its scores are ranks, not log-probabilities. The ids are the
    best splits under the Zipf scores made from those ranks, so they are NOT the ids that the library gives for
    this file (its merge order splits otherwise). With a unigram model's own scores, which ``Encoder`` takes,
    they are the library's.
    """
    return round_trip(common.read(spark, sf_dir, "documents"))
