"""Token counts by byte-pair merging with a heap and a linked list of symbols.

The adjacent pair of lowest rank is popped again and again (equal ranks: leftmost first); every
successful merge takes one symbol away, so the count is initial symbols minus merges and no
identifier is ever made. A character outside the vocabulary counts as its UTF-8 bytes.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, piece_model
from .piece_model import SPACE

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

#: Counts kept in a worker's memory (about 130 bytes each); beyond it the table starts anew.
CACHE_WORDS = 1_000_000


class MergeCounter:
    """Counts the tokens of whole texts.

    Pieces never join across a pair of characters that stands in no piece, so a text falls apart
    there exactly; what lies between is merged once and remembered.
    """

    def __init__(self, pieces: piece_model.Pieces, cache: int = CACHE_WORDS):
        words = [pieces.strings[i] for i in pieces.normal]
        order = {r: i for i, r in enumerate(sorted({-pieces.scores[i] for i in pieces.normal}))}
        self.rank = {w: order[-pieces.scores[i]] for i, w in zip(pieces.normal, words, strict=True)}
        self.chars = frozenset(w for w in words if len(w) == 1)
        self.joined = frozenset(a + b for w in words for a, b in zip(w, w[1:], strict=False))
        self.counts: dict[str, int] = {}
        self.cache = cache

    def segments(self, word: str) -> list[str]:
        """Parts of a word that no merge can cross."""
        out, start, joined = [], 0, self.joined
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merged(self, text: str) -> int:
        """Initial symbols minus merges. A heap entry is one integer: rank, then place."""
        rank, n = self.rank.get, len(text)
        count = n if self.chars.issuperset(text) else sum(1 if c in self.chars else len(c.encode()) for c in text)
        if n == 1:
            return count
        symbols = list(text)
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        after, before, pop, push = list(range(1, n + 1)), list(range(-1, n - 1)), heapq.heappop, heapq.heappush
        symbols.append("")  # stands behind the last symbol; no piece ends here
        while heap:
            x = pop(heap)
            i = x & 0xFFFFFFFF
            if not (left := symbols[i]) or (j := after[i]) >= n or rank(pair := left + symbols[j]) != x >> 32:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + symbols[k])) is not None:
                    push(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := rank(symbols[k] + pair)) is not None:
                push(heap, r << 32 | k)
        return count

    def word(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            if len(self.counts) >= self.cache:
                self.counts.clear()
            n = 0
            for s in self.segments(word):
                if (m := self.counts.get(s)) is None:
                    m = self.merged(s)
                    if len(s) <= 64:
                        self.counts[s] = m
                n += m
            if len(word) <= 64:
                self.counts[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of one text: each blank becomes the space mark, one more stands in front."""
        if not text:
            return 0
        total, get, word = 0, self.counts.get, self.word
        for w in cut(text):
            if (n := get(w)) is None:
                n = word(w)
            total += n
        return total


def cut(text: str) -> list[str]:
    """Units of a marked text: a run of space marks and what follows it up to the next mark."""
    text = SPACE + text.replace(" ", SPACE)
    if SPACE + SPACE not in text:
        return [SPACE + w for w in text[1:].split(SPACE)]
    out, i, n = [], 0, len(text)
    while i < n:
        j = i
        while j < n and text[j] == SPACE:
            j += 1
        if (k := text.find(SPACE, j)) < 0:
            k = n
        out.append(text[i:k])
        i = k
    return out


_worker: dict[int, MergeCounter] = {}


def worker_counter(proto: bytes) -> MergeCounter:
    """One counter for a Python worker; its table of words lives on from task to task."""
    key = hash(proto)
    if key not in _worker:
        _worker.clear()
        _worker[key] = MergeCounter(piece_model.load(proto))
    return _worker[key]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row, whole texts.

    Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows are counted
    each; an empty table gives an empty result. Narrow: no shuffle at all.
    """
    proto = piece_model.model_bytes(model)

    def make():
        counter = worker_counter(proto)

        def run(ids, bodies):
            n = [counter.count(b.decode("utf-8", "replace")) for b in bodies]
            return ids, [len(b) for b in bodies], n, [x > limit for x in n]

        return run

    return common.map_rows(common.ids_and_bytes(docs, id_col, text_col), make, SCHEMA, ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"))
