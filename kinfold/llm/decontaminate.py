"""Benchmark decontamination with a generalised suffix automaton over normalised item words.

Items are cut into words and joined in one automaton. A document's words are streamed through it
while the longest suffix that stands in any item is tracked; wherever that reaches the window
length (or ends a whole shorter item), the words it covers are hit.

Most words of a corpus stand in no item. So a table of bits of fixed size, of the items' words and of
their pairs of neighbours, first finds the runs of words that may hold a match (it passes too much at
times, never too little). Items are dealt to blocks and runs to shares of bounded size, and each task
streams one share through the one automaton of its block. Neither the driver nor a task ever
holds all items, and nothing but the bits is sent to all.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 10
#: Item bytes in one automaton, about (100,000 words, some 40 MB in a worker), and bytes of runs in one share.
BLOCK_BYTES, SHARE_BYTES = 600_000, 16_000_000
#: Bits for each word of the items, and all bits at most (8 MB).
BITS_A_WORD, MOST_BITS = 32, 1 << 26

#: A-Z become a-z, digits and bytes from 0x80 stay, all else becomes a blank: what is left between blanks are the words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(body: bytes) -> list[bytes]:
    return body.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with what matches need to know.

    A state stands for all substrings that end at the same places. ``window_of[v]``: the state
    above v (or v) that holds the suffix of ``window`` words; ``items_of``: by such a state the items
    in which it occurs. Whole shorter items are marked at their own state, ``short_of[v]`` chains them.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        seqs = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.items_of: dict[int, set[str]] = {}
        self.window_of = [-1] * n
        for v in order:  # links lead to shorter states, so those are known
            up = self.link[v]
            self.window_of[v] = v if self.length[up] < window <= self.length[v] else self.window_of[up]
        self.short_at: dict[int, list[tuple[int, str]]] = {}
        for item, seq in seqs:
            v = 0
            if len(seq) < window:
                for c in seq:
                    v = self.next[v][c]
                self.short_at.setdefault(v, []).append((len(seq), item))
                continue
            size = 0
            for c in seq:
                v, size = self.next[v][c], size + 1
                if size >= window:
                    self.items_of.setdefault(self.window_of[v], set()).add(item)
        self.short_of = [-1] * n
        for v in order:
            self.short_of[v] = v if v in self.short_at else self.short_of[self.link[v]]
        #: Fewest words of a match; a run of words of which each pair of neighbours stands in an item can hold one only from this size.
        self.least = min((window, *(k for of in self.short_at.values() for k, _ in of)))
        pairs = {a * len(self.vocab) + b for _, seq in seqs for a, b in zip(seq, seq[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # known from an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (start, end), in order of their ends, and the items that occur."""
        n, v_size = len(tokens), len(self.vocab)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if n < self.least or not v_size:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, tokens, [-1] * n), dtype=np.int64, count=n)
        for start, end in self._runs(ids):
            self._stream(ids[start:end].tolist(), start, spans, found)
        return spans, found

    def _runs(self, ids: np.ndarray):
        """Ranges in which every word and pair of neighbours stands in some item; no match crosses their ends."""
        known = ids >= 0
        if self.least == 1:
            joined = known[1:] & known[:-1]
        else:
            code = ids[:-1] * len(self.vocab) + ids[1:]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            joined = known[1:] & known[:-1] & (self.pairs[at] == code if len(self.pairs) else False)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + 1
        if self.least == 1:  # single known words are runs too
            alone = known.copy()
            for s, e in zip(starts, ends, strict=True):
                alone[s:e] = False
            one = np.flatnonzero(alone)
            starts, ends = np.concatenate((starts, one)), np.concatenate((ends, one + 1))
            by = np.argsort(starts)
            starts, ends = starts[by], ends[by]
        long = ends - starts >= self.least
        return zip(starts[long].tolist(), ends[long].tolist(), strict=True)

    def _stream(self, ids: list[int], base: int, spans: list, found: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = size = 0
        for i, c in enumerate(ids, base + 1):
            while (to := nxt[v].get(c)) is None:
                v = link[v]
                if v < 0:
                    break
                size = length[v]
            if to is None:
                v = size = 0
                continue
            v, size = to, size + 1
            if size >= window:
                spans.append((i - window, i))
                found |= self.items_of[self.window_of[v]]
            if self.short_at:
                at = self.short_of[v]
                while at >= 0:  # every marked state above ends here with its whole item
                    for k, item in self.short_at[at]:
                        if k <= size:
                            spans.append((i - k, i))
                            found.add(item)
                    at = self.short_of[link[at]]


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """i (id as text) and b (bytes) of the items that have both."""
    return benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("b")).where("i is not null and b is not null")


def _hashes(ws: list[bytes], cache: common.WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, ws), dtype=np.uint64, count=len(ws))


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbours."""
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sieve:
    """Which runs of words may hold a match: bits of the items' words and pairs, and the fewest words of a match."""

    def __init__(self, bits: np.ndarray, least: int):
        self.bits, self.least, self.mask = bits, least, np.uint64(64 * len(bits) - 1)
        self.cache = common.WordHashes()

    def _has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def runs(self, ws: list[bytes]) -> list[tuple[int, int]]:
        """Ranges of ``least`` words and more in which every word and every pair of neighbours may stand in an item."""
        if not self.least or len(ws) < self.least:
            return []
        h = _hashes(ws, self.cache)
        known = self._has(h)
        if not known.any():
            return []
        joined = known[1:] & known[:-1]
        joined[joined] = self._has(_pairs(h)[joined])
        start = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        end = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = end - start >= self.least
        return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def sieve(items: DataFrame, window: int) -> Sieve:
    """Built from the items in tasks; the driver gets at most MOST_BITS bits."""
    total = items.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    n_bits = min(MOST_BITS, 1 << max(12, (BITS_A_WORD * total // 4).bit_length()))

    def mark(batches):
        cache = common.WordHashes()
        for b in batches:
            slots, sizes = [np.empty(0, dtype=np.uint64)], set()
            for body in b.column(0).to_pylist():
                if ws := words(body):
                    h = _hashes(ws, cache)
                    slots += [h, _pairs(h)]
                    sizes.add(min(window, len(ws)))
            slot = np.unique(np.concatenate(slots) & np.uint64(n_bits - 1))
            at, bit = (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))[: len(at)]
            words_of = np.bitwise_or.reduceat(bit, first) if len(at) else bit
            sizes = np.array(sorted(sizes), dtype=np.int64)  # places below 0 stand for sizes
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at[first], -sizes))), pa.array(np.concatenate((words_of.view(np.int64), np.zeros_like(sizes))))], ["at", "bits"])

    got = items.select("b").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    at, bits = got["at"].to_numpy(dtype=np.int64), got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    table = np.zeros(n_bits // 64, dtype=np.uint64)
    table[at[at >= 0]] = bits[at >= 0]
    return Sieve(table, int(-at[at < 0].max()) if (at < 0).any() else 0)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(id, tag, n_words) of every row, and (id, tag, spans, items) of those that are hit.

    tag is the text's hash, so that an id may repeat with several texts. spans: hit word ranges (s, e) in order,
    which may touch and overlap where several blocks have found them; items: the ids that occur, sorted.
    """
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    items = items_of(benchmark, item_col)
    total = items.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    n_blocks, filter_ = 1 + total // block_bytes, sieve(items, window)

    def make():
        def run(ids, tags, bodies):
            n, found = [], []
            for body in bodies:
                ws = words(body)
                n.append(len(ws))
                found.append([{"s": s, "w": b" ".join(ws[s:e])} for s, e in filter_.runs(ws)])
            return ids, tags, n, found

        return run

    arrow = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("s", pa.int32()), ("w", pa.binary())])))])
    df = common.ids_and_bytes(docs, id_col, text_col).select("id", F.xxhash64("body").alias("tag"), "body")
    read = common.written(common.map_rows(df, make, "id long, tag long, n_words long, runs array<struct<s:int,w:binary>>", arrow), folder, "read")
    runs = read.where(F.size("runs") > 0).select("id", "tag", F.explode("runs").alias("r")).select("id", "tag", "r.s", "r.w")
    n_shares = 1 + (runs.agg(F.sum(F.octet_length("w"))).first()[0] or 0) // share_bytes
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    runs = runs.withColumn("share", F.pmod(F.xxhash64("id", "tag", "s"), F.lit(n_shares)).cast("int")).withColumn("block", every(n_blocks))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n_blocks)).cast("int")).withColumn("share", every(n_shares))

    def match(of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(of) and len(rows):
            automaton = Automaton([(i, words(b)) for i, b in sorted(zip(of["i"], of["b"], strict=True))], window)
            for i, tag, s, w in zip(rows["id"], rows["tag"], rows["s"], rows["w"], strict=True):
                spans, found = automaton.match(w.split(b" "))
                if spans:
                    out.append((i, tag, [{"s": x["s"] + s, "e": x["e"] + s} for x in merge(spans)], sorted(found)))
        return pd.DataFrame(out, columns=["id", "tag", "spans", "items"]).astype({"id": "Int64"})

    hits = dealt.groupBy("block", "share").cogroup(runs.groupBy("block", "share")).applyInPandas(match, f"id long, tag long, spans {MATCHES}, items array<string>")
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return read.select("id", "tag", "n_words"), hits.groupBy("id", "tag").agg(joined("spans"), joined("items"))


MATCHES = "array<struct<s:int,e:int>>"


def merge(spans) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["e"]:
            out[-1]["e"] = max(e, out[-1]["e"])
        else:
            out.append({"s": s, "e": e})
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; null ids stay null; repeated rows are each reported; items that are null,
    empty or without words have no window; a repeated item id is one item. Without items nothing is hit.
    """
    read, hits = matched(docs, benchmark, window, block_bytes, share_bytes)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"))
    hits = hits.select(F.col("id").alias("id2"), F.col("tag").alias("tag2"), F.aggregate("spans", start, step, lambda acc: acc["n"]).alias("hit"), "items")
    rows = read.join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2")), "left")
    n_hit, items = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """The columns of ``documents`` with hit spans of more than ``max_words`` words taken out of the text.

    A document of whose words more than ``max_coverage`` is hit goes as a whole. What stands between
    the first and the last character of a span's words goes with it; other text stays as it is, and
    n_chars is counted anew. Texts without a hit, null ones among them, pass unchanged.
    """
    keep = [c for c in CLEANED if c in docs.columns]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    read, hits = matched(docs, benchmark, window)
    folder = common.shared_dir(docs.sparkSession)
    hits = common.written(hits.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "spans"), folder, "hits")  # its size is known to what joins it
    this = docs["doc_id"].eqNullSafe(hits["__id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit(b""))) == hits["__tag"])

    def make():
        def run(ids, texts, langs, sources, sizes, found):
            out = []
            for i, text, lang, source, n, spans in zip(ids, texts, langs, sources, sizes, found, strict=True):
                body = text.encode()
                spans = merge((x["s"], x["e"]) for x in spans)
                if sum(x["e"] - x["s"] for x in spans) > max_coverage * len(words(body)):
                    continue
                if spans := [x for x in spans if x["e"] - x["s"] > max_words]:
                    text = without(body, spans).decode("utf-8", "replace")
                    n = len(text)
                out.append((i, text, lang, source, n))
            return list(zip(*out, strict=True)) or [[]] * 5

        return run

    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    cut = common.map_rows(docs.join(hits, this).select(*CLEANED, "spans"), make, "doc_id long, text string, lang string, source string, n_chars long", arrow)
    return docs.join(hits, this, "left_anti").unionByName(cut).select(*keep)


CLEANED = ("doc_id", "text", "lang", "source", "n_chars")


def without(body: bytes, spans: list[dict]) -> bytes:
    """The text without the bytes from each span's first word to the end of its last."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(body)]
    out, at = [], 0
    for x in spans:
        out.append(body[at : places[x["s"]][0]])
        at = places[x["e"] - 1][1]
    out.append(body[at:])
    return b"".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with items as (select item_id::varchar as item, {_SQL_WORDS} as w from benchmark where item_id is not null),
windows as (
  select distinct item, least({WINDOW}, len(w)) as n, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') as g
  from (select item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as k from items where len(w) > 0)
), docs as (select doc_id, {_SQL_WORDS} as w from documents),
sizes as (select distinct n from windows),
grams as (
  select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from docs, sizes where len(w) >= n)
), hits as (select doc_id, k, n, item from grams join windows using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by 1),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hits group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (doc_id) left join found using (doc_id)
"""
