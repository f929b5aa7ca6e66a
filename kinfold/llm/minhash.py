"""Near-duplicate documents by b-bit MinHash.

Each distinct set of shingles gets a signature: the low bits of its minima, packed in longs, and the
hashes of the bands of full minima. Sets that share a band are candidates. In each bucket one pivot is
chosen, the member that shares most buckets (in a group of copies, the text closest to all); members
are compared with pivots, by a collision-corrected estimate from bit counts first and then exactly on
full sets. A pivot removes no member: what stays apart from its pivot, or was too far from it to be
compared, meets all that the pivot's buckets hold, by signatures in blocks first and then exactly. So the
work on texts grows with a group's size, not with its pairs, save for texts near the threshold; the
work on signatures grows with what is apart from a pivot times what its buckets hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

#: Minima in a signature, low bits kept of each, minima in a band.
MINIMA, BITS, ROWS = 128, 4, 4
#: Words of a shingle, and the similarity that links (as a fraction of integers).
SHINGLE, LINK = 5, (80, 100)
#: Below this estimate a pair isn't compared: seven standard deviations under a similarity of 0.8.
LEAST_ESTIMATE = 0.55
#: Shingles, and texts, that one block of a comparison holds, about.
BLOCK, BLOCK_TEXTS = 1_600_000, 2000
#: Parts that the rows of every pivot are dealt to in joins on pivots, as one pivot may have very many.
PARTS = 16
#: Signatures that one block of a comparison holds, about, and rows of it that are compared at once.
BLOCK_SIGNATURES, AT_ONCE = 5000, 64
#: Word hashes kept in a worker's memory.
CACHE_WORDS = 200_000

_U = np.uint64
_MULTIPLY = np.random.default_rng(20240607).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * _U(2) + _U(1)
_ADD = np.random.default_rng(20240608).integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(body: bytes, k: int, cache: common.WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of k words (fewer words: the whole sequence as one)."""
    words = body.lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)
    size = min(k, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096]
        low = np.minimum(low, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, 64 / BITS of them in a long."""
    per = 64 // BITS
    bits = (low & _U((1 << BITS) - 1)).reshape(-1, per)
    return (bits << (np.arange(per, dtype=np.uint64) * _U(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def bands(low: np.ndarray) -> np.ndarray:
    out = np.arange(1, MINIMA // ROWS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + low[j::ROWS])
    return out.view(np.int64)


def estimate(a, b):
    """Similarity from two packed signatures: the share of equal cells, less what collides by chance."""
    chance = 2.0**-BITS

    def equal(x):  # cells of a long that hold no set bit
        for shift in (1 << i for i in range((BITS - 1).bit_length())):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        ones = sum(1 << (BITS * i) for i in range(64 // BITS))
        return F.lit(64 // BITS) - F.bit_count(x.bitwiseAND(F.lit(ones if ones < 1 << 63 else ones - (1 << 64))))

    total = F.aggregate(F.zip_with(a, b, lambda x, y: equal(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (total / MINIMA - chance) / (1 - chance)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the set), key (128-bit digest of the set), sig and bands; without words, n is 0 and the rest null."""

    def make():
        cache = common.WordHashes(CACHE_WORDS)

        def run(ids, bodies):
            out = []
            for i, body in zip(ids, bodies, strict=True):
                s = shingles(body, k, cache)
                if not len(s):
                    out.append((i, 0, None, None, None))
                    continue
                low = minima(s)
                out.append((i, len(s), fingerprint(s), packed(low), bands(low)))
            return list(zip(*out, strict=True)) or [[]] * 5

        return run

    return common.map_rows(common.ids_and_bytes(docs, id_col, text_col), make, "doc_id long, n long, key binary, sig array<long>, bands array<long>", SIGNED)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def compare(units: DataFrame, k: int, link: tuple[int, int]) -> DataFrame:
    """Links (u, v) between the x rows and the y rows of each unit (h, xb, yc), on full sets.

    ``units``: h, xb, yc, is_x, node, comp, key, body. Pairs of one component are passed over. The x sets
    make one sorted list of (shingle, x); each y looks its shingles up and counts its hits by x.
    """
    need, of = link

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets, cache = {}, common.WordHashes(CACHE_WORDS)
        for node, key, body in zip(rows["node"], rows["key"], rows["body"], strict=True):
            if node not in sets:
                s = shingles(body, k, cache)
                if fingerprint(s) == key:  # an id that repeats with another text has another set
                    sets[node] = s
        del cache
        comp = dict(zip(rows["node"], rows["comp"], strict=True))
        xs = [n for n in dict.fromkeys(rows.loc[rows["is_x"], "node"]) if n in sets]
        ys = [n for n in dict.fromkeys(rows.loc[~rows["is_x"], "node"]) if n in sets]
        out = []
        if xs and ys:
            sizes = np.array([len(sets[n]) for n in xs])
            x_comp, x_id = np.array([comp[n] for n in xs]), np.array(xs)
            hashes, owner = np.concatenate([sets[n] for n in xs]), np.repeat(np.arange(len(xs)), sizes)
            by = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[by], owner[by]
            for y in ys:
                s = sets[y]
                lo, hi = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
                size = hi - lo
                if not (total := int(size.sum())):
                    continue
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
                both = np.bincount(owner[at], minlength=len(xs))
                for i in np.flatnonzero((of * both >= need * (sizes + len(s) - both)) & (x_comp != comp[y]) & (x_id != y)):
                    out.append((y, xs[i]))
            del hashes, owner
        del sets
        common.tidy()
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return units.groupBy("h", "xb", "yc").applyInPandas(run, "u long, v long")


def near(units: DataFrame, link: tuple[int, int]) -> DataFrame:
    """h, node, comp, is_x of the rows of each unit (h, xb, yc) that may link with a row of its other side, by sizes and signatures.

    ``units``: h, xb, yc, is_x, node, comp, n, sig. Gives rows, not pairs; pairs of one component are passed over.
    """
    need, of = link
    chance = 2.0**-BITS
    ones = _U(sum(1 << (BITS * i) for i in range(64 // BITS)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        x, y = (rows[rows["is_x"] == side].drop_duplicates("node") for side in (True, False))
        live_x, live_y = np.zeros(len(x), dtype=bool), np.zeros(len(y), dtype=bool)
        if len(x) and len(y):
            n_x, n_y, comp_x, comp_y = x["n"].to_numpy(), y["n"].to_numpy(), x["comp"].to_numpy(), y["comp"].to_numpy()
            sig_x, sig_y = (np.stack(df["sig"].to_numpy()).astype(np.int64).view(np.uint64).T for df in (x, y))
            for i in range(0, len(x), AT_ONCE):
                here = slice(i, i + AT_ONCE)
                size = n_x[here]
                lo, hi = np.searchsorted(n_y * of, size[0] * need, "left"), np.searchsorted(n_y * need, size[-1] * of, "right")
                if lo >= hi:
                    continue
                equal = np.zeros((len(size), hi - lo), dtype=np.int64)
                for a, b in zip(sig_x[:, here], sig_y[:, lo:hi], strict=True):
                    d = a[:, None] ^ b[None, :]
                    for shift in (1 << j for j in range((BITS - 1).bit_length())):
                        d |= d >> _U(shift)
                    equal += 64 // BITS - np.bitwise_count(d & ones).astype(np.int64)
                size, other = size[:, None], n_y[None, lo:hi]
                good = (equal / MINIMA - chance) / (1 - chance) >= LEAST_ESTIMATE
                good &= (np.minimum(size, other) * of >= np.maximum(size, other) * need) & (comp_x[here, None] != comp_y[None, lo:hi])
                live_x[here] |= good.any(axis=1)
                live_y[lo:hi] |= good.any(axis=0)
        return pd.concat([x[live_x], y[live_y]])[["h", "node", "comp", "is_x"]]

    return units.groupBy("h", "xb", "yc").applyInPandas(run, "h long, node long, comp long, is_x boolean").distinct()


def classes(docs: DataFrame, k: int = SHINGLE, link: tuple[int, int] = LINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id), one row for every row with an id.

    Two documents are linked when their sets of shingles share at least link[0] / link[1] of their union.
    Null and empty texts have no set and link with nothing; rows without an id take no part; rows that
    repeat are returned each, and an id that repeats with different texts counts as linked with itself.
    All intermediate tables are written to the shared folder: there is no lineage to recompute. All joins
    sort, as either side of each grows with the documents: nothing is broadcast.
    """
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    docs = docs.where(F.col(id_col).isNotNull())
    signed = common.written(signatures(docs, k, id_col, text_col), folder, "signed")
    sets = common.written(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node")), folder, "sets")
    nodes = common.sorted_join(signed, sets.select(F.col("key").alias("k2"), "node"), (F.col("key") == F.col("k2")) & (F.col("doc_id") == F.col("node"))).dropDuplicates(["node"])
    nodes = common.written(nodes.select("node", "n", "key", "sig", "bands"), folder, "nodes")

    # buckets of two and more, the pivot of each, and the pairs of members with pivots
    spread = nodes.select("node", F.explode("bands").alias("b"))
    full = spread.groupBy("b").agg(F.count("*").alias("c")).where("c > 1")
    member = common.written(common.sorted_join(spread, full, "b"), folder, "member")
    central = member.groupBy("node").agg(F.sum("c").alias("score"))
    ranked = common.sorted_join(member.select("b", "node"), central, "node")
    pivot = ranked.groupBy("b").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("p")).select("b", F.col("p.score").alias("score"), (-F.col("p.minus")).alias("h"))
    met = common.sorted_join(member.select("b", "node"), pivot, "b").where("node <> h").groupBy("node", "h", "score").agg(F.count("*").alias("shared"))
    met = common.written(met, folder, "met")
    size_ok = (F.least("n", "n_h") * link[1] >= F.greatest("n", "n_h") * link[0]) & (estimate(F.col("sig"), F.col("sig_h")) >= LEAST_ESTIMATE)
    there = nodes.select("node", "n", "sig")
    pairs = _with_pivots(common.sorted_join(met, there, "node"), there.toDF("h", "n_h", "sig_h")).where(size_ok).select("node", "h", "score", "shared", "n", "n_h")
    pairs = common.written(pairs, folder, "pairs")

    # the texts of members, once: what is compared is read from here, and Spark knows the size of either side
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("body"))
    used = common.written(met.select("node").union(met.select("h")).distinct(), folder, "used")
    texts = common.written(common.sorted_join(texts, used, "node", "left_semi"), folder, "texts")
    keys = nodes.select("node", "n", "key")
    step = iter(range(1, 4))

    def sides(ys: DataFrame, xs: DataFrame, more: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Both sides with the columns of ``more``, written: what follows uses each several times over."""
        return tuple(common.written(common.sorted_join(df, more, "node"), folder, f"{side}_{name}") for df, side in ((ys, "ys"), (xs, "xs")))

    def confirmed(ys: DataFrame, xs: DataFrame) -> DataFrame:
        i = next(step)
        units = common.sorted_join(common.written(_units(*sides(ys, xs, keys, i)), folder, f"units_{i}"), texts, "node")
        return common.written(compare(units, k, link), folder, f"links_{i}")

    def merged(comps: DataFrame, more: DataFrame, name: str) -> DataFrame:
        """The components once ``more`` links have come: the old ones, each a star around its smallest node, are joined by them."""
        if more.isEmpty():
            return comps
        return graph.components(comps.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).unionAll(more), folder, name)

    # each member with its best pivot, then with the other pivots that are still apart
    best = common.written(pairs.groupBy("node").agg(F.max(F.struct("score", "shared", "h")).alias("p")).select("node", F.col("p.h").alias("h")), folder, "best")
    links = confirmed(best.withColumn("comp", F.col("node")), best.select("h").distinct().select("h", F.col("h").alias("node"), F.col("h").alias("comp")))
    comps = graph.components(links, folder, "comps_1")
    apart = common.written(_with_comps(common.sorted_join(pairs.select("node", "h"), best, ["node", "h"], "left_anti"), comps).where("comp <> comp_h"), folder, "apart")
    hubs = apart.select("h", F.col("h").alias("node"), F.col("comp_h").alias("comp")).distinct()
    comps = merged(comps, confirmed(apart.select("node", "h", "comp"), hubs), "comps_2")

    # all that met a pivot, near to it or not: where components differ, those apart from the pivot against all
    around = _with_comps(met.select("node", "h"), comps)
    mixed = around.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    around = common.written(common.sorted_join(around, mixed, "h", "left_semi"), folder, "around")
    both = sides(around.select("h", "node", "comp"), around.where("comp <> comp_h").select("h", "node", "comp"), there, "near")
    live = common.written(near(_dealt(*both, F.ceil(F.count("*") / BLOCK_SIGNATURES)), link), folder, "live")
    more = confirmed(live.where("not is_x").drop("is_x"), live.where("is_x").drop("is_x"))
    comps = common.written(merged(comps, more, "comps_3"), folder, "comps")
    for name in ("nodes", "member", "met", "pairs", "used", "texts", "best", "apart", "around", "live", "xs_near", "ys_near", *(f"{x}_{i}" for x in ("xs", "ys", "units", "links") for i in (1, 2, 3))):
        common.removed(spark, f"{folder}/{name}")

    by_set = common.sorted_join(sets, comps, "node", "left").select("key", F.coalesce("comp", "node").alias("c"))
    out = common.sorted_join(signed.select("doc_id", "n", "key"), by_set, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"), (F.coalesce("c", "doc_id") == F.col("doc_id")).alias("kept"))


def _with_comps(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (node, h) with the components of both (a node without links is its own)."""
    of = lambda a, b: comps.select(F.col("node").alias(a), F.col("comp").alias(b))
    pairs = _with_pivots(common.sorted_join(pairs, of("node", "comp"), "node", "left"), of("h", "comp_h"))
    return pairs.select("node", "h", F.coalesce("comp", "node").alias("comp"), F.coalesce("comp_h", "h").alias("comp_h"))


def _with_pivots(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``rows`` (node, h, ...) with what ``about`` (h, ...) says of their pivots, if anything."""
    return _spread(rows, common.sorted_join(rows.select("h").distinct(), about, "h", "left"))


def _spread(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``rows`` joined with ``about`` on h: a pivot's rows are dealt to PARTS parts and its one row goes to each, so no task gets all rows of a hot one."""
    about = about.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    return common.sorted_join(rows, about, ["h", "__part"]).drop("__part")


def _units(ys: DataFrame, xs: DataFrame) -> DataFrame:
    """Units of a comparison on full sets, of about BLOCK shingles and BLOCK_TEXTS texts of each side."""
    rows = _dealt(ys, xs, F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_TEXTS)))
    return rows.select("h", "xb", "yc", "is_x", "node", "comp", "key")


def _dealt(ys: DataFrame, xs: DataFrame, n_blocks) -> DataFrame:
    """Units of a comparison of the xs with the ys of each h.

    Both are dealt over n_blocks blocks; an x goes to every block of ys and a y to every block of xs. No
    pairs are made here.
    """
    blocks = lambda df, name: df.groupBy("h").agg(n_blocks.cast("int").alias(name))
    sizes = common.sorted_join(blocks(xs, "nx"), blocks(ys, "ny"), "h")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ys = _spread(ys, sizes).withColumns({"is_x": F.lit(False), "yc": mine("ny"), "xb": every("nx")}).drop("nx", "ny")
    xs = _spread(xs, sizes).withColumns({"is_x": F.lit(True), "xb": mine("nx"), "yc": every("ny")}).drop("nx", "ny")
    return ys.unionByName(xs)


def drop_copies(docs: DataFrame, k: int = SHINGLE, link: tuple[int, int] = LINK) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their class, with all columns (rows without an id stay)."""
    gone = classes(docs, k, link).where("not kept").select("doc_id").distinct()
    return common.sorted_join(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"), k=2)


_SQL_WORDS = "string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     ')), ' +')"
SQL = f"""
with recursive w as (select doc_id, {_SQL_WORDS} as w from documents),
s as (
  select distinct doc_id, case when len(w) = 1 then w[1] else w[k] || ' ' || w[k + 1] end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as k from w where w[1] <> '')
), n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as m from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from pairs join n x on u = x.doc_id join n y on v = y.doc_id where 100 * m >= 80 * (x.n + y.n - m)),
edges as (select u, v from links union all select v, u from links),
reach(doc_id, c) as (select doc_id, doc_id from documents union select e.u, r.c from reach r join edges e on e.v = r.doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(c) as component_id, doc_id = min(c) as kept
from reach left join n using (doc_id) group by doc_id, n
"""
