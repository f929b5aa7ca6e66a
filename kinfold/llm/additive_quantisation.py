"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook. Codebooks are learnt on
a bounded sample, by residual k-means and then by least squares on all codes at once; every row is
encoded by beam search and kept as codes and the norm of its reconstruction. The first code is the
row's cell. Queries probe the cells of their best first codewords, as many as the sample shows to be
needed, score codes from lookup tables of inner products, and the best by score are compared exactly on
the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that codebooks are learnt on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 8192
#: Codebooks and codewords in each.
BOOKS, WORDS = 16, 128
#: Partial codes that the encoder's beam keeps.
BEAM = 4
#: Rows in one bin of cells, queries that meet it at once, and candidates of a bin that are compared exactly.
BIN_ROWS, QUERY_ROWS, RERANK = 8192, 8192, 200
#: Share of the sample's true neighbours whose cells must be probed, and rows of the sample that ask for them.
PROBED, ASKED = 0.99, 512


@dataclass(frozen=True)
class Quantiser:
    """books: (m, k, dim)."""

    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.books.shape[2]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, m) of unit vectors: at each codebook the best ``beam`` sums so far go on."""
        m, k, dim = self.books.shape
        flat = self.books.reshape(m * k, dim).astype(np.float32)
        norms, gram = (flat**2).sum(1), 2 * flat @ flat.T
        blocks = [[np.ascontiguousarray(gram[p * k : (p + 1) * k, j * k : (j + 1) * k]) for p in range(j)] for j in range(m)]
        out = []
        for i in range(0, len(x), 512):
            part = x[i : i + 512].astype(np.float32)
            n = len(part)
            alone = norms - 2 * part @ flat.T
            codes, cost = np.zeros((n, 1, 0), dtype=np.int64), np.zeros((n, 1), dtype=np.float32)
            for j in range(m):
                # |x - s - c|^2 = |x - s|^2 - 2 <x, c> + |c|^2 + 2 <s, c>
                step = alone[:, None, j * k : (j + 1) * k] + cost[:, :, None]
                for p in range(j):
                    step += blocks[j][p][codes[:, :, p]]
                step = step.reshape(n, -1)
                width = min(beam, step.shape[1])
                best = np.argpartition(step, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(step, best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], axis=2)
            out.append(codes[np.arange(n), cost.argmin(1)])
        return np.concatenate(out) if out else np.zeros((0, m), dtype=np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(len(self.books)))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 7) -> Quantiser:
    """Residual k-means, then rounds of beam-search codes and least squares for all codebooks together."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    rest, made = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(8):
            near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
            count = np.bincount(near, minlength=words)
            total = np.stack([np.bincount(near, weights=c, minlength=words) for c in rest.T], axis=1)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.integers(len(rest), size=words)])
        near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
        rest = rest - centres[near]
        made.append(centres)
    q = Quantiser(np.stack(made))
    for _ in range(rounds):
        codes = q.encode(x) + np.arange(books) * words
        size = books * words
        right = np.zeros((size, x.shape[1]))
        pairs = np.zeros((size, size))
        for a in range(books):
            right += np.stack([np.bincount(codes[:, a], weights=c, minlength=size) for c in x.T], axis=1)
            for b in range(books):
                at = slice(a * words, (a + 1) * words), slice(b * words, (b + 1) * words)
                pairs[at] = np.bincount((codes[:, a] - a * words) * words + codes[:, b] - b * words, minlength=words * words).reshape(words, words)
        pairs[np.diag_indices_from(pairs)] += 1e-2
        right += 1e-2 * q.books.reshape(-1, x.shape[1])
        q = Quantiser(np.linalg.solve(pairs, right).reshape(books, words, -1))
    return q


def unit_rows(vectors: list, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that take part: of the right length, finite, not zero."""
    at = [i for i, v in enumerate(vectors) if v is not None and (dim is None or len(v) == dim) and len(v) and None not in v]
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros((0, dim or 1))
    x = np.array([vectors[i] for i in at], dtype=np.float64)
    size = np.sqrt((x**2).sum(1))
    good = np.isfinite(x).all(1) & (size > 0) & np.isfinite(size)
    return np.array(at)[good], x[good] / size[good][:, None]


def needed_probes(q: Quantiser, x: np.ndarray, k: int = 5) -> int:
    """Cells that a query must probe for PROBED of the true neighbours of the sample's rows (unit vectors) among each other.

    Neighbours are farther in a sample than in the whole table, so this is on the safe side. Vectors without
    any structure need nearly all cells at every size, clustered ones few.
    """
    first, cell = q.books[0], q.encode(x)[:, 0]
    ranks = []
    for i in range(min(ASKED, len(x))):
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(first), dtype=np.int64)
        place[np.argsort((first**2).sum(1) - 2 * first @ x[i], kind="stable")] = np.arange(len(first))
        ranks.append(place[cell[best]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, dtype=np.int64)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(PROBED * len(ranks))))]) + 1 if len(ranks) else len(first)


def fit(vectors: DataFrame, rows: int = TRAIN_ROWS, books: int = BOOKS, words: int = WORDS) -> tuple[Quantiser, int] | None:
    """A quantiser learnt on at most ``rows`` rows, and the cells that a query must probe; None where no vector takes part."""
    got = vectors.where("v is not null and size(v) > 0").orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    if not got:
        return None
    sizes = pd.Series([len(r.v) for r in got]).mode()
    _, x = unit_rows([r.v for r in got], int(sizes[0]))
    if not len(x):
        return None
    q = train(x, books, words)
    return q, needed_probes(q, x)


def _kind(df: DataFrame) -> tuple[str, pa.DataType]:
    """The vectors' own type, in Spark's and Arrow's terms."""
    return ("array<float>", pa.list_(pa.float32())) if df.schema["v"].dataType.simpleString() == "array<float>" else ("array<double>", pa.list_(pa.float64()))


def encode(vectors: DataFrame, q: Quantiser) -> DataFrame:
    """id, same (digest of the vector), cell, codes (one byte a codebook), norm of the reconstruction and v, for rows that take part."""
    name, kind = _kind(vectors)
    schema = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("cell", pa.int32()), ("codes", pa.binary()), ("norm", pa.float64()), ("v", kind)])

    def make():
        import xxhash

        def run(ids, vs):
            at, x = unit_rows(vs, q.dim)
            codes = q.encode(x)
            norm = np.sqrt((q.decode(codes) ** 2).sum(1)) if len(codes) else np.zeros(0)
            raw = [np.array(vs[i], dtype=np.float64).tobytes() for i in at]
            return [ids[i] for i in at], [xxhash.xxh3_128_digest(r) for r in raw], codes[:, 0], [c.tobytes() for c in codes.astype(np.uint8)], norm, [vs[i] for i in at]

        return run

    return common.map_rows(vectors, make, f"id long, same binary, cell int, codes binary, norm double, v {name}", schema)


def bins_of(sizes: dict[int, int], rows: int = BIN_ROWS) -> tuple[dict[int, tuple[int, int]], int]:
    """cell: (first bin, bins), and the number of bins: small cells share one, large ones are split over several."""
    out, at, used = {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if used and used + n > rows:
            at, used = at + 1, 0
        parts = -(-n // rows)
        out[cell] = at, max(1, parts)
        if parts > 1:
            at += parts
        else:
            used += n
    return out, at + (used > 0)


def search(
    embeddings: DataFrame, queries: DataFrame, k: int = 5, q: Quantiser | None = None, probes: int | None = None, rerank: int | None = RERANK, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query by cosine, ties to the smaller id.

    ``queries`` has the columns of ``embeddings``; a row isn't its own neighbour. Null ids, null, zero and
    empty vectors, such with null or non-finite parts and such of another length than most take no part.
    Rows that repeat are one; of an id with several vectors the smallest that takes part, in the order of its
    numbers, stands for it, as a candidate and as a query. Of equal vectors the k + 1 smallest ids stand for
    all, which loses no answer and keeps a vector that very many rows share from filling a cell.

    Cells are gathered in bins of bounded size; a bin meets the queries that probe one of its cells, a bounded
    number at once, scores its codes from lookup tables and compares its ``rerank`` best exactly, so that only
    k rows a query and bin are shuffled on. ``probes``: cells a query probes (default: what the sample needs).
    With rerank=None all rows of the bins are compared exactly; with all cells probed besides, the search is exact.
    """
    spark = embeddings.sparkSession
    folder = common.shared_dir(spark)
    pick = lambda df: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    vectors, asked = pick(embeddings), pick(queries)
    if q is None:
        fitted = fit(vectors)
        if fitted is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        q, needed = fitted
        probes = needed if probes is None else probes
    probes = min(q.books.shape[1] if probes is None else probes, q.books.shape[1])
    order = Window.partitionBy("same").orderBy("id")
    coded = encode(vectors, q).groupBy("id").agg(F.min(F.struct("v", "same", "cell", "codes", "norm")).alias("x")).select("id", "x.*")
    lists = common.written(coded.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r", "same"), folder, "lists")
    sizes = {r.cell: r["count"] for r in lists.groupBy("cell").count().collect()}  # at most WORDS rows
    bins, n_bins = bins_of(sizes)
    first_of, parts_of = ({c: x[i] for c, x in bins.items()} for i in (0, 1))
    lists = lists.withColumn("bin", (_lookup(first_of, F.col("cell")) + F.pmod(F.xxhash64("id"), _lookup(parts_of, F.col("cell")))).cast("int"))
    name, kind = _kind(asked)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = (F.size("v") == q.dim) & F.forall("v", number) & F.exists("v", lambda x: x != 0)
    asked = common.written(asked.where(valid).groupBy("id").agg(F.min("v").alias("v")), folder, "asked")
    n_parts = max(1, -(-asked.count() // QUERY_ROWS))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int"))

    def probe():
        first, spread = q.books[0], np.zeros((q.books.shape[1], n_bins), dtype=bool)
        for c, (at, n) in bins.items():
            spread[c, at : at + n] = True

        def run(ids, vs, parts):
            at, x = unit_rows(vs, q.dim)
            order = np.argsort(((first**2).sum(1) - 2 * x @ first.T), axis=1, kind="stable")[:, :probes]
            out = [(ids[i], b, parts[i], vs[i]) for i, cells in zip(at, order, strict=True) for b in np.flatnonzero(spread[cells].any(axis=0)).tolist()]
            return list(zip(*out, strict=True)) or [[]] * 4

        return run

    arrow = pa.schema([("query", pa.int64()), ("bin", pa.int32()), ("part", pa.int32()), ("w", kind)])
    probed = common.map_rows(asked.select("id", "v", "part"), probe, f"query long, bin int, part int, w {name}", arrow)

    def score(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows = rows.sort_values("id")
            ids, norm = rows["id"].to_numpy(), np.maximum(rows["norm"].to_numpy(), 1e-12)
            codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(ids), -1)
            v = np.stack(rows["v"].to_numpy()).astype(np.float64)
            size = np.sqrt((v**2).sum(1))
            w = np.stack(asks["w"].to_numpy()).astype(np.float64)
            length = np.sqrt((w**2).sum(1))
            own = asks["query"].to_numpy()
            for s in range(0, len(w), 128):
                table = np.einsum("qd,mkd->mqk", w[s : s + 128], q.books).astype(np.float32)
                near = sum(table[m][:, codes[:, m]] for m in range(codes.shape[1])) / norm.astype(np.float32)
                near[ids[None, :] == own[s : s + 128, None]] = -np.inf
                if rerank is not None and rerank < len(ids):  # equal scores at the border all go on
                    a, b = np.nonzero(near >= np.partition(near, len(ids) - rerank, axis=1)[:, len(ids) - rerank, None])
                else:
                    a, b = np.nonzero(near > -np.inf)
                keep = ids[b] != own[s + a]
                a, b = a[keep], b[keep]
                exact = np.empty(len(a))
                for i in range(0, len(a), 20_000):
                    x, y = s + a[i : i + 20_000], b[i : i + 20_000]
                    exact[i : i + 20_000] = (v[y] * w[x]).sum(1) / (size[y] * length[x])
                by = np.lexsort((ids[b], -exact, a))
                a, b, exact = a[by], b[by], exact[by]
                start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))[: len(a)]
                top = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < k
                out.append((own[s + a[top]], ids[b[top]], exact[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query", "id", "score"), cols, strict=True)))

    found = lists.drop("cell").groupBy("bin", "part").cogroup(probed.groupBy("bin", "part")).applyInPandas(score, "query long, id long, score double")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _lookup(table: dict[int, int], key):
    pairs = [x for kv in sorted(table.items()) for x in kv]
    return F.element_at(F.create_map(*map(F.lit, pairs)), key) if pairs else F.lit(1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.read(spark, sf_dir, "embeddings")
    return search(table, table.where("vec_id % 50 = 0"))
