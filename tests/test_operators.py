import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking as B
from kinfold.operators import decode as D
from kinfold.operators import evaluate as E
from kinfold.operators import learn as L
from kinfold.operators import validate as V
from kinfold.sources import files


def f05(h, k, t):
    if t == 0:
        return float(k == 0)
    if not h:
        return 0.0
    p, r = h / k, h / t
    return 1.25 * p * r / (0.25 * p + r)


def test_f05_is_the_textbook_value(spark):
    cases = [(0, 0, 0), (0, 1, 0), (0, 0, 1), (1, 2, 1), (2, 3, 4), (3, 3, 3)]
    df = spark.createDataFrame(cases, "h int, k int, t int").select(E.f05(F.col("h"), F.col("k"), F.col("t")).alias("s"))
    for r, c in zip(df.collect(), cases, strict=True):
        assert r.s == pytest.approx(f05(*c))


@pytest.fixture(scope="module")
def world(spark):
    ents, truth, cands = files.synthetic(spark, 400, seed=3)
    return ents.cache(), truth.cache(), cands.cache()


def marked_and_entities(world, cfg):
    ents, truth, cands = world
    return D.marked(cands, cfg), E.with_n_true(ents, truth)


def test_decomposition(world):
    table = E.entity_counts(*marked_and_entities(world, D.DecodeConfig(gate=0.5, pair=0.5)))
    r, p = E.report(table).first(), E.project(E.report(table)).first()
    assert p.projected == pytest.approx(r.score, abs=1e-9)


def test_missed_pairs_count(spark):
    """An entity with two true pairs, of which one is a candidate, cannot score 1."""
    ents = spark.createDataFrame([("a", 2)], "s1_id string, n_true long")
    cands = spark.createDataFrame([("a", "x", 0.9, True)], "s1_id string, cand_id string, prob double, label boolean")
    want = f05(1, 1, 2)
    assert E.report(E.entity_counts(D.marked(cands, D.DecodeConfig()), ents)).first().score == pytest.approx(want)
    assert E.grid_search(cands, ents, {"gate": [0.5]}).first().score == pytest.approx(want)


def test_grid_equals_single_decodes(world):
    """Whatever the axes and modes, a row of the grid is the report of that decode against the truth."""
    _, _, cands = world
    grids = [
        ({"gate": [0.3, 0.6], "pair": [0.4, 0.8], "rel": [0.0, 0.9]}, D.DecodeConfig()),
        ({"max_k": [1, 2], "max_per_source": [1, 2]}, D.DecodeConfig(gate=0.9, gate_source="any", pair=0.2)),
        ({"mode": ["threshold", "expected_f"], "min_prob": [0.0, 0.3]}, D.DecodeConfig(ef_max_cands=6)),
    ]
    for grid, base in grids:
        _, ents = marked_and_entities(world, base)
        rows = E.grid_search(cands, ents, grid, base).collect()
        assert len(rows) == math.prod(map(len, grid.values()))
        for r in rows:
            cfg = replace(base, **{a: r[a] for a in grid})
            table = E.entity_counts(D.marked(cands, cfg), ents)
            want = E.report(table).first()
            assert (r.score, r.spec, r.open_rate, r.f_open) == pytest.approx((want.score, want.spec, want.open_rate, want.f_open or 0.0), abs=1e-12)
            size = table.where("n_pred > 0").agg(F.avg("n_pred")).first()[0]
            assert r.avg_set_size == pytest.approx(size or 0.0)
        pick = E.best_config(E.grid_search(cands, ents, grid, base), base, robust=False)
        assert max(r.score for r in rows) == next(r.score for r in rows if all(r[a] == getattr(pick, a) for a in grid))
    with pytest.raises(ValueError, match="a grid can't hold"):
        E.grid_search(cands, ents, {"mode": ["other"]})


def test_decode_refuses_what_it_does_not_know(world):
    _, _, cands = world
    for cfg, word in ((D.DecodeConfig(mode="x"), "mode"), (D.DecodeConfig(gate_source="x"), "gate"), (D.DecodeConfig(max_per_source=1), "source")):
        with pytest.raises(ValueError, match=word):
            D.marked(cands.drop("source"), cfg)


def test_oracles_are_ordered(world):
    ents, truth, cands = world
    n = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    e = ents.join(n, "s1_id", "left").na.fill(0)
    cfg = D.DecodeConfig(gate=0.5, pair=0.5)
    s = {r.scenario: r.macro_f05 for r in E.oracles(D.marked(cands, cfg), D.marked(cands, D.DecodeConfig(gate=float("-inf"), pair=0.5)), e).collect()}
    assert s["current"] <= s["perfect gate"] + 1e-9 and s["current"] <= s["perfect sets"] + 1e-9
    assert s["perfect sets"] <= s["blocking ceiling"] + 1e-9 <= s["perfect blocking"] + 1e-9


def test_errors_partition(world):
    ents, truth, cands = world
    marked = D.marked(cands, D.DecodeConfig(gate=0.5, pair=0.5))
    kinds = {r.kind: r["count"] for r in E.error_pairs(marked, truth, ents).groupBy("kind").count().collect()}
    table = E.per_entity(marked.where("kept"), truth, ents).agg(F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).first()
    assert kinds.get("false_merge_singleton", 0) + kinds.get("false_merge_matched", 0) == table.fp
    assert kinds.get("blocking_miss", 0) + kinds.get("model_miss", 0) == table.fn


def test_bootstrap_verdicts(spark):
    a = spark.range(400).select(F.col("id").alias("s1_id"), (F.rand(1) * 0.5).alias("score"))
    assert E.paired_bootstrap(a, a)["verdict"] == "NO CHANGE"
    assert E.paired_bootstrap(a, a.withColumn("score", F.col("score") + 0.1))["verdict"] == "WINS"
    assert E.paired_bootstrap(a, a.withColumn("score", F.col("score") - 0.1))["verdict"] == "LOSES"
    with pytest.raises(ValueError, match="different entities"):
        E.paired_bootstrap(a, a.where("s1_id < 10"))
    mean, lo, hi = E.bootstrap_interval(a)
    assert lo <= mean <= hi


def test_expected_size_is_the_best_by_enumeration():
    rng = random.Random(5)
    for _ in range(30):
        p = sorted((rng.random() for _ in range(rng.randint(0, 6))), reverse=True)
        value = []
        for k in range(len(p) + 1):
            v = 0.0
            for world in range(1 << len(p)):
                hits = [world >> i & 1 for i in range(len(p))]
                weight = math.prod(x if h else 1 - x for x, h in zip(p, hits, strict=True))
                v += weight * f05(sum(hits[:k]), k, sum(hits))
            value.append(v)
        assert value[D.best_size(p)] == pytest.approx(max(value), abs=1e-9)


def test_folds_are_even(world):
    ents, truth, _ = world
    n = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    b = E.fold_balance(E.kfold(ents.join(n, "s1_id", "left").na.fill(0), k=4)).collect()
    assert len(b) == 4 and max(r.n for r in b) - min(r.n for r in b) <= 20


def test_block_caps_at_the_border(spark):
    def keys(n_t, n_s):
        return [(f"S2-{i}", "S2", "pre", "k") for i in range(n_t)] + [(f"S1-{i}", "S1", "pre", "k") for i in range(n_s)]

    for n_t, n_s, want in ((3, 2, 6), (4, 2, 0), (3, 3, 0)):
        df = spark.createDataFrame(keys(n_t, n_s), "entity_id string, src string, kind string, key string")
        assert B.build_candidates(df, {"pre": 3}, {"pre": 2}).count() == want


def test_hops_need_groups_within_bounds(spark):
    for size, found in ((1, 0), (2, 1), (20, 19), (21, 0)):
        norm = spark.createDataFrame([(f"S2-{i}", "S2", "x", "same", "", "") for i in range(size)], "entity_id string, src string, country string, name_phon string, addr_clean string, house_no string")
        cands = spark.createDataFrame([("S1-0", "S2-0", ["a", "b", "c", "d"])], "s1_id string, cand_id string, keys array<string>")
        assert B.add_hops(cands, norm).count() - 1 == found


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "gt.tsv"
    p.write_text('id\ts2\ts3\n007\t"a, b"\t[c]\nx\tnan\t\ny\tb\t\n007\td\t\n')
    got = {r.s1_id: r.cand_ids for r in files.read_match_sets(spark, str(p)).collect()}
    assert got == {"007": ["a", "b", "c", "d"], "x": [], "y": ["b"]}
    order = spark.createDataFrame([("y", 0), ("007", 1), ("z", 2)], "s1_id string, ord int")
    files.write_lists(spark.createDataFrame(list(got.items()), "s1_id string, cand_ids array<string>"), str(tmp_path / "out"), order)
    lines = (tmp_path / "out").read_text().splitlines()
    assert lines == ["s1_id\tcand_ids", "y\tb", "007\ta,b,c,d", "z\t"]
    assert files.convert(spark, str(p), str(tmp_path / "pq")) == 4
    with pytest.raises(ValueError, match="expected"):
        files.convert(spark, str(p), str(tmp_path / "pq"), expected=5)


def test_line_checks(spark):
    lines = spark.createDataFrame([("a\tb",), ("1\t2",), ("bad",), ("1\t2\t3",)], "value string")
    assert {r.check: r.n for r in V.line_violations(lines, "a\tb").collect()} == {"header": 0, "no_tab": 1, "many_tabs": 1}


def test_calibration_and_rerank(spark, world):
    _, _, cands = world
    for method in ("isotonic", "platt"):
        out = L.calibrate_out_of_fold(cands, k=2, method=method)
        assert out.agg(F.min("prob").alias("a"), F.max("prob").alias("b")).first().a >= 0
    pairs = spark.createDataFrame([("a b", "a b"), ("x", "yyyyyy")], "text_a string, text_b string")
    got = {r.text_a: r.ce for r in L.rerank(pairs, L.overlap_scorer).collect()}
    assert got["a b"] > got["x"]
    assert np.isfinite(L.area_under_curve(cands, "prob"))
