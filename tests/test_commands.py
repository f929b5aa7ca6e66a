"""Every command, on small files; the pipeline from raw files to results; the run log; records as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinfold import cli, storage
from kinfold.functions import text
from kinfold.operators import decode as D
from kinfold.operators import evaluate as E
from kinfold.operators import learn as L
from kinfold.plans import linkage, runs
from kinfold.sources import files
from kinfold.streaming import incremental

WORDS = "amber basil cedar delta ember fjord garnet harbor indigo jasper kelp lunar maple nectar onyx pearl quartz raven slate topaz".split()


def write(path, header, rows):
    path.write_text("\n".join(["\t".join(header), *("\t".join(map(str, r)) for r in rows)]) + "\n")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Two splits of records: most reference records have one or two likenesses, some none."""
    folder, rng = tmp_path_factory.mktemp("raw"), random.Random(4)
    header = ("entity_id", "business_name", "business_address", "country")
    for split, n in (("train", 90), ("test", 40)):
        sources, truth = {1: [], 2: [], 3: []}, []
        for i in range(n):
            name = " ".join(rng.sample(WORDS, 3)) + f" {chr(97 + i % 26)}{chr(97 + i // 26)}works"
            address = f"{rng.randint(1, 999)} {rng.choice(WORDS)} street, {rng.choice(WORDS)}ville"
            sources[1].append((f"S1-{i}", name.title() + " Inc", address, "US"))
            true = []
            for s in (2, 3):
                if i % 4 and rng.random() < 0.8:
                    other = name.replace("a", "e", 1) if rng.random() < 0.3 else name
                    sources[s].append((f"S{s}-{i}", other + (" LLC" if rng.random() < 0.3 else ""), address if rng.random() < 0.8 else "", "US"))
                    true.append(f"S{s}-{i}")
            for s in (2, 3):
                sources[s].append((f"S{s}-x{i}", " ".join(rng.sample(WORDS, 3)), f"{rng.randint(1, 999)} {rng.choice(WORDS)} road", "US"))
            truth.append((f"S1-{i}", ",".join(true)))
        for s, rows in sources.items():
            write(folder / f"{split}_source{s}.tsv", header, rows)
        if split == "train":
            write(folder / "train_truth.tsv", ("s1_id", "matched"), truth)
    return folder


def run(capsys, *argv):
    """The JSON lines that a command prints."""
    cli.main([str(x) for x in argv])
    out = []
    for line in capsys.readouterr().out.splitlines():
        try:
            out.append(json.loads(line))
        except ValueError:
            out.append(line)
    return out


def test_pipeline_from_raw_files(spark, raw, tmp_path, capsys):
    job = ("--raw", raw, "--work", tmp_path / "work", "--out", tmp_path / "out", "--rounds", 4, "--folds", 2)
    assert run(capsys, "data", "convert", "--split", "all", *job)[0] == {s: {f"s{n}": sum(1 for _ in (raw / f"{s}_source{n}.tsv").open()) - 1 for n in (1, 2, 3)} for s in ("train", "test")}
    assert {r["src"] for r in run(capsys, "data", "profile", *job) if "median_name" in r} == {"S1", "S2", "S3"}
    run(capsys, "data", "dev", "--percent", 30, *job)
    assert (tmp_path / "out/dev/train_source1.tsv").read_text().startswith("entity_id\t") and (tmp_path / "out/dev/train_truth.tsv").exists()
    assert run(capsys, "prep", "train", *job)[0].startswith("train ")
    recall = run(capsys, "block", "train", *job)[-1]
    assert recall["recall"] >= 0.9 and recall["true_pairs"] == spark.read.parquet(str(tmp_path / "work/train/truth")).count()
    assert run(capsys, "features", "train", *job)[0] > 0
    report = run(capsys, "pipeline", "train", *job)[0]
    assert report["report"]["score"] >= 0.8 and report["report"]["n"] == 90
    gains = json.loads((tmp_path / "work/model_gains.json").read_text())
    assert gains == sorted(gains, key=lambda g: (-g[1], g[0])) and sum(g for _, g in gains) == pytest.approx(1, abs=1e-6)
    run(capsys, "pipeline", "predict", *job)
    ids = [f"S1-{i}" for i in range(40)]
    lines = (tmp_path / "out/matches.tsv").read_text().splitlines()
    assert lines[0] == "s1_id\tcand_ids" and [x.split("\t")[0] for x in lines[1:]] == ids
    check = ("--matching", tmp_path / "out/matches.tsv", "--candidate", tmp_path / "out/candidates.tsv", "--test-dir", raw, "--check-ids")
    found = run(capsys, "validate-submission", *check)
    assert "wrong_prefix 0" in found and all(str(x).endswith(" 0") for x in found)
    bad = tmp_path / "bad.tsv"
    bad.write_text("s1_id\tcand_ids\nS1-0\tS1-4,S2-0,S2-0\nno tab\nS1-0\tS2-77777\n")
    with pytest.raises(SystemExit):
        run(capsys, "validate-submission", "--matching", bad, "--test-dir", raw, "--check-ids")
    told = dict(x.split() for x in capsys.readouterr().out.splitlines())
    assert {k: int(told[k]) for k in ("no_tab", "duplicate_rows", "duplicate_ids", "wrong_prefix", "missing_references", "unknown_targets")} == {"no_tab": 1, "duplicate_rows": 1, "duplicate_ids": 1, "wrong_prefix": 1, "missing_references": 39, "unknown_targets": 3}
    second = run(capsys, "stage2", "train", *job)[0]
    assert second["report"]["score"] >= 0.8
    run(capsys, "stage2", "decode", *job)
    run(capsys, "rerank", "export", *job)
    chosen = run(capsys, "rerank", "run", *job)[0]
    assert chosen["chosen"] == max(("p1", "p2"), key=lambda k: chosen["scores"][k])
    assert [x.split("\t")[0] for x in (tmp_path / "out/matches.tsv").read_text().splitlines()[1:]] == ids
    feats, w = spark.read.parquet(str(tmp_path / "work/train/features")), linkage.Job(spark, str(raw), str(tmp_path / "work"), str(tmp_path / "out"))
    rows = linkage.ablation(feats, {"keys": [c for c in feats.columns if c.startswith("k_")]}, w.entities("train"), D.DecodeConfig(**report["config"]), rounds=2)
    assert [r["without"] for r in rows] == ["all", "keys"] and all(0 <= r["score"] <= 1 for r in rows)


def test_places(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert linkage.place("raw", None, "d") == "d" and linkage.place("raw", "x", "d") == "x"
    (tmp_path / "kinfold.json").write_text('{"raw": "c"}')
    assert linkage.place("raw", None, "d") == "c"
    monkeypatch.setenv("KINFOLD_RAW", "e")
    assert linkage.place("raw", None, "d") == "e"


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    """Candidate, truth, group and id files of a synthetic world, and two match files."""
    folder = tmp_path_factory.mktemp("scored")
    ents, truth, cands = files.synthetic(spark, 300, seed=5)
    sets = {r.s1_id: r.ids for r in truth.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("ids")).collect()}
    ids = [r.s1_id for r in ents.orderBy("s1_id").collect()]
    write(folder / "gt.tsv", ("s1_id", "matches"), [(i, ",".join(sets.get(i, []))) for i in ids])
    write(folder / "ids.tsv", ("s1_id",), [(i,) for i in reversed(ids)])
    write(folder / "groups.tsv", ("s1_id", "grp"), [tuple(r) for r in ents.collect()])
    rows = cands.withColumn("key", F.when(F.col("label"), "full|pre").otherwise("pre")).orderBy("s1_id", "cand_id").collect()
    write(folder / "cands.tsv", ("s1_id", "cand_id", "prob", "source", "key"), [(r.s1_id, r.cand_id, round(r.prob, 6), r.source, r.key) for r in rows])
    write(folder / "perfect.tsv", ("s1_id", "matches"), [(i, ",".join(sets.get(i, []))) for i in ids])
    return folder


def test_harness_commands(spark, scored, tmp_path, capsys):
    gt, cands = ("--gt", scored / "gt.tsv"), ("--cands", scored / "cands.tsv")
    config = tmp_path / "config.json"
    grid = tmp_path / "grid.json"
    grid.write_text(json.dumps({"gate": [0.3, 0.5, 0.7], "pair": [0.4, 0.6], "max_k": [1, 3]}))
    swept = run(capsys, "sweep", *gt, *cands, "--grid", grid, "--top", 3, "--out", tmp_path / "grid", "--save-config", config)
    assert len(swept) == 3 and swept[0]["score_smooth"] >= swept[1]["score_smooth"] and json.loads(config.read_text())["max_k"] in (1, 3)
    run(capsys, "decode", *cands, "--ids", scored / "ids.tsv", "--config", config, "--out", tmp_path / "pred.tsv")
    got = run(capsys, "score", *gt, "--pred", tmp_path / "pred.tsv", "--groups", scored / "groups.tsv", "--strict", "--test-s", 0.5, "--dump", tmp_path / "dump", "--log", tmp_path / "log", "--config", config, "--notes", "first")
    row = next(r for r in swept if all(r[k] == json.loads(config.read_text())[k] for k in ("gate", "pair", "max_k")))
    assert got[0]["score"] == pytest.approx(row["score"], abs=1e-9)  # the file scores as the grid said, against the truth
    assert files.read_entity_scores(spark, str(tmp_path / "dump")).agg(F.avg("score")).first()[0] == pytest.approx(got[0]["score"], abs=1e-9)
    first = got[-1]
    best = run(capsys, "score", *gt, "--pred", scored / "perfect.tsv", "--log", tmp_path / "log")
    assert best[0]["score"] == 1.0
    assert run(capsys, "compare", first, best[-1], "--log", tmp_path / "log")[0]["verdict"] == "WINS"
    assert run(capsys, "compare", scored / "perfect.tsv", best[-1], *gt, "--log", tmp_path / "log")[0]["verdict"] == "NO CHANGE"
    run(capsys, "lb", first, 0.5, "--folder", tmp_path / "log", "--notes", "sent")
    shown = run(capsys, "report", "--folder", tmp_path / "log", "--budget", 9)
    assert shown[0] == "8 of 9 submissions left" and shown[-1]["n"] == 1 and any("first; sent" in str(x) for x in shown)
    logged = {r["run"]: r for r in runs.all_runs(spark, str(tmp_path / "log"))}
    assert logged[first]["leaderboard"] == 0.5 and logged[first]["user"] and len(logged) == 2
    scenarios = {r["scenario"]: r["macro_f05"] for r in run(capsys, "oracles", *gt, *cands, "--config", config)}
    assert scenarios["current"] == pytest.approx(got[0]["score"], abs=1e-9) and scenarios["perfect blocking"] == 1.0
    audit = run(capsys, "blocking", *gt, *cands, "--n-targets", 1000, "--missed", tmp_path / "missed")
    assert 0.9 < audit[0]["pair_recall"] < 1 and audit[-1]["add_key"] in ("full", "pre")
    run(capsys, "errors", *gt, *cands, "--config", config, "--out-dir", tmp_path / "errors")
    assert (tmp_path / "errors/kind=blocking_miss").is_dir()
    calibrated = run(capsys, "calib", *gt, *cands, "--folds", 2, "--bins", 5, "--out", tmp_path / "calibrated")
    assert sum("ece" in r for r in calibrated) == 2 and (tmp_path / "calibrated").is_dir()
    assert len(run(capsys, "split", *gt, "--k", 4, "--groups", scored / "groups.tsv", "--out", tmp_path / "folds")) == 4
    nothing = run(capsys, "empty", "--ids", scored / "ids.tsv", "--out", tmp_path / "empty.tsv", *gt)
    assert nothing[0]["score"] == pytest.approx(nothing[0]["singleton_frac"])
    order = [x.split("\t")[0] for x in (tmp_path / "empty.tsv").read_text().splitlines()[1:]]
    assert order == (scored / "ids.tsv").read_text().split()[1:]
    assert all(str(x).endswith(" 0") for x in run(capsys, "validate", "--pred", tmp_path / "empty.tsv", "--ids", scored / "ids.tsv"))
    with pytest.raises(SystemExit):
        run(capsys, "validate", "--pred", tmp_path / "empty.tsv", "--ids", scored / "ids.tsv", "--sample", scored / "gt.tsv")
    shown = run(capsys, "demo", "--n", 200, "--out-dir", tmp_path / "demo")
    assert next(r for r in shown if isinstance(r, dict) and "singleton_frac" in r)["n"] == 200 and (tmp_path / "demo/matches.tsv").exists()


def test_strict_score(spark, scored, tmp_path, capsys):
    write(tmp_path / "part.tsv", ("s1_id", "matches"), [("S1-1", ""), ("S1-1", "x"), ("nobody", "y")])
    with pytest.raises(SystemExit):
        run(capsys, "score", "--gt", scored / "gt.tsv", "--pred", tmp_path / "part.tsv", "--strict")
    cli.main(["score", "--gt", str(scored / "gt.tsv"), "--pred", str(tmp_path / "part.tsv")])
    told = capsys.readouterr().err
    assert "299 missing entities" in told and "1 unknown entities" in told and "1 repeated rows" in told


def test_alignment_of_runs():
    logged = [{"run": f"r{i}", "config": {}, "report": {"score": 0.8 + i / 100}, "leaderboard": 0.78 + i / 100} for i in range(4)]
    a = runs.alignment([*logged, {"run": "far", "config": {}, "report": {"score": 0.9}, "leaderboard": 0.8}, {"run": "e", "config": {"kind": runs.PROBE}, "report": {"score": 0.3}, "leaderboard": 0.25}, {"run": "not sent", "report": {"score": 1}, "leaderboard": None}])
    assert (a["submitted"], a["n"], a["singleton_frac"]) == (6, 5, 0.25)
    assert a["gap_mean"] == pytest.approx(-0.036) and "far" in a["drifters"] and a["spearman"] == pytest.approx(8 / 95**0.5)
    assert runs.alignment([]) == {"submitted": 0, "n": 0}


def test_rows_keep_the_order_of_their_file(spark, tmp_path):
    names = [f"n{i}" for i in random.Random(1).sample(range(5000), 5000)]
    write(tmp_path / "ids.tsv", ("s1_id", "more"), [(n, "x" * 40) for n in names])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_tsv(spark, str(tmp_path / "ids.tsv"), ordered=True)
        assert df.rdd.getNumPartitions() > 3
        files.write_lists(spark.createDataFrame([("n7", ["b", "a"])], "s1_id string, cand_ids array<string>"), str(tmp_path / "out.tsv"), df.select("s1_id", "ord"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = (tmp_path / "out.tsv").read_text().splitlines()[1:]
    assert [x.split("\t")[0] for x in lines] == names and "n7\ta,b" in lines
    assert not (tmp_path / "out.tsv.parts").exists()


def test_gains_and_early_stopping(spark):
    df = spark.range(600).select(F.col("id").alias("s1_id"), (F.col("id") % 2).cast("double").alias("good"), F.rand(3).alias("noise"), (F.col("id") % 2 == 1).alias("label"))
    models: list = []
    out = L.out_of_fold(df, ["good", "noise"], k=2, early_stop=True, models=models, rounds=6, depth=2)
    assert out.count() == 600 and "__aside" not in out.columns and L.feature_gains(models, ["good", "noise"], 1)[0][0] == "good"
    assert L.area_under_curve(out, "prob") > 0.99


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Cluster)


def test_records_as_a_stream(spark, tmp_path):
    """What a stream gives is what the batch gives."""
    rows = [(f"S2-{i}", "S2", f"{WORDS[i]} Trading Inc", f"{i} {WORDS[-i]} street", "US") for i in range(1, 12)]
    names = "entity_id string, src string, business_name string, business_address string, country string"
    table = spark.createDataFrame(rows, names)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.name_keys(incremental.normalized_stream(stream)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "keys"))
    query.awaitTermination(120)
    want = {tuple(r) for r in incremental.name_keys(text.normalize_records(table)).collect()}
    assert want and {tuple(r) for r in spark.read.parquet(str(tmp_path / "keys")).collect()} == want


def test_warnings_of_inputs(spark):
    pred = spark.createDataFrame([("a", "x"), ("a", "x"), ("z", "y")], "s1_id string, cand_id string")
    ents = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    assert E.input_warnings(pred, ents) == {"missing_entities": 1, "unknown_entities": 1, "repeated_pairs": 1}
