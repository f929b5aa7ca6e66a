"""Commands: python -m kinfold.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import storage
from kinfold.operators import blocking as B
from kinfold.operators import decode as D
from kinfold.operators import evaluate as E
from kinfold.operators import learn as L
from kinfold.operators import profile as P
from kinfold.operators import validate as V
from kinfold.plans import linkage, runs
from kinfold.session import ship
from kinfold.sources import files


def session() -> SparkSession:
    return ship(SparkSession.builder.appName("kinfold").getOrCreate())


def config_of(path: str | None) -> D.DecodeConfig:
    return replace(D.DecodeConfig(), **json.loads(Path(path).read_text())) if path else D.DecodeConfig()


def warn(**counts: int) -> None:
    for name, n in counts.items():
        if n:
            print(f"warning: {n} {name.replace('_', ' ')}", file=sys.stderr)


def truth_of(spark, path) -> tuple[DataFrame, DataFrame]:
    """Entities with n_true, and true pairs."""
    sets = files.read_match_sets(spark, path)
    return sets.select("s1_id", F.size("cand_ids").alias("n_true")), files.pairs_of(sets)


def labelled(spark, paths: list[str], truth: DataFrame, ents: DataFrame) -> DataFrame:
    from kinfold.operators.blocking import label

    df = D.deduplicate(reduce(DataFrame.unionByName, [files.read_candidates(spark, p) for p in paths]))
    warn(candidates_of_unknown_entities=D.unknown_entities(df, ents))
    return label(df, truth)


def say(df: DataFrame) -> None:
    for r in df.collect():
        print(json.dumps(r.asDict(), default=str))


def score(a):
    spark = session()
    ents, truth = truth_of(spark, a.gt)
    pred = files.read_match_sets(spark, a.pred)
    counts = E.input_warnings(files.pairs_of(pred), ents) | {"missing_entities": ents.join(pred, "s1_id", "left_anti").count(), "repeated_rows": files.repeated_rows(spark, a.pred), "rows_with_too_many_fields": files.too_wide(spark, a.pred)}
    if a.strict and (counts["missing_entities"] or counts["unknown_entities"]):
        raise SystemExit(f"missing or unknown entities: {counts}")
    warn(**counts)
    table = E.per_entity(files.pairs_of(pred), truth, ents.select("s1_id"))
    row = E.report(table)
    say(row)
    say(E.by_true_size(table))
    if a.groups:
        say(E.by_group(table.join(files.read_groups(spark, a.groups), "s1_id", "left")))
    if a.test_s is not None:
        say(E.project(row, a.test_s))
    if a.dump:
        files.write_entity_scores(table, a.dump)
    mean, lo, hi = E.bootstrap_interval(table)
    print(json.dumps({"mean": mean, "low": lo, "high": hi}))
    if a.log:
        print(runs.log_run(spark, a.log, config_of(a.config).as_dict(), row.first().asDict(), (mean, lo, hi), table, a.notes))


def compare(a):
    """Each side is a match file or the id of a logged run."""
    spark = session()
    ents, truth = truth_of(spark, a.gt) if a.gt else (None, None)

    def side(x):
        if a.log and storage.exists(spark, f"{a.log}/{x}.json"):
            return runs.entity_table(spark, a.log, x)
        if ents is None:
            raise SystemExit("a match file needs --gt")
        return E.per_entity(files.pairs_of(files.read_match_sets(spark, x)), truth, ents.select("s1_id"))

    print(json.dumps(E.paired_bootstrap(side(a.a), side(a.b), a.n_boot)))


def sweep(a):
    spark = session()
    ents, truth = truth_of(spark, a.gt)
    grid = json.loads(Path(a.grid).read_text()) if a.grid else {"gate": [i / 20 for i in range(4, 18)], "pair": [i / 20 for i in range(3, 19)], "rel": [0.0, 0.5, 0.8]}
    base = config_of(a.base)
    table = E.grid_search(labelled(spark, a.cands, truth, ents), ents, grid, base).cache()
    say(table.orderBy(F.desc("score" if a.argmax else "score_smooth"), F.desc("score")).limit(a.top))
    pick = E.best_config(table, base, robust=not a.argmax)
    for line in E.edge_warnings(pick, grid):
        print(line, file=sys.stderr)
    if a.out:
        table.write.mode("overwrite").csv(a.out, sep="\t", header=True)
    if a.save_config:
        Path(a.save_config).write_text(json.dumps(pick.as_dict()))


def ordered_ids(spark, path: str) -> DataFrame:
    df = files.read_tsv(spark, path, ordered=True)
    return df.select(F.trim(F.col(df.columns[0])).alias("s1_id"), "ord")


def decode(a):
    spark = session()
    cands, order = reduce(DataFrame.unionByName, [files.read_candidates(spark, p) for p in a.cands]), ordered_ids(spark, a.ids)
    warn(candidates_of_unknown_entities=D.unknown_entities(cands, order))
    files.write_lists(D.decode(cands, order, config_of(a.config)), a.out, order, (a.id_header, a.match_header))


def oracles(a):
    spark = session()
    ents, truth = truth_of(spark, a.gt)
    c, cfg = labelled(spark, a.cands, truth, ents), config_of(a.config)
    say(E.oracles(D.marked(c, cfg), D.marked(c, replace(cfg, gate=float("-inf"))), ents))


def errors(a):
    spark = session()
    ents, truth = truth_of(spark, a.gt)
    table = E.error_pairs(D.marked(labelled(spark, a.cands, truth, ents), config_of(a.config)), truth, ents)
    # one folder a kind, the most confident first: parts are ranges of the order
    table.orderBy("kind", F.desc_nulls_last("prob"), "s1_id", "cand_id").write.mode("overwrite").partitionBy("kind").csv(a.out_dir, sep="\t", header=True)


def blocking(a):
    spark = session()
    ents, truth = truth_of(spark, a.gt)
    c = labelled(spark, a.cands, truth, ents)
    say(E.blocking_audit(c, truth, ents, a.n_targets))
    if "key" in c.columns:
        c = c.withColumn("keys", F.split("key", "\\|"))
        n = truth.agg(F.count("*").alias("n"))
        say(E.per_key(c, n))
        for row in E.greedy_keys(c, n.first().n):
            print(json.dumps(row))
    if a.missed:
        truth.join(c, ["s1_id", "cand_id"], "left_anti").write.mode("overwrite").csv(a.missed, sep="\t", header=True)


def calib(a):
    spark = session()
    ents, truth = truth_of(spark, a.gt)
    c = labelled(spark, a.cands, truth, ents)
    calibrated = L.calibrate_out_of_fold(c, a.folds, a.method)
    if a.out:
        calibrated.select("s1_id", "cand_id", "prob").write.mode("overwrite").csv(a.out, sep="\t", header=True)
    for df in (c, calibrated):
        table = E.calibration(df, a.bins).cache()
        say(table.orderBy("bin"))
        say(E.calibration_error(table))


def split(a):
    spark = session()
    ents, _ = truth_of(spark, a.gt)
    groups = files.read_groups(spark, a.groups) if a.groups else None
    ents = ents.join(groups, "s1_id", "left") if groups is not None else ents.withColumn("grp", F.lit(None).cast("string"))
    folds = E.kfold(ents, a.k, a.seed)
    say(E.fold_balance(folds).orderBy("fold"))
    folds.select("s1_id", "fold").write.mode("overwrite").csv(a.out, sep="\t", header=True)


def empty(a):
    """The file that leaves all sets empty; with a truth, what it would score."""
    spark = session()
    ids = ordered_ids(spark, a.ids)
    files.write_lists(ids.select("s1_id", F.array().cast("array<string>").alias("cand_ids")), a.out, ids)
    if a.gt:
        ents, truth = truth_of(spark, a.gt)
        say(E.report(E.per_entity(truth.where("false"), truth, ents.select("s1_id"))))


def _named(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*[*names, *df.columns[len(names) :]])


def validate(a):
    spark = session()
    lists = _named(files.read_tsv(spark, a.pred), "s1_id", "ids")
    refs = _named(files.read_tsv(spark, a.ids), "s1_id")
    targets = _named(files.read_tsv(spark, a.targets), "cand_id") if a.targets else None
    found = [(r.check, r.n) for r in V.violations(lists, refs, targets).collect()]
    if a.sample:
        found.append(("other_columns_than_the_sample", int(V.header_differs(spark, a.pred, a.sample))))
    _tell(found)


def _tell(found: list[tuple[str, int]]) -> None:
    for check, n in found:
        print(check, n)
    if any(n for _, n in found):
        raise SystemExit(1)


def validate_submission(a):
    """Match file, and candidate file, against the raw test files."""
    spark = session()
    job = linkage.Job(spark, a.test_dir, a.test_dir, a.test_dir)
    refs = files.read_tsv(spark, job.source("test", 1)).select(F.trim("entity_id").alias("s1_id"))
    targets = reduce(DataFrame.union, [files.read_tsv(spark, job.source("test", n)).select(F.trim("entity_id").alias("cand_id")) for n in (2, 3)]) if a.check_ids else None
    header, found = (a.id_header, a.match_header), []
    for path in [a.matching, *([a.candidate] if a.candidate else [])]:
        found += V.check_file(spark, path, header, refs, targets, ("S2-", "S3-"))
    if a.candidate:
        pairs = lambda p: files.pairs_of(files.read_match_sets(spark, p))
        warn(matches_outside_the_candidates=V.outside_candidates(pairs(a.matching), pairs(a.candidate)).count())
    _tell(found)


def leaderboard(a):
    runs.set_leaderboard(session(), a.folder, a.run_id, a.score, a.notes)


def report(a):
    table = runs.all_runs(session(), a.folder)
    print(runs.render(table, a.budget))
    print(json.dumps(runs.alignment(table)))


def profile(a):
    spark = session()
    df = reduce(DataFrame.unionByName, [files.read_tsv(spark, p).withColumn("src", F.substring("entity_id", 1, 2)) for p in a.records])
    say(P.profile_sources(df))
    say(P.country_summary(df))


def demo(a):
    spark = session()
    ents, truth, cands = files.synthetic(spark, a.n)
    ents = E.with_n_true(ents, truth)
    pick = E.best_config(E.grid_search(cands, ents, {"gate": [0.3, 0.5, 0.7], "pair": [0.3, 0.5, 0.7]}))
    print(json.dumps(pick.as_dict()))
    marked = D.marked(cands, pick)
    say(E.report(E.entity_counts(marked, ents)))
    say(E.oracles(marked, D.marked(cands, replace(pick, gate=float("-inf"))), ents))
    if a.out_dir:
        files.write_lists(D.decode(cands, ents, pick), f"{a.out_dir}/matches.tsv")


# --- the pipeline ---------------------------------------------------------------------------------


def job_of(a) -> linkage.Job:
    here = lambda name, default: linkage.place(name, getattr(a, name), default)
    return linkage.Job(session(), here("raw", "data/raw"), here("work", "data/work"), here("out", "data/out"), a.force, a.sample, a.folds, a.rounds)


def data(a):
    job = job_of(a)
    splits = [s for s in ("train", "test") if a.split in (s, "all")]
    if a.what in ("convert", "all"):
        print(json.dumps({s: job.convert(s) for s in splits}))
    if a.what in ("dev", "all"):
        job.dev(a.percent)
    if a.what in ("profile", "all"):
        for s in splits:
            say(P.profile_sources(job.records(s)))
            say(P.country_summary(job.records(s)))


def prep(a):
    job = job_of(a)
    for s in ("train", "test"):
        if a.split in (s, "all"):
            print(s, job.normalized(s).count())


def block(a):
    job = job_of(a)
    cands = job.candidates(a.split)
    say(B.block_statistics(job.spark.read.parquet(f"{job.work}/{a.split}/keys")))
    if a.split == "train":
        say(B.recall_report(cands, job.truth))


def features(a):
    print(job_of(a).features(a.split).count())


def model(a):
    job = job_of(a)
    if a.what == "train":
        print(json.dumps(job.train()))
    elif a.what == "fit":
        job.fit()
    elif a.what == "predict":
        print(job.predict().count())
    else:
        job.decode()


def second(a):
    job = job_of(a)
    if a.what == "train":
        print(json.dumps(job.second_stage()))
    else:
        job.second_decode()


def rerank(a):
    job = job_of(a)
    if a.what == "export":
        job.rerank_export()
    else:
        print(json.dumps(job.rerank()))


def pipeline(a):
    job = job_of(a)
    if a.what in ("all", "train"):
        print(json.dumps(job.train()))
        job.fit()
    if a.what in ("all", "predict"):
        job.decode()


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name, fn, **options):
        p = commands.add_parser(name)
        for option, kind in options.items():
            positional = option.startswith("_")
            flag = option.lstrip("_") if positional else "--" + option.replace("_", "-")
            kind = kind if isinstance(kind, dict) else {"required": True} if kind is True else {"default": kind, "type": type(kind)} if kind is not None else {}
            p.add_argument(flag, **({} if positional and kind == {"required": True} else kind))
        p.set_defaults(fn=fn)

    many, switch = {"nargs": "+", "required": True}, {"action": "store_true"}
    choice = lambda *names: {"choices": names}
    number = {"type": int}
    command("score", score, gt=True, pred=True, groups=None, strict=switch, test_s={"type": float}, dump=None, log=None, config=None, notes="")
    command("compare", compare, _a=True, _b=True, gt=None, log=None, n_boot=2000)
    command("sweep", sweep, gt=True, cands=many, grid=None, base=None, argmax=switch, top=10, out=None, save_config=None)
    command("decode", decode, cands=many, ids=True, config=None, out=True, id_header="s1_id", match_header="cand_ids")
    command("oracles", oracles, gt=True, cands=many, config=None)
    command("blocking", blocking, gt=True, cands=many, n_targets=number, missed=None)
    command("errors", errors, gt=True, cands=many, config=None, out_dir=True)
    command("calib", calib, gt=True, cands=many, bins=10, folds=3, out=None, method="isotonic")
    command("split", split, gt=True, k=3, groups=None, seed=0, out=True)
    command("empty", empty, ids=True, out=True, gt=None)
    command("lb", leaderboard, _run_id=True, _score={"type": float}, folder=True, notes="")
    command("report", report, folder=True, budget=number)
    command("validate", validate, pred=True, ids=True, targets=None, sample=None)
    command("validate-submission", validate_submission, matching=True, candidate=None, test_dir=True, check_ids=switch, id_header="s1_id", match_header="cand_ids")
    command("profile", profile, records=many)
    command("demo", demo, n=2000, out_dir=None)
    job = {"raw": None, "work": None, "out": None, "force": switch, "sample": 1.0, "folds": 3, "rounds": 40}
    command("data", data, _what=choice("convert", "dev", "profile", "all"), split="train", percent=10, **job)
    command("prep", prep, _split=choice("train", "test", "all"), **job)
    command("block", block, _split=choice("train", "test"), **job)
    command("features", features, _split=choice("train", "test"), **job)
    command("model", model, _what=choice("train", "predict", "fit", "decode"), **job)
    command("stage2", second, _what=choice("train", "decode"), **job)
    command("rerank", rerank, _what=choice("export", "run"), **job)
    command("pipeline", pipeline, _what=choice("all", "train", "predict"), **job)
    a = top.parse_args(argv)
    a.fn(a)


if __name__ == "__main__":
    main()
