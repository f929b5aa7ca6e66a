"""The linkage pipeline: raw files to match sets, stage by stage, each written once and skipped when it is there."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import storage
from kinfold.functions import text
from kinfold.operators import blocking as B
from kinfold.operators import decode as D
from kinfold.operators import evaluate as E
from kinfold.operators import features as X
from kinfold.operators import learn as L
from kinfold.operators import profile as P
from kinfold.session import ship
from kinfold.sources import files

#: Thresholds that training searches.
GRID = {"gate": [i / 10 for i in range(2, 9)], "pair": [i / 10 for i in range(2, 9)]}
HEADER = ("s1_id", "cand_ids")


def stage(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table ``name`` in ``folder``: read if a finished one is there, else made and written."""
    path = f"{folder}/{name}"
    if force or not storage.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def place(name: str, given: str | None, default: str) -> str:
    """Where a kind of files lies: as given, else by the variable KINFOLD_<NAME>, else by kinfold.json here, else the default."""
    if given:
        return given
    if found := os.environ.get(f"KINFOLD_{name.upper()}"):
        return found
    config = Path("kinfold.json")
    return (json.loads(config.read_text()) if config.exists() else {}).get(name, default)


def ablation(pairs: DataFrame, groups: dict[str, list[str]], entities: DataFrame, config: D.DecodeConfig, k: int = 2, rounds: int = 20) -> list[dict]:
    """Macro score without each group of features. ``entities`` holds n_true by the truth."""
    out = []
    for name, gone in {"all": [], **groups}.items():
        kept = [f for f in X.FEATURES if f not in gone]
        oof = D.assign_owner(L.out_of_fold(pairs, kept, k, rounds=rounds))
        out.append({"without": name, "score": E.report(E.entity_counts(D.marked(oof, config), entities)).first().score})
    return out


@dataclass
class Job:
    """One workspace: raw files, tables between stages, results. ``sample``: share of the reference records that training uses."""

    spark: SparkSession
    raw: str
    work: str
    out: str
    force: bool = False
    sample: float = 1.0
    k: int = 3
    rounds: int = 40

    def __post_init__(self):
        ship(self.spark)

    def table(self, split: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return stage(self.spark, f"{self.work}/{split}", name, make, self.force)

    # raw files ------------------------------------------------------------------------------------

    def source(self, split: str, n: int) -> str:
        """The raw file of a source: its name holds the split and source1, source_1 or s1."""
        names = [p for p in storage.listed(self.spark, self.raw, ".tsv") if split in p.rsplit("/", 1)[1].lower()]
        hits = [p for p in names if any(x in p.rsplit("/", 1)[1].lower() for x in (f"source{n}", f"source_{n}", f"s{n}."))]
        if len(hits) != 1:
            raise FileNotFoundError(f"{len(hits)} files of source {n} of {split} in {self.raw}")
        return hits[0]

    def truth_file(self) -> str:
        hits = [p for p in storage.listed(self.spark, self.raw, ".tsv") if "truth" in p.rsplit("/", 1)[1].lower()]
        if len(hits) != 1:
            raise FileNotFoundError(f"{len(hits)} files of the truth in {self.raw}")
        return hits[0]

    def convert(self, split: str) -> dict[str, int]:
        """Raw files to Parquet, with their rows counted."""
        return {f"s{n}": files.convert(self.spark, self.source(split, n), f"{self.work}/{split}/raw_s{n}", force=self.force) for n in (1, 2, 3)}

    def records(self, split: str) -> DataFrame:
        self.convert(split)
        parts = [self.spark.read.parquet(f"{self.work}/{split}/raw_s{n}").withColumn("src", F.lit(f"S{n}")) for n in (1, 2, 3)]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def truth(self) -> DataFrame:
        """Pairs (s1_id, cand_id)."""
        return self.table("train", "truth", lambda: files.pairs_of(files.read_match_sets(self.spark, self.truth_file())))

    def entities(self, split: str) -> DataFrame:
        ents = self.records(split).where("src = 'S1'").select(F.col("entity_id").alias("s1_id"))
        return E.with_n_true(ents, self.truth) if split == "train" else ents

    def dev(self, percent: int = 10) -> None:
        """A consistent part of the training data, as Parquet and as raw files."""
        part = self.table("dev", f"records_{percent}", lambda: P.dev_subset(self.records("train"), self.truth, percent))
        kept = part.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"))
        for n in (1, 2, 3):
            part.where(F.col("src") == f"S{n}").drop("src").write.mode("overwrite").parquet(f"{self.work}/dev/s{n}")
            files.parquet_to_tsv(self.spark, f"{self.work}/dev/s{n}", f"{self.out}/dev/train_source{n}.tsv")
        sets = self.truth.join(kept, "s1_id", "left_semi").groupBy("s1_id").agg(F.collect_set("cand_id").alias("cand_ids"))
        files.write_lists(kept.join(sets, "s1_id", "left").withColumn("cand_ids", F.coalesce("cand_ids", F.array().cast("array<string>"))), f"{self.out}/dev/train_truth.tsv")

    # stages ---------------------------------------------------------------------------------------

    def normalized(self, split: str) -> DataFrame:
        return self.table(split, "normalized", lambda: text.normalize_records(self.records(split)))

    def candidates(self, split: str) -> DataFrame:
        """Keys and candidates with hops. Keys are read three times by what follows, so they are written."""
        norm = self.normalized(split)
        keys = self.table(split, "keys", lambda: B.build_keys(norm))
        first = self.table(split, "first_candidates", lambda: B.build_candidates(keys))
        return self.table(split, "candidates", lambda: B.add_hops(first, norm))

    def features(self, split: str) -> DataFrame:
        """Features of the candidates, of a share of the reference records where a sample is asked for in training."""

        def make():
            df = X.pair_features(self.candidates(split), self.normalized(split))
            if split != "train":
                return df
            return B.label(P.sample(df, "s1_id", self.sample) if self.sample < 1 else df, self.truth)

        return self.table(split, "features", make)

    def trained_entities(self) -> DataFrame:
        ents = self.entities("train")
        return P.sample(ents, "s1_id", self.sample) if self.sample < 1 else ents

    def _pick(self, oof: DataFrame) -> dict:
        """The best thresholds on out-of-fold scores, as they are or each target with its best entity only, whichever scores higher."""
        ents, best = self.trained_entities(), None
        for assign in (True, False):
            cands = D.assign_owner(oof) if assign else oof
            config = E.best_config(E.grid_search(cands, ents, GRID))
            row = E.report(E.entity_counts(D.marked(cands, config), ents)).first().asDict()
            if best is None or row["score"] > best["report"]["score"]:
                best = {"config": config.as_dict(), "assign": assign, "report": row}
        return best

    def _save(self, name: str, value) -> None:
        storage.write_text(self.spark, f"{self.work}/{name}.json", json.dumps(value, indent=1))

    def load(self, name: str):
        return json.loads(storage.read_text(self.spark, f"{self.work}/{name}.json"))

    def _learn(self, name: str, pairs: DataFrame, columns: list[str]) -> dict:
        """Out-of-fold scores with early stopping, thresholds and gains."""
        models: list = []
        oof = self.table("train", f"{name}_oof", lambda: L.out_of_fold(pairs, columns, self.k, early_stop=True, models=models, rounds=self.rounds).select("s1_id", "cand_id", "prob", "label"))
        picked = self._pick(oof)
        if models:
            self._save(f"{name}_gains", L.feature_gains(models, columns))
        self._save(f"{name}_config", picked)
        return picked

    def train(self) -> dict:
        return self._learn("model", self.features("train"), list(X.FEATURES))

    def fit(self) -> None:
        """The model of all pairs."""
        L.train_gbt(self.features("train"), X.FEATURES, rounds=self.rounds).write().overwrite().save(f"{self.work}/model")

    def predict(self, split: str = "test") -> DataFrame:
        feats = self.features(split)
        return self.table(split, "scores", lambda: L.score(PipelineModel.load(f"{self.work}/model"), feats, X.FEATURES).select("s1_id", "cand_id", "prob"))

    def write_results(self, scores: DataFrame, picked: dict) -> None:
        """matches.tsv and candidates.tsv of the test records, in the order of their file."""
        order = files.read_tsv(self.spark, self.source("test", 1), ordered=True).select(F.trim("entity_id").alias("s1_id"), "ord")
        sets = D.decode(D.assign_owner(scores) if picked["assign"] else scores, order.select("s1_id"), D.DecodeConfig(**picked["config"]))
        files.write_lists(sets, f"{self.out}/matches.tsv", order, HEADER)
        lists = self.candidates("test").groupBy("s1_id").agg(F.collect_set("cand_id").alias("cand_ids"))
        files.write_lists(lists, f"{self.out}/candidates.tsv", order, HEADER)

    def decode(self) -> None:
        self.write_results(self.predict(), self.load("model_config"))

    # second stage and re-ranking ------------------------------------------------------------------

    def _second(self, split: str, scores: DataFrame) -> DataFrame:
        """Features with the first score in its context."""
        base = self.features(split).join(scores.select("s1_id", "cand_id", F.col("prob").alias("p1")), ["s1_id", "cand_id"])
        return self.table(split, "second_features", lambda: X.sibling_features(X.interactions(X.score_context(base)), self.normalized(split)))

    def second_stage(self) -> dict:
        """A second classifier that sees the first one's scores in context."""
        self.train()
        df, columns = self._second("train", self.spark.read.parquet(f"{self.work}/train/model_oof")), [*X.FEATURES, *X.SCORE_CONTEXT]
        picked = self._learn("second", df, columns)
        L.train_gbt(df, columns, rounds=self.rounds).write().overwrite().save(f"{self.work}/second_model")
        return picked

    def second_decode(self) -> None:
        df = self._second("test", self.predict())
        scores = self.table("test", "second_scores", lambda: L.score(PipelineModel.load(f"{self.work}/second_model"), df, [*X.FEATURES, *X.SCORE_CONTEXT]).select("s1_id", "cand_id", "prob"))
        self.write_results(scores, self.load("second_config"))

    def rerank_export(self, least: float = 0.01) -> None:
        """Pairs with a first score of ``least`` or more, of both splits, with labels where they are known, and the texts of their records."""
        for split in ("train", "test"):
            pairs = self.spark.read.parquet(f"{self.work}/train/model_oof") if split == "train" else self.predict()
            pairs = pairs.where(F.col("prob") >= least).withColumnRenamed("prob", "p1")
            pairs.write.mode("overwrite").parquet(f"{self.work}/{split}/rerank_pairs")
            pairs = self.spark.read.parquet(f"{self.work}/{split}/rerank_pairs")
            ids = pairs.select(F.col("s1_id").alias("entity_id")).union(pairs.select("cand_id")).distinct()
            L.texts(self.records(split), ids).write.mode("overwrite").parquet(f"{self.work}/{split}/rerank_texts")

    def rerank(self, scorer: Callable[[list[str], list[str]], list[float]] = L.overlap_scorer) -> dict:
        """Scores uncertain pairs again, fits a blend on one half of the entities, and decodes by it if that scores higher on the other half.

        ``scorer`` takes two lists of texts and gives a list of scores; by default it is the stand-in.
        """

        def blended(split):
            pairs = self.spark.read.parquet(f"{self.work}/{split}/rerank_pairs")
            t = self.spark.read.parquet(f"{self.work}/{split}/rerank_texts")
            sure = L.band(pairs).join(t.toDF("s1_id", "text_a"), "s1_id").join(t.toDF("cand_id", "text_b"), "cand_id")
            return pairs, self.table(split, "reranked", lambda: L.rerank(sure, scorer).drop("text_a", "text_b"))

        pairs, scored = blended("train")
        half = lambda df: df.withColumn("half", P.split_of(F.col("s1_id"), 50, 50))
        model = L.fit_blend(half(scored).where("half = 0"))
        merge = lambda pairs, df: pairs.join(L.apply_blend(model, df).select("s1_id", "cand_id", "p2"), ["s1_id", "cand_id"], "left").withColumn("p2", F.coalesce("p2", "p1"))
        held = half(merge(pairs, scored)).where("half = 1")
        ents = half(self.trained_entities()).where("half = 1")
        config = self.load("model_config")
        cfg, scores = D.DecodeConfig(**config["config"]), {}
        for name in ("p1", "p2"):
            cands = held.withColumn("prob", F.col(name))
            scores[name] = E.report(E.entity_counts(D.marked(D.assign_owner(cands) if config["assign"] else cands, cfg), ents)).first().score
        better = max(("p1", "p2"), key=lambda n: scores[n])
        test_pairs, test_scored = blended("test")
        self.write_results(merge(test_pairs, test_scored).select("s1_id", "cand_id", F.col(better).alias("prob")), config)
        return {"scores": scores, "chosen": better}

    def all(self) -> dict:
        """Raw files to results with the first model."""
        report = self.train()
        self.fit()
        self.decode()
        return report
