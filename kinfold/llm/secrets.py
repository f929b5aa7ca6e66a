"""Secret scans with Spark expressions only.

Three base patterns (assignments, access keys, long hex runs) are joined by character Markov
models: one of random strings, one of ordinary identifiers, both learnt from labelled samples, as is the threshold.
A long token whose log-likelihood ratio favours the random model is a span of kind ``markov``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "markov")
#: The look-ahead only makes places fail early where no keyword can start.
ASSIGN = r"(?=[pstaPSTA])(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
#: A run of 16 or more after AKIA is a whole match of 20 or more; a shorter run is dropped with all that starts in it.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Tokens that the Markov models judge.
TOKEN_LEAST = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}"
#: Of FOLDS folds of the samples, the one that tests hold out, and the one that the threshold is fitted on; the rest train.
FOLDS, TEST_FOLD, THRESHOLD_FOLD = 5, 0, 1
#: Share of the strings of each kind that the threshold may leave aside.
FALSE_SHARE = 0.001
#: Odds for a random string that a token needs, at least.
ODDS = 1000
MASK = "[SECRET]"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: States of a model: 0 stands for any other character.
STATES = len(ALPHABET) + 1
#: Labelled sample strings of each kind: a fixed bound.
SAMPLES = 4000
#: Words of the ordinary identifiers in the labelled samples.
WORDS = (
    "account action address admin agent array async base batch binary block body branch buffer build bytes cache call cell channel check child class clear client close cluster code column command commit common config connect content "
    "context control copy count create current data date debug default delete depth detail device direct disk document domain driver edge element email encode engine entry error event exec export extra factory fail feature field file filter "
    "first flag float folder format frame from function global graph group handle hash header height host image import index info input insert internal item iterator join key label language last layer layout length level library license "
    "limit line link list load local lock log main manager map mask master match max merge message method min mode model module mount name network next node null number object offset open option order output owner package page parent "
    "parse part path pattern point pool port post prefix print process project property proxy public query queue range read record region release remove render report request reset resource response result return role root route row run "
    "sample schema scope search section select sender sequence server service session set shape shared size sort source split stack stage start state static status step stop storage stream string style system table tag target task temp test text "
    "thread time title token total trace track tree trigger type unit update upload user utils value vector version view wait web width window with word worker write zone"
).split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """id, fold, text, label of strings made by rule: label 1 random (base64, hex, letters and digits), 0 ordinary identifiers."""
    words = F.split(F.lit(" ".join(WORDS)), " ")

    def pick(salt: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))

    style = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(5))
    parts = [pick(k) for k in range(4)]
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *parts))
        .when(style == 1, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]))
        .when(style == 2, F.concat(*[F.initcap(p) for p in parts], F.pmod("id", F.lit(100)).cast("string")))
        .when(style == 3, F.concat_ws("-", *parts))
        .otherwise(F.concat_ws("/", *parts, F.upper(parts[0])))
    )
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = F.when(style < 3, F.base64(digest)).when(style == 3, F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 224)).otherwise(F.regexp_replace(F.base64(digest), "[+/=]", ""))
    made = spark.range(0, n, 1, 2)
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    return made.select("id", fold, ordinary.alias("text"), F.lit(0).alias("label")).unionAll(made.select("id", fold, random.alias("text"), F.lit(1).alias("label")))


@dataclass(frozen=True)
class Model:
    """ratios: log-likelihood ratio of each transition; least: the mean ratio (nats a character) from which a token is a secret."""

    ratios: list[float]
    least: float


def fit(labelled: DataFrame) -> Model:
    """Train on the folds that are neither tested nor used for the threshold, and fit the threshold on its own fold.

    The threshold lies halfway between what all but FALSE_SHARE of that fold's ordinary strings stay under and
    what all but FALSE_SHARE of its random ones reach, but not below ODDS to one for a token of the least length,
    as most long tokens of texts are no secrets. Strings of the training folds are left out of it. One row comes
    to the driver.
    """
    trained = labelled.where(f"fold not in ({TEST_FOLD}, {THRESHOLD_FOLD})")
    ratios = train(trained)
    fresh = labelled.where((F.col("fold") == THRESHOLD_FOLD) & (F.length("text") > 0)).join(trained.select("text"), "text", "left_anti")
    at = lambda y, share: F.percentile(F.when(F.col("label") == y, mean_ratio(F.col("text"), ratios)), share)
    low, high = fresh.agg(at(0, 1 - FALSE_SHARE), at(1, FALSE_SHARE)).first()
    return Model(ratios, max(math.log(ODDS) / TOKEN_LEAST, ((low or 0.0) + (high or 0.0)) / 2))


def _states(token: Column) -> Column:
    """The state of each character."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(labelled: DataFrame) -> list[float]:
    """log P(random) - log P(ordinary) of each transition (from * STATES + to), add-one smoothed.

    ``labelled``: text and label (1 random, 0 ordinary); rows with a null are passed over. What comes
    to the driver is at most 2 * STATES * STATES counts, whatever the number of samples.
    """
    steps = labelled.where("text is not null and label is not null").select("label", _states(F.col("text")).alias("s"))
    pairs = steps.select("label", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0)))), "s", lambda a, b: a * STATES + b)).alias("t"))
    counts = {(r.label, r.t): r.n for r in pairs.groupBy("label", "t").agg(F.count("*").alias("n")).collect()}
    from_sum = {(y, a): sum(counts.get((y, a * STATES + b), 0) for b in range(STATES)) for y in (0, 1) for a in range(STATES)}
    log = lambda y, a, b: math.log((counts.get((y, a * STATES + b), 0) + 1.0) / (from_sum[y, a] + STATES))
    return [log(1, a, b) - log(0, a, b) for a in range(STATES) for b in range(STATES)]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, a character."""
    # one literal, folded to an array once, instead of thousands in every plan
    table, s = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>"), _states(token)
    steps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(s, 1, F.size(s) - 1)), s, lambda a, b: F.element_at(table, a * STATES + b + 1))
    return F.when(F.length(token) > 0, F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / F.length(token))


def _found(text: Column, pattern: str, take) -> Column:
    """An array made by ``take`` where the pattern occurs, else an empty one: most texts are read once."""
    return F.when(text.rlike(pattern), take).otherwise(F.array())


SPANS = "array<struct<s:int,k:int,e:int>>"


def _let(x: Column, of) -> Column:
    """``of(x)`` with x computed once, however often it is used."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array cut in parts of about the root of its length, so that work on parts grows with its power of 1.5 at most."""
    step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(values))).cast("int"))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(1), F.size(values), step), lambda s: F.slice(values, s, step)))


def _running(values: Column, add) -> Column:
    """For each of the integers what ``add`` makes of 0 and all before it."""

    def of(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), add))
        heads = F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(add(F.element_at(acc, -1), t))))
        within = lambda c, head: F.slice(F.aggregate(c, F.array(head), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))), 1, F.size(c))
        return F.flatten(F.transform(F.filter(F.arrays_zip(chunks.alias("c"), heads.alias("h")), lambda p: p["c"].isNotNull()), lambda p: within(p["c"], p["h"])))

    return F.coalesce(_let(_chunks(values), of), F.array().cast("array<int>"))


def _spans(kind: int, matches: Column, gaps: Column, good: Column | None = None) -> Column:
    """Spans (s, k, e) from the lengths of matches and of what stands between them."""
    good = F.transform(matches, lambda _: F.lit(True)) if good is None else good
    rows = F.arrays_zip(matches.alias("n"), F.slice(gaps, 1, F.size(matches)).alias("gap"), good.alias("good"))

    def of(rows):
        before = _running(F.transform(rows, lambda x: x["n"] + x["gap"]), lambda a, b: a + b)
        both = F.zip_with(rows, before, lambda x, at: F.struct((at + x["gap"]).alias("s"), F.lit(kind).alias("k"), (at + x["gap"] + x["n"]).alias("e"), x["good"].alias("good")))
        return F.transform(F.filter(both, lambda x: x["good"]), lambda x: F.struct(x["s"], x["k"], x["e"]))

    return _let(rows, of)


def _outside(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``; both are in order of their starts."""

    def of(chunk, base):
        near = F.filter(base, lambda b: (b["s"] < F.element_at(chunk, -1)["e"]) & (F.element_at(chunk, 1)["s"] < b["e"]))
        return _let(near, lambda near: F.filter(chunk, lambda m: ~F.exists(near, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))))

    return _let(base, lambda base: _let(_chunks(spans), lambda chunks: F.flatten(F.transform(chunks, lambda c: of(c, base)))))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (arrays of s, k, e: code points, end exclusive, k the place in KINDS) for every row.

    Base spans are leftmost and do not overlap within a kind; markov spans overlap no base span. Null
    texts are empty; null ids stay null; repeated rows are each scanned. ``keep``: columns to carry.
    """
    model = fit(samples(docs.sparkSession)) if model is None else model
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    t = F.col("__t")
    lengths = lambda a: F.transform(a, F.length)
    cols = {}
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("markov", TOKEN)):
        cols[f"m_{kind}"] = _found(t, pattern, lengths(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
        cols[f"g_{kind}"] = _found(t, pattern, lengths(F.split(t, pattern, -1)))
    cols["v_assign"] = _found(t, ASSIGN, F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= ASSIGN_LEAST))
    cols["v_markov"] = _found(t, TOKEN, F.transform(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda v: mean_ratio(v, model.ratios) >= model.least))
    df = df.withColumns({k: v for k, v in cols.items()})
    none = F.array().cast(SPANS)
    made = {f"s_{kind}": F.when(F.size(f"m_{kind}") > 0, _spans(i, F.col(f"m_{kind}"), F.col(f"g_{kind}"), F.col(f"v_{kind}") if f"v_{kind}" in cols else None)).otherwise(none) for i, kind in enumerate(KINDS)}
    df = df.withColumns(made).withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    free = F.when(F.size("base") > 0, _outside(F.col("s_markov"), F.col("base"))).otherwise(F.col("s_markov"))
    df = df.withColumn("spans", F.when(F.size("s_markov") > 0, F.array_sort(F.concat("base", free))).otherwise(F.col("base")))
    return df.select("doc_id", "base", "spans", F.col("__t").alias("text"), *[F.col(f"__keep_{c}").alias(c) for c in keep])


def _text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans (kind:start:end, comma-joined)."""
    count = lambda col, k: F.size(F.filter(col, lambda x: x["k"] == k)).cast("long")
    return scan(docs, model).select(
        "doc_id", *[count("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])], count("spans", 3).alias("n_markov"), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans")
    )


def _pieces(spans: Column) -> Column:
    """(at, s) of the text that stays in front of each span; a span that begins inside those before it adds nothing."""
    rows = lambda x: F.zip_with(x, _running(F.transform(x, lambda y: y["e"]), lambda a, b: F.greatest(a, b)), lambda y, at: F.struct(at.alias("at"), y["s"].alias("s")))
    return F.filter(_let(spans, rows), lambda x: x["s"] >= x["at"])


def _masked(text: Column, pieces: Column) -> Column:
    """The pieces of a text, each with a mask behind it, cut chunk by chunk, as finding a place in a text takes as long as the text is."""

    def of(c):
        start = F.element_at(c, 1)["at"]
        part = F.substring(text, start + 1, F.element_at(c, -1)["s"] - start)
        return _let(part, lambda part: F.array_join(F.transform(c, lambda x: F.concat(F.substring(part, x["at"] - start + 1, x["s"] - x["at"]), F.lit(MASK))), ""))

    return _let(_chunks(pieces), lambda chunks: F.array_join(F.transform(chunks, of), ""))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of ``documents``, every span of a secret replaced by ``[SECRET]`` (overlapping spans by one).

    n_chars is counted anew where a text has changed; texts without a span, null ones too, pass unchanged.
    """
    keep = ("text", "lang", "source", "n_chars")
    df = scan(docs, model, keep=keep)
    df = df.toDF("doc_id", "base", "spans", "t", *keep)
    df = df.withColumn("pieces", F.when(F.size("spans") > 0, _pieces(F.col("spans"))))
    df = df.withColumn("end", F.array_max(F.transform("spans", lambda x: x["e"])))
    clean = F.concat(_masked(F.col("t"), F.col("pieces")), F.substring(F.col("t"), F.col("end") + 1, F.length("t")))
    df = df.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return df.select("doc_id", "text", "lang", "source", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")).alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))
