"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes (insult, threat, target, negation, report, quotation mark); small transducers for
negation, quotations, reported speech, targets and clause borders are composed into one, which reads a text
once and gives the kind of each clause. The kinds of clauses, not isolated words, are weighted: a direct
insult never counts less than one without a target, and a negated or reported one never more.

From a bounded sample of labelled rows are learnt the insult lexicon (whole words and word beginnings), the
words of context (a seed stays only where the labels don't contradict it; words before a match that make it
harmless, or in its clause that make it toxic, come in) and the weights, which stay at a prior where the
sample tells nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are learnt from, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Of FOLDS remainders of crc32(doc_id), the one that is held out.
FOLDS, HELD_OUT = 5, 0
#: Word beginnings that may become a lexicon entry; whole words may too.
STEMS = (4, 5, 6, 7, 8)
#: Surprise (nats, beyond the log of the number of candidates) that an entry needs over chance.
MARGIN = 4.0
#: Tokens that a negation reaches.
SCOPE = 3
#: Labelled texts in which a word of context must stand beside a match before the labels can contradict its seed.
TELLING = 5

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT, QUOTE, BREAK, LINE = range(9)
CLASSES = range(9)
SEEDS = {
    TARGET: "you your yours yourself u he she they him her them this that these those who du dich dir ihr sie er dein deine tu toi te ton vous votre il elle ils usted ustedes tú ti él ella ellos".split(),
    NEGATION: "not no never neither nor without isn't aren't wasn't nicht kein keine nie niemals ne pas jamais non sin nunca jamás".split(),
    REPORT: "said says say called calls told wrote writes quoted claimed alleged reported sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split(),
    INSULT: "idiot idiots moron morons scum stupid loser losers pathetic worthless trash clown disgusting".split(),
    THREAT: "kill murder hurt destroy beat shoot stab strangle töten umbringen schlagen tuer frapper matar golpear".split(),
}

#: Kinds of clauses, weakest first; "none" is a clause without a match.
KINDS = ("none", "reported", "negated", "threat", "insult", "direct_threat", "direct_insult")
#: Marks that transducers add: to INSULT or THREAT the first two, to BREAK or LINE the others.
NEGATED, QUOTED, SAID, AIMED = 16, 32, 64, 128


@dataclass(frozen=True)
class Transducer:
    """Deterministic, letter to letter: step[state, symbol] = (state, output); any other symbol stays in state and passes."""

    step: dict = field(default_factory=dict)

    def __call__(self, state, symbol):
        return self.step.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet) -> Transducer:
    """The transducer that feeds the outputs of ``first`` to ``second``; states are pairs, from (0, 0) on."""
    step, todo, seen = {}, [(0, 0)], {(0, 0): 0}
    while todo:
        pair = todo.pop()
        for symbol in alphabet:
            a, mid = first(pair[0], symbol)
            b, out = second(pair[1], mid)
            if (a, b) not in seen:
                seen[a, b] = len(seen)
                todo.append((a, b))
            step[seen[pair], symbol] = seen[a, b], out
    return Transducer(step)


def negation(scope: int = SCOPE) -> Transducer:
    """Marks a match that stands within ``scope`` tokens after a negation."""
    step = {}
    for s in range(scope + 1):
        step[s, NEGATION] = scope, OTHER
        for x in (BREAK, LINE):
            step[s, x] = 0, x
        for x in (OTHER, TARGET, REPORT):
            step[s, x] = max(0, s - 1), x
        for x in (INSULT, THREAT):
            step[s, x] = max(0, s - 1), x + NEGATED * (s > 0)
    return Transducer(step)


def quotation() -> Transducer:
    """Marks matches between quotation marks; a line's end closes them."""
    step = {(s, QUOTE): (1 - s, OTHER) for s in (0, 1)} | {(1, LINE): (0, LINE)}
    return Transducer(step | {(1, x + n): (1, x + n + QUOTED) for x in (INSULT, THREAT) for n in (0, NEGATED)})


def report() -> Transducer:
    """Marks the end of a clause that holds a verb of saying, before or behind a match."""
    step = {(s, REPORT): (1, OTHER) for s in (0, 1)}
    return Transducer(step | {(s, x): (0, x + SAID * s) for s in (0, 1) for x in (BREAK, LINE)})


def target() -> Transducer:
    """Marks the end of a clause that holds a target, before or behind a match."""
    step = {(s, TARGET): (1, OTHER) for s in (0, 1)}
    return Transducer(step | {(s, x + said): (0, x + said + AIMED * s) for s in (0, 1) for x in (BREAK, LINE) for said in (0, SAID)})


def clause() -> Transducer:
    """At each border, gives the kind of the clause that ends there: that of its strongest match, by what the clause holds."""
    reported, negated, threat, insult, direct = 1, 2, 3, 4, {3: 5, 4: 6}
    match = {INSULT: insult, THREAT: threat}
    for x in (INSULT, THREAT):
        match |= {x + NEGATED: negated, x + QUOTED: reported, x + NEGATED + QUOTED: reported}
    step = {}
    for s in range(insult + 1):
        for x, k in match.items():
            step[s, x] = max(s, k), OTHER
        for x in (BREAK, LINE):
            for said in (0, SAID):
                for aimed in (0, AIMED):
                    kind = reported if s and said else direct.get(s, s) if aimed else s
                    step[s, x + said + aimed] = 0, -1 - kind
    return Transducer(step)


def grammar() -> list[list[tuple[int, int]]]:
    """The composed transducer as a table: [state][class] -> (state, output); outputs below 0 are -1 - kind."""
    whole = negation()
    for part in (quotation(), report(), target(), clause()):
        whole = compose(whole, part, CLASSES)
    return [[whole(s, x) for x in CLASSES] for s in range(1 + max(s for s, _ in whole.step))]


_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n|\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = {"\n": LINE} | dict.fromkeys(".!?;:|", BREAK) | dict.fromkeys('"“”„«»', QUOTE)


def contexts(classes=(TARGET, NEGATION, REPORT, THREAT)) -> dict[str, int]:
    """The class of each seed."""
    return {w: c for c in classes for w in SEEDS[c]}


@dataclass
class Model:
    """Insults (whole words and word beginnings), the weights of ``features``, of which the last is the bias, and the class of each word of context."""

    words: frozenset
    stems: frozenset
    weights: list[float]
    context: dict[str, int] = field(default_factory=contexts)

    def grammar(self):
        return Reader(self.words, self.stems, self.context)


class Reader:
    def __init__(self, words: frozenset, stems: frozenset, lexicon: dict[str, int]):
        self.words, self.stems, self.lexicon, self.table = words, stems, lexicon, grammar()
        self.sizes = sorted({len(s) for s in stems})
        self.threats = {w for w, c in lexicon.items() if c == THREAT}

    def insult(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.stems for k in self.sizes)

    def classes(self, text: str) -> list[tuple[str, int]]:
        """(word, class) of a text's tokens, with a line's end behind them; empty if nothing in it is a match."""
        text = text.lower()
        seen = set(_WORD.findall(text))
        bad = {w for w in seen if self.insult(w)}
        if not bad and self.threats.isdisjoint(seen):
            return []
        of = lambda w: INSULT if w in bad else self.lexicon.get(w, OTHER)
        out = []
        for t in _TOKEN.findall(text):
            c = _SIGNS[t] if t in _SIGNS else of(t)
            if c == OTHER and "'" in t:  # a joined word that is none itself is read by what matches in its parts
                out += [(w, x) for w in t.split("'") if (x := of(w)) != OTHER] or [(t, c)]
            else:
                out.append((t, c))
        return [*out, ("\n", LINE)]

    def clauses(self, text: str) -> Counter:
        """How many clauses there are of each kind but none."""
        table, state, kinds = self.table, 0, Counter()
        for _, c in self.classes(text):
            state, out = table[state][c]
            if out < -1:
                kinds[-1 - out] += 1
        return kinds

    def features(self, text: str) -> list[float]:
        """For each kind of clause the logarithm of their number, and whether there is one; then 1."""
        kinds = self.clauses(text)
        n = [kinds[k] for k in range(1, len(KINDS))]
        return [*(math.log1p(x) for x in n), *(float(x > 0) for x in n), 1.0]

    def around(self, text: str) -> tuple[set[str], set[str]]:
        """Words within SCOPE before a match in its clause, and all other words of clauses with a match."""
        before, clause, words, match = set(), set(), [], False
        for w, c in self.classes(text):
            if c in (BREAK, LINE):
                if match:
                    clause |= set(words)
                words, match = [], False
            elif c in (INSULT, THREAT):
                before |= set(words[-SCOPE:])
                match = True
            elif c != QUOTE:
                words.append(w)
        return before, clause


#: Weights before anything is learnt (and where the sample tells nothing): numbers of clauses, then presence, by kind; the bias.
PRIOR = [0.2, 0.2, 0.4, 0.5, 0.6, 0.6, 0.8, 0.8, 2.2, 3.0, 4.0, 4.2, -3.0]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and y of at most ``rows`` labelled documents outside the held-out fold, one of each group of likely copies.

    Copies would let chance words look significant. Groups are joined by equal minima of five-word shingle
    hashes; what the driver gets for that is ``rows`` times SKETCH numbers.
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picked = picked.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")  # the broadcast side has at most ``rows`` rows

    def sketch(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("m", pa.list_(pa.int64()))])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([minima(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], schema=kind)

    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    ids = set()
    for r in sample.select("doc_id", "text").mapInArrow(sketch, "doc_id long, m array<long>").collect():
        ids.add(r.doc_id)
        for k, m in enumerate(r.m):
            a, b = find(r.doc_id), find(("m", k, m))
            if a != b:
                root[a] = b
    first: dict = {}
    for i in sorted(ids):
        first.setdefault(find(i), i)
    keep = docs.sparkSession.createDataFrame([(i,) for i in first.values()], "doc_id long")
    return sample.join(F.broadcast(keep), "doc_id").select("text", "y")  # at most ``rows`` ids again


#: Minima that sketch a training text.
SKETCH = 6


def minima(text: str) -> list[int]:
    words = _WORD.findall(text.lower())
    if not words:
        return []
    grams = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
    h = np.fromiter(grams, dtype=np.uint64, count=len(grams))
    return [int((((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(20)).min()) for k in range(SKETCH)]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn the lexicon, then the weights. What comes to the driver is bounded by ``rows`` and by the significant entries."""
    sample = labelled(docs, labels, rows)
    seeds = frozenset(SEEDS[INSULT])

    def count(batches):
        pos, neg = Counter(), Counter()
        n = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                found = words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}
                (pos if y else neg).update(found)
                n[1 if y else 0] += 1
        keys = ["", *pos.keys(), *(k for k in neg if k not in pos)]
        table = pa.table({"f": pa.array(keys, pa.string()), "p": pa.array([n[1], *(pos[k] for k in keys[1:])], pa.int64()), "q": pa.array([n[0], *(neg[k] for k in keys[1:])], pa.int64())})
        yield from table.to_batches(max_chunksize=50_000)
        del pos, neg, keys, table
        common.tidy()

    counts = sample.mapInArrow(count, "f string, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    folder = common.shared_dir(docs.sparkSession)
    counts = common.written(counts, folder, "counts")  # read twice
    total = {r.f: (r.p, r.q) for r in counts.where("f = ''").collect()}.get("", (0, 0))
    n_found = counts.count()
    if not total[0] or not total[1]:
        common.removed(docs.sparkSession, folder)
        return Model(seeds, frozenset(), PRIOR)
    base = total[0] / sum(total)
    log = lambda of: F.when(of > 0, F.log(F.when(of > 0, of).otherwise(1.0))).otherwise(0.0)
    n = F.col("p") + F.col("q")
    surprise = F.col("p") * (log(F.col("p") / n) - math.log(base)) + F.col("q") * (log(F.col("q") / n) - math.log(1 - base))
    kept = counts.where((F.col("f") != "") & (F.col("p") > 0)).where((F.col("p") >= 4 * F.col("q")) & (surprise >= math.log(n_found) + MARGIN))
    entries = {r.f: (r.s, r.p) for r in kept.select("f", "p", surprise.alias("s")).orderBy(F.desc("s"), "f").limit(rows).collect()}
    common.removed(docs.sparkSession, folder)
    words, stems = lexicon(entries)
    words |= seeds
    context = learn_context(sample, Model(words, stems, PRIOR).grammar(), rows)
    reader = Model(words, stems, PRIOR, context).grammar()

    def measure(batches):
        for b in batches:
            rows = [reader.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "y"])

    seen = sample.mapInArrow(measure, "x array<double>, y int").groupBy("x", "y").count().collect()
    x, y, k = np.array([r.x for r in seen]), np.array([r.y for r in seen], dtype=float), np.array([r["count"] for r in seen], dtype=float)
    return Model(words, stems, ordered(fit(x, y, k, np.array(PRIOR))).tolist(), context)


def learn_context(sample: DataFrame, reader: Reader, rows: int) -> dict[str, int]:
    """The class of each word of context, by the labels of the texts in which it stands beside a match.

    A negation or verb of saying must make matches harmless and a target must not, as far as TELLING texts or
    more tell. Other words before a match whose texts are surprisingly seldom toxic become negations, words of
    its clause whose texts are surprisingly often toxic targets. At most ``rows`` words come to the driver.
    """
    seeds = reader.lexicon

    def count(batches):
        for b in batches:
            found = Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                before, clause = reader.around(text)
                y = bool(y)
                found.update(("before", w, y) for w in before)
                found.update(("clause", w, y) for w in clause)
                if before or clause or reader.classes(text):
                    found["", "", y] += 1
            rows = [(*k, n) for k, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["place", "w", "y", "n"])

    counts = sample.mapInArrow(count, "place string, w string, y boolean, n long").groupBy("place", "w")
    counts = counts.agg(F.coalesce(F.sum(F.when(F.col("y"), F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~F.col("y"), F.col("n"))), F.lit(0)).alias("q"))
    folder = common.shared_dir(sample.sparkSession)
    counts = common.written(counts, folder, "context")  # read twice
    total = counts.where("place = ''").first()
    kept = dict(seeds)
    if total and total.p and total.q:
        base, n_found = total.p / (total.p + total.q), counts.count()
        telling = counts.where("place <> ''").where(F.col("w").isin(list(seeds)) | (F.col("p") + F.col("q") >= TELLING))
        for r in telling.orderBy(F.desc(F.col("p") + F.col("q")), "w").limit(rows).collect():
            n, rate, seed = r.p + r.q, r.p / (r.p + r.q), seeds.get(r.w)
            surprise = sum(x * math.log(x / n / share) for x, share in ((r.p, base), (r.q, 1 - base)) if x)
            strange = surprise >= math.log(n_found) + MARGIN
            if seed == NEGATION and r.place == "before" and n >= TELLING and rate > base / 2:
                kept.pop(r.w, None)
            elif seed in (REPORT, TARGET) and r.place == "clause" and n >= TELLING and (rate > base / 2 if seed == REPORT else rate < base / 2):
                kept.pop(r.w, None)
            elif seed is None and strange and r.place == "before" and rate < base / 2:
                kept[r.w] = NEGATION
            elif seed is None and strange and r.place == "clause" and rate > base:
                kept.setdefault(r.w, TARGET)
    common.removed(sample.sparkSession, folder)
    return kept


def ordered(w: np.ndarray) -> np.ndarray:
    """Weights in the order of the kinds: negated and reported ones at most those of a plain match, direct ones at least."""
    w = w.copy()
    for of in (w[:6], w[6:12]):  # views: reported, negated, threat, insult, direct threat, direct insult
        of[4], of[5] = max(of[4], of[2]), max(of[5], of[3])
        of[0], of[1] = min(of[0], of[3]), min(of[1], of[3])
    return w


def lexicon(entries: dict[str, tuple[float, int]]) -> tuple[frozenset, frozenset]:
    """Whole words and stems from candidates with their surprise and support, the most surprising first.

    A stem grows as long as a longer one has nearly its support; what a chosen entry holds adds nothing.
    """
    stems: set[str] = set()
    words: set[str] = set()
    for f in sorted(entries, key=lambda f: (-entries[f][0], f.endswith("*"), -len(f), f)):
        s, support = f.rstrip("*"), entries[f][1]
        if any(s[:k] in stems for k in STEMS):
            continue
        if not f.endswith("*"):
            words.add(s)
        elif not any(w.startswith(s) for w in (*words, *stems)):
            longer = [t for t, (_, n) in entries.items() if t.endswith("*") and t.startswith(s) and n >= 0.97 * support]
            stems.add(max(longer, key=lambda t: (len(t), t)).rstrip("*"))
    return frozenset(words), frozenset(stems)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior weights; the bias (last column) is free."""
    w, penalty = prior.copy(), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty @ (w - prior)
        step = np.linalg.solve(x.T @ (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]) + penalty, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_clauses int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int32())])


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), n_clauses (matched ones) for every row, whole texts.

    Null texts are empty and get the score of a text without a match; a null id stays null and is not
    held out; repeated rows are scored each. Narrow: no shuffle.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))

    def make():
        reader, w = model.grammar(), model.weights

        def run(ids, held, texts):
            out = []
            for i, h, t in zip(ids, held, texts, strict=True):
                x = reader.features(t)
                p = _sigmoid(sum(a * b for a, b in zip(w, x, strict=True)))
                out.append((i, h, p, int(p >= 0.5), round(sum(map(math.expm1, x[: len(KINDS) - 1])))))
            return list(zip(*out, strict=True)) or [[]] * 5

        return run

    return common.map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("h"), F.coalesce("text", F.lit("")).alias("t")), make, SCHEMA, ARROW)


def reject(docs: DataFrame, model: Model, columns=("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged (null and empty texts stay)."""

    def run(batches):
        reader, w = model.grammar(), model.weights
        at = columns.index("text")
        for b in batches:
            keep = [t is None or sum(x * y for x, y in zip(w, reader.features(t), strict=True)) < 0 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
        common.tidy()

    df = docs.select(*columns)
    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
