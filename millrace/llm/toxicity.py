"""Toxicity by maximum-scoring segments.

Model: log-odds of holding a word or a beginning of one between toxic and other documents with an
informative Dirichlet prior (Monroe, Colaresi and Quinn, "Fightin' Words"). Those whose
log-odds are at least LEAST_Z standard deviations over 0 form the lexicon; a word scores the
largest log-odds of itself and its beginnings there, if any, and every word loses DRIFT. In a
text, all maximal scoring segments are found in linear time (Ruzzo and Tompa). A segment's
score S in a text of n words has the expected number E = K n exp(-lambda S) of segments at
least as good in harmless text (Karlin and Altschul); lambda solves sum p exp(lambda s) = 1
over the words of other documents, and K is counted on harmless calibration documents.
Segments with E under SIGNIFICANT are toxic passages. A logistic calibration of -ln E of the
best segment and of the number of passages gives the score.

The fit uses at most SAMPLE labelled rows, those with the least hash of their id, one of
each group of near copies, three of four for the words and the rest for the calibration;
every document is scored. Rows whose crc32(doc_id) mod 4 is 2 are held out.

Defined results: texts without words (null, empty) have no segment and score like a harmless
text; repeated rows score alike; a document with several labels is toxic if any says so; rows
with null id or label are not learnt from, and a null id is not held out. Without labels of
both kinds every text scores the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

SAMPLE = 20_000
SHINGLE = 5
#: Beginnings of words that count as features, in bytes.
BEGINNINGS = range(4, 11)
PRIOR, LEAST_Z, DRIFT, SIGNIFICANT, CUT = 0.05, 3.0, 0.5, 0.01, 0.3
#: ASCII punctuation becomes a space; bytes of longer code points stay.
APART = bytes(32 if chr(b) in string.punctuation else b for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.lower().translate(APART).split()


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place) of a sequence in which the
    given places score so much, and every other place -drift. Linear in the number of places."""
    found: list[list] = []  # first, last, sum before, sum after, place in found of the last one with less before
    total, before = 0.0, -1
    for at, s in zip(places, scores):
        total -= drift * (at - before - 1)
        before = at
        seg = [at, at, total, total + s, -1]
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= seg[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= seg[3]:
                seg[4] = j
                found.append(seg)
                break
            gone = found[j]  # joins with it and what lies between
            seg[0], seg[2] = gone[0], gone[2]
            del found[j:]
            j = gone[4]
    return [(r - l, a, b) for a, b, l, r, _ in found]


def parts(word: bytes) -> list[bytes]:
    """A word as a feature, marked by a space at its end, and its beginnings."""
    return [word + b" ", *(word[:k] for k in BEGINNINGS if k < len(word))]


class Scores(dict):
    """Scores of words over -DRIFT, 0 for others; remembers what it has worked out."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        found = [x for f in parts(word) if (x := self.lexicon.get(f)) is not None]
        if len(self) > 500_000:
            self.clear()
        self[word] = out = max(found) - DRIFT if found else 0.0
        return out

    def __reduce__(self):
        return Scores, (self.lexicon,)


@dataclass
class Model:
    """scores: by the lexicon, over -DRIFT."""

    scores: Scores
    rate: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] | None = None
    share: float = 0.5

    @property
    def lexicon(self) -> dict[bytes, float]:
        return self.scores.lexicon

    def passages(self, tokens: list[bytes]) -> list[tuple[float, int, int]]:
        values = list(map(self.scores.__getitem__, tokens)) if self.scores.lexicon else []
        places = [i for i, v in enumerate(values) if v]
        return segments(places, [values[i] for i in places], DRIFT) if places else []

    def features(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, float]:
        if not found:
            return 0.0, 0.0
        logs = [self.rate * s - math.log(self.k * max(n, 1)) for s, _, _ in found]  # -ln E
        return min(40.0, max(0.0, max(logs))), math.log1p(sum(x > -math.log(SIGNIFICANT) for x in logs))

    def score(self, data: bytes) -> tuple[float, int]:
        """Probability, and the number of significant passages."""
        tokens = words(data)
        found = self.passages(tokens)
        x = self.features(len(tokens), found)
        passages = round(math.expm1(x[1]))
        if self.weights is None:
            return self.share, passages
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), passages


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; the intercept, then the weights."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 4


def sketched(batches):
    """(doc_id, text) with the least hash of its SHINGLE-word shingles: near copies mostly share it."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("group", pa.int64())])
    for batch in common.slices(batches):
        least = []
        for data in common.bytes_of(batch.column(1)):
            w = words(data)
            least.append(min((xxhash.xxh64_intdigest(b" ".join(x)) for x in zip(*(w[i:] for i in range(SHINGLE)))), default=xxhash.xxh64_intdigest(b" ".join(w))))
        yield common.batch_of(schema, doc_id=batch.column(0), text=batch.column(1), group=common.signed(np.array(least, np.uint64)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic and part (0 to 3) of at most `sample` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(remainder() != 2)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = common.stored(chosen.select(F.col("doc_id").alias("id"), "toxic"), "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most `sample` rows of 16 bytes: the bound for the broadcast.
    own = rows.join(F.broadcast(chosen), rows.doc_id == chosen.id, "left_semi").mapInArrow(sketched, "doc_id long, text string, group long").join(F.broadcast(chosen), F.col("doc_id") == chosen.id)
    # One of each group of near copies: else words that only its members have look toxic.
    one = own.groupBy("group").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("x")).select("x.text", F.when(F.col("x.toxic") > 0, 1).otherwise(0).alias("toxic"), F.pmod(F.xxhash64("group") + 1, F.lit(4)).cast("int").alias("part"))
    return common.stored(one, "sample")


def part_counts(sample: DataFrame) -> DataFrame:
    """feature, and how many toxic and other documents hold it."""

    def run(batches):
        schema = pa.schema([("feature", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64())])
        for batch in common.slices(batches, 4096):
            sums = (Counter(), Counter())
            for data, toxic in zip(common.bytes_of(batch.column(0)), batch.column(1).to_pylist()):
                sums[1 - toxic].update({f for w in set(words(data)) for f in parts(w)})
            every = list(sums[0] | sums[1])
            yield common.batch_of(schema, feature=every, toxic=[sums[0][w] for w in every], other=[sums[1][w] for w in every])

    return sample.select("text", "toxic").mapInArrow(run, "feature binary, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The lexicon holds all features that pass, of at most `sample` documents."""
    rows = labelled_sample(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    counts = common.stored(part_counts(rows.where("part < 3")), "parts")
    whole = F.expr("substring(feature, length(feature), 1) = X'20'")
    n1, n0 = (int(x or 0) for x in counts.where(whole).agg(F.sum("toxic"), F.sum("other")).first())
    if not n1 or not n0:
        return Model(Scores({}), share=share)
    prior = PRIOR * (n1 + n0)
    own = PRIOR * (F.col("toxic") + F.col("other"))
    odds = F.log((F.col("toxic") + own) / (n1 + prior)) - F.log((F.col("other") + own) / (n0 + prior))
    z = odds / F.sqrt(1 / (F.col("toxic") + own) + 1 / (F.col("other") + own))
    best = counts.select("feature", odds.alias("odds"), z.alias("z")).where(f"z >= {LEAST_Z} and odds > {DRIFT}").orderBy("feature").collect()
    model = Model(Scores({bytes(r["feature"]): r["odds"] for r in best}), share=share)
    if not best:
        return model

    def scored(batches):
        schema = pa.schema([("s", pa.float64()), ("n", pa.int64())])
        for batch in common.slices(batches):
            sums = Counter(v for t in common.bytes_of(batch.column(0)) for v in map(model.scores.__getitem__, words(t)))
            yield common.batch_of(schema, s=list(sums), n=list(sums.values()))

    # How often harmless words score what: at most as many values as the lexicon has entries.
    seen = rows.where("part < 3 and toxic = 0").select("text").mapInArrow(scored, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    s, p = np.array([r["s"] or -DRIFT for r in seen]), np.array([r["n"] for r in seen], float)
    p = (p + 0.5) / (p + 0.5).sum()
    low, high = 0.0, 50.0
    for _ in range(100):  # the positive root of sum p exp(rate s) = 1; the sum is under 1 just over 0
        rate = (low + high) / 2
        low, high = (rate, high) if (p * np.exp(np.minimum(rate * s, 700))).sum() < 1 else (low, rate)
    model.rate = min(max(low, 0.05), 5.0)
    floor = min(model.lexicon.values()) - DRIFT

    def measured(batches):
        schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.float64()))])
        for batch in common.slices(batches):
            found = [(len(t), [x[0] for x in model.passages(t)]) for t in map(words, common.bytes_of(batch.column(0)))]
            yield common.batch_of(schema, toxic=batch.column(1), n=[n for n, _ in found], scores=[x for _, x in found])

    held = rows.where("part = 3").select("text", "toxic").mapInArrow(measured, "toxic int, n long, scores array<double>").collect()  # at most `sample` rows
    clean = [r for r in held if not r["toxic"]]
    reached = sum(x >= floor for r in clean for x in r["scores"])
    model.k = min(10.0, max(1e-6, (reached + 0.5) / (sum(r["n"] for r in clean) * math.exp(-model.rate * floor) + 1)))
    x = np.array([model.features(r["n"], [(v, 0, 0) for v in r["scores"]]) for r in held]).reshape(-1, 2)
    y = np.array([r["toxic"] for r in held], float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = logistic(x, y)
    else:
        model.weights = (math.log(share / (1 - share)) - 2, 0.3, 1.0)
    return model


SCHEMA = "doc_id long, score double, predicted int, n_passages int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row. No exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of at most SAMPLE documents

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int32())])
        m = shared.value
        for batch in common.slices(batches):
            rows = [m.score(t) for t in common.bytes_of(batch.column(1))]
            yield common.batch_of(schema, doc_id=batch.column(0), score=[r[0] for r in rows], predicted=[int(r[0] >= CUT) for r in rows], n_passages=[r[1] for r in rows])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages")
