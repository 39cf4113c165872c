"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features are rates, so long and short texts compare: densities of a lexicon of insults (plain, and read through
obfuscation: ``1d10t``, ``st*pid``, doubled letters), of insults near a second person, of word stems that the training rows
show to be toxic, of capitals, punctuation, repeated and masked letters; and the worst stretch of a long text.
Stems (word beginnings of 4 to 8 letters) are learned by one aggregation of documents by stem and label; the
strongest few come to the driver.  Trees and calibration are Spark ML's; the calibration is fitted on rows that neither the
stems nor the trees saw.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, ref

#: Fit on so many labelled rows at most, the first by a hash of their id.
FIT_ROWS = 12_000
#: So many learned stems at most, of these lengths.
LEARNED_STEMS = 400
STEM = range(4, 9)
THRESHOLD = 0.3
TREES, DEPTH = 20, 4
#: Words in a stretch; a text's worst stretch has features of its own.
STRETCH = 60

INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers pathetic worthless scum trash garbage clown clowns ugly disgusting"
    " imbecile jerk bastard bitch shit crap damn hate kill die vermin filth pig pigs coward liar freak creep dumbass asshole fuck fucking"
    " idiota estúpido imbécil basura inútil asqueroso cerdo idiotin dumm dummkopf blöd trottel versager abschaum dreck"
    " widerlich stupide imbécile crétin ordure minable nul dégoûtant".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti tus usted vous toi votre vos du dich dir dein deine ihr euch".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_DOUBLED = re.compile(r"(.)\1+")
_SIGN, _REPEAT, _DIGIT = re.compile(r"[^\w\s]"), re.compile(r"([^\W\d_])\1\1"), re.compile(r"\d")
_CAPITAL, _SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_EDGES = ".,;:!?\"'()[]{}|<>*#$%&-_"
FEATURES = (
    "insults", "hidden", "insults_near_you", "learned", "worst", "any_insult", "learned_weight", "strongest",
    "second_person", "capitals", "shouted", "punctuation", "exclamations", "repeats", "masked", "digits", "mean_word", "log_words",
)


def plain_words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower())


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEM if len(word) >= n]


def squeezed(token: str) -> str:
    """A token with look-alikes undone, signs dropped and doubled letters made one."""
    return _DOUBLED.sub(r"\1", "".join(filter(str.isalpha, token.translate(_LEET))))


_SQUEEZED = frozenset(map(squeezed, INSULTS))
#: Signs in a masked word stand for one letter each, so longer tokens mask none of these.
_LONGEST = max(map(len, INSULTS))


def masked_as(token: str) -> re.Pattern | None:
    """A pattern for a token with signs in place of letters (``st*pid``), None for others and for those too long to mask an insult."""
    if ("*" in token or "#" in token) and len(token) <= _LONGEST:
        return re.compile("".join("[a-z]" if c in "*#" else re.escape(c) for c in token))
    return None


def features_of(text: str | None, learned: dict[str, float], memo: dict[str, float]) -> list[float]:
    """The dense features of one whole text; a text without characters has all zero.  ``memo`` is for words' weights."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _LETTERS.findall(low)
    hits, marks, weight, strongest, you = [], [], 0.0, 0.0, 0
    for i, w in enumerate(words):
        known = memo.get(w)
        if known is None:
            known = max((learned[s] for s in stems(w) if s in learned), default=0.0) + 100.0 * (w in INSULTS) + 1000.0 * (w in SECOND_PERSON)
            if len(memo) < 50_000:
                memo[w] = known
        if known:
            if known >= 1000.0:
                you, known = you + 1, known - 1000.0
            if known >= 100.0:
                hits.append(i)
                known -= 100.0
            if known:
                weight, strongest = weight + known, max(strongest, known)
                marks.append(i)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - 4) : i + 5]) for i in hits)
    hidden = masked = 0
    for t in set(low.split()):
        core = t.strip(_EDGES)
        if core.isalpha() or len(core) < 3:
            continue
        mask = masked_as(core)
        masked += "*" in core or "#" in core
        hidden += squeezed(core) in _SQUEEZED or bool(mask and any(map(mask.fullmatch, INSULTS)))
    worst, lo, all_marks = 0, 0, sorted({*hits, *marks})
    for hi in range(len(all_marks)):
        while all_marks[hi] - all_marks[lo] >= STRETCH:
            lo += 1
        worst = max(worst, hi - lo + 1)
    letters, per, chars = sum(map(len, words)), 1.0 / max(len(words), 1), len(text)
    return [
        len(hits) * per, hidden * per, near * per, len(marks) * per, worst / STRETCH, float(bool(hits or hidden)), min(weight, 100.0), strongest,
        you * per, len(_CAPITAL.findall(text)) / max(letters, 1), len(_SHOUTED.findall(text)) * per, len(_SIGN.findall(text)) / chars,
        text.count("!") * per, len(_REPEAT.findall(low)) * per, masked * per, len(_DIGIT.findall(text)) / chars, letters * per, math.log1p(len(words)),
    ]


def with_features(docs: DataFrame, text_col: str, out: str, learned: dict[str, float]) -> DataFrame:
    """``docs`` plus an array of the features in ``out``; the learned stems are a bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learned, memo = shared.value, {}  # words are remembered until the task ends
        for texts in batches:
            yield pd.Series([features_of(t, learned, memo) for t in texts], dtype=object)

    return docs.withColumn(out, features(ref(text_col)))


@dataclass
class ToxicityModel:
    """Learned stems, trees and calibration; without the last two, ``prior`` if all labels were toxic, else the lexicon alone."""

    learned: dict[str, float]
    prior: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text_col: str, out: str) -> DataFrame:
        """``docs`` plus a score from 0 to 1 of every text, read whole, however long; null and empty ones have one, too.

        Equal texts have equal scores; an empty table stays empty; other columns, whatever their names, stay.
        """
        if self.trees is None and self.prior == 1.0:
            return docs.withColumn(out, F.lit(1.0))
        if self.trees is None:
            (feats,) = fresh(docs, "features_")
            worst, any_insult = (ref(feats)[FEATURES.index(f)] for f in ("worst", "any_insult"))
            return with_features(docs, text_col, feats, {}).withColumn(out, 1.0 - F.exp(-(12.0 * worst + 0.4 * any_insult))).drop(feats)
        feats, vec, raw, chance, label, p = fresh(docs, "features_", "vector_", "raw_", "chance_", "label_", "p_")
        marked = with_features(docs, text_col, feats, self.learned).withColumn(vec, array_to_vector(ref(feats)))
        trees = self.trees.copy().setFeaturesCol(vec).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(label)
        guessed = trees.transform(marked).withColumn(p, vector_to_array(ref(chance))[1])
        iso = self.calibration.copy().setFeaturesCol(p).setPredictionCol(out)
        bounded = iso.transform(guessed).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ref(out))))
        return bounded.drop(feats, vec, raw, chance, label, p)


def _label_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """``(id, text, label, part)`` of up to ``fit_rows`` labelled rows, the first by a hash of the id; part 0 to 4."""
    y = (
        labels.select(ref(id_col).alias("id"), ref(label_col).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id").agg(F.max("label").alias("label"))
        .withColumn("h", F.xxhash64("id"))
        .orderBy("h", "id").limit(fit_rows)
    )
    # each label is dealt to all parts, however few rows it has; the window is over at most `fit_rows` rows
    turn = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    parted = y.select("id", "label", F.pmod(turn, F.lit(5)).cast("int").alias("part"))
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).where("text IS NOT NULL")
    # at most `fit_rows` small rows, so a broadcast of bounded size
    return rows.join(F.broadcast(parted), "id").select("id", "text", "label", "part")


def learn_stems(rows: DataFrame, most: int = LEARNED_STEMS) -> dict[str, float]:
    """Stems by log odds of standing in a toxic rather than a clean training row."""

    @F.pandas_udf("array<string>")
    def all_stems(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for w in set(plain_words(t or "")) for s in stems(w)}) for t in texts], dtype=object)

    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    seen = rows.select("label", F.explode(all_stems("text")).alias("s")).groupBy("s").agg(
        F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    # in toxic rows more often than chance gives, and by far more often than in clean ones
    strong = seen.withColumn("odds", odds).where((F.col("t") >= max(3, 0.01 * toxic)) & (F.col("odds") > 2.0))
    top = strong.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "s").limit(most).collect()
    return {r.s: float(r.odds) for r in top}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Stems from three parts in five of the labelled rows, trees from those and a fourth, calibration from the fifth.

    Labels that are null or not 0 or 1 are ignored; an id labelled twice is toxic if either label says so.  Where a part has
    no toxic or no clean row (fewer than five of them, or texts missing), nothing is learned and the lexicon alone scores.
    """
    rows = checkpointed(_label_rows(docs, labels, id_col, text_col, label_col, fit_rows))
    counts = {(r.held, r.label): r.n for r in rows.groupBy((F.col("part") == 4).alias("held"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = sum(n for (_, y), n in counts.items() if y == 1) / total if total else 0.0
    if not all(counts.get((held, y)) for held in (False, True) for y in (0, 1)) or any(sum(n for (_, z), n in counts.items() if z == y) < 5 for y in (0, 1)):
        return ToxicityModel({}, prior)
    learned = learn_stems(rows.where("part < 3"))
    table = with_features(rows, "text", "f", learned).select("label", "part", array_to_vector("f").alias("features"))
    table = checkpointed(table.repartition(4))
    booster = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=7)
    # rows from which the stems were taken look too clear; each unseen row counts for three
    seen, unseen = table.where("part < 3"), table.where("part = 3")
    trees = booster.fit(seen.unionByName(unseen).unionByName(unseen).unionByName(unseen).coalesce(4))
    held = trees.transform(table.where("part = 4")).select(vector_to_array("probability")[1].alias("p"), F.col("label").cast("double").alias("label"))
    return ToxicityModel(learned, prior, trees, IsotonicRegression(featuresCol="p", labelCol="label").fit(held))
