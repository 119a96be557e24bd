"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon (a few seed words, and words and stems that labelled toxic texts
have far oftener than others), its nearness to the second person, capitals, punctuation, and the rate
of obfuscated words, which count in the lexicon after undoing the obfuscation. Boosted trees and calibration are
Spark ML models fitted on a bounded sample of labelled rows: lexicon and trees on three quarters, the calibration on the
others, which neither has seen. Scoring reads whole texts and shuffles nothing.

Null texts count as empty ones, which get the score of a text without any feature. Repeated rows get equal scores.
Labels of only one class give a constant score, that class; no labels give 0. Empty tables give empty
ones. Extra columns pass through; names that clash are extended by underscores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpointed, fold, fresh, table
from tidemark.llm.labelled import SAMPLE_ROWS, labelled_sample, parts

LEXICON_ENTRIES = 2_000
LEXICON_LEAST = 14.0
"""A word or stem enters the lexicon at this log-likelihood ratio."""
STEMS = (3, 4, 5, 6, 7)
TOKENS = 300_000
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "imbecile", "bastard", "asshole", "bitch", "idioten", "dummkopf", "arschloch", "imbécile", "connard", "idiota", "imbécil")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi vous votre tes usted ustedes tú ti vos".split())
NEAR = 4
UNDO = str.maketrans("013457@$!|€", "oieastasile")
PUNCTUATION = re.compile(r"[^\w\s]")
LETTERS = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"[^\W\d_][\d@$!|€*._\-]+[^\W\d_]")
FEATURES = ["hits", "hit_rate", "weight", "weight_rate", "strongest", "hidden", "hidden_rate", "near_you", "you_rate", "capital_rate", "shout_rate", "punctuation_rate", "exclaim_rate", "obfuscated_rate", "log_words"]
WEIGHT, HIDDEN, YOU, SHOUT, UPPER, LETTER, PUNCT, EXCLAIM, MIXED, SIZE = range(10)


def keys_of(word: str) -> list[str]:
    """What a word counts as in the lexicon: itself, and its stems if it is longer."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class TokenTable:
    """Features of distinct tokens, filled on demand; between texts it is emptied when large."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.rows, table = 0, self
        self.values = np.zeros((4096, 10), np.float32)

        class Index(dict):
            def __missing__(self, token: str) -> int:
                self[token] = at = table.add(token)
                return at

        self.index = Index()

    def weigh(self, word: str) -> float:
        return max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0)

    def add(self, token: str) -> int:
        if self.rows == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        row = self.values[self.rows]
        low = token.lower()
        words = LETTERS.findall(low)
        row[WEIGHT] = max(map(self.weigh, words), default=0.0)
        row[YOU] = any(w in SECOND_PERSON for w in words)
        row[MIXED] = mixed = INNER.search(token) is not None and "@" not in token.strip("@")[1:-1].replace("@", "", 1) and not token[-1:].isdigit()
        if mixed and not row[WEIGHT]:
            row[HIDDEN] = max(self.weigh("".join(LETTERS.findall(low.translate(UNDO)))), self.weigh("".join(LETTERS.findall(low))))
        row[UPPER] = sum(map(str.isupper, token))
        row[LETTER] = sum(map(len, words))
        row[SHOUT] = row[UPPER] >= 2 and token.isupper()
        row[PUNCT] = len(PUNCTUATION.findall(token))
        row[EXCLAIM] = token.count("!")
        row[SIZE] = len(token)
        self.rows += 1
        return self.rows - 1

    def features(self, text: str) -> list[float]:
        if self.rows > TOKENS:
            self.clear()
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, n)
        rows = self.values[at]
        weight, hidden, you, shout, upper, letters, punctuation, exclaims, mixed, size = rows.sum(axis=0, dtype=np.float64)
        hit = (rows[:, WEIGHT] > 0) | (rows[:, HIDDEN] > 0)
        hits = int(hit.sum())
        near = 0
        if hits and you:
            where, yous = np.flatnonzero(hit), np.flatnonzero(rows[:, YOU])
            after = np.searchsorted(yous, where)
            gap = np.minimum(np.abs(yous[np.minimum(after, len(yous) - 1)] - where), np.abs(yous[np.maximum(after - 1, 0)] - where))
            near = int((gap <= NEAR).sum())
        n_hidden = int((rows[:, HIDDEN] > 0).sum())
        strongest = float(rows[:, [WEIGHT, HIDDEN]].max())
        size = max(size, 1.0)
        return [hits, hits / n, weight + hidden, (weight + hidden) / n, strongest, n_hidden, n_hidden / n, near / hits if hits else 0.0, you / n, upper / max(letters, 1.0), shout / n, punctuation / size, exclaims / size, mixed / n, float(np.log1p(n))]


def with_features(df: DataFrame, text: str, lexicon: dict[str, float], drop_text: bool = False) -> tuple[DataFrame, list[str]]:
    """df with the columns of FEATURES, and their names there."""
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if not (drop_text and i == at)]
    names = fresh(df, *FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tokens = TokenTable(lexicon)
        for batch in batches:
            made = np.array([tokens.features(v.as_py() or "") for v in batch.column(at)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c) for c in made.T)], names=[*(batch.schema.names[i] for i in kept), *names])

    schema = T.StructType([*(df.schema.fields[i] for i in kept), *(T.StructField(n, T.DoubleType()) for n in names)])
    return df.mapInArrow(run, schema), names


def learn_lexicon(sample: DataFrame, entries: int = LEXICON_ENTRIES, least: float = LEXICON_LEAST) -> dict[str, float]:
    """Weights of words and stems far commoner in texts labelled 1, from a bounded sample (id, text, label).

    Near copies count once: of texts with the same smallest word-run hash and label one stands for all. What
    leaves a task are counts for its part of the sample; at most `entries` weights reach the driver.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            marks = []
            for v in batch.column(1):
                words = LETTERS.findall((v.as_py() or "").lower())
                runs = (" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2)))
                marks.append(min(map(xxh64_intdigest, runs)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), batch.column(2)], names=["id", "mark", "label"])

    chosen = sample.mapInArrow(signed, "id long, mark long, label int").groupBy("mark", "label").agg(F.min("id").alias("id"))
    once = sample.join(F.broadcast(chosen.select("id")), "id", "left_semi").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        texts = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                y = int(label.as_py() == 1)
                words = set(LETTERS.findall((text.as_py() or "").lower()))
                counts[y].update({k for w in words if 3 <= len(w) <= 40 for k in keys_of(w)})
                texts[y] += 1
        every = [k for k in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array([*every, *(k for k in counts[0] if k not in counts[1]), ""]), pa.array([*(counts[1][k] for k in every), *(0 for k in counts[0] if k not in counts[1]), texts[1]], pa.int64()), pa.array([*(counts[0][k] for k in every), *(counts[0][k] for k in counts[0] if k not in counts[1]), texts[0]], pa.int64())], names=["key", "bad", "good"])

    counted = checkpointed(once.mapInArrow(count, "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("bad >= 2 or key = ''"))
    whole = counted.filter("key = ''").first()
    lexicon = {w: 1.5 for w in SEED_WORDS}
    if whole is None or not whole.bad or not whole.good:
        return lexicon
    n1, n0 = float(whole.bad), float(whole.good)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (F.col("bad") + F.col("good")) / (n1 + n0)
    ratio = 2 * (part(F.col("bad"), share * n1) + part(F.col("good"), share * n0) + part(n1 - F.col("bad"), (1 - share) * n1) + part(n0 - F.col("good"), (1 - share) * n0))
    odds = F.log((F.col("bad") + 0.1) / (n1 + 0.2)) - F.log((F.col("good") + 0.1) / (n0 + 0.2))
    found = counted.filter("key <> ''").select("key", ratio.alias("ratio"), odds.alias("odds")).filter((F.col("ratio") >= least) & (F.col("odds") >= 2.0))
    for r in found.orderBy(F.desc("ratio"), "key").limit(entries).collect():
        lexicon[r.key] = min(float(r.odds), 8.0)
    return lexicon


@dataclass
class Toxicity:
    """A fitted scorer. Without both classes among the labels, `constant` is every score."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    constant: float = 0.0

    def score(self, df: DataFrame, text: str = "text", to: str = "score", drop_text: bool = False, raw: str | None = None) -> DataFrame:
        """df with a score from 0 to 1 of every whole text, the calibrated probability; where `raw` is named, also the
        trees' own, which orders texts of equal scores."""
        made_names = fresh(df, *([to] if raw is None else [to, raw]))
        named = [f"c{i}" for i in range(len(df.columns))]  # no name of df can clash with those of the models
        at = df.columns.index(text)
        kept = [i for i in range(len(named)) if not (drop_text and i == at)]
        made = df.toDF(*named)
        if self.trees is None:
            made = made.withColumns({"score": F.lit(self.constant), "_raw": F.lit(self.constant)})
        else:
            made, names = with_features(made, named[at], self.lexicon, drop_text)
            made = self.steps.transform(_raw(made, names, self.trees))
            made = made.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_step"))))
        return made.select(*(named[i] for i in kept), *["score", "_raw"][: len(made_names)]).toDF(*(df.columns[i] for i in kept), *made_names)


def _raw(df: DataFrame, names: list[str], trees: GBTClassificationModel | None) -> DataFrame:
    made = VectorAssembler(inputCols=names, outputCol="_features").transform(df)
    return made if trees is None else trees.transform(made).withColumn("_raw", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on at most `rows` labelled documents whose ids meet `keep`."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, rows)
    seen = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not seen.get(0) or not seen.get(1):
        return Toxicity({}, None, None, 1.0 if seen.get(1) else 0.0)
    fitted, rest = parts(sample, 4, 3)
    lexicon = learn_lexicon(fitted)

    def featured(rows: DataFrame) -> DataFrame:
        return checkpointed(_raw(*with_features(rows, "text", lexicon, True), None))

    made = featured(fitted).withColumn("_weight", F.when(F.col("label") == 1, min(8.0, seen[0] / seen[1])).otherwise(1.0))
    booster = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", predictionCol="_prediction", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=max(1, min(20, seen[1] // 10)), seed=11)
    trees = booster.fit(made)
    scored = trees.transform(featured(rest)).withColumn("_raw", vector_to_array("probability")[1])
    steps = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_step").fit(scored.select("_raw", F.col("label").cast("double").alias("label")))
    return Toxicity(lexicon, trees, steps)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learnt only where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0)
    return model.score(docs, drop_text=True, raw="raw").select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")
