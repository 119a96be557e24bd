import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity, trees

D = "/root/testdata/sf0.1"


def measured(spark, query, label):
    """(rows, accuracy, recall of the rarer class, share of the other class taken for it) on held-out labels."""
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = query(spark, D).join(labels, "doc_id").filter("held_out").select("predicted", "score", label).collect()
    rare = 1 if label == "toxic" else 0
    hit = [r for r in rows if r[label] == rare]
    rest = [r for r in rows if r[label] != rare]
    return len(rows), sum(r.predicted == r[label] for r in rows) / len(rows), sum(r.predicted == rare for r in hit) / len(hit), sum(r.predicted == rare for r in rest) / len(rest)


def test_toxicity_held_out(spark):
    rows, accuracy, recall, wrong = measured(spark, toxicity.op5_toxicity, "toxic")
    assert rows > 500 and accuracy > 0.97 and recall > 0.85 and wrong < 0.01


def test_quality_held_out(spark):
    rows, accuracy, recall, wrong = measured(spark, quality.op2_quality, "quality")
    assert rows > 500 and accuracy > 0.94 and recall > 0.85 and wrong < 0.06


@pytest.fixture()
def odd(spark):
    good, bad = "the quiet river runs along the old town and its mills ", "you IDIOT!!! such w0rthless tr@sh you pathetic loser!!! "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (102, good * 4000), (102, good * 4000)]
    docs = spark.createDataFrame([(i, t, "x", 1.0, 2.0) for i, t in rows], "doc_id long, text string, score string, hits double, _features double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(60)] + [(None, 1, 0), (5, None, None), (5, 0, 1)], "doc_id long, toxic int, quality int")
    return docs, labels


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_edges(odd, module, label):
    docs, labels = odd
    model = module.fit(docs, labels, label)
    got = model.score(docs)
    assert got.columns == [*docs.columns, "score_"]
    rows = got.collect()
    assert len(rows) == 64 and all(0 <= r.score_ <= 1 for r in rows) and {r.score for r in rows} == {"x"}
    by = {r.doc_id: r.score_ for r in rows}
    assert by[100] == by[101] and len({r.score_ for r in rows if r.doc_id == 102}) == 1
    one = labels.filter("doc_id % 3 = 0").select("doc_id", label)
    positive = one.first()[label]
    assert {r.score_ for r in module.fit(docs, one, label).score(docs).collect()} == {float(positive)}
    assert module.fit(docs, labels.limit(0), label).score(docs).count() == 64
    assert model.score(docs.limit(0)).count() == 0


def texts_of(spark, rows):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(rows)


def test_quality_against_a_plain_version(spark):
    """Sizes by zstandard, block by block, and the logistic function of them."""
    docs = texts_of(spark, 300)
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.constant is None

    def size(data, dictionary):
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(data[k : k + quality.BLOCK])) for k in range(0, len(data), quality.BLOCK))

    for r in model.score(docs).collect():
        data = (r.text or "").encode()
        g, b = (size(data, d) for d in (model.good, model.bad))
        inputs = ((b - g) / (b + g), math.log(min(g, b) / len(data))) if data else (0.0, 0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(sum(x * y for x, y in zip(model.slopes, inputs)) + model.offset))), abs=1e-9)


def plain_features(text, lexicon):
    """The features by their definitions, token by token."""
    def weigh(word):
        stems = [word] + [word[:k] + "*" for k in toxicity.STEMS if len(word) > k]
        return max([lexicon.get(k, 0.0) for k in stems])

    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)
    rows = []
    for token in tokens:
        words = re.findall(r"[^\W\d_]+", token.lower())
        weight = max([weigh(w) for w in words], default=0.0)
        mixed = re.search(r"[^\W\d_][\d@$!|€*._\-]+[^\W\d_]", token) is not None and "@" not in token.strip("@")[1:-1].replace("@", "", 1) and not token[-1].isdigit()
        undone = token.lower().translate(str.maketrans("013457@$!|€", "oieastasile"))
        hidden = max(weigh("".join(re.findall(r"[^\W\d_]+", x))) for x in (undone, token.lower())) if mixed and not weight else 0.0
        uppers = sum(c.isupper() for c in token)
        rows.append((weight, hidden, any(w in toxicity.SECOND_PERSON for w in words), uppers >= 2 and token.isupper(), uppers, sum(map(len, words)), len(re.findall(r"[^\w\s]", token)), token.count("!"), mixed, len(token)))
    n = len(rows)
    hits = [i for i, r in enumerate(rows) if r[0] > 0 or r[1] > 0]
    yous = [i for i, r in enumerate(rows) if r[2]]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in yous) for i in hits)
    total = [float(np.sum(np.array([r[k] for r in rows], np.float32), dtype=np.float64)) for k in range(10)]
    strongest = max(max(np.float32(r[0]), np.float32(r[1])) for r in rows)
    n_hidden = sum(r[1] > 0 for r in rows)
    return [len(hits), len(hits) / n, total[0] + total[1], (total[0] + total[1]) / n, strongest, n_hidden, n_hidden / n, near / len(hits) if hits else 0.0, total[2] / n, total[4] / max(total[5], 1.0), total[3] / n, total[6] / max(total[9], 1.0), total[7] / max(total[9], 1.0), total[8] / n, math.log1p(n)]


def test_toxicity_against_a_plain_version(spark):
    docs = texts_of(spark, 300)
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.trees is not None
    bounds, values = list(model.steps.boundaries), list(model.steps.predictions)
    for r in model.score(docs, raw="raw").collect():
        raw = model.trees.predictProbability(Vectors.dense(plain_features(r.text, model.lexicon)))[1]
        assert r.raw == pytest.approx(raw, abs=1e-9)
        assert r.score == pytest.approx(float(np.interp(raw, bounds, values)), abs=1e-9)


def test_trees_as_sql_against_the_models(spark):
    rng = np.random.default_rng(4)
    rows = [(*map(float, x), float(x[0] * x[1] > 0.2 or x[2] > 0.9)) for x in rng.random((1_500, 3)).round(3)]
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, label double"))
    boosted = GBTClassifier(maxIter=6, maxDepth=4, seed=1).fit(data)
    got = boosted.transform(data).select(F.expr(trees.boosted_probability(boosted, ["a", "b", "c"])).alias("sql"), vector_to_array("probability")[1].alias("model")).collect()
    forest = RandomForestRegressor(numTrees=7, maxDepth=6, seed=1).fit(data)
    got += forest.transform(data).select(F.expr(trees.forest_probability(forest, ["a", "b", "c"])).alias("sql"), F.col("prediction").alias("model")).collect()
    assert len(got) == 3_000 and max(abs(r.sql - r.model) for r in got) < 1e-9
