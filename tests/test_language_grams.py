"""The language identifier's buckets are those of HashingTF, its probabilities those of Spark ML's naive Bayes."""

import random

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from glyphmill.operators import ml as M


def test_as_spark_ml(spark):
    rnd = random.Random(5)
    rows = [(t, l) for t, l in [("", "a"), (None, "b"), ("x", "a"), ("Éß", "b"), ("😀語x😀", "c")]]
    rows += [("".join(rnd.choices({"a": "abc d", "b": "bcß É", "c": "語c😀d"}[l], k=rnd.randint(0, 30))), l) for l in "aaabbc" for _ in range(20)] + [("abc", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, label string")
    f = M._Features("text", (1, 2, 3), 1 << 12)
    x = f(df)
    index = StringIndexer(inputCol="label", outputCol="_y", handleInvalid="skip").fit(x)
    nb = NaiveBayes(featuresCol="features", labelCol="_y", predictionCol="_p").fit(index.transform(x))
    want = {r.id: (index.labels[int(r._p)], r.c) for r in nb.transform(x).select("id", "_p", F.array_max(vector_to_array("probability")).alias("c")).collect()}
    got = {r.id: (r.pred, r.confidence) for r in M.train_lid(df, "text", "label", 1 << 12).transform(df).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9, (rows[i], got[i], want[i])


def test_no_n_gram_arrays_in_the_plan(spark):
    """Joining a slice of characters for every n-gram in an interpreted expression took most of the time."""
    df = spark.createDataFrame([("ab", "x"), ("cd", "y")], "text string, label string")
    assert "slice(" not in M.train_lid(df, "text", "label", 64).transform(df)._jdf.queryExecution().optimizedPlan().toString()
