import math
import random

import pytest
from pyspark.sql import functions as F

from sampleloom.llm import rule_ensemble as re_


def texts(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice("the of and tion ness hall river stone bridge garden".split()) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(5, 80))]
        bad = i % 3 == 0
        out.append((i, " | ".join(words) if bad and i % 2 else " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".", int(not bad)))
    return out


def test_rules_of_a_printed_forest():
    debug = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 <= 1.5)
      Predict: 0.0
     Else (feature 2 > 1.5)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
"""
    assert re_.rules_of(debug) == [((0, True, 0.5),), ((0, True, 0.5), (2, True, 1.5)), ((0, True, 0.5), (2, False, 1.5)), ((0, False, 0.5),), ((0, True, 0.25),)]


def test_statistics():
    s = dict(zip(re_.STATISTICS, re_.statistics("Aa b b 12\nx|!")))
    assert s["distinct_words"] == 4 / 5 and s["repeats_next"] == 1 / 5 and s["distinct_lines"] == 1
    assert s["upper"] == 1 / 13 and s["digit"] == 2 / 13 and s["pipe"] == 1 / 13 and s["bang"] == 1 / 13
    assert s["log_words"] == math.log1p(5) and s["mean_word"] == 9 / 5
    assert all(map(math.isfinite, re_.statistics("")))


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(texts(300, 1), "doc_id long, text string, label int")
    return re_.fit(re_.with_statistics(docs).join(docs.drop("text"), "doc_id"))


def test_learned_rules_and_column(spark, fitted):
    assert 0 < len(fitted.rules) < 150 and fitted.describe()
    rows = texts(120, 2)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, ""), (502, "x " * 100000), (None, "a b."), (502, "x " * 100000)], "doc_id long, text string").withColumn("digit", F.lit("q"))
    out = re_.with_statistics(docs).select("doc_id", fitted.score().alias("score"), *re_.STATISTICS).collect()
    assert len(out) == 125 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert sum((by[i].score > 0.5) == bool(y) for i, _, y in rows) > 110
    for r in out:  # the column is the sum of the weights of the rules that hold
        total = fitted.intercept + sum(w for rule, w in fitted.rules if all((r[re_.STATISTICS[f]] <= t) == below for f, below, t in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "doc_id long, text string, label int")
    stats = re_.with_statistics(docs).join(docs.drop("text"), "doc_id")
    assert re_.fit(stats).score() is not None and re_.fit(stats.limit(0)).intercept == 0.0
    assert re_.with_statistics(docs.limit(0)).count() == 0


def test_held_out(spark):
    out = re_.op10_rule_ensemble(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95, auc
    print("auc", auc, sum(r.predicted == r.quality for r in out) / len(out))


def test_query_against_the_plain_form(spark, monkeypatch):
    """Every row of the query: the rules of the model that it learned, over each text's own statistics; labels of the fold that
    is held out are not learned from."""
    import zlib

    learn, made = re_.fit, []
    monkeypatch.setattr(re_, "fit", lambda rows: made.append((learn(rows), {r.doc_id for r in rows.collect()})) or made[0][0])
    data = "/root/testdata/sf0.01"
    out = re_.op10_rule_ensemble(spark, data).collect()
    model, used = made[0]
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(out) == len(texts_) and used and not {r.doc_id for r in out if r.held_out} & used
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
        s = re_.statistics(texts_[r.doc_id] or "")
        total = model.intercept + sum(w for rule, w in model.rules if all((s[f] <= t) == below for f, below, t in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
