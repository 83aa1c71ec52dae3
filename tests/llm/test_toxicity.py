"""Toxic passages: segments against all stretches, the law of chance against shuffled texts, held-out accuracy."""

import random

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_module
from plumbline.llm import toxicity
from plumbline.llm.common import Scratch, string_column

LARGE = "/root/testdata/sf0.01"
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])


def maximal(scores):
    """Maximal segments by their definition: the best stretch, then those of what lies left and right of it."""
    total = [0]
    for s in scores:
        total.append(total[-1] + s)
    found = []

    def search(a, b):
        ways = [(-(total[j] - total[i]), j - i, i, j) for i in range(a, b) for j in range(i + 1, b + 1) if total[j] - total[i] > 0]
        if ways:
            _, _, i, j = min(ways)
            search(a, i)
            found.append((i, j))
            search(j, b)

    search(0, len(scores))
    return found


def test_segments_are_the_maximal_ones():
    pick = random.Random(3)
    for _ in range(1500):
        # Distinct subsums, so that the best stretch is one.
        scores = [pick.choice([-1, 1]) * (pick.randint(1, 6) + pick.random()) for _ in range(pick.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == maximal(scores), scores
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_segments_of_a_long_row_take_linear_time():
    scores = np.tile([1.0, -0.5, 2.0, -1.8], 100_000)
    assert len(toxicity.segments(scores)) == 1
    assert len(toxicity.segments(np.tile([1.0, -2.0], 100_000))) == 100_000


def test_law_of_chance_holds_for_random_scores():
    random_ = np.random.default_rng(5)
    values, share = np.array([-1.0, 0.0, 1.0, 3.0]), np.array([0.72, 0.12, 0.12, 0.04])
    rate = toxicity._rate(values, share * 1e6)
    assert abs(share @ np.exp(rate * values) - 1) < 1e-6
    rows = [random_.choice(values, 400, p=share) for _ in range(1500)]
    best = np.array([max((s for _, _, s in toxicity.segments(r)), default=0.0) for r in rows])
    chance = toxicity.Chance(rate, float(np.log(1 / np.mean(400 * np.exp(-rate * best)))))
    for level in (0.3, 0.1, 0.02):
        expected = np.array([1 - np.exp(-chance.expected(s, 400)) for s in best])
        assert 0.4 * level < np.mean(expected <= level) < 2.2 * level
    assert chance.log_p([], 400) == 0 and chance.log_p([50.0, 40.0], 400) > chance.log_p([50.0], 400) > 20


def test_tokens_and_forms_stop_at_row_ends():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["Idiots, all", None, "", "été-x9", "idiots"])], names=["text"])
    data, offsets = string_column(batch, "text")
    starts, ends, n = toxicity.tokens(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["Idiots", "all", "été", "x9", "idiots"]
    assert n.tolist() == [2, 0, 0, 2, 1]
    found = toxicity.forms(data, starts, ends)
    assert (found[0] == found[4]).all() and found[0][1] not in found[:, 0] and (found[1][1:] == 0).all()


def made(spark, n=600):
    """Plain texts of ten words in two alphabets, one in five with two words of spite somewhere."""
    pick = random.Random(8)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        row = [pick.choice(words) for _ in range(pick.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                row.insert(pick.randrange(len(row)), pick.choice(["zzscum", "zzrot", "Wretch" + pick.choice(["ed", "es", "ing", "like"])]))
        texts.append((i, " ".join(row)))
        labels.append((i, int(bad), None))
    return texts, spark.createDataFrame(labels, LABELS)


def test_passages_cover_the_planted_words_and_unseen_endings(spark):
    texts, labels = made(spark)
    scratch = Scratch(spark)
    docs = documents(spark, texts)
    model = toxicity.learn(docs.where("doc_id % 3 != 1"), labels, docs, scratch)
    scratch.remove()
    extra = [(9000, None), (9001, ""), (9002, "plain " * 3), (9003, "bace zzscum zzrot " + "jab " * 4), (9004, "wretchedness wretchful"), (9003, "bace zzscum zzrot " + "jab " * 4)]
    extra.append((9005, "abc " * 200_000 + "zzrot zzscum wretchly " * 4 + "abc " * 50_000))
    rows = toxicity.passages(documents(spark, texts + extra), model).collect()
    assert len(rows) == len(texts) + len(extra) and "a.b" in rows[0].__fields__
    by_id = {r["doc_id"]: r for r in rows}
    held = [r for r in rows if r["doc_id"] < 9000 and r["doc_id"] % 3 == 1]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    for i in (9000, 9001, 9002):
        assert by_id[i]["passages"] == [] and by_id[i]["score"] < 0.2
    text = dict(extra)[9003].encode()
    assert [text[p["begin"] : p["end"]] for p in by_id[9003]["passages"]] == [b"zzscum zzrot"]
    assert by_id[9003]["score"] > 0.5 and by_id[9004]["score"] > 0.5 and sum(r["doc_id"] == 9003 for r in rows) == 2
    long = by_id[9005]
    assert [dict(extra)[9005].encode()[p["begin"] : p["end"]] for p in long["passages"]] == [b"zzrot zzscum wretchly " * 3 + b"zzrot zzscum wretchly"] and long["score"] > 0.5


@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(1, 1, None), (2, 1, None)], [(1, 0, None)]])
def test_without_both_kinds_of_labels_every_score_is_a_half(spark, labels):
    docs = documents(spark, [(1, "one"), (2, None)])
    scratch = Scratch(spark)
    model = toxicity.learn(docs, spark.createDataFrame(labels, LABELS), docs, scratch)
    assert model is None
    assert [r["score"] for r in toxicity.passages(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.passages(documents(spark, []), None).count() == 0


def test_held_out_documents_of_the_given_table(spark):
    rows = entry_module.queries()["op12_toxicity"](spark, LARGE)
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    assert rows.count() == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert rows.where("score < 0 or score > 1 or score is null or predicted != int(score >= 0.5)").count() == 0
    held = rows.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("toxic")).alias("right"), "toxic").collect()
    assert np.mean([r["right"] for r in held]) > 0.9
