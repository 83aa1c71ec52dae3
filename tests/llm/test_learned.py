"""Operators that learn: held-out accuracy, exact parts, and the pipeline against plain versions."""

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, near_classes
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from plumbline.llm import language, personal_data, quality
from plumbline.llm.boosting import BoostedTrees

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 .,!"), (4, "é"), (5, "the " * 20_000), (5, "the " * 20_000), (None, "und der die das"), (6, "a\x00b �")]


def test_languages_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = entry_module.queries()["op4_language"](spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.select("text", "lang"))
    rows = language.identify(documents(spark, ODD), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        no_letter = r.text is None or not re.search(r"[^\W\d_]", r.text)
        assert (r.lang_pred == "und") == no_letter and (r.score == 0 and r.rejected or not no_letter)
        assert r["a.b"] == "t"
    far = documents(spark, [(1, "Ωδξψ φχβθ ζηνκ " * 200), (2, docs.where("n_chars > 1000").first().text)])
    assert [r.rejected for r in language.identify(far, model).orderBy("doc_id").collect()] == [True, False]
    # Every length has a limit, also those that no document has.
    same = documents(spark, [(n, "Ωδξψ φχβθ ζηνκ " * n) for n in (1, 2, 5, 30, 200, 1000, 20_000)])
    assert all(r.rejected for r in language.identify(same, model).collect())
    known = docs.where("n_chars > 1000").first().text
    same = documents(spark, [(n, known[:n]) for n in (2, 5, 10, 30, 100, 300)] + [(n, known * n) for n in (1000, 7, 50)])
    assert not any(r.rejected for r in language.identify(same, model).collect())
    # A text in very many copies is one of the sample; too many languages are refused.
    copies = spark.range(4000).select(F.lit("der Hund und die Katze").alias("text"), F.lit("de").alias("lang"))
    some = language.learn(copies.union(docs.select("text", "lang")), per_language=40)
    truth = language.identify(docs.where("n_chars > 200"), some).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert truth > 0.97
    with pytest.raises(ValueError, match="10 different languages"):
        language.learn(docs.select("text", F.col("doc_id").cast("string").alias("lang")), most_languages=10)
    assert language.learn(docs.select("text", F.lit(None).cast("string").alias("lang"))) is None
    assert {r.lang_pred for r in language.identify(documents(spark, ODD), None).collect()} == {"und"}
    assert language.identify(documents(spark, []).limit(0), model).count() == 0


def test_languages_are_fitted_outside_the_driver(spark):
    """The sampled texts of a language meet in a task of that language; the driver gets centroids and numbers."""
    draw = random.Random(5)
    letters = {"x": "abcdef", "y": "ghijkl", "z": "mnopqr"}
    word = lambda lang: "".join(draw.choices(letters[lang], k=draw.randint(2, 7)))
    rows = [(" ".join(word(lang) for _ in range(draw.randint(5, 60))), lang) for lang in letters for _ in range(300)]
    docs = spark.createDataFrame([*rows, ("stuvw " * 9, "single")], "text string, lang string")
    tracemalloc.start()
    model = language.learn(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
    assert model.languages == ["single", "x", "y", "z"] and np.bincount(model.of).tolist() == [1, 4, 4, 4]
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    # Of each language with several texts a quarter is held back, whole and some also as a piece; these make the limits.
    assert len(model.lengths) > 1 and (model.least > 0).all()
    found = language.identify(docs, model)
    assert found.where("lang_pred <> lang").count() == 0 and found.where("rejected").count() < 10


def test_languages_are_fitted_in_little_memory():
    """No task holds a sample with all its zeros, which would be 39 MB for each 1,200 texts."""
    draw = np.random.default_rng(6)
    cells = [np.sort(draw.choice(language.BUCKETS, 200, replace=False)).astype(np.int16) for _ in range(2400)]
    counts = [draw.integers(1, 9, 200).astype(np.float32) for _ in cells]
    rows = pa.table({
        "hash": pa.array([i // 2 - 600 for i in range(2400)], pa.int64()), "piece": [i % 2 == 1 for i in range(2400)],
        "cells": [c.tobytes() for c in cells], "counts": [c.tobytes() for c in counts],
    })
    idf = draw.uniform(1, 5, language.BUCKETS).astype(np.float32)
    tracemalloc.start()
    own, lengths, cosines = language.fitted(rows.take(draw.permutation(2400)), idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    # Against the same steps on whole matrices.
    dense = np.zeros((2400, language.BUCKETS), np.float32)
    for row, c, n in zip(dense, cells, counts, strict=True):
        row[c] = n
    x = language.weighted(dense, idf)
    whole, held = np.arange(2400) % 2 == 0, np.arange(2400) // 2 % 4 == 1

    def plain(x):
        chosen = [int(np.argmax(x @ x.mean(axis=0)))]
        while len(chosen) < language.CLUSTERS:
            chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
        centroids = x[chosen]
        for _ in range(language.ROUNDS):
            label = np.argmax(x @ centroids.T, axis=1)
            totals = np.stack([x[label == k].sum(axis=0) if (label == k).any() else c for k, c in enumerate(centroids)])
            centroids = totals / np.linalg.norm(totals, axis=1)[:, None]
        return centroids

    assert np.allclose(own, plain(x[whole]), atol=1e-5)
    assert np.allclose(cosines, (x[held] @ plain(x[whole & ~held]).T).max(axis=1), atol=1e-5)
    assert np.allclose(lengths, np.log2(dense[held].sum(axis=1)))


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = entry_module.queries()["op5_quality"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert auc(score, label) > 0.97 and np.mean((score >= 0.5) == (label == 1)) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_odd_documents_and_without_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    assert 0.7 < model.prior < 0.98
    rows = quality.score(documents(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert quality.learn(docs, labels.where("quality = 0")) is None
    # A table of which every row is labelled teaches as well, and a row in very many copies changes little.
    both = docs.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    copies = both.union(both.limit(1).crossJoin(spark.range(3000)).drop("id"))
    for rows in (both, copies):
        model = quality.learn(rows.drop("quality"), labels)
        scored = quality.score(both.select("doc_id", "quality", "text"), model).collect()
        assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.95
    assert {r.score for r in quality.score(documents(spark, ODD), None).collect()} == {0.5}
    assert quality.score(documents(spark, []).limit(0), model).count() == 0


def test_class_prior_and_risk():
    pick = np.random.default_rng(0)
    good, bad = pick.normal(1.5, 1, (3000, 4)), pick.normal(-1.5, 1, (3000, 4))
    unlabelled = np.concatenate([good[1500:2900], bad[:600]])
    prior = quality.class_prior(good[:1500], unlabelled)
    assert abs(prior - 0.7) < 0.08
    network = quality.fit(good[:1500], unlabelled, prior, 1)
    assert (network.output(network.standard(good[2900:])) > 0).mean() > 0.97
    assert (network.output(network.standard(bad[600:])) < 0).mean() > 0.97


def test_boosted_trees_learn_an_exclusive_or():
    x = np.random.default_rng(0).uniform(-1, 1, (2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = BoostedTrees().fit(x[:1500], y[:1500]).probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


# The formats of base spans.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and personal_data.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_the_formats():
    pick = random.Random(4)
    for _ in range(8000):
        text = "".join(pick.choice("a@.+-0123 9(b)_é") for _ in range(pick.randint(0, 45)))
        assert sorted(personal_data.base_spans(text)) == sorted(plain_spans(text)), text
    assert personal_data.base_spans("card 4532015112830366, ip 0001.2.3.255") == [("ip", 26, 38), ("card", 5, 21)]
    assert personal_data.luhn("4532015112830366") and not personal_data.luhn("4532015112830367")


def test_personal_data_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = entry_module.queries()["op6_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    added = []
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        base = plain_spans(texts[r.doc_id])
        assert [s for s in spans if s[0] in FORMATS] == base
        added += [texts[r.doc_id][a:b] for k, a, b in spans if k not in FORMATS]
    secrets = {m for t in texts.values() for m in re.findall(r'(?:password=|token = ")([0-9a-f]+)', t)}
    assert secrets and set(added) == secrets


RARE = {
    20: ("mail me: jane (at) host (dot) com please", "contact", "jane (at) host (dot) com"),
    21: ("set password=x7Kq92mVbT4w now", "secret", "x7Kq92mVbT4w"),
}


def found_in(rows):
    return {(r.doc_id, s.kind, r.text[s.begin : s.end]) for r in rows for s in r.spans if s.kind not in FORMATS}


def test_rare_kinds_are_found_in_any_table(spark):
    rare = [(i, t) for i, (t, _, _) in RARE.items()]
    wanted = {(i, kind, value) for i, (_, kind, value) in RARE.items()}
    common = [(i, f"{i} items, order 57310803{i:08d} was sent on day {i}") for i in range(1000, 9000)]
    for texts in (rare, rare + common):
        docs = documents(spark, texts)
        model = personal_data.learn(docs)
        assert set(model.judges) == set(personal_data.GENERATORS)
        assert found_in(personal_data.find(docs.where("doc_id < 100"), model).collect()) == wanted
    # One text in many copies neither fills the sample nor leaves it.
    docs = documents(spark, rare + common[:50] + [(5, common[0][1])] * 4000)
    assert found_in(personal_data.find(docs.where("doc_id < 100"), personal_data.learn(docs, sample=20)).collect()) == wanted


def test_all_candidates_of_all_texts_teach(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(personal_data, "_drawn", refused)
    many = "".join(f"order 57310803{i:05d} of day {i}, " for i in range(150))
    texts = [many, *(f"{i} items, order 57310803{i:08d} was sent with password=a{i:05d}bcd" for i in range(1700))]
    docs = documents(spark, list(enumerate(texts + texts[:30])))
    taught = personal_data._taught(docs.select("text", F.xxhash64("text").alias("hash"))).groupBy("generator").sum("n").collect()
    plain = Counter(personal_data.GENERATORS.index(g) for t in texts for g, _, _ in personal_data.examples(t))
    assert {r[0]: r[1] for r in taught} == plain and plain[2] == 1850
    # However the table is dealt to tasks, the same is learnt.
    one, other = (personal_data.learn(docs.repartition(n, "doc_id")) for n in (1, 7))
    for name, judge in one.judges.items():
        assert judge.threshold == other.judges[name].threshold
        assert np.array_equal(judge.steps, other.judges[name].steps) and np.array_equal(judge.levels, other.judges[name].levels)


def test_long_values_are_covered_whole(spark):
    pick = random.Random(8)
    some = lambda letters, n: "".join(pick.choice(letters) for _ in range(n))
    code = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    signature, key, late = some(code, 342), some(code + "+/", 2400) + "==", some("abcdef", 90) + some(code, 5000) + "7"
    texts = [f"go password={some(code, 300)}7a end", f"with token: {signature} end", f'api_key = "{key}" end', f"secret: {late} end"]
    for text, value in zip(texts[1:], (signature, key, late), strict=True):
        assert ("random", text.index(value), text.index(value) + len(value)) in personal_data.candidates(text)
    digits = "12 " * 30 + "7"
    assert ("digits", 2, 2 + len(digits)) in personal_data.candidates(f"a {digits} b")
    local = some("abc", 90)
    assert ("spelled", 2, 2 + len(local) + 17) in personal_data.candidates(f"a {local} (at) de (dot) fr b")
    docs = documents(spark, list(enumerate(texts)))
    found = personal_data.find(docs, personal_data.learn(docs))
    clean = [r.c for r in found.orderBy("doc_id").select(personal_data.redacted(F.col("text"), F.col("spans")).alias("c")).collect()]
    assert clean == ["go password=[SECRET] end", "with token: [SECRET] end", 'api_key = "[SECRET]" end', "secret: [SECRET] end"]
    # What makes a value random may come late in it.
    model = personal_data.learn(docs)
    for text in (f"set password={some('abcdefghij', 400)}{some(code, 300)} now", f"at {some('abcdefghij', 400)}{some(code, 300)}9 now"):
        spans = personal_data.judged([text], model)[0]
        assert [(kind, text[b:]) for kind, _, b, _ in spans] == [("secret", " now")], text
    # Read and judged in time that grows with the text.
    long = ("token=" * 50_000 + "4111111111111111", "1 " * 200_000 + "x", "1" + " " * 300_000, "a" * 300_000 + "!", "(1" * 100_000, "a-" * 200_000,
            "a@b.de 12345678x " * 20_000)
    for text in long:
        start = time.monotonic()
        personal_data.candidates(text)
        assert time.monotonic() - start < 5
        personal_data.judged([text], model)
        assert time.monotonic() - start < 40


def test_shapes_of_values_in_one_another_are_those_of_each():
    pick = random.Random(5)
    for _ in range(300):
        text = "".join(pick.choice(["ab", "C", "12", "0", " ", ":", "=", "\u00b2", "\u00e9", "_", '"', "123456789"]) for _ in range(40))
        spans = sorted({tuple(sorted(pick.sample(range(len(text) + 1), 2))) for _ in range(8)})
        spans += [(a, spans[0][1]) for a in range(spans[0][1])] + spans[:2]
        for i, shape in personal_data.shapes(text, spans):
            assert np.allclose(personal_data.features(text, "value", *spans[i], shape), personal_data.features(text, "value", *spans[i])), (text, spans[i])


def test_national_numbers_are_found_and_counts_are_not(spark):
    numbers = {
        1: ("call (212) 555-0187 today", "(212) 555-0187"), 2: ("his ssn 078-05-1120 leaked", "078-05-1120"),
        3: ("or try 415-555-0134, they said", "415-555-0134"), 4: ("tel: 2125550187 and more", "2125550187"),
        5: ("account number 8812 004417 is closed", "8812 004417"), 6: ("reach us at 646.555.0199 or not", "646.555.0199"),
    }
    other = ["years 1999-2004 were", "on 2023-04-15 it", "version 10.0.19045 of", "about 10 000 000 people", "value 3.14159265 is", "number 5731080387325255 here"]
    texts = [(i, t) for i, (t, _) in numbers.items()] + [(50 + i, t) for i, t in enumerate(other)]
    docs = documents(spark, texts)
    for model in (personal_data.learn(docs), personal_data.learn(spark.read.parquet(f"{SF}/documents.parquet"))):
        found = found_in(personal_data.find(docs, model).collect())
        assert found == {(i, "number", value) for i, (_, value) in numbers.items()}
    two = "ring 212-555-0187 415-555-0134 now"
    assert {two[a:b] for _, a, b in personal_data.candidates(two)} >= {"212-555-0187", "415-555-0134"}


def test_redaction_of_odd_documents(spark):
    texts = ODD + [(7, "é a.b@c.de é +1 (415) 555-0134, 4532015112830366 end"), (8, "b@c.de")]
    found = personal_data.find(documents(spark, texts), None)
    redacted = found.select("doc_id", "text", personal_data.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    clean = {r.doc_id: r.clean for r in redacted}
    assert clean[7] == "é [EMAIL] é [PHONE], [CARD] end" and clean[8] == "[EMAIL]" and clean[1] is None and clean[2] == ""
    assert personal_data.find(documents(spark, []).limit(0), None).count() == 0
    assert personal_data.learn(documents(spark, [(1, None), (2, "no digits")])) is None


def staged(spark, docs):
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs
    return kept


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = staged(spark, docs)
    assert all(kept[n].columns == docs.columns for n in list(kept)[:-1])
    assert kept["language_id"].count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    texts = {r.doc_id: r.text for r in kept["language_id"].collect()}
    classes, _ = near_classes(texts, 5)
    assert {r.doc_id for r in kept["near_dedup"].collect()} == {i for i, c in classes.items() if i == c}
    from test_exact import plain_hits

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = plain_hits([(r.doc_id, r.text) for r in kept["near_dedup"].collect()], items)
    assert {r.doc_id for r in kept["decontaminate"].collect()} == {h[0] for h in hits if not h[4]}
    for r in kept["personal_data"].collect():
        assert not plain_spans(re.sub(r"\[[A-Z]+\]", "  ", r.text)) and r.n_chars == len(r.text)
    last = kept["bpe"].collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in last) and len(last) == kept["decontaminate"].count()


def test_pipeline_on_odd_and_empty_documents(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = ODD + [(10, words), (10, words), (11, words + " x"), (12, "mail a@b.cd " + words[::-1])]
    kept = staged(spark, documents(spark, rows))
    assert kept["near_dedup"].where("doc_id in (10, 11)").count() == 1
    assert kept["bpe"].where("doc_id = 12").first().text.startswith("mail [EMAIL] ")
    assert kept["bpe"].first()["a.b"] == "t" and kept["bpe"].first()["score"] == "x"
    empty = staged(spark, documents(spark, []).limit(0))
    assert [f.count() for f in empty.values()] == [0] * 5
