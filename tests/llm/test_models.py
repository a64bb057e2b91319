"""Language and toxicity on held-out texts, and on odd ones."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from arbor.llm import langid, toxicity
from arbor.llm.common import table
from tests.llm.conftest import empty, frame

SPEECH = {"en": "the and ing tion of that with is was for", "de": "der und ung die nicht schaft ist zu ein ich", "fr": "le la les des eaux ment que une dans est"}


def texts(rng, lang, n=40):
    parts = SPEECH[lang].split()
    return " ".join(rng.choice(parts) + rng.choice(["", *parts]) for _ in range(n))


def test_languages(spark, cases):
    rng = random.Random(1)
    rows = [(i, texts(rng, lang), lang) for i, lang in enumerate(list(SPEECH) * 100)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !? 34", "en"), (902, "", None)], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs), "doc_id", "lang").collect()
    held = [r for r in found if r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and not any(r["rejected"] for r in held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in found if r["doc_id"] >= 900)
    odd = langid.identify(frame(spark, cases), langid.fit(docs), "doc_id").collect()
    assert len(odd) == len(cases) and all(0 <= r["score"] <= 1 and r["lang_pred"] in {*SPEECH, "und"} for r in odd)
    assert langid.identify(empty(spark), langid.fit(docs), "doc_id").collect() == []


def test_without_labels_all_is_undetermined(spark, cases):
    docs = frame(spark, cases).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs), "doc_id").collect()} == {"und"}


def test_toxicity_reaches_unseen_spellings(spark, cases):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = texts(rng, "en").split()
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "nasty" + rng.choice(["", "x", "oo", "ly", "est", str(i)])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, told)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, "doc_id").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum((got[i] >= 0.3) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    odd = toxicity.score(frame(spark, cases), model, "doc_id").collect()
    assert len(odd) == len(cases) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty(spark), model, "doc_id").collect() == []
    none = toxicity.fit(docs, told.where("false"))
    assert {r["score"] for r in toxicity.score(docs, none, "doc_id").collect()} == {0.5}


def test_what_no_language_resembles_is_rejected(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
    other = [(10**9 + n, letters(n), None) for n in (60, 100, 200, 500, 2000, 8000)] + [(10**9 + 10**6 + n, finnish * n, None) for n in (1, 2, 5, 30)]
    known = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    docs = known.unionAll(spark.createDataFrame(other, known.schema))
    found = langid.identify(docs, langid.fit(docs), "doc_id", "lang", "text").collect()
    held = [r for r in found if r["lang"] and any(c.isalpha() for c in r["text"] or "") and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r["rejected"] for r in held) <= 0.01 * len(held)
    assert all(r["rejected"] for r in found if r["doc_id"] >= 10**9)


def test_fits_leave_little_memory_with_the_driver(spark, monkeypatch):
    given = []
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "give_back", lambda name=module.__name__: given.append(name))
    docs = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    langid.fit(docs)
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    assert given == [langid.__name__, toxicity.__name__]
    rng = np.random.default_rng(1)
    tf, by = rng.random((700, 64), np.float32), rng.random(64, np.float32)
    told = langid.unit(tf * by)
    x = langid.weighted(tf, by)
    assert x is tf and np.array_equal(x, told)
