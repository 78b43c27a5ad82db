import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from daqframe.llm import langid, quality_classifier
from daqframe.llm.sampling import sampled
from daqframe.llm.textblock import TextBlock, mix
from tests.llm.conftest import prose


def good_and_bad(n):
    return [(i, prose(i, 60 + i % 40) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 50).split())) for i in range(n)]


def test_quality_on_held_out_rows(spark, documents, odd_rows):
    rows = [(1000 + i, t) for i, t in good_and_bad(400)]
    labels = spark.createDataFrame([(i, int((i - 1000) % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(documents(odd_rows + rows + [(1001, rows[1][1]), (None, "x")]), labels).collect()
    assert len(got) == len(odd_rows) + 402
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert len(held) > 40 and sum((r.score >= 0.5) == ((r.doc_id - 1000) % 3 > 0) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 1001}) == 1


def test_quality_score_does_not_depend_on_batches():
    texts = [t for _, t in good_and_bad(60)]
    model = quality_classifier.train(pa.array(texts), np.array([int(i % 3 > 0) for i in range(60)]))
    one = [model.score(pa.array([t]))[0] for t in texts]
    assert one == list(model.score(pa.array(texts)))


def test_quality_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_classifier.classify(documents([(1, "a"), (2, None)]), labels).collect()] == [0.5, 0.5]
    assert quality_classifier.classify(documents([]), labels).collect() == []


WORDS = {"en": "the of and that with there is a house on hill", "de": "der die und das mit ist ein haus auf berg für", "fr": "le la et que avec est une maison sur colline é"}


def test_language_on_held_out_rows(spark, documents, odd_rows):
    rng = random.Random(1)
    rows = [(1000 + i, " ".join(rng.choices(WORDS[lang].split(), k=30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    got = langid.identify(documents(odd_rows + rows + [(None, "the of and", "en")])).collect()
    assert len(got) == len(odd_rows) + 301
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert all((by[i] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in odd_rows)


def test_language_without_rows_to_learn_from(spark, documents):
    assert langid.identify(documents([])).collect() == []
    assert [tuple(r[2:]) for r in langid.identify(documents([(1, "some text")])).collect()] == [("und", 0.0)]


def texts_for_scores():
    rng = random.Random(8)
    letters = "abc XYZ\n é漢ß\U0001f600İႠ\U00010400.1"
    return ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(80)] + [None, "", "a", "漢漢", "one two  three"]


def hash_of(grams, n):
    """The hash of an n-gram of code points, one number at a time."""
    gram = 0
    for k in range(n):
        gram = ((gram + grams[k]) * 2654435761) & 0xFFFFFFFF
        gram ^= gram >> 15
    return (gram * 0x85EBCA6B) & 0xFFFFFFFF


def test_language_scores_equal_a_direct_regression():
    rng = random.Random(3)
    texts = texts_for_scores()
    labels = [rng.choice(["en", "de", "x"]) for _ in texts]
    model = langid.train(pa.array(texts, pa.string()), labels)
    names, scores = model.predict(pa.array(texts, pa.string()))
    for text, name, score in zip(texts, names, scores):
        points = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text or ""]
        logits = list(model.bias)
        for n in (1, 2, 3):
            found = Counter((hash_of(points[i : i + n], n) >> 17) + (n - 1) * langid.BUCKETS for i in range(len(points) - n + 1))
            for bucket, count in found.items():
                for k in range(len(logits)):
                    logits[k] += count / sum(found.values()) * float(model.weight[k][bucket]) / langid.SCALE
        e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0.0)
        else:
            assert abs(score - max(e) / sum(e)) < 1e-9 and name == model.languages[e.index(max(e))]


def test_quality_scores_equal_a_direct_average():
    texts = texts_for_scores()
    model = quality_classifier.train(pa.array(texts, pa.string()), np.array([i % 3 > 0 for i in range(len(texts))], int))
    for text, score in zip(texts, model.score(pa.array(texts, pa.string()))):
        words = [int(x) for x in word_hashes(text)]
        buckets = [w >> 48 for w in words]
        buckets += [(int(mix(np.array([(a + 3 * b) % 2**64], np.uint64))[0]) >> 48) + quality_classifier.BUCKETS for a, b in zip(words, words[1:])]
        points = [ord(c) for c in text or ""]
        for k, n in enumerate((3, 4)):
            buckets += [(hash_of(points[i : i + n], n) >> 16) + (2 + k) * quality_classifier.BUCKETS for i in range(len(points) - n + 1)]
        logit = sum(int(model.weight[b]) for b in buckets) / quality_classifier.SCALE / max(len(buckets), 1) + model.bias
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-9


def word_hashes(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        block = TextBlock.of([w])
        out.append(block.hashes(*block.words()[:2])[0])
    return out


def test_gradients_move_towards_the_labels():
    """The reduced weights are those of average and softmax: on the rows that it has learned from, scores go to their labels."""
    texts = [t for _, t in good_and_bad(120)]
    label = np.array([int(i % 3 > 0) for i in range(120)])
    score = quality_classifier.train(pa.array(texts), label).score(pa.array(texts))
    assert ((score >= 0.5) == label).all()


def test_rows_of_one_doc_id_are_learned_as_their_own_lang(spark, documents):
    rows = [(i, f"the of and that {i}", "en") for i in range(20)] + [(i, f"le la et que {i}", "fr") for i in range(20)] + [(i, f"zzz {i}", None) for i in range(20)]
    drawn = {(r.doc_id, r.label, r.text.split()[0]) for r in sampled(documents(rows).withColumn("label", F.col("lang")), 100, 1 << 10, 1 << 20).collect()}
    assert drawn == {(i, lang, word) for i in range(20) for lang, word in (("en", "the"), ("fr", "le"))}
    got = langid.identify(documents(rows)).collect()
    by_text = {(r.doc_id, r.lang_pred) for r in got}
    assert {(i, x) for i in range(20) for x in ("en", "fr")} <= by_text


def test_samples_are_bounded(spark, documents):
    rows = [(1, "same text")] * 500 + [(1, "other text")] + [(i, "x" * (10 + i)) for i in range(2, 60)] + [(100, "y" * 500)]
    marked = documents(rows).withColumn("label", F.when(F.col("doc_id") == 100, 0).otherwise(1))
    got = sampled(marked, 40, 30, 2000).collect()
    assert len(got) == 40 and sum(r.doc_id == 1 for r in got) <= 1
    assert [r.doc_id for r in got if r.label == 0] == [100]
    assert all(len(r.text) <= 30 for r in got if r.label == 1 and r.doc_id <= 20)
    assert sum(len(r.text) for r in sampled(marked, 400, 30, 700).collect()) <= 700


def test_document_frequencies_cover_all_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(texts_for_scores())]
    seen, total = langid.document_frequencies(documents(rows))
    want = np.zeros(langid.ORDERS * langid.BUCKETS, int)
    for _, t in rows:
        points = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in t or ""]
        for n in (1, 2, 3):
            for b in {(hash_of(points[i : i + n], n) >> 17) + (n - 1) * langid.BUCKETS for i in range(len(points) - n + 1)}:
                want[b] += 1
    assert total == len(rows) and (seen == want).all()
