import math
from collections import Counter, defaultdict
import numpy as np
import pytest
from pyspark.sql import functions as F

from cardsieve.llm import langid


def test_held_out_accuracy(docs):
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert out.filter("score < 0 or score > 1").count() == 0


def test_labels_and_sources_are_no_inputs(docs):
    model = langid.train(docs)
    a = langid.predict(docs.select("doc_id", "text"), model)
    b = langid.predict(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), model).select(*a.columns)
    assert a.exceptAll(b).count() == 0


def test_odd_rows(odd):
    out = {(r.doc_id, i): r for i, r in enumerate(langid.identify(odd).collect())}
    assert len(out) == odd.count()
    for (doc_id, _), r in out.items():
        if doc_id in (2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(odd.filter("false")).count() == 0
    none = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert [r.lang_pred for r in none.select("lang_pred").distinct().collect()] == ["und"]
    assert langid.accepted(odd).columns == odd.columns


def test_digits_only_is_unknown(spark, docs):
    model = langid.train(docs)
    assert langid.predict(spark.createDataFrame([(1, "123 456 !")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_counts_are_the_formula(spark):
    train = spark.createDataFrame([("ab", "x"), ("b", "y"), ("b", "y")], "text string, lang string")
    model = langid.train(train, buckets=1 << 12, sizes=(1,), smoothing=1.0)
    ((_, counts, words),) = langid._features(__import__("pyarrow").array(["b"]), 1 << 12, (1,))
    space, b = words[0], words[1]
    import math

    assert list(counts) == [3] and model.labels == ["x", "y"]
    assert math.isclose(model.weights[b, 1], math.log(3 / (6 + 4096)), rel_tol=1e-5) and math.isclose(model.weights[space, 0], math.log(3 / (4 + 4096)), rel_tol=1e-5)


def hashed(gram, buckets):
    """The bucket of an n-gram, character by character in whole numbers of 64 bits."""
    h = 0x9E3779B97F4A7C15 + len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x100000001B3 % 2**64
        h ^= h >> 29
    return h % buckets


def grams(text, buckets, sizes=(1, 2, 3, 4)):
    for word in text.lower().split():
        padded = f" {word} "
        yield from (hashed(padded[k : k + n], buckets) for n in sizes for k in range(len(padded) - n + 1))


def test_predictions_equal_brute_force(docs, spark):
    """Counts, weights and posteriors worked out text by text with plain Python numbers."""
    rows = [(r.doc_id, r.text[:600], r.lang) for r in docs.limit(60).collect()]
    learned = [(t, lang) for i, t, lang in rows if i % 3 and lang]
    buckets, counts, prior = 1 << 16, defaultdict(Counter), Counter()
    for text, lang in learned:
        prior[lang] += 1
        counts[lang].update(grams(text, buckets))
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(small, langid.train(small.filter("doc_id % 3 <> 0"))).collect()}
    for doc_id, text, _ in rows:
        total = {lang: math.log(prior[lang] / len(learned)) for lang in prior}
        for lang, own in counts.items():
            norm = math.log(sum(own.values()) + 0.5 * buckets)
            total[lang] += sum(math.log(own[g] + 0.5) - norm for g in grams(text, buckets))
        best = max(sorted(total), key=total.get)
        score = 1 / sum(math.exp(x - total[best]) for x in total.values())
        assert got[doc_id].lang_pred == best and got[doc_id].score == pytest.approx(score, abs=1e-3)


def test_a_very_long_word_is_read_whole_in_bounded_parts(monkeypatch):
    word, array = "abcdefghij" * 50, __import__("pyarrow").array
    whole = np.concatenate([found for _, _, found in langid._features(array([word, "xy"]), 1 << 16, (1, 2, 3, 4))])
    monkeypatch.setattr(langid, "PART", 64)
    parts = np.concatenate([found for _, _, found in langid._features(array([word, "xy"]), 1 << 16, (1, 2, 3, 4))])
    assert sorted(whole) == sorted(parts) == sorted([*grams(word, 1 << 16), *grams("xy", 1 << 16)])
