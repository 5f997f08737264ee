import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.llm.language import Profiles, fit_prototypes
from sagebrook.llm.pairs import DEFECTS, Hashed, defective_pairs, features, made_pairs, prompt_pairs, train_classifier, training_pairs

from .test_language import WORDS, made


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    langs = ["en", "tr", "de"]
    proto = fit_prototypes([" ".join(made(x, 50 * i + j) for j in range(3)) for i in range(40) for x in WORDS], [x for _ in range(40) for x in WORDS])
    pick = [r.choice(langs) for _ in range(600)]
    q = [made(x, 10_000 + i, 8)[:-1] + "?" for i, x in enumerate(pick)]
    a = [" ".join(made(x, 20_000 + 7 * i + j) for j in range(r.randint(1, 4))) for i, x in enumerate(pick)]
    return train_classifier(q[:450], a[:450], proto), proto, q[450:], a[450:], pick[450:]


def test_held_out_accuracy(model):
    clf, proto, q, a, langs = model
    qs, ans, y, _ = made_pairs(q, a, langs, seed=99)
    p = clf.scores(*features(qs, ans, Profiles(proto))) >= clf.thresholds
    for k, d in enumerate(DEFECTS):
        if y[:, k].sum() >= 5:
            assert p[y[:, k] == 1, k].mean() >= 0.85, d
            assert p[y[:, k] == 0, k].mean() <= 0.05, d


def test_pairs_and_edges(spark, model):
    clf, proto, *_ = model
    good = made("en", 1) + " " + made("en", 2)
    rows = [
        ("m1", "c", "Human", made("en", 3)[:-1] + "?", 1, 1), ("m2", "c", "bot", "  ", 1, 1), ("m3", "c", "user", "Why is the dose of this drug not given?", 3, 1), ("m4", "c", "assistant", good, 4, 1), ("m4", "c", "assistant", good, 4, 2),
        ("m5", "c", "assistant", good, 5, 1), ("m6", None, "user", "x", 1, 1), ("m7", None, "assistant", None, 2, 1), ("m8", "d", "user", None, None, 1), ("m9", "d", "assistant", None, None, 1), ("m0", "d", "what", "?", 9, 1),
    ]
    df = spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, t int, ingested_at int").withColumn("created_at", F.timestamp_seconds("t")).withColumn("question", F.lit("clash"))
    pairs = prompt_pairs(df)
    assert sorted((r["question_id"], r["answer_id"]) for r in pairs.collect()) == [("m1", "m2"), ("m3", "m4"), ("m8", "m9")]
    got = {(r["answer_id"], r["defect"]) for r in defective_pairs(pairs, clf, proto).collect()}
    assert {("m2", "empty"), ("m9", "empty")} <= got
    assert not any(a == "m4" for a, _ in got)
    assert prompt_pairs(df.limit(0)).count() == 0
    nothing = train_classifier(*training_pairs(prompt_pairs(df.limit(0))), proto)
    assert {r["defect"] for r in defective_pairs(pairs, nothing, proto).collect()} == {"empty"}
    assert np.isfinite(clf.thresholds).all()


def test_five_rounds_of_training_and_cleaning(monkeypatch):
    from sagebrook.llm.pairs import Classifier

    rounds, kept = [], Classifier.calibrate
    monkeypatch.setattr(Classifier, "calibrate", lambda self, *a, **k: (rounds.append(1), kept(self, *a, **k))[1])
    proto = fit_prototypes([made(x, i) for i in range(10) for x in WORDS], [x for _ in range(10) for x in WORDS])
    train_classifier([made("en", 500 + i, 8)[:-1] + "?" for i in range(60)], [made("en", 900 + i) + " " + made("en", 1900 + i) for i in range(60)], proto)
    assert len(rounds) == 5


def test_swaps_within_a_language_are_sound_and_balance_those_between():
    q, a, langs = [f"what of {i}?" for i in range(60)], [f"answer {i}" for i in range(60)], ["en", "tr"] * 30
    qs, ans, y, source = made_pairs(q, a, langs)
    assert qs[:60] == q and ans[:60] == a and not y[:60].any() and len(qs) == len(ans) == len(y) == len(source)
    wrong = np.flatnonzero(y[:, DEFECTS.index("wrong_language")])
    assert len(wrong) >= 10
    for i in wrong:
        given, j = source[i]
        assert langs[given] != langs[j] and ans[i] == a[j] == ans[i + 1] and not y[i + 1].any()
        assert langs[q.index(qs[i + 1])] == langs[j] and qs[i] == q[given]


def test_languages_asked_for():
    from sagebrook.llm.pairs import _asked

    assert _asked("Bunu alabilir miyim? Lütfen İspanyolca yanıtla.") == {"es"}
    assert _asked("LÜTFEN İNGİLİZCE YANITLA") == {"en"} and _asked("Bitte antworte auf français.") == {"fr"} and not _asked("Bu nedir?")


def test_ngrams_serve_every_defect(model):
    clf = model[0]
    trained = np.abs(clf.sparse).sum(axis=1)
    assert all(trained[DEFECTS.index(d)] > 0 for d in DEFECTS)
    assert clf.scores(np.zeros((0, clf.dense.shape[1])), Hashed([])).shape == (0, len(DEFECTS))
    each = [np.array([3, 5]), np.zeros(0, np.int64), np.array([5])]
    places, own, weight = Hashed(each)[np.array([2, 0, 1])]
    assert places.tolist() == [5, 3, 5] and own.tolist() == [0, 1, 1] and np.allclose(weight, [1, 2**-0.5, 2**-0.5])
