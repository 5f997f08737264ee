import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sagebrook.llm.language import LANGUAGES, Coded, Fitted, Profiles, calibrated, corrected_labels, detect, fit, fit_prototypes, label_code, norms, text_languages

WORDS = {
    "en": "the dose of this drug should not be taken with water when the patient has been given another label before".split(),
    "tr": "bu ilacın dozu hasta için uygun değildir ve etiketi su ile alınmalı sonra başka bir uyarı göre verilir".split(),
    "de": "die Dosis dieses Mittels darf nicht mit Wasser eingenommen werden wenn der Patient vorher eine andere Packung erhielt".split(),
    "ru": "доза этого препарата не должна приниматься вместе с водой если больной получил другую таблетку".split(),
}


def made(lang, seed, n=14):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def prototypes():
    texts = [(" ".join(made(x, 100 * i + j) for j in range(3)), x) for i in range(40) for x in WORDS]
    labels = [x if i % 10 else "en" for i, (_, x) in enumerate(texts)]  # a tenth is wrong
    return fit_prototypes([t for t, _ in texts], labels)


def test_held_out_accuracy(prototypes):
    p = Profiles(prototypes)
    texts = [(made(x, 9000 + i), x) for i in range(60) for x in WORDS]
    found = detect([t for t, _ in texts], p)
    right = sum(len(f) == 1 and f[0][0] == x for f, (_, x) in zip(found, texts))
    assert right >= 0.97 * len(texts)


def test_mixed_text_has_segments(prototypes):
    text = made("en", 1) + " " + made("ru", 2) + " " + made("en", 3)
    got = detect([text, "", " \n", "​"], Profiles(prototypes))
    assert [x[0] for x in got[0]] == ["en", "ru", "en"]
    assert got[0][0][2] == 0 and got[0][-1][3] == len(text)
    assert all(a[3] == b[2] for a, b in zip(got[0], got[0][1:]))
    assert all(0 <= x[1] <= 1 for x in got[0])
    assert got[1:] == [[], [], []]


def test_products_equal_the_vectors(prototypes):
    """The sum of kept products is the product of the bundle."""
    from sagebrook.llm.language import DIMENSIONS, Coded, _bound

    coded = Coded([made("tr", 5)])
    bundle = _bound(coded.grams).sum(axis=0, dtype=np.float64)
    direct = bundle @ prototypes.T.astype(np.float64) / DIMENSIONS
    kept = Profiles(prototypes).products(coded.grams).sum(axis=0)
    assert np.allclose(direct, kept, atol=1e-3)


def test_decomposed_letters_count_as_composed(prototypes):
    import unicodedata

    text = "Bölüm içinde değeri ölçülene dek yükseltir ve başka bir şey için uyarı gösterilmiştir."
    a, b = (detect([unicodedata.normalize(k, text)], Profiles(prototypes))[0][0] for k in ("NFC", "NFD"))
    assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6


def test_labels(spark):
    forms = ["tr", "TR", "tr-TR", "tur", "en_GB", "und", "", None, "xx", "German"]
    got = [r["c"] for r in spark.createDataFrame([(x,) for x in forms], "l string").select(label_code(F.col("l")).alias("c")).collect()]
    assert got == ["tr", "tr", "tr", "tr", "en", None, None, None, None, "de"]


def test_operator_edges(spark, prototypes):
    rows = [("k", "1", "en", made("en", 1)), ("k", "2", "en", made("ru", 2)), ("k", "3", None, made("de", 3)), ("k", "4", "ru", None), ("k", "5", "ru", ""), ("k", "6", "EN-us", made("en", 4)), ("k", "6", "EN-us", made("en", 4))]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, language string, content string")
    found = text_languages(df, prototypes, ["record_kind", "record_id", "language"])
    assert found.count() == 7
    got = {(r["record_id"], r["true_language"]) for r in corrected_labels(found).collect()}
    assert got == {("2", "ru"), ("3", "de")}
    with pytest.raises(ValueError):
        text_languages(df.withColumnRenamed("language", "segments"), prototypes, ["segments"])
    empty = df.limit(0)
    assert corrected_labels(text_languages(empty, fit(empty), ["record_kind", "record_id", "language"])).count() == 0
    assert len(LANGUAGES) == 10 and isinstance(found.toPandas(), pd.DataFrame)


@pytest.fixture(scope="module")
def with_cjk():
    r = random.Random(5)
    zh = "我母亲住在维索康|患有卡美尼的最大剂量是多少|络达赛芬可以和洛康尼一起服用吗|使用卡贝格之后在体内停留多久|服药之前请咨询医生|暴露量加倍".split("|")
    ja = "母はサメクに住んでいます|ナキサカと一緒に飲めますか|この薬の最大用量はいくつですか|痛みが続いています|服用の前に医師に相談してください|曝露量は二倍になります".split("|")
    texts = [(" ".join(made(x, 100 * i + j) for j in range(3)), x) for i in range(40) for x in WORDS]
    texts += [("。".join(r.sample(s, 4)) + "。", x) for _ in range(40) for s, x in ((zh, "zh"), (ja, "ja"))]
    return Profiles(fit_prototypes([t for t, _ in texts], [x for _, x in texts]))


@pytest.mark.parametrize(
    ("first", "then", "lang"),
    [("tr", "我母亲76岁，住在维索康。", "zh"), ("en", "使用卡贝格之后沙格贝沙在体内停留多久？", "zh"), ("tr", "母は80歳でゼピケに住んでいます。", "ja"), ("en", "ピカポゾをサシネと一緒に飲めますか？", "ja"), ("ru", "暴露量加倍。", "zh"), ("en", "Доза не должна. Больной получил.", "ru")],
)
def test_short_sentences_name_their_language(with_cjk, first, then, lang):
    """A whole sentence of Chinese or Japanese is short, and short sentences of one language speak together."""
    long, after = made(first, 1), made(first, 2)
    for text, want in ((long + " " + then, [first, lang]), (then + " " + long, [lang, first]), (long + " " + then + " " + after, [first, lang, first])):
        got = detect([text], with_cjk)[0]
        assert [x[0] for x in got] == want
        assert got[0][2] == 0 and got[-1][3] == len(text) and all(a[3] == b[2] for a, b in zip(got, got[1:]))


def test_a_foreign_word_or_heading_names_no_language(with_cjk):
    assert [x[0] for x in detect([made("en", 1) + " 患有 " + made("en", 2)], with_cjk)[0]] == ["en"]
    assert [x[0] for x in detect(["Dose.\n\n" + made("tr", 1) + "\n\nDosis.\n\n" + made("tr", 2)], with_cjk)[0]] == ["tr"]


def test_confidence_is_calibrated_and_grows_with_the_margin(prototypes):
    """On held-out sentences, some of them short, the mean confidence is near the share of right languages."""
    r = random.Random(9)
    texts = [(made(x, 5000 + i, r.choice((2, 3, 4, 6, 12))), x) for i in range(150) for x in WORDS]
    fitted = calibrated([t for t, _ in texts[:300]], [x for _, x in texts[:300]], prototypes)
    p = Profiles(fitted)
    cos, n = p.cosines(coded := Coded([t for t, _ in texts[300:]]))
    owner = np.searchsorted(coded.starts, coded.ends, side="right") - 1
    said = n > 0
    right = np.array([LANGUAGES[k] == texts[300 + o][1] for k, o in zip(cos.argmax(axis=1)[said], owner[said])])
    ranked = np.sort(cos[said], axis=1)
    trust = p.confidence(ranked[:, -1] - ranked[:, -2], n[said])
    assert abs(trust.mean() - right.mean()) < 0.05
    assert p.confidence(np.array([0.0]), np.array([30]))[0] < p.confidence(np.array([0.3]), np.array([30]))[0]
    assert calibrated([], [], prototypes).curve == Fitted(prototypes).curve


def test_norms_count_repeated_ngrams():
    from sagebrook.llm.language import DIMENSIONS, _bound

    for text in ("the label of the drug and the label of the dose", "zuderin zuderin zuderin zuderin zuderin"):
        coded = Coded([text])
        true = np.linalg.norm(_bound(coded.grams).sum(axis=0, dtype=np.float64)) / np.sqrt(DIMENSIONS)
        assert abs(norms(coded.grams, np.zeros(len(coded.grams), int), 1)[0] - true) < 0.1 * true


def test_segment_boundaries(prototypes):
    """Boundaries between languages fall where sentences meet."""
    r, p, near, all_ = random.Random(4), Profiles(prototypes), 0, 0
    for i in range(40):
        langs = r.sample(list(WORDS), 3)
        parts = [" ".join(made(x, 70_000 + 31 * i + j, r.randint(6, 14)) for j in range(r.randint(1, 3))) for x in langs]
        got = detect([" ".join(parts)], p)[0]
        all_ += 2
        if [x[0] for x in got] == langs:
            near += sum(abs(g[3] - end) <= 1 for g, end in zip(got, (len(parts[0]), len(parts[0]) + 1 + len(parts[1]))))
    assert near >= 0.95 * all_


def test_long_words_are_words(prototypes):
    text = "Die Dosis des Arzneimittelverschreibungspflichtigkeitsnachweises darf nicht mit Wasser eingenommen werden."
    assert [x[0] for x in detect([text], Profiles(prototypes))[0]] == ["de"]
    assert Coded(["derpatientvorhereineandereerhieltundnichtmehr"]).grams.size == 45
    assert detect(["zuderin " * 60, "zuderin\n" * 60], Profiles(prototypes)) == [[], []]
