import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sagebrook.llm.sentences import sentence_units

CASES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("Dose is 3.5 mg e.g. with Dr. A. B. Smith, etc. Next one.", ["Dose is 3.5 mg e.g. with Dr. A. B. Smith, etc.", "Next one."]),
    ("Bölüm 4.2’te Prof. Ak’a göre 34. haftada artar. pH değeri 7 iken.", ["Bölüm 4.2’te Prof. Ak’a göre 34. haftada artar.", "pH değeri 7 iken."]),
    ("He wrote: “Stop it. Now.” Then he left.", ["He wrote: “Stop it. Now.”", "Then he left."]),
    ("“Is it safe?” asked one. Yes.", ["“Is it safe?” asked one.", "Yes."]),
    ("It faded… then it came back. Done…", ["It faded… then it came back.", "Done…"]),
    ("Heading\n\nText wrapped\nhere.\n- item one\n- item two\n1. third", ["Heading", "Text wrapped\nhere.", "- item one", "- item two", "1. third"]),
    ("Fact.[^1][^2] More [^3]. End! 🙂", ["Fact.[^1][^2]", "More [^3].", "End! 🙂"]),
    ("See https://a.example/b.html?x=1.2 now. Mail a.b@c.example. Ok.", ["See https://a.example/b.html?x=1.2 now.", "Mail a.b@c.example.", "Ok."]),
    ("若普超过33.9。较低剂量？“请勿压碎。请用水送服。”然后。", ["若普超过33.9。", "较低剂量？", "“请勿压碎。请用水送服。”", "然后。"]),
    ("説明書には「砕かないでください。水で。」とある。次。", ["説明書には「砕かないでください。水で。」とある。", "次。"]),
    ("2.4 ขนาด\n\nยาเม็ด12.5มิลลิกรัม ก่อนให้ยา\n1. หลัง", ["2.4 ขนาด", "ยาเม็ด12.5มิลลิกรัม", "ก่อนให้ยา", "1. หลัง"]),
    ("هل هذا صحيح؟ نعم. انتهى", ["هل هذا صحيح؟", "نعم.", "انتهى"]),
    ("yükseltir.Hâlen sürer [^2].Sonra", ["yükseltir.", "Hâlen sürer [^2].", "Sonra"]),
    ("no closing mark", ["no closing mark"]),
    ("दवा भोजन के बाद लें। पानी के साथ लें। क्या यह सुरक्षित है?", ["दवा भोजन के बाद लें।", "पानी के साथ लें।", "क्या यह सुरक्षित है?"]),
    ("Դեղը խմեք ջրով։ Մի մանրացրեք։", ["Դեղը խմեք ջրով։", "Մի մանրացրեք։"]),
    ("Acme Inc. Announced it on Jan. 5 to all. Next.", ["Acme Inc. Announced it on Jan. 5 to all.", "Next."]),
    ("He said: “दवा लें। पानी लें।” Then he left.", ["He said: “दवा लें। पानी लें।”", "Then he left."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_units(spark, text, want):
    rows = sentence_units(spark.createDataFrame([("a", text)], "id string, content string")).orderBy("unit_no").collect()
    assert [r["unit"] for r in rows] == want
    assert all(text[r["start_char"] : r["end_char"]] == r["unit"] for r in rows)


def test_edges(spark):
    data = [("n", None, 1), ("e", "", 1), ("b", " ​\n ", 1), ("d", "One. Two.", 1), ("d", "One. Two.", 1), ("p", "ab\ue000cd. Zu", 1)]
    df = spark.createDataFrame(data, "id string, content string, unit int").drop("unit").selectExpr("*", "1 AS unit_no", "2 AS _lens")
    rows = sentence_units(df).collect()
    assert sorted((r["id"], r["end_char"]) for r in rows) == [("d", 4), ("d", 4), ("d", 9), ("d", 9), ("p", 6), ("p", 9)]
    assert sentence_units(df.limit(0)).count() == 0


def test_long_text_keeps_positions(spark):
    text = "".join(f"Sentence number {i} ends. " for i in range(3000))
    rows = sentence_units(spark.createDataFrame([("a", text)], "id string, content string")).orderBy("unit_no").collect()
    assert len(rows) == 3000
    assert all(text[r["start_char"] : r["end_char"]] == r["unit"] for r in rows)


@given(st.text(alphabet="aB1.!?…。\n “”\"[^]ก", max_size=60))
@settings(max_examples=40, deadline=None)
def test_units_are_the_text_without_blanks(spark, text):
    rows = sentence_units(spark.createDataFrame([("a", text)], "id string, content string")).orderBy("unit_no").collect()
    assert "".join("".join(r["unit"].split()) for r in rows) == "".join(text.split())
