import numpy as np
import pytest

from sagebrook.llm.textstats import COLUMNS, LEXICAL, autocorrelation, kinds_apart_from_prose, statistics, text_statistics, word_statistics

PROSE = "The label of the drug warns about the dose. It should not be taken with water.\nBefore the first dose the patient is measured again."
KINDS = [
    (PROSE, "prose"),
    (PROSE + "\n- one item\n- two items", "prose"),
    ("Short prose.", "prose"),
    ("The key is 3F9AK2JQ8ZL0PMW7XN5TB4VC and the label of the drug says so in the text. It is a long code within the prose.", "prose"),
    ("Storage\n- keep cold\n- keep dry\n- away from light\n- not in water", "list"),
    ("Storage\n1. keep cold\n2. keep dry\n3. away from light\n4. not in water", "list"),
    ("Product | Strength | Form\nA | 3 mg | drops\nB | 4 mg | \nC | 5 mg | tablets", "table"),
    ("Product\tStrength\tForm\nA\t3 mg\tdrops\nB\t4 mg\t\nC\t5 mg\ttablets", "table"),
    ("Product    Strength    Form\nA    3 mg    drops\nB    4 mg    \nC    5 mg    tablets", "table"),
    ("a,b,c,d\n1,2,3,4\n5,6,7,8\n9,1,2,3", "table"),
    ("", "junk"), (None, "junk"), (" \n​", "junk"),
    ("stol stol stol stol " * 20, "junk"), ("Home\nMenu\nLogin\nSearch\nHome\nPrint\nMenu", "junk"), ("Menu Login Home Search RSS Print", "junk"),
    ("{<^~ |}§ a~=` {;<0§ ¬^r| ~{>=< §¬`^ |{}~", "junk"), ("8h35p7VCK6oykARfgiHv8ncPNgLZGCXbNaEDSK0SjecCFM4hHqNhRRvm6n9Vzeue9vKnaI0uIE", "junk"),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kind(text, kind):
    assert statistics(text)[-1] == kind


def test_features():
    assert autocorrelation(np.array([5, 9, 5, 9, 5, 9, 5, 9.0])) > 0.8
    assert autocorrelation(np.array([1.0, 2.0])) == 0
    assert dict(zip(COLUMNS, statistics(PROSE)))["symbol_ratio"] == 0


def test_operator_edges(spark):
    rows = [(i, t) for i, (t, _) in enumerate(KINDS)] + [(0, PROSE), (None, PROSE), (99, " ".join(f"The dose {i * 7919 % 4001} of the {chr(97 + i % 26)}{chr(97 + i * 7 % 26)}x drug is not given to {chr(97 + i * 5 % 26)}{chr(97 + i * 3 % 23)}." for i in range(9000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_kind", "1 AS n_chars")
    assert text_statistics(df).count() == len(rows)
    got = {(r["doc_id"], r["text_kind"]) for r in kinds_apart_from_prose(df).collect()}
    assert got == {(i, k) for i, (_, k) in enumerate(KINDS) if k != "prose"}
    assert text_statistics(df.limit(0)).count() == 0 and word_statistics(df).count() == len(rows)
    assert text_statistics(df).columns == ["doc_id", *LEXICAL, *COLUMNS]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Product | Strength\nA | 3 mg\nB | 4 mg\nC | 5 mg", "table"),
        ("Product\tForm\nA\tdrops\nB\tsyrup\nC\ttablets", "table"),
        ("Product   Form\nA         drops\nB         syrup\nC         tablets", "table"),
        ("name,dose\na,3\nbcd,41\nef,500", "table"),
        ("Drug | What it does | Advice\n" + "\n".join(f"{x} | {'lowers the pressure of the blood in patients over sixty years'} | {'taken in the morning, not together with other medicines or juice'}" for x in ("Avel", "Brun", "Cort")), "table"),
        ("The label warns, as others\ndo, about the dose and the\nwater, which should not be\ntaken before, nor after it.", "prose"),
        ("Avel tablets, 3 mg\nBrun drops, 41 mg\nCort syrup, 5 mg\nDran tablets, 7 mg\nEvol drops, 12 mg", "list"),
        ("- Avel | 3 mg\n- Brun | 4 mg\n- Cort | 5 mg\n- Dran | 6 mg", "list"),
    ],
)
def test_two_columns_and_long_cells(text, kind):
    assert statistics(text)[-1] == kind


def test_indented_prose_is_no_table():
    lines = ["The label of the drug warns about the dose and the many others who", "gave the water that should not be taken before it by children while", "the patient is measured again by a nurse of the unit named above for", "a second time and the first dose is given with yet another label now"]
    for mark in ("\t", "  "):
        assert statistics("\n".join(mark + s for s in lines))[-1] == "prose" and statistics("\n".join(s + mark for s in lines))[-1] == "prose"


def test_words_of_any_script(spark):
    texts = [PROSE, "使用卡贝格之后在体内停留多久？请勿压碎药片的包装。", "服用の前に医師に相談してください。", "ยานี้ใช้เพื่อรักษาและป้องกันการเจ็บป่วย", "ab" * 40_000 + "é́" * 2000, "", None]
    by = {r["doc_id"]: r for r in word_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert by[0]["n_lines"] == 2 and by[0]["punctuation_end_share"] == 1 and by[0]["common_word_share"] > 0.3
    for i in (1, 2, 3):
        assert by[i]["n_words"] >= 6 and 1 <= by[i]["mean_word_length"] <= 4 and by[i]["common_word_share"] > 0, i
    assert by[4]["n_words"] == 1 and by[5]["n_words"] == by[6]["n_words"] == 0 and by[6]["mean_word_length"] == 0
