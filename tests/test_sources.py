import json

from sagebrook.sources import readers


def test_labels(spark, tmp_path):
    rows = [{"id": "1", "openfda": {"brand_name": ["A"], "product_type": ["HUMAN PRESCRIPTION DRUG"]}, "indications_and_usage": ["x"]}, {"id": "2", "openfda": {"product_type": ["OTHER"]}, "indications_and_usage": ["x"]}, {"id": "3", "openfda": {"product_type": ["HUMAN PRESCRIPTION DRUG"]}}, {"id": "4"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    assert [r["id"] for r in readers.labels(spark, str(tmp_path)).collect()] == ["1"]


def test_papers_and_questions(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "p.json").write_text(json.dumps({"resultList": {"result": [{"id": "7", "title": "T", "citedByCount": 3}, {"id": "8"}]}}))
    assert [(r["id"], r["citedByCount"]) for r in readers.papers(spark, str(tmp_path / "p")).collect()] == [("7", 3), ("8", None)]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "lang": "en", "question": "?"}], indent=1))
    assert readers.questions(spark, str(tmp_path / "q.json")).count() == 1


def test_uploads(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": "ok", "b.txt": "not a PDF"}
