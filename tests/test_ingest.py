from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

from paperloom.operators import export, inventory
from paperloom.sources import ingest

CSV = '''type,subject,difficulty,tags,text,options,answer,weight,latex,essay_lines,essay_line_height
true_false,Math,easy,"A;b","Is it
""true""?",,True,1,,,
essay,Math,hard,,Write $x$ and,,Long,0,,,100
riddle,Math,easy,,What?,,x,,,,
,,,,,,,,,,
single_choice,,medium,,Pick,a|b,a,,,,
'''


def test_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text(CSV)
    rows = ingest.validate(ingest.read_csv(spark, str(tmp_path / "q.csv")))
    good = {r.row_number: r for r in ingest.accepted(rows).collect()}
    assert good[2].options == ["True", "False"] and good[2].text == 'Is it\n"true"?' and good[2].tags == ["a", "b"]
    assert good[3].essay_blank_space.lineHeight if hasattr(good[3].essay_blank_space, "lineHeight") else good[3].essay_blank_space.line_height == 48
    assert good[3].score_weight == "1" and not good[3].has_latex is None
    bad = {r.row_number: r.errors for r in ingest.rejected(rows).collect()}
    assert len(good) == 2 and any("type must be" in e for e in bad[4]) and len(bad) == 2
    assert "subjects is required" in [e for es in bad.values() for e in es]


def test_csv_records_keep_their_numbers(spark, tmp_path):
    """Leading blank records count, empty lines do not; short records are padded, long ones cut; each file has its header."""
    (tmp_path / "a.csv").write_text('type,Text,text\r\n,,\r\n\r\nessay,x,"a,b\r\nc"\r\nblank\r\nblank,,t,more,"and ""more"""\r\n')
    (tmp_path / "b.csv").write_text("\ufefftext,essay_lines,score-weight,type\nhello, 3 ,2,essay")
    got = {(r.file[-5:], r.row_number): r for r in ingest.read_csv(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("a.csv", 3), ("a.csv", 4), ("a.csv", 5), ("b.csv", 2)]
    assert got["a.csv", 3].text == "a,b\r\nc" and got["a.csv", 4].text == "" and got["a.csv", 5].text == "t" and got["a.csv", 5].lines is None
    assert (got["b.csv", 2].text, got["b.csv", 2].lines, got["b.csv", 2].weight) == ("hello", " 3 ", "2")


def test_import_of_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MAX_BYTES", 600)
    for name, body in {
        "q.csv": CSV.encode(), "list.txt": b' [{"type": "essay", "text": "a"}, 1]', "x.JSON": b"{x", "empty.csv": b" \n", "head.csv": b"a,b\n1,2",
        "bad.csv": b"type,text\n\xff,x", "big.csv": b"type,text\n" + b"essay,x\n" * 100,
    }.items():
        (tmp_path / name).write_bytes(body)
    rows, errors = ingest.read_import(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/")[-1], r.row_number) for r in rows.collect()) == [("list.txt", 1), ("list.txt", 2), *[("q.csv", n) for n in (2, 3, 4, 6)]]
    said = {r.file.rsplit("/")[-1]: r.error for r in errors.collect()}
    assert sorted(said) == ["bad.csv", "big.csv", "empty.csv", "head.csv", "x.JSON"]
    assert "UTF-8" in said["bad.csv"] and "600 byte" in said["big.csv"] and "empty" in said["empty.csv"]


def test_json(spark, tmp_path):
    one = {"type": "single_choice", "subjects": ["Math"], "difficulty": "easy", "tags": "latex|algebra", "text": "$a$", "options": ["1", "2"], "answer": "1", "scoreWeight": 0}
    for name, body in (("a", [one, 5]), ("b", {"questions": [one, 5]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        rows = ingest.validate(ingest.read_json(spark, str(tmp_path / f"{name}.json")))
        good, bad = ingest.accepted(rows).collect(), ingest.rejected(rows).collect()
        assert [(r.row_number, r.tags, r.options, r.score_weight, r.has_latex) for r in good] == [(1, ["latex", "algebra"], ["1", "2"], "1", True)]
        assert [r.row_number for r in bad] == [2]


def test_commit_and_blobs(spark, tmp_path):
    (tmp_path / "q.csv").write_text(CSV)
    rows = ingest.validate(ingest.read_csv(spark, str(tmp_path / "q.csv")))
    assert ingest.commit(rows, str(tmp_path / "bank")) == {"valid": 2, "invalid": 2} and tuple(ingest.counts(rows).first()) == (2, 2)
    bank = spark.read.parquet(str(tmp_path / "bank"))
    assert bank.where("accepted = 'true'").count() == 2 and bank.where("accepted = 'false' and size(errors) > 0").count() == 2
    (tmp_path / "files").mkdir()
    for n, b in (("x", b"1"), ("y", b"1"), ("z", b"22")):
        (tmp_path / "files" / n).write_bytes(b)
    got = inventory.blobs(ingest.read_blobs(spark, str(tmp_path / "files"))).collect()
    assert sorted(r.uses for r in got) == [1, 2]


def test_docx(spark):
    papers = spark.createDataFrame([(1, "A & B", "Maths", 90, "10.0"), (2, "Empty", "x", 5, "3")], "paper_id int, title string, subject string, duration_minutes int, total_marks string")
    rows = [
        (1, 0, True, "true_false", "x < y", "2.5", ["Yes", "No & no"], "Yes", None),
        (1, 1, True, "essay", "Why?", None, None, "", 3),
    ]
    items = spark.createDataFrame(rows, "paper_id int, place int, starts_section boolean, question_type string, text string, marks string, options array<string>, answer string, essay_lines int")
    a, b = ({r.paper_id: r for r in export.docx(papers, items).collect()} for _ in range(2))
    assert {k: r.package for k, r in a.items()} == {k: r.package for k, r in b.items()} and a[1].filename == "A & B.docx"

    def texts(package):
        xml = zipfile.ZipFile(io.BytesIO(package)).read("word/document.xml")
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return [t.text for t in ElementTree.fromstring(xml).iter(f"{w}t")]

    head = ["A & B", "Subject: Maths    Duration: 90 minutes    Total Marks: 10"]
    questions = ["True or False", "1. x < y (2.5 marks)", "    A. Yes", "    B. No & no", "Essay", "2. Why?"]
    assert texts(a[1].package) == [*head, *questions, " ", " ", " "]
    assert texts(a[2].package) == ["Empty", "Subject: x    Duration: 5 minutes    Total Marks: 3"]
    told = export.docx(papers, items, answers=True).where("paper_id = 1").first().package
    assert texts(told) == [*head, *questions[:4], "Answer: Yes", *questions[4:], "Answer: "]
