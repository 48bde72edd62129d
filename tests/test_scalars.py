from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import canonical
from paperloom.functions import scalars as S
from paperloom.operators import export, search
from paperloom.sources.ingest import normalize_header


def values(spark, f, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_score_weight(spark):
    got = values(spark, S.score_weight, "1.0000", " 2.50 ", "0.0001", "9999.9999", "10000", "0", "-1", "1e3", "1.23456", "7.", "", None, "100")
    assert got == ["1", "2.5", "0.0001", "9999.9999", None, None, None, None, None, "7", None, None, "100"]


def test_import_weight(spark):
    got = values(spark, S.import_weight, "0", "2", "x", "-3", "500", None, "NaN")
    assert got == ["1.0000", "2.0000", "1.0000", "0.0100", "100.0000", "1.0000", "1.0000"]


def test_lists_flags_and_math(spark):
    assert values(spark, S.parse_list, ' a ;b,a| ', '["x", " y ", "x"]', "[broken", None) == [["a", "b"], ["x", "y"], ["[broken"], []]
    assert values(spark, S.tri_bool, " YES", "0", "maybe", None) == [True, False, None, None]
    assert values(spark, S.has_math, "$x$", "$", "", None) == [True, False, False, False]
    assert values(spark, lambda c: S.bounded_int(c, 6, 1, 20), "3.9", "-4", "99", "x", None) == [3, 1, 20, 6, 6]
    assert values(spark, S.is_canonical_decimal, "0", "10", "1.5", "01", "1.50", "+1", "") == [True, True, True, False, False, False, False]


def test_names(spark):
    got = values(spark, lambda c: S.safe_filename(c, "tex"), 'a/b:"c"  d', " ", None, "x" * 200)
    assert got == ["a b c d.tex", "paper.tex", "paper.tex", "x" * 80 + ".tex"]
    assert [normalize_header(h) for h in ("essay_lines", "﻿Type", "score-weight", "Has Latex")] == ["essayLines", "Type", "scoreWeight", "HasLatex"]
    assert values(spark, S.backoff_micros, 1, 2, 9, 50, kind="int") == [1_000_000, 2_000_000, 256_000_000, 256_000_000]


def test_canonical_json_and_hashes(spark):
    assert values(spark, canonical.canonical_json, '{"b":1,"a":{"d":[2,1],"c":null}}', '{"a":1,"a":2}', "x") == ['{"a":{"c":null,"d":[2,1]},"b":1}', None, None]
    df = spark.createDataFrame([(None,)], "value string")
    got = df.select(canonical.content_hash("question", 1, F.struct("value"))).first()[0]
    assert got == "dfbc3f4bec97819c4905aad70b6abedb7eb461555d51cd34f0424f33e03c8e36"
    assert values(spark, canonical.payload_hash, None)[0] == values(spark, lambda c: F.sha2(F.lit("null"), 256), "x")[0]


def test_tex_escape(spark):
    texts = ["50% & $a_b$ c_d", "$$x#$$ #", "a\nb", "plain", None, "\\{~^}", "$$a_$b_$$c_", "_$a_", "", "a\\"]
    want = [r"50\% \& $a_b$ c\_d", r"$$x#$$ \#", "a\\\\\nb", "plain", None, r"\textbackslash{}\{\textasciitilde{}\textasciicircum{}\}"]
    want += [r"$$a_$b_$$c\_", r"\_$a_", "", r"a\textbackslash{}"]
    assert values(spark, export.tex_text, *texts) == want


def test_phrase_is_whole_tokens(spark):
    docs = spark.createDataFrame([(1, "Árt of war"), (2, "part of"), (3, None), (4, "ART, of—x")], "id int, text string")
    assert sorted(r.id for r in search.search(docs, "art OF", ["text"]).collect()) == [1, 4]
    assert search.search(docs, "  ", ["text"]).count() == 4
    assert search.search(docs, "!!", ["text"]).count() == 0


def test_cursor():
    assert search.decode_cursor(search.encode_cursor(50)) == 50
    with pytest.raises(ValueError):
        search.decode_cursor("tpq1.x")


def test_json_is_compact(spark):
    body = values(spark, canonical.canonical_json, json.dumps({"z": [1, {"y": "é"}], "a": True}))[0]
    assert body == '{"a":true,"z":[1,{"y":"é"}]}'
