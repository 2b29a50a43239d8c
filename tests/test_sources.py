import json

import pytest
from pyspark.sql import functions as F

from postmatch.operators.dedup import first_wins
from postmatch.sources import json_sources as J
from postmatch.sources import pages as P
from postmatch.sources import tables

A = [
    {"id": 11, "title": "Estágio", "description": "texto " * 90, "created": "2026-09-01T10:00:00Z", "redirect_url": "https://a.example/1",
     "company": {"display_name": "  Firma "}, "location": {"display_name": "X", "area": ["Brasil", "Sudeste", "Rio de Janeiro", "Niterói"]}},
    {"id": 12, "title": "Outra", "description": "curta", "created": "2026-09-01T10:00:00Z", "redirect_url": "u", "location": {"display_name": "Rio"}},
    {"title": "sem id", "description": "x", "created": "2026-09-01T10:00:00Z", "redirect_url": "u"},
    {"id": 11, "title": "repetida", "description": "x", "created": "2026-09-01T10:00:00Z", "redirect_url": "u"},
]
B = [{"id": 5, "name": "Estágio ", "description": "<p>a&nbsp;b</p><li>c &amp; d</li>", "careerPageName": "Firma", "publishedDate": "2026-09-01T03:00:00",
      "city": "Rio", "state": "", "jobUrl": "u", "workplaceType": "hybrid"}]
C = [{"id": -9007199254740993123, "title": "<b>Estágio</b> TI", "snippet": "a&nbsp;...", "company": "", "location": " ", "source": " Site.COM ",
      "link": "u", "updated": "2026-09-01T09:00:00.1234567-03:00"}]


def read(spark, tmp_path, payload, record, field, required):
    path = tmp_path / "page.json"
    path.write_text(json.dumps(payload))
    return J.split_malformed(J.read_records(spark, str(path), record, field), required)


def test_source_a(spark, tmp_path):
    good, bad = read(spark, tmp_path, {"count": 4, "results": A}, J.SOURCE_A_RECORD, "results", J.REQUIRED_A)
    assert bad.count() == 1
    rows = {r["external_id"]: r for r in J.with_seq(first_wins(J.postings_from_a(good), seq="arrival")).collect()}
    assert set(rows) == {"11", "12"} and rows["11"]["seq"] < rows["12"]["seq"]
    assert (rows["11"]["title"], rows["11"]["company"], rows["11"]["location"]) == ("Estágio", "Firma", "Niterói, Rio de Janeiro")
    assert rows["11"]["description_complete"] is False and rows["12"]["description_complete"] is True
    assert (rows["12"]["company"], rows["12"]["location"]) == ("Empresa não informada", "Rio")


def test_sources_b_and_c(spark, tmp_path):
    good, _ = read(spark, tmp_path, {"data": B}, J.SOURCE_B_RECORD, "data", J.REQUIRED_B)
    row = J.postings_from_b(good).first()
    assert (row["title"], row["description"], row["location"], row["mode"]) == ("Estágio", "a b c & d", "Rio", "hibrido")
    good, _ = read(spark, tmp_path, {"jobs": C}, J.SOURCE_C_RECORD, "jobs", J.REQUIRED_C)
    row = J.postings_from_c(good).first()
    assert row["external_id"] == "-9007199254740993123" and row["origin"]["domain"] == "site.com"
    assert (row["title"], row["company"], row["location"]) == ("Estágio TI", "Empresa não informada", "Brasil")
    assert str(row["published_at"]) == "2026-09-01 12:00:00.123456" and row["description_complete"] is False


PAGE = """<html><script>var x = {"source_id" : "77"};</script><img src="/Partners/a.png" alt=" Portal "><img src="/partners/b.png" alt="no">
<section class="x adp-body"><p>Um<br>dois</p><div>tr&ecirc;s <section>quatro</section></div><img src=a></section><p>fora</p></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>nada</p>"), (3, None)], "k int, html string")
    got = {r["k"]: tuple(r)[1:] for r in P.parse_pages(df, ["k"]).collect()}
    assert got == {1: ("Um dois três quatro", "Portal", "77"), 2: ("", None, None), 3: ("", None, None)}


def test_page_url(spark):
    df = spark.createDataFrame([("https://x.example//Land/ad/5?a=1", "5/é"), ("https://x.example/jobs/5", "5")], "u string, i string")
    assert [r[0] for r in df.select(P.page_url(F.col("u"), F.col("i"))).collect()] == [
        "https://x.example/details/5%2F%C3%A9", "https://x.example/jobs/5",
    ]


def test_union_and_label_sheet(spark, tmp_path):
    with pytest.raises(tables.AllSourcesFailed):
        tables.union_sources({"a": None, "b": None}, {"a": "down"})
    key = "0a1b2c3d-0000-4000-8000-000000000000"
    rows = spark.createDataFrame([(key, "s", "1", None), (key, "s", "2", True)], "profile_id string, source string, external_id string, relevant boolean")
    tables.write_label_sheet(rows, f"{tmp_path}/sheet")
    assert [r["external_id"] for r in tables.read_label_sheet(spark, f"{tmp_path}/sheet").collect()] == ["2"]
    (tmp_path / "bad.json").write_text('{"profile_id": "x", "source": "s", "external_id": "1", "relevant": true}\n')
    with pytest.raises(Exception, match="label sheet"):
        tables.read_label_sheet(spark, f"{tmp_path}/bad.json").collect()
