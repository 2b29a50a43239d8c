import html
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmatch.functions import dates, text

DASHES = str.maketrans({c: "-" for c in text.DASHES})


def fold(value):
    plain = unicodedata.normalize("NFKD", value.translate(DASHES)).encode("ascii", "ignore").decode()
    return " ".join(plain.lower().split())


def rows(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_fold_equals_unicode_decomposition(spark):
    points = [chr(p) for p in range(1, 0x3100)] + ["ﬁm", "½ hora", "𝐀𝐛", "a—b–c", "x\x1cy z", "ß œ", "Ǆ…"]
    got = rows(spark, points, text.fold_text(F.col("t")))
    assert [g[0] for g in got] == [fold(p) for p in points]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=40), min_size=40, max_size=60))
def test_fold_random(spark, values):
    got = rows(spark, values, text.fold_text(F.col("t")))
    assert [g[0] for g in got] == [fold(v) for v in values]


def test_keys_and_opening_words(spark):
    long_text = " ".join(f"w{i % 45}" for i in range(90))
    got = rows(spark, ["C# e C++ (avançado)!", long_text], text.clean_key(F.col("t")), text.opening_words(F.col("t")))
    assert got[0][0] == "c# e c++ avancado"
    assert got[1][1] == [f"w{i}" for i in range(40)]  # the cut comes before the distinct


def test_suffix_truncation_mode_and_html(spark):
    values = ["Dev - Vaga aberta", "fim ...", "<p>a&nbsp;&amp; b</p><li>c", "Híbrido "]
    got = rows(
        spark, values, text.strip_aggregator_suffix(text.fold_text(F.col("t"))), text.is_truncated(F.col("t")),
        text.clean_html(F.col("t")), text.recognize_mode(F.col("t")),
    )
    assert got[0][0] == "dev" and got[1][1] is True and got[0][1] is False
    assert got[2][2] == "a & b c" == " ".join(html.unescape(re.sub("<[^>]+>", " ", values[2])).split())
    assert got[3][3] == "hibrido"


def test_escape_never_splits_an_entity(spark):
    (got,) = rows(spark, ["abc & def"], text.escape_truncate(F.col("t"), 7))
    assert got[0] == "abc…"


def test_origin_label_and_durations(spark):
    got = rows(spark, ["--Google Ads!!", "!!"], text.origin_label(F.col("t"), 6))
    assert [g[0] for g in got] == ["google", None]
    df = spark.createDataFrame([(59.0,), (90.0,), (5400.0,), (129600.0,)], "s double")
    shown = [r[0] for r in df.select(dates.readable_duration(F.col("s"))).collect()]
    assert shown == ["59 s", "1.5 min", "1.5 h", "1.5 d"]


def test_local_days(spark):
    df = spark.sql("select timestamp'2026-09-07 02:00:00' a, timestamp'2026-09-07 00:00:00' b")
    row = df.select(
        dates.local_date(F.col("a")).cast("string"), dates.local_week(F.col("a")).cast("string"),
        dates.publication_date(F.col("b")).cast("string"), dates.local_date(F.col("b")).cast("string"),
    ).first()
    assert tuple(row) == ("2026-09-06", "2026-08-31", "2026-09-07", "2026-09-06")
