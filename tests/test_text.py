"""Street text, numbers, dates and other scalars: pinned facts."""

import pytest
from pyspark.sql import functions as F

from gridlume.functions import scalars as S
from gridlume.functions import text as X


def column(spark, build, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("given", "want"),
    [("12 R. de Longchamp", "RUE DE LONGCHAMP"), ("BD Saint-Michel", "BOULEVARD SAINT-MICHEL"), ("12B AVE ST GERMAIN", "12B AVE SAINT GERMAIN"), ("7 PL. X", "7 PL. X"), ("7 5 R  (x) STE FBG", "RUE X SAINTE FAUBOURG"), ("", ""), ("// ET IMP. A", "IMPASSE A"), (None, None)],
)
def test_street(spark, given, want):
    assert column(spark, X.normalize_street, [given]) == [want]


def test_accents(spark):
    assert column(spark, X.strip_accents, ["Ÿ Œ œ Æ é ÿ"]) == ["Ÿ OE oe AE e y"]
    assert column(spark, X.fold_key, ["  Rue de l'Église "]) == ["RUE DE L'EGLISE"]


def test_location(spark):
    rows = [("R. de Longchamp, PARIS 16 (75116)", "Paris"), ("Rue X,", ""), ("Rue 75011 a", ""), (None, None), ("A, b, c (12345)", "z")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, c string").orderBy("i").select(X.parse_location(F.col("l"), F.col("c")).alias("p"))
    got = [tuple(r.p) for r in df.collect()]
    assert got[0] == ("Rue de Longchamp", "RUE DE LONGCHAMP", "RUE DE LONGCHAMP", "Paris 16", "75116")
    assert got[1][3:] == ("Paris", "") and got[2][4] == "75011" and got[3][3] == "Paris"
    assert got[4][3:] == ("B, C", "12345")


def test_title(spark):
    assert column(spark, X.title_case, ["DE LA saint-michel d été", ""]) == ["De la Saint-michel d Été", ""]


def test_numbers(spark):
    given = ["", "abc", "Infinity", " 5 ", "5d", "1e3", "0x10", "1e999", None, "-.5", "+7."]
    assert column(spark, S.js_number, given) == [0, 0, 0, 5, 0, 1000, 16, 0, 0, -0.5, 7]


def test_dates(spark):
    got = column(spark, S.french_millis, ["31/02/2026 10:00", "03/03/2026 10:00", "x", "", "01/13/2025 00:00", "01/01/2026 00:00"])
    assert got[0] == got[1] and got[2:4] == [0, 0] and got[4] == got[5]


def test_date_limits(spark):
    df = spark.createDataFrame([(1, "x"), (2, "01/01/2026 00:00"), (3, "")], "s int, v string")
    assert tuple(df.agg(S.earliest(F.col("v"), F.col("s")), S.latest(F.col("v"), F.col("s"))).first()) == ("x", "01/01/2026 00:00")


def test_durations(spark):
    assert column(spark, lambda c: S.duration_seconds(c, -1), ["7d", "not-a-duration", "0.5s", "250ms", "15m", "3", "15M"]) == [604800, -1, 0.5, 0.25, 900, 3, -1]


def test_fixed(spark):
    assert column(spark, lambda c: S.fixed(c, 1), [0.15, 0.25, -0.04, 1.0, None], "double") == ["0.1", "0.3", "-0.0", "1.0", None]
    assert column(spark, lambda c: S.fixed(c, 6), [-1e-7, 1e-7, -0.0], "double") == ["-0.000000", "0.000000", "0.000000"]
    assert column(spark, lambda c: S.fixed(c, 6), [2.35, -48.85], "double") == ["2.350000", "-48.850000"]


@pytest.mark.parametrize(
    ("names", "digest"),
    [
        (["RUE A", "AVENUE B", ""], "b4788f3364b6e329a8ece0e8235da25e1eef5d290059afad9d0f31c0d8e59044"),
        (["RUE A"], "0730d15b5c769c17b42eff83649ef8a19d240766ef2a055fd83018643eac3451"),
        (["RUE ABSENTE"], "64428b80fcc0232cc09f60ab31e6e87a043293dd7cd6a3127e624425e7363b0e"),
    ],
)
def test_digest(spark, names, digest):
    assert column(spark, S.digest_key, [names], "array<string>") == [digest]


def test_department(spark):
    assert column(spark, X.department_code, ["75056", "97411", "98", "2A004"]) == ["75", "974", "98", "2A"]


def test_variants(spark):
    assert column(spark, X.variant_pattern, ["RUE B."]) == ["R[UÙÚÛÜùúûü][EÈÉÊËèéêë][ ./'’-]+B\\."]


def test_times(spark):
    assert column(spark, S.french_time, ["2026-03-21T09:05:00Z", "", "oops", None]) == ["21/03 09:05", "-", "-", "-"]


def test_numbers_in_other_bases(spark):
    """Against Python's own conversion, ties and overflow too."""
    hard = [(1 << 53) + 1, (1 << 54) + 2, (1 << 54) + 6, (1 << 60) - 1, ((1 << 53) + 1) << 11, (((1 << 53) + 1) << 40) + 1, (1 << 1023) + (1 << 970), 0, 7]
    texts = [f(n) for n in hard for f in (hex, oct, bin)] + ["0x", "0b2", "0o8", "-0x5", "0xg", "0x" + "f" * 300, " 0B101 "]
    want = [float(n) for n in hard for _ in range(3)] + [0.0] * 6 + [5.0]
    assert column(spark, S.js_number, texts) == want


#: Rewrites of street texts that must come out so (abbreviations, house numbers, class boundaries).
STREETS = {
    "12 R. de Longchamp": "RUE DE LONGCHAMP",
    "BD Saint-Michel": "BOULEVARD SAINT-MICHEL",
}


def test_streets_of_fixed_results(spark):
    assert column(spark, X.normalize_street, list(STREETS)) == list(STREETS.values())


def test_language_aware_order(spark):
    row = spark.range(1).select(S.locale_sorted(F.array(*map(F.lit, ["b", "É", "a", "Z", "e", "A", "f", "B"]))).alias("l")).first()
    assert row.l == ["a", "A", "b", "B", "e", "É", "f", "Z"]
