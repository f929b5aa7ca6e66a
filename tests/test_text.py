import pytest
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.functions import text as X

CASES = [
    ("-- Holloway Peak Inc Seafood", "", "", {"name_core": "holloway peak seafood"}),
    ("TORRES INC. INTEGRATED", "", "", {"name_core": "torres integrated"}),
    ("Torres Integrated Inc.", "", "", {"name_core": "torres integrated"}),
    ("Nagavi S0il Pvt. Ltd.", "", "", {"name_core": "nagavi soil", "legal": "pvt_ltd"}),
    ("84 Congo Industrie EURL", "", "", {"name_core": "84 congo industrie"}),
    ("wilfordhancock.com", "", "", {"name_core": "wilfordhancock", "is_domain": True}),
    ("Onyxumbra F/K/A Oncology Care Inc", "", "", {"alias_core": "oncology care"}),
    ("Ape Tech  S.A.S", "", "", {"legal": "sas"}),
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "", "", {"name_core": "ram marketing", "legal": "pvt_ltd", "is_translit": True}),
    ("nullify", "", "", {"name_core": "ify"}),
    (None, None, None, {"name_core": "", "addr_clean": "", "house_no": "", "legal": ""}),
    ("", "#1303 Cattle Trl, Austin, Texas", "US", {"addr_clean": "1303 cattle trail, austin, texas", "house_no": "1303", "street": "cattle trail"}),
    ("", "0015703 BYBEE DR, PORTLAND, OR", "US", {"house_no": "15703"}),
    ("", "OAK GROVE ROAD, N/A, ELKIN, NC", "US", {"addr_clean": "oak grove road, elkin, nc"}),
    ("", "(67) R. SAINTE-THÉRÈSE, ROUBAIX, Nord", "France", {"street": "rue sainte therese", "house_no": "67"}),
    ("", "Plot No-1154, Bhubaneswar, Orissa 751019", "India", {"postcode": "751019", "addr_nums": "1154"}),
]


def test_normalisation(spark):
    df = spark.createDataFrame([(f"S1-{i}", *c[:3]) for i, c in enumerate(CASES)], "entity_id string, business_name string, business_address string, country string")
    rows = {r.entity_id: r for r in X.normalize_records(df).collect()}
    for i, case in enumerate(CASES):
        for column, want in case[3].items():
            assert rows[f"S1-{i}"][column] == want, (case[0], case[1], column)
    assert list(X.normalize_records(df).columns) == X.NORMAL_COLUMNS


def test_sound(spark):
    df = spark.createDataFrame([("dynamictrading", "dayanamiktrading"), ("ramventures", "shyamventures")], "a string, b string")
    same = [r[0] for r in df.select(X.phonetic(F.col("a")) == X.phonetic(F.col("b"))).collect()]
    assert same == [True, False]


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("abc", "", 0.0), ("abc", "abd", 4 / 6), ("kitten", "sitting", 8 / 13)])
def test_ratio(a, b, want):
    assert S.ratio_of(a, b) == pytest.approx(want)


def test_token_and_partial():
    assert S.token_set_of("a b c", "b a") == 1.0
    assert S.token_set_of("", "a") == 0.0
    assert S.partial_of("abc", "xxabcxx") == 1.0
    assert S.jaro_winkler_of("dwayne", "duane") == pytest.approx(0.84)
