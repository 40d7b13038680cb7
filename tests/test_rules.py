"""Inline rows for detector quirks, guards and the rule-set modes."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import rules as R
from veilspark.operators.classify import classify, classify_fast


def hit(spark, key, ic, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(R.matches(F.col("text"), key, ic).alias("h")).first()["h"]


@pytest.mark.parametrize("key,ic,text,expected", [
    ("ssn_strict", False, "my ssn is 123-45-6789.", True),
    ("ssn_strict", False, "123 45 6789", False),
    ("ssn_loose", True, "ssn 123 45 6789", True),
    ("ssn_loose", True, "any nine digits 123456789", True),
    ("ssn_loose", True, "area 000-12-3456", False),
    ("ssn_loose", True, "area 666-12-3456", False),
    ("ssn_loose", True, "area 912-12-3456", False),
    ("ssn_loose", True, "area 665-12-3456", True),
    ("card_narrow", False, "card 4111 1111 1111 1111", True),
    ("card_narrow", False, "amex 3782 822463 10005", False),       # real 15-digit Amex never matches
    ("card_narrow", False, "discover 6011 1111 1111 1117", False),
    ("card_wide", True, "discover 6011 1111 1111 1117", True),
    ("iban_spaced", False, "DE89 3704 0044 0532 0130 00", True),
    ("iban_spaced", False, "GB29 NWBK 6016 1331 9268 19", False),  # letters: GB/FR IBANs missed
    ("iban_compact", True, "GB29NWBK60161331926819", True),
    ("phone_de", False, "Erreichen Sie mich unter 0176 12345678", True),
    ("phone_intl", False, "call +49 176 1234567", True),
    ("phone_us_strict", False, "(555) 123-4567", True),
    ("phone_us_strict", False, "5551234567", False),
    ("phone_us_loose", True, "5551234567", True),
    ("phone_us_loose", True, "x 12345551234567", True),            # no left boundary
    ("email", False, "mail jane.doe@example.org now", True),
    ("ip_address", True, "host 192.168.1.20 up", True),
    ("ip_address", True, "host 999.168.1.20 up", False),
    ("passport", True, "passport ab1234567", True),                # ignore case: lower letters count
    ("address_v1", True, "I live at 12 Maple Grove Terrace", True),
    ("dob_mmddyyyy", True, "born 03/14/1985", True),
    ("dob_mmddyyyy", True, "born 13/14/1985", False),
    ("named_relation_v1", True, "my boss mike is rude", True),     # ignore case: any word is a name
    ("confession", True, "I have a question", True),               # no closing boundary
    ("possessive_health_wide", True, "my cat saw the doctor", True),
    ("first_person_dollar", True, "we paid $1,200", True),
    ("salary_amount", True, "I earn $85,000 a year", True),
    # Unicode classes as in Python re: umlaut is a word char, NBSP is whitespace
    ("ssn_strict", False, "ä123-45-6789", False),
    ("phone_us_strict", False, "555 123 4567", True),
])
def test_detector_quirks(spark, key, ic, text, expected):
    assert hit(spark, key, ic, text) is expected


def test_guard_first_v4(spark):
    rows = [(1, "contact me at jane@example.org"), (2, "write a regex for jane@example.org"),
            (3, "nothing here"), (4, None), (5, "call 555-123-4567 or mail a@b.co")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r["id"]: (r["verdict"], list(r["matches"])) for r in classify(df, "v4").collect()}
    assert out[1] == ("SENSITIVE", ["email"])
    assert out[2] == ("UNCERTAIN", [])            # guard first: no names
    assert out[3] == ("UNCERTAIN", [])
    assert out[4] == ("UNCERTAIN", [])            # null text never errors
    assert out[5] == ("SENSITIVE", ["email", "phone_us"])   # rule order, not text order


def test_tiered_v1(spark):
    rows = [(1, "my ssn 123-45-6789"), (2, "example: my ssn 123-45-6789"),
            (3, "my boss Mike yelled"), (4, "explain how my doctor works"), (5, "the weather")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r["id"]: (r["verdict"], list(r["matches"])) for r in classify(df, "v1").collect()}
    assert out[1][0] == "SENSITIVE" and out[1][1][0] == "ssn"
    assert out[2][0] == "UNCERTAIN" and out[2][1][-1] == "code_context"   # names kept
    assert out[3][0] == "SENSITIVE" and "named_person_context" in out[3][1]
    assert out[4][0] == "UNCERTAIN" and out[4][1][-1] == "code_context"
    assert out[5] == ("UNCERTAIN", [])


def test_fast_form_agrees_with_names(spark):
    rows = [(i, t) for i, t in enumerate(["a@b.co", "implement a@b.co", "plain", "0176 12345678"])]
    df = spark.createDataFrame(rows, "id int, text string")
    full = {r["id"]: r["verdict"] == "SENSITIVE" for r in classify(df, "v4").collect()}
    fast = {r["id"]: r["rule_hit"] for r in classify_fast(df, "v4").collect()}
    assert full == fast


def test_prefilters_change_no_answer(spark):
    """A detector with its cheap test first answers as its bare pattern does."""
    from veilspark.sources.derived import probe_text
    extra = ["a@b.de", "a@", "call ٠١٢-٣٤٥-٦٧٨٩", "123-45-6789", "income of $, a year", "my loan is $5", "no figures", "", None]
    rows = spark.range(400).select("id", F.lit("some words").alias("t")).select(probe_text("t", "id").alias("text"))
    rows = rows.union(spark.createDataFrame([(t,) for t in extra], "text string"))
    for key in [*R.NEEDS_DIGIT, *R.NEEDS]:
        for ic in (True, False):
            bare = F.coalesce(F.col("text").rlike(R.java_pattern(key, ic)), F.lit(False))
            assert rows.where(bare != R.matches(F.col("text"), key, ic)).count() == 0, key
