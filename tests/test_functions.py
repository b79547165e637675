import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import validators as V

TD3 = "P<UTOERIKSSON<<ANNA<MARIA".ljust(44, "<") + "\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
TD1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
TD2 = "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"
CASES = [
    ("ssn", "123-45-6789", True, "123-45-6789", ""), ("ssn", "987-65-4320", False, "", "reserved_for_advertising:never_issued"), ("ssn", "666 12 3456", False, "", "invalid_area:666"),
    ("ssn", "123-00-6789", False, "", "invalid_group:00"), ("ssn", "123-45-0000", False, "", "invalid_serial:0000"), ("ssn", "12345", False, "", "bad_length:5!=9"), ("ssn", "  ", False, "", "empty_value"), ("ssn", None, False, "", "empty_value"),
    ("ein", "12-3456789", True, "12-3456789", ""), ("ein", "07-1234567", False, "", "invalid_irs_prefix:07"),
    ("itin", "912-50-1234", True, "912-50-1234", ""), ("itin", "912-93-1234", False, "", "invalid_group:93"), ("itin", "812-50-1234", False, "", "invalid_prefix:8!=9"), ("itin", "912-70-0000", False, "", "invalid_serial:0000"),
    ("sin_luhn", "130 692 544", True, "130-692-544", ""), ("sin_luhn", "130692545", False, "", "luhn_check_failed"), ("sin_luhn", "046454286", True, "046-454-286", "unassigned_prefix:0"),
    ("curp", "HEGG560427MVZRRL04", True, "HEGG560427MVZRRL04", ""), ("curp", "HEGG560427MVZRRL05", False, "", "check_digit_failed:5!=4"), ("curp", "HEGG56042", False, "", "bad_length:9!=18"),
    ("rfc", "GODE561231GR8", True, "GODE561231GR8", ""), ("rfc", "GODE561231GR7", True, "GODE561231GR7", "check_digit_soft_fail:7!=8"), ("rfc", "GODE561231", True, "GODE561231", "no_homoclave:check_digit_unavailable"), ("rfc", "GODE569931GR8", False, "", "embedded_date_invalid"), ("rfc", "GOD", False, "", "bad_length:3"),
    ("mrz_td3", TD3, True, TD3, ""), ("mrz_td3", TD3.replace("<", "«"), True, TD3, ""), ("mrz_td3", TD3.replace("L898902C3", "L898902C4"), False, "", "check_digit_failed:document_number,composite"), ("mrz_td3", "ABC", False, "", "bad_shape:expected_2x44_got_[3]"),
    ("mrz_td1", TD1, True, TD1, ""), ("mrz_td2", TD2, True, TD2, ""),
    ("iso_date", "2026-08-05", True, "2026-08-05", ""), ("iso_date", "2026-02-30", False, "", "not_a_calendar_date"), ("iso_date", "05/08/2026", False, "", "bad_format:expected_YYYY-MM-DD"),
    ("generic_date", "31/12/1999", True, "1999-12-31", ""), ("generic_date", "1999-12-31", True, "1999-12-31", ""), ("generic_date", "Dec 31, 1999", True, "1999-12-31", ""), ("generic_date", "1 de enero de 2020", True, "2020-01-01", ""), ("generic_date", "31 December 1999", True, "1999-12-31", ""),
    ("generic_date", "01/02/2020", True, "2020-02-01", "ambiguous_day_month:assumed_DMY"), ("generic_date", "31/13/1999", False, "", "not_a_calendar_date"), ("generic_date", "not a date", False, "", "unparseable_date"), ("generic_date", "31/12/99", True, "1999-12-31", "two_digit_year:assumed_1999"),
    ("name", "  Anna Maria  Eriksson ", True, "Anna Maria Eriksson", ""), ("name", "12/03/1999", False, "", "looks_like_a_date"), ("name", "A", False, "", "no_letters"), ("name", "AB 12345", False, "", "too_many_digits:5"),
    ("address", "12 Main Street\nSpringfield", True, "12 Main Street, Springfield", ""), ("address", "12/03/1999", False, "", "looks_like_a_date"), ("address", "1234567", False, "", "no_word_of_three_letters"), ("address", "ab", False, "", "too_short:2"),
    ("amount", "$1,234.56", True, "1234.56", ""), ("amount", "1.234,56", True, "1234.56", ""), ("amount", "(1,234.56)", True, "-1234.56", ""), ("amount", "1234.56-", True, "-1234.56", ""), ("amount", "INR 5000", True, "5000", ""), ("amount", "1,23,456.78", True, "123456.78", ""), ("amount", "twelve", False, "", "no_digits"), ("amount", "12.34.56.78", False, "", "malformed_number"),
    ("no_such", " a  b ", True, "a b", "unknown_validator:no_such"),
]


def test_validators(spark):
    df = spark.createDataFrame([(k, v) for k, (_, v, *_) in enumerate(CASES)], "k int, v string")
    for name in sorted({c[0] for c in CASES}):
        got = {r.k: tuple(r.a) for r in df.select("k", V.check(name, F.col("v")).alias("a")).collect()}
        for k, (n, v, *want) in enumerate(CASES):
            if n == name:
                assert got[k] == tuple(want), (n, v)
    assert V.verification("curp") == "checksum" and V.verification("ssn") == "format" and V.verification("x") == "none"


def test_text_columns_agree_with_the_exact_forms(spark):
    texts = ["Situación  ESPECIAL", "", None, "PASSPORT PA5SPORT", "straße Grüße", "Ñandú — café", "आधार सरकार", "a_b c-d 12", "  İ "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", "t", T.normal_forms(F.col("t")).alias("n"), T.fold(F.col("t")).alias("f"), T.skeleton(T.fold(F.col("t"))).alias("s"), T.tokens(T.skeleton(T.fold(F.col("t")))).alias("w")).collect()
    for r in rows:
        if r.k != 8:
            assert (r.n.folded, r.n.skeleton, r.n.tokens) == (r.f, r.s, r.w), r.t
    assert rows[0].s == "51tuac10n e5pec1a1" and rows[6].w == ["आधार", "सरकार"]


def test_small_text_functions(spark):
    r = spark.createDataFrame([("a b c", "1234567", " Total :\n\n  x ", "Name ____ ....")], "a string, b string, c string, d string").select(
        T.ngrams(F.split("a", " "), 2).alias("n"), T.ngrams(F.split("a", " "), 4).alias("none"), T.redact(F.col("b")).alias("r"), T.redact(F.lit("12")).alias("r2"), T.clean_value(F.col("c")).alias("c"), T.strip_fill_rules(F.col("d")).alias("d"), T.slug(F.lit(" A-b C!")).alias("s"), T.has_substance(F.lit("____")).alias("h"), T.legacy_tokens(F.lit("A_b Cd9")).alias("l")
    ).first()
    assert (r.n, r.none, r.r, r.r2, r.c, r.d, r.s, r.h, r.l) == (["a b", "b c"], [], "***4567", "**", "Total :\nx", "Name", "a_b_c", False, ["a", "b", "cd9"])


def naive(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_ratios():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(0, 12))) for _ in "12")
        assert T._common(a, b) == naive(a, b)
    assert T.ratio("abc", "abd") == pytest.approx(200 * 2 / 6) and T.partial_ratio("bcd", "abcde") == 100 and T.token_sort_ratio("b a", "a b") == 100
    assert T.label_similarity("date of birth", "the date of birth here") == 100 and T.label_similarity("name", "full name of") == 96
