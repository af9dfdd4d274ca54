"""Scalar text operators and pattern translation against Python's own re and str."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import exprs, patterns, text
from docloom.functions.fuzzy import partial_ratio

SAMPLES = [
    "[Sheet: A]  KW12abc",
    "[Sheet: A b]\n\nZeile 1a2b3C  camelCase9x",
    "camelCase9x  und   mehr\n  neueZeile",
    "Größe12cm ÄÖÜß\r\nx  y",
    "a1b2C3 [Sheet: x",
    "٣abc १x",
    "",
]


def spark_values(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def python_normalise(t):
    t = re.sub(r"\[Sheet:[^\]]*\]\s*", " ", t)
    for p in (r"([a-z])([A-Z])", r"(\d)([A-Za-z])", r"([A-Za-z])(\d)"):
        t = re.sub(p, r"\1 \2", t)
    return re.sub("  +", " ", t)


def random_texts(n=300):
    rng = random.Random(7)
    alphabet = "abAB12 \n\r äÖß[]:.,-٣{}&"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_normalise_like_python(spark):
    values = SAMPLES + random_texts() + ["x[Sheet: %s]\t\n y" % t for t in random_texts(50)]
    assert spark_values(spark, values, text.normalise_text) == [python_normalise(v) for v in values]


def test_strip_like_python(spark):
    values = [" x ", " x ", "\x1cx\x1f", "\n\t", "a b", "​x", "\x85y\x85"] + random_texts(100)
    assert spark_values(spark, values, exprs.strip_unicode) == [v.strip() for v in values]


def test_paths_like_pathlib(spark):
    from pathlib import PurePosixPath

    values = ["a/b/c.PDF", ".bashrc", "x/.b.tar.gz", "a.", "noext", "/x/y.z/", "a b/ü.xlsx"]
    assert spark_values(spark, values, text.basename) == [PurePosixPath(v).name for v in values]
    assert spark_values(spark, values, text.extension) == [PurePosixPath(v).suffix.lstrip(".") for v in values]


def test_float_text_like_str(spark):
    values = [0.0, 1.0, 0.1, 1e7, 12345678.5, 1e16, 1.5e22, 1e-4, 1e-5, 1.5e-7, -3.25, 999999.99, 1e15, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(exprs.float_text(F.col("v"))).collect()]
    assert got == [str(v) for v in values]


def test_python_float(spark):
    values = ["1", " 1.5 ", "1d", "1_000", "1__0", ".5", "5.", "1e3", "1e", "inf", "-Infinity", "abc", "", "+2", "0x1"]

    def expected(v):
        try:
            return float(v)
        except ValueError:
            return None

    assert spark_values(spark, values, exprs.python_float) == [expected(v) for v in values]


RULES = [
    r"Bestellung:\s*(\d+)",
    r"^(\w+)$",
    r"(?:a|b)+\s([A-Z]+)",
    r"([äöü]+)",
    r"(?P<x>[ab])(?P=x)",
    r"([[a&&b]+)",
    r"b{,2}([A-Z])\Z",
    r"{(\w*)}",
    r"(.+)$",
    r"[]\d](.)",
]


@pytest.mark.parametrize("pattern", RULES)
def test_patterns_find_what_python_finds(spark, pattern):
    import warnings

    prepared = patterns.prepare_pattern(pattern)
    assert prepared.error is None and not prepared.python_syntax
    values = random_texts(400) + ["Bestellung: 8859\nDatum: 18.06.2026", "bestellung: ٣٤", "ÄÖ äü", "{abc}"]

    def expected(v):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            m = re.search(pattern, v, re.IGNORECASE | re.MULTILINE)
        return None if m is None else m.group(1)

    from docloom.operators.extraction import first_capture

    column = lambda c: first_capture(c, F.lit(patterns.SEARCH + prepared.java), F.lit(1))
    got = spark_values(spark, values, column)
    assert got == [expected(v) for v in values]


@pytest.mark.parametrize(
    "pattern, groups, optional, python_syntax",
    [
        (r"(a)|b", 1, True, False),
        (r"(a)?b", 1, True, False),
        (r"(?:x(a))*b", 1, True, False),
        (r"(?:a|b)(c)", 1, False, False),
        (r"(a|b)", 1, False, False),
        (r"(a)(?(1)b|c)", 1, True, True),
        (r"(?x) a (b)", 1, False, True),
        (r"(unclosed", -1, False, False),
        (r"no group", 0, False, False),
    ],
)
def test_pattern_facts(pattern, groups, optional, python_syntax):
    p = patterns.prepare_pattern(pattern)
    assert (p.groups, p.optional_group, p.python_syntax) == (groups, optional, python_syntax)


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_partial_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)

    def best(s, t):
        windows = (t[max(i, 0) : i + len(s)] for i in range(1 - len(s), len(t)))
        return max(2 * common_subsequence(s, w) / (len(s) + len(w)) for w in windows)

    return 100 * max(best(short, long), best(long, short) if len(a) == len(b) else 0)


def test_partial_ratio_against_brute_force():
    rng = random.Random(3)
    for case in range(250):
        alphabet = "abcd ü"[: rng.randint(2, 6)]
        long = case % 10 == 0
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80 if long else 12)))
        b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 100 if long else 35)))
        assert partial_ratio(a, b) == pytest.approx(slow_partial_ratio(a, b))


def test_partial_ratio_by_hand():
    assert partial_ratio("abc", "xxabcxx") == 100.0
    # The cut-off window "gmb" at the start of the text: 2 * 3 / (4 + 3).
    assert partial_ratio("gmbh", "gmb h") == pytest.approx(600 / 7)
    # No cut-off window inside a text: best is "gmb " with 2 * 3 / 8.
    assert partial_ratio("gmbh", "xyzv gmb htuv") == pytest.approx(75.0)
    assert partial_ratio("abcd", "zzzz") == 0.0
