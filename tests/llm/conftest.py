import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en"), (1, "Alpha beta gamma delta epsilon zeta.", "en"), (2, None, "de"), (3, "", None),
    (4, " \t\r\n", "en"), (None, "Alpha  beta gamma delta\nepsilon zeta.", None), (5, LONG, "en"), (6, LONG + " tail", "en"),
    (7, "12 34 56 !? %%", "fr"), (8, "e", "fr"), (9, "É ß\x1c\x85 <|endoftext|> \U0001f600", "de"), (None, None, None),
]
NAMES = "kept keep_id score id hash n at doc size root same host path rule verdict label weight".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with NULLs, blanks, very long texts, ties and repeats, and columns named like those of operators."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.selectExpr("*", *[f"'{n}' AS {n}" for n in NAMES])


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")
