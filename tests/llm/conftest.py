import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t int, h double, n long, spans string, c int, rep int, component string"


def documents(spark, texts, langs=None):
    """A table with the columns of documents and some that operators might use themselves."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "x", 1, 0.5, 2, "y", 3, 4, "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [
    "", " ", "  a", "a  b ", "\n\nx\ty", "a\u0000b", "▁x y", "a▁ b", "a▁▁  b▁", "<s> </s> <0x41> <|endoftext|>x<|startoftext|>", "é𝄞", "a　b", "ﬁ",
    " " * 3000 + "x", "a" * 3000, "ab" * 700 + " c", "🙂🙂 日本語のテキスト", "ΑΣ Σ ΣΑΣ İ", "é ́a", "it's we'Ll '''s", "\x1c\x85a\xa0b\xadc", "word " * 30000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null text, a row twice, and a null key."""
    rows = [*enumerate(ODD), (len(ODD), None), (0, ODD[0]), (3, ODD[3]), (None, "no key")]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


def by_key(df, key="doc_id"):
    return sorted(((r[key] is not None, r[key] or 0), tuple(r)) for r in df.collect())
