import pytest

TABLES = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or give to their results.
CLASHING = ("row", "id", "words", "at", "node", "n", "key", "line", "kept", "rule", "spans", "lang_pred", "score", "hash", "range", "k", "mix_block")


@pytest.fixture
def odd_documents(spark):
    """Null ids, texts and sources, empty, very long and repeated texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
    plain = "the quick brown fox jumps over the lazy dog and then it sleeps in the sun\nuntil the evening comes"
    rows = [
        (1, plain, "en", "src0", 1), (2, None, "en", "src1", None), (3, "", None, None, 0), (4, " \n\t\n ", "fr", "src1", 5),
        (5, long, "en", "src0", 5), (6, plain, "en", None, 1), (6, plain, "en", None, 1), (None, plain, "en", "src2", 1),
        (None, None, None, None, None), (7, "één déjà-vu; ça va? 你好 世界", "fr", "src1", 3), (8, "one two", "en", "src9", 7),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df
