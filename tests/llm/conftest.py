import pytest
from pyspark.sql.types import _parse_datatype_string

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves, as columns of the input.
CLASHING = "keep_id long, size string, shard int, `key` string, rep int, fp string, spans string, found string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang); any further columns by DDL and values."""
    def make(rows, extra="", values=(), parts=3):
        schema = _parse_datatype_string(DOCS + (f", {extra}" if extra else ""))
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), *values) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts) if full else \
            spark.createDataFrame([], schema)
    return make


@pytest.fixture(scope="session")
def clashing():
    return {"extra": CLASHING, "values": (7, "a", 7, "b", 7, "c", "d", "e")}


def odd_texts():
    """Texts with nulls, nothing, odd white space, repeated characters, special strings and great length."""
    return [None, "", " ", "\n", "  a  b ", "a\n b\n", "\x1c.\x1c", "don't I'LL we'Ve", "<|endoftext|>",
            "x<|endoftext|> y<|startoftext|>", "aaaa" * 40, "é́ ﬁ Σας İ ǅ ß", "中文字符 😀😀", "▁ ▁▁ x▁y",
            "tab\tcr\r\nvt\x0bff\x0c\x85\xa0", "<0x41> <unk> </s>", "word, other. (third)!", "ab" * 3000,
            "long words go on " * 3000, "1234 56,7 3.14", "　wide space   line"]
