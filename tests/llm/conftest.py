import pytest

WEIRD = [
    (1, "The cat sat on the mat. " * 8, "en", "a", 7),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "an id is missing here but words are not", "fr", "b", 3),
    (4, " \t\n\x0b\x0c\r ", "fr", "b", 3),
    (5, "nbsp inside line sep \x1cfs é ﬁ ÀÉÎ <|endoftext|> ▁x  y", "de", "c", 1),
    (6, "word " * 30000, "de", None, 1),
    (7, "same text twice over", "en", "a", 2),
    (8, "same text twice over", "en", "a", 2),
    (8, "same text twice over", "en", "a", 2),
    (9, "x", "en", "zz", 2),
    (10, "日本語のテキスト 🚴‍♀️ ǅ İstanbul ΣΑΣ", "en", "ü", 2),
]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls, empty and very long texts, repeated rows, odd characters, and columns the operators use themselves."""
    taken = (
        "score label rank size copies target source_size taken kept n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed row fp component_id fingerprint _kept _text _id _part "
        "_index _c _lines _symbols _repeats stratum cutoff x bin held_out predicted piece start length part part_rank offset sequence_id h doc words h_ _h mix_id mix_hash mix_copies a.b"
    ).split()
    rows = [(*r, *(f"{r[0]} {c}" for c in taken)) for r in WEIRD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in taken))


@pytest.fixture(scope="session")
def no_docs(weird):
    return weird.where("false")


@pytest.fixture(scope="session")
def weird_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (6, 0, None), (9, None, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
