"""Functions that return the user's rows keep columns of any name as they are."""

import pytest

from quire.llm import chunk_dedup as CD, decontamination as DC, language_id as LI, mixing as MX, near_dedup as ND

NAMES = ["_f", "_r", "_at_file", "_at_row", "_time", "_times", "_raw", "_cut", "_place", "_text", "_key", "_h", "_id", "_all", "_b", "_row",
         "_out", "size", "copies", "kept", "stays", "lang_pred", "score", "a.b", "with space"]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    texts = [f"some words of a text that number {i} has and no other one {i * i}" for i in range(12)]
    rows = [(i, t, "en", "s", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


FUNCTIONS = {
    "one_of_each": lambda d: ND.one_of_each(d),
    "materialize": lambda d: MX.materialize(d, MX.mix(d, MX.cycle((1.0,)))),
    "without": lambda d: CD.without(d, CD.repeated_spans(d)),
    "clean": lambda d: DC.clean(d, d.limit(0).selectExpr("doc_id AS item_id", "text")),
    "accepted": lambda d: LI.accepted(d, 0.0),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_columns_of_any_name(docs, name):
    got = FUNCTIONS[name](docs)
    assert got.columns == docs.columns
    line = lambda r: tuple(r)
    assert sorted(map(line, got.collect())) == sorted(map(line, docs.collect()))


def test_copies_of_one_row_count_once(spark):
    """A language that is mostly copies of one row is learned all the same."""
    rows = [(7, "the same words over and over", "en")] * 3000 + [(i, f"andere Wörter hier {i}", "de") for i in range(100, 900)]
    rows += [(i, f"a few other words {i}", "en") for i in range(1000, 1010)]
    got = LI.sample(spark.createDataFrame(rows, "_key long, text string, lang string"), 100, 1)
    n = {k: sum(lang == k for lang, _ in got) for k in ("en", "de")}
    assert n == {"en": 11, "de": 100}
