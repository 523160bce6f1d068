"""Renames of staged documents whose ids are at or above 10,000,000."""

from catalog import QUERIES
from quire.session import prepare


def test_rename_staged_of_large_ids(spark, tmp_path):
    first = 10_000_003
    rows = [(i, f"text {i}", "en", "s", 10) for i in range(first, first + 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["rename_staged"][0](prepare(spark), str(tmp_path)).collect()
    # pairs (i % 19 <= 1) share an id and are left out here
    want = {i for i in range(first, first + 40) if i % 3 == 0 and i % 19 > 1}
    renamed = {r.arrival for r in got if "enamed" in r.doc_id}
    assert want and want <= renamed and all(i % 3 == 0 for i in renamed if i % 19 > 1)
