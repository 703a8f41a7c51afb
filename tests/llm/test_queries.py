"""Which queries there are, and which of them SQL can express."""

from quaestor.llm.queries import QUERIES, SQL


def test_queries_and_their_sql():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    # learned models, sketches, packing, approximate search and page extraction have no SQL form
    assert {int(name[2:].split("_")[0]) for name in SQL} == {1, 7, 8, 10, 12, 13}
    assert set(SQL) <= set(QUERIES)
