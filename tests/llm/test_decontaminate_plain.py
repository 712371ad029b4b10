from gridloom.llm import decontaminate

DENSE = [(1, "Compute 12 + 7 * 3 - 4 / 2"), (2, "we met Anna Bert Carl Dora Emil Fritz Gerd Hanna Ida Jon Kim Lea Max Nora"), (3, "3 1 4 1 5 9 2 6 5 3 5 8")]


def test_items_dense_in_values_are_found_verbatim(spark):
    bench = spark.createDataFrame(DENSE, "item_id long, text string")
    docs = [(10 * i, f"some words before it. {t} and some words after it") for i, t in DENSE]
    docs += [(10 * i + 1, t.lower()) for i, t in DENSE] + [(5, "some words 3 1 4 2 2 9 2 7 5 3 6 8 and Compute 13 + 8 * 3 - 4 / 9")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for windows in (10**6, 0):
        got = decontaminate.leaks(df, bench, broadcast_windows=windows).collect()
        assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(10 * i + j, i, "verbatim") for i, _ in DENSE for j in (0, 1)}
        assert [r.doc_id for r in decontaminate.keep_clean(df, bench, broadcast_windows=windows).collect()] == [5]
