from gridloom.llm import decontaminate

ITEM = "A train leaves Paris at 9 and travels 120 km in 2 hours so how fast does it go then"


def test_clean_rows_of_a_leaking_id_stay(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    # Two parts that each match less than the share; under one id they must not be put together.
    w = ITEM.split()
    parts = [" ".join(w[:11]), " ".join(["x"] * 5 + w[5:14])]
    rows = [(None, ITEM), (None, "clean under a null id"), (None, None), (7, "so " + ITEM), (7, "clean under a shared id"), (7, "clean under a shared id"), (8, parts[0]), (8, parts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for windows in (10**6, 0):
        left = decontaminate.keep_clean(docs, bench, broadcast_windows=windows)
        assert left.columns == docs.columns
        assert sorted(left.collect(), key=str) == sorted([r for r in docs.collect() if r.text is None or ITEM not in r.text], key=str)
        assert {r.doc_id for r in decontaminate.leaks(docs, bench, broadcast_windows=windows).collect()} == {None, 7}


def test_every_text_of_an_item_is_searched(spark):
    texts = ["Anna walks nine miles to the river and comes back by the old road before it is dark again", "which of these seven metals would melt first when all of them are heated in the same furnace"]
    lone = "how many blue stones remain in the basket after both of the brothers have taken their share of them"
    bench = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (7, texts[1]), (None, lone), (7, None)], "item_id long, text string")
    rows = [(1, texts[0]), (2, "before it " + texts[1] + " and behind"), (3, lone), (4, "nothing of the kind is said in here at all by anyone of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for windows in (decontaminate.BROADCAST_WINDOWS, 0):
        found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, broadcast_windows=windows).collect()}
        assert found == {(1, 7), (2, 7), (3, None)}
        assert [r.doc_id for r in decontaminate.keep_clean(docs, bench, broadcast_windows=windows).collect()] == [4]
