import hashlib
import random

from gridloom.llm import line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def brute(rows, min_docs=2):
    """(id, n_lines, n_dropped, kept); a null id is one document behind all others."""
    last = max((i for i, _ in rows if i is not None), default=0) + 1
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = last if i is None else i
        gone = [len(key(x)) >= 10 and len(held[key(x)]) >= min_docs and me > min(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    found = line_dedup.dedup(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()], key=str)


def test_odd_rows(spark):
    rows = [
        (3, "Shared LINE here \nown line of three\n"), (1, "\tshared line HERE\n\nshort\nshared line here"), (7, "shared line here"), (7, "shared line here"), (7, "shared line here\nseven alone 123"),
        (None, "shared line here\nonly null ids hold this"), (None, "only null ids hold this"), (5, None), (6, ""), (8, "\n\n\n"), (9, "ÄÖÜ äöü ÄÖÜ x"), (10, "äöü äöü ÄÖÜ x\nÄÖÜ äöü ÄÖÜ x"),
        (11, "short\nninechars"), (12, "short\nninechars\r\n ninechars0\x0b"), (13, "NINECHARS0\x0c\x1f"), (14, "ninechars0"), (15, "no-break\xa0 space line\xa0"), (16, "no-break\xa0 space line"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_random_lines_and_thresholds(spark):
    rng = random.Random(7)
    pool = [f"line number {k} of the pool" + " " * (k % 3) for k in range(40)] + ["", "tiny", "Line Number 3 Of The Pool"]
    rows = [(rng.randrange(30), "\n".join(rng.choices(pool, k=rng.randrange(12)))) for _ in range(60)]
    for least in (2, 3, 5):
        assert run(spark, rows, min_docs=least) == brute(rows, least)


def test_hot_line_long_text_and_clashing_columns(spark):
    rows = [(i, "the line that all hold\n" + f"line of {i} alone") for i in range(300)] + [(900, "\n".join(f"long text line {k % 7000}" for k in range(20_000)))]
    assert run(spark, rows) == brute(rows)
    table = spark.createDataFrame([(2, "same line as one", 5, "a", 1), (1, "same line as one", 6, "b", 2)], "doc_id long, text string, n_lines int, _d1 string, `key.h1` int")
    got = {r["doc_id"]: r for r in line_dedup.dedup(table).collect()}
    assert (got[2]["text"], got[2]["n_lines"], got[2]["n_dropped"], got[2]["_d1"], got[2]["key.h1"]) == ("", 1, 1, "a", 1)
    assert (got[1]["text"], got[1]["n_dropped"]) == ("same line as one", 0)


def test_digests_and_native_plan(spark):
    table = spark.createDataFrame([(1, "alpha beta gamma"), (2, "x\nAlpha beta gamma")], SCHEMA)
    found = line_dedup.digests(table)
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found.collect()} == {(1, 1, 0, hashlib.sha256(b"alpha beta gamma").hexdigest()), (2, 2, 1, hashlib.sha256(b"x").hexdigest())}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
