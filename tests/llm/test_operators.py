import base64
import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, decontaminate, neighbours, order, pii, quality, toxicity, warc

BENCH = [(1, "A train leaves Paris at 9 and travels 120 km in 2 hours so how fast does it go then"), (2, "short item of five"), (3, None), (3, "short item of five"), (None, "x")]


def test_leaks_by_both_ways(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    same = "intro words. " + BENCH[0][1] + " and more"
    changed = same.replace("Paris", "Rome").replace("120", "300").replace("2 hours", "5 hours")
    docs = spark.createDataFrame([(1, same, 0), (2, changed, 0), (3, "nothing of that kind here at all, " * 50, 0), (4, None, 0), (5, "", 0), (6, "so short item of five it is", 0), (6, "so short item of five it is", 0)], "doc_id long, text string, item long")
    for windows in (10**6, 0):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench, broadcast_windows=windows).collect()}
        assert set(got) == {(1, 1), (2, 1), (6, 2), (6, 3)}
        assert got[1, 1].kind == "verbatim" and got[2, 1].kind == "reparameterised" and got[2, 1].changed >= 2
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_contradicting_slots_are_no_leak(spark):
    item = "the number 5 plus the number 5 makes twice the number 5 which everybody knows by now"
    docs = spark.createDataFrame([(1, item.replace("5", "7")), (2, item.replace("5", "7", 1))], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if fine(kind, m.group()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in found)


def test_pii_against_python_patterns(spark):
    rnd = random.Random(2)
    bits = ["a@b.co", "._x@y.z-1", "1.2.3.4", "300.1.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824", "+12", "é", " ", "😀", "9" * 15, "@", ".", "-", "x", "(499) 555-6503"]
    texts = [None, "", *["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(150)], "7 " * 20_000, "a" * 60_000, "1" * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:80]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    planted = ["write to jo [at] mail [dot] com now", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "call (499) 555-6503 today", "visa 4111.1111.1111.1112 paid", 'api token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" set', "order 4234 5678 9012 3457 x"]
    clean = ["x4111111111111112y", "build 999.999.999.999 out", "see the-long-name-of-section-3-here please", "sha 12345678901234567890123456789012345678901234567890"]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate((planted + clean) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _base string, _spans string, _LOOSE string")
    for r in pii.find(df).collect():
        assert (r.n_added > 0) == (r.doc_id % 10 < 6), (rows[r.doc_id][1], r.spans)
    redacted = pii.redact(df).collect()
    assert redacted[0].asDict().keys() == dict.fromkeys(df.columns).keys() and {(r._base, r._spans, r._LOOSE) for r in redacted} == {("x", "y", "z")}
    assert next(r.text for r in redacted if r.doc_id == 0) == "write to <EMAIL> now"
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!"), (2, None)], "doc_id long, text string")).collect()}
    assert clean == {1: "é <EMAIL>, <IP>!", 2: None}
    assert pii.find(df.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    pages = [(3, "u", "same"), (1, "u\n2", "same"), (2, None, None), (5, "v", ""), (None, "w", "same"), (7, "x", "é" * 400_000)]
    df = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, sha string, first string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    monkeypatch.setattr(warc, "HOT_SHARE", 2)
    assert {r.page_id: r for r in warc.round_trip(df).collect()} == got
    many = [(i, f"u{i}", f"text {i % 90}" if i % 3 else "one text for a third") for i in range(600)]
    first = {}
    for i, _, t in many:
        first.setdefault(t, i)
    for r in warc.round_trip(spark.createDataFrame(many, "page_id long, url string, html string")).collect():
        t = many[r.page_id][2].encode()
        want = (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), None if first[t.decode()] == r.page_id else first[t.decode()])
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == want and (r.record_type == "response") == (want[2] is None)
    assert got[1].record_type == "response" and got[3].refers_to == 1 and got[None].refers_to == 1 and got[5].refers_to == 2
    assert got[7].payload_bytes == 800_000 and got[7].payload_digest == warc.payload_digest(("é" * 400_000).encode())
    bundles = warc.write(df)
    two = {r.page_id: r for r in warc.fetch(bundles, warc.index(bundles).where("page_id IN (1, 7)")).collect()}
    assert two[7].payload.decode() == "é" * 400_000 and two[1].payload == b"same"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chat_against_sql(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (4, 0, None, None), (None, 0, "user", "z")]
    rows += [(9, t, "user", f"turn {t}") for t in range(700)] + [(8, t, "user", f"turn {t}") for t in range(300)]
    rows += [(20, 0, "user", f"same number {t}") for t in range(600)] + [(21, None, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, block int")
    con = duckdb.connect()
    conversations = df.toPandas()
    con.register("conversations", conversations)
    assert set(map(tuple, chat.render(df).collect())) == set(con.execute(chat.ORACLE_SQL.replace("WHERE conv_id IS NOT NULL", "WHERE conv_id IS NOT NULL AND NOT isnan(conv_id::DOUBLE)")).fetchall())
    assert chat.render(df.limit(0)).count() == 0


def test_neighbours_recall_and_edge_cases(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 16)).astype(float)
    x[50:90] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0]), (None, x[3].tolist())]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 600, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(want) & {v for v, _ in found.values()})
        assert sorted(found) == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for v, s in found.values())
    assert hits >= 0.9 * 60 and [got[100][k][0] for k in range(1, 11)] == list(range(50, 60))


def test_neighbours_recall_on_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [r for r in table.select("vec_id", "embedding").collect() if r.embedding is not None]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ids, x = ids[fine], x[fine]
    clash = table.select("vec_id", "embedding", F.lit(1).alias("query_id"), F.lit(1).alias("rank"), F.lit(1).alias("packed"), F.lit(1).alias("cell"))
    got = {}
    for r in neighbours.search(clash).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        want = [int(i) for i in ids[order] if i != q][:10]
        hits += len(set(want) & {v for v, _ in found.values()})
        at = dict(zip(ids.tolist(), d.tolist()))
        assert all(abs(at[v] - s) < 1e-9 for v, s in found.values())
    assert hits >= 0.9 * 10 * len(got)


def test_order_is_a_dense_permutation(spark):
    for n in (1, 2, 3, 1000):
        p = order.Permutation(n)
        s = p.slots(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (p.numbers(s) == np.arange(n)).all()
    codec = bpe.Codec(bpe.vocabulary_path())
    texts = [None, "", "x1 " * 5000, "short", "short", "é" * 3000, "a word or two " * 4000]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)] + [(6, texts[6], 1, 2)], "doc_id long, text string, id int, body int")
    for encoder, ids_of in ((order.BpeBodies(), lambda t: np.array(codec.encode(t), "uint16").tobytes()), (order.ByteBodies(), str.encode)):
        dtype = encoder.dtype
        runs = []
        for parts in (1, 7):
            written = order.write(df.repartition(parts), shard_slots=4, encoder=encoder)
            got = order.read(written, shard_slots=4, dtype=dtype).collect()
            assert sorted(r.slot for r in got) == list(range(len(got)))
            assert min(r.slot for r in order.read(written, from_slot=6, shard_slots=4, dtype=dtype).collect()) == 6
            runs.append({r.slot: (r.doc_id, r.seq_no, r.n_ids, bytes(r.ids)) for r in got})
        assert runs[0] == runs[1]
        back = {}
        for doc, seq, n, ids in runs[0].values():
            back.setdefault((doc, seq), []).append(ids)
        for i, t in enumerate(texts):
            raw, step = ids_of(t or ""), order.STRIDE * np.dtype(dtype).itemsize
            for seq, at in enumerate(range(0, len(raw), step)):
                assert back.pop((i if i != 3 else None, seq)) == [raw[at : at + step]] * (2 if i == 6 else 1)
        assert not back
    assert order.layout(df.limit(0)).count() == 0


def test_classifiers_on_held_out_rows(spark):
    """Recall and precision of both classes, and a Brier score below that of the share alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        clash = docs.select("doc_id", "text", F.lit("x").alias("_text"), F.lit("x").alias("_f"), F.lit("x").alias("y"), F.lit("x").alias("th"), F.lit(1).alias("held_out"))
        rows = module.score(clash, labels).join(labels, "doc_id").where("held_out").select("predicted", label, "score").collect()
        p, y, score = (np.array([r[k] for r in rows], float) for k in range(3))
        for c in (0, 1):
            assert ((p == c) & (y == c)).sum() > 0.8 * (y == c).sum() and ((p == c) & (y == c)).sum() > 0.8 * (p == c).sum()
        assert ((score - y) ** 2).mean() < ((y.mean() - y) ** 2).mean() / 2
    odd = spark.createDataFrame([(1, None), (None, ""), (1, None), (2, "word " * 200_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for m in (quality, toxicity) for r in m.score(odd, labels.limit(0)).collect())
    assert all(m.score(odd.limit(0), labels).count() == 0 for m in (quality, toxicity))
