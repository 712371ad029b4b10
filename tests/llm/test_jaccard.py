import random

import corpus_pipeline
from gridloom.llm import jaccard, simhash


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    ids, label = [r[0] for r in rows], {r[0]: r[0] for r in rows}
    s = {i: sets(t) for i, t in rows}
    near = [(a, b) for a in ids for b in ids if a < b and (s[a] == s[b] or 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]))]
    again = True
    while again:
        again = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                again = True
    return sorted(set(label.values())), near


def test_stage_keeps_one_of_texts_at_five_word_similarity(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = [(900, ""), (901, None), (902, " \n"), (903, "Two words"), (904, "two  WORDS")]
    for g in range(12):
        base = [word() for _ in range(rnd.choice([9, 60, 150, 700]))]
        for v in range(30 if g == 0 else 6):  # one crowded group
            text = list(base)
            for _ in range(rnd.randint(0, 1 + len(text) // 55)):
                text[rnd.randrange(len(text))] = word()
            rows.append((g * 40 + v, " ".join(text)))
    want, near = kept(rows)
    text = dict(rows)
    apart = [p for p in near if (simhash.fingerprint(text[p[0]]) ^ simhash.fingerprint(text[p[1]])).bit_count() > 3]
    assert len(apart) > 20  # pairs that the three-bit rule does not link
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == want
    both = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "g")], "doc_id long, text string")
    assert sorted(r.text for r in jaccard.keep_one(both).collect()) == ["a b c d e f", "g"]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_fingerprints_meet_on_the_grid_first(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    rows = [(k, " ".join(base[:-k] + [f"end{k}-{i}" for i in range(k)] if k else base)) for k in range(40)] + [(90, ""), (91, "far from all others here today")]
    nodes = jaccard._nodes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    fps = {r.node: r.fp % (1 << 64) for r in nodes.collect()}
    found = [(r.src, r.dst) for r in jaccard.grid_pairs(nodes.select("node", "fp")).collect()]

    def groups(pairs):
        label = {n: n for n in fps}
        for _ in fps:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert groups(found) == groups(near) and len(near) > 10


def test_variants_of_one_text_do_not_meet_by_what_all_hold(spark):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**9)}"
    met = {}
    for size in (60, 240):
        base = [word() for _ in range(150)]
        rows = [(0, " ".join(base))]
        for i in range(1, size):
            text = list(base)
            for _ in range(rnd.randint(2, 9)):
                text[rnd.randrange(150)] = word()
            rows.append((i, " ".join(text)))
            if i % 5 == 0:  # a variant of a variant, seldom near the text that all come from
                text[rnd.randrange(150)] = word()
                rows.append((1000 + i, " ".join(text[: rnd.randint(138, 150)])))
        shared = [word() for _ in range(2000)]  # long texts with many shingles in common meet once
        rows += [(9000 + i, " ".join(shared + [word() for _ in range(150)])) for i in range(3)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        nodes = jaccard._nodes(df, "doc_id", "text")
        node = {r.id: r.node for r in nodes.select("first.id", "node").collect()}
        held = jaccard._sets(nodes.select("node"), nodes, df, "doc_id", "text")
        s = {node[i]: sets(t) for i, t in rows}
        like = lambda a, b: 9 * len(s[a] & s[b]) >= 4 * (len(s[a]) + len(s[b]))
        cls = {n: node[0] if like(n, node[0]) else n for n in s}  # as the rounds leave them
        mixed = spark.createDataFrame([(1, n, c) for n, c in cls.items()], "key long, node long, cls long")
        found = [frozenset(r) for r in jaccard._prefix_pairs(mixed, held).collect()]
        want = {frozenset((a, b)) for a in s for b in s if a < b and cls[a] != cls[b] and like(a, b)}
        assert want and want <= set(found) and len(want) > size // 20 and len(set(cls.values())) > size // 4
        assert len(found) == len(set(found)) <= 2 * len(s)
        met[size] = jaccard._prefix_meetings(mixed, held).count()
        assert met[size] <= 4 * len(s)
    assert met[240] <= 12 * met[60]
