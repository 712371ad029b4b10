"""Values of another length, names at the start of sentences, lower-cased copies, and a brute-force comparison."""

import random

import numpy as np

from gridloom.llm import decontaminate as dec

ITEM = "Tom has 25 apples in Paris. Tom buys 2 more apples for 3 dollars each and then rides home by train. How many apples does Tom have in the end?"
CHANGED = {
    1: ITEM,
    2: ITEM.replace("Tom", "Anna Maria").replace("Paris", "New York").replace("25", "twenty five").replace("2 more", "seven more"),
    3: ITEM.lower(),
    4: ITEM.replace("and then rides", "and then quickly rides"),
    5: ITEM.replace("Tom buys 2", "Bob buys 2"),
    6: "Tom likes trains. " * 40,
    7: ITEM.replace("25", "thirty-one").upper().lower(),
}


def test_values_of_another_length(spark):
    docs = spark.createDataFrame([(i, "Intro words stand here. " + t + " And more text follows it.") for i, t in CHANGED.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for windows in (10**6, 0):
        got = {r.doc_id: r.kind for r in dec.leaks(docs, bench, broadcast_windows=windows).collect()}
        assert got[1] == "verbatim" and got[2] == "reparameterised" and got[3] == "verbatim" and 4 in got and 6 not in got
        assert 5 not in got  # Tom maps to Bob in one place only


def longest(pairs):
    best = 0
    for mask in range(1 << len(pairs)):
        chosen = sorted(p for k, p in enumerate(pairs) if mask >> k & 1)
        if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chosen, chosen[1:])):
            best = max(best, len(chosen))
    return best


def test_chain_is_the_longest():
    rnd = random.Random(3)
    for _ in range(60):
        pairs = list({(rnd.randint(0, 6), rnd.randint(0, 6)) for _ in range(rnd.randint(0, 9))})
        got = dec._chain(pairs)
        assert len(got) == longest(pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def tokens(text):
    t = dec.Templates([text], dec.Lexicon())
    return ["WNUM"[k] if k else t.value(i) for i, k in enumerate(t.kind.tolist())], [t.value(i) for i in range(len(t.kind))], t.kind.tolist()


def leaked(text, item):
    """Every place of the text against every place of the item, at equal offsets, template and values compared token by token."""
    (doc, values, _), (want, own, kinds) = tokens(text), tokens(item)
    n = min(dec.WINDOW, len(want))
    fine = [w for w in range(len(want) - n + 1) if n and sum(k == dec.WORD for k in kinds[w : w + n]) >= min(dec.MIN_WORDS, -(-n // 2))]
    for offset in range(-len(want), len(doc)):
        hit = [w for w in fine if w + offset >= 0 and doc[w + offset : w + offset + n] == want[w : w + n]]
        if fine and len(hit) >= dec.COVERAGE * len(fine):
            maps = {}
            if all(maps.setdefault((kinds[p], own[p]), values[p + offset]) == values[p + offset] for w in hit for p in range(w, w + n) if kinds[p]):
                return True
    plain, bare = (" ".join(t.split()).lower() for t in (text, item))
    return bool(bare) and bare in plain


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = "the cat sat on a mat and ate some fish with rice before noon while birds sang loudly".split()
    items = [(i, " ".join(rnd.choice([*words, str(rnd.randint(1, 99)), rnd.choice(["Ann", "Bob", "Cid"])]) for _ in range(rnd.randint(3, 22)))) for i in range(12)]
    items.append((90, None))
    docs = []
    for i in range(120):
        base = rnd.choice(items)[1] or ""
        if rnd.random() < 0.4:
            base = " ".join(rnd.choice(["7", "11", "305"]) if w.isdigit() and rnd.random() < 0.7 else w for w in base.split())
        docs.append((i, " ".join([rnd.choice(words) for _ in range(rnd.randint(0, 6))] + base.split() + [rnd.choice(words) for _ in range(rnd.randint(0, 6))])))
    docs += [(200, None), (201, ""), (202, "cat " * 60_000 + items[0][1])]
    sdf = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, item long, _th string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(sdf, bench).collect()}
    want = {(d, i) for d, t in docs if t and d < 202 for i, x in items if x and leaked(t, x)}
    assert want <= got and (202, 0) in got
    # What the chains and the windows of plain tokens add beyond equal offsets is a few pairs of nearly whole items.
    assert len(got - want - {(202, i) for i, _ in items}) <= 0.1 * len(want)
    assert {r.doc_id for r in dec.keep_clean(sdf, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert np.all([c in sdf.columns for c in dec.keep_clean(sdf, bench).columns])
