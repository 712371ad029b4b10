import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import bpe, simhash

VOCAB = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(VOCAB)


def whole(codec, text):
    return codec.tok.encode(text, add_special_tokens=False).ids


def test_pieces_equal_library(codec):
    texts = ["", " ", "The cat's 12 dogs.\n\nÀ la Été!! <|endoftext|> x", "İstanbul 日本語 é́ 가나", "a\x1cb c ́d", "'tis it's \x0b y'all '''s"]
    for text, ids in zip(texts, codec.encode_many(texts)):
        assert ids == whole(codec, text)
        assert codec.decode(ids) == codec.tok.decode(ids, skip_special_tokens=False)


def test_tree_concatenation_is_exact(codec):
    rnd = random.Random(5)
    parts = ["a", "b", "the", "ing", "'", "'s", "'ll", "1", "é", "é", "日本", "!!", "<|endoftext|>", "가", "-", " ", "thereofand"]
    for k in range(300):
        text = "".join(rnd.choice("etaoinsr" if k % 2 else parts) for _ in range(rnd.randint(30, 600)))
        assert bpe.encode_whole(codec, text, rnd.choice([8, 20, 64])) == whole(codec, text)
    assert bpe.encode_whole(codec, "ab" * 50_000, 4096) == whole(codec, "ab" * 50_000)


def test_byte_level_vocabulary_tree():
    codec = bpe.Codec(bpe.vocabulary_path("byte_bpe_50k.json"))
    text = "Some words, and  more   words; " * 40 + "x" * 500
    assert bpe.encode_whole(codec, text, 64) == whole(codec, text)
    assert codec.decode(whole(codec, text)) == text


def test_operator_rows(spark, codec):
    texts = [None, "", "short text", "word " * 3000, "thereof" * 900, "thereof" * 900]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "short text", "y")], "doc_id long, text string, ids string")
    got = sorted(bpe.digests(df, leaf=1024).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == 7
    for r, t in zip(got, [*texts, "short text"]):
        ids = whole(codec, t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.decode(bpe.encode(df.drop("ids"), leaf=1024))
    assert {r.doc_id: r.decoded for r in coded.collect()}[3] == codec.decode(whole(codec, texts[3]))
    assert bpe.digests(df.limit(0)).count() == 0


def brute(fps):
    ids, label = sorted(fps), {i: i for i in fps}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] != label[a]:
                    label[a] = label[b] = min(label[a], label[b])
                    again = True
    return label


def test_components_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    fps, base = {}, [rnd.getrandbits(64) for _ in range(12)]
    for i in range(160):
        f = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            f ^= 1 << rnd.randrange(64)
        fps[i] = f
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps.values())], "fp long")
    back = {int(np.uint64(f).view(np.int64)): f for f in fps.values()}
    least = {}
    for i, f in fps.items():
        least[f] = min(i, least.get(f, i))
    want = brute({i: f for f, i in least.items()})
    for dense in (2, 64):
        pairs = [(back[r.src], back[r.dst]) for r in simhash.link_fingerprints(df, dense=dense).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        got = {f: {f} for f in back.values()}
        for a, b in pairs:
            both = got[a] | got[b]
            for x in both:
                got[x] = both
        assert {i: min(least[x] for x in got[f]) for f, i in least.items()} == want


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [(5, "", 1), (4, None, 1), (7, "One two three four", 1), (6, "ONE two  three\tfour", 1), (6, "ONE two  three\tfour", 1), (None, "lonely words here now", 1), (9, long, 1), (8, long + " tail", 1), (3, "É", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert got[5].fingerprint == "0" * 16 and got[5].component_id == got[4].component_id == 4
    assert got[7].component_id == got[6].component_id == 6 and got[9].component_id == 8
    assert got[None].component_id is None and got[3].component_id == 3
    assert simhash.near_duplicates(df).count() == len(rows)
    left = simhash.keep_one(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([4, 6, None, 8, 3], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_definition():
    import xxhash

    text = "The cat\x0bsat on é the cat sat on"
    words = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("solo") == xxhash.xxh64_intdigest(b"solo", 42)
