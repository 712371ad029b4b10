import hashlib
import random

from gridloom.llm import bpe

VOCAB = bpe.vocabulary_path()


def test_hard_leaves_are_encoded_and_sewn_apart(spark):
    codec, rnd = bpe.Codec(VOCAB), random.Random(4)
    texts = {"letters": "".join(rnd.choice("etaoinsrhé") for _ in range(30_000)), "signs": "".join(rnd.choice("-=+*/") for _ in range(9_000)), "mixed": "some words " * 300 + "thereofand" * 700 + " more words" * 300}
    df = spark.createDataFrame(list(texts.items()), "key string, text string")
    leaves = bpe._leaves(df, VOCAB, 1024)
    parts = bpe.hard_parts(leaves.where("hard"), VOCAB, 8).collect()
    assert len(parts) > 30 and all(p.sound and p.text is None for p in parts)
    for key in ("letters", "signs"):
        mine = sorted((p for p in parts if p.key == key), key=lambda p: p.at)
        assert [i for p in mine for i in p.ids] == codec.tok.encode(texts[key], add_special_tokens=False).ids


def test_leaves_without_shared_tokens_fall_back(spark):
    tok = bpe.load(VOCAB)
    texts = ["a" * 5_001, "x " * 600 + "ha" * 3_001 + " y" * 600, "".join("zq"[i % 3 % 2] for i in range(4_000)), "́" * 3_000 + "b" * 2_000]
    rows = bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaf=512).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_whole_words_are_looked_up_and_stay_bounded():
    import random

    rnd = random.Random(2)
    parts = ["Straße", "it's", "naïve,", "(a)", "12", "...", "'ve", "x" * 200, "\t", "\r\n", "’t", "<|", "ÀÉ!", "and", "[SEP]"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "and and\tAND\nand"]
    tok = bpe.load(bpe.vocabulary_path())
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (bpe.CACHE_PIECES, 40):
        codec = bpe.Codec(bpe.vocabulary_path(), most)
        for _ in range(2):
            assert list(codec.encode_many(texts)) == want
        words = codec.packed.words
        assert 0 < len(words) <= most and max(map(len, words)) <= bpe.WORD_CHARS
        if most > 40:
            codec.packed.known.clear()  # a word that was met needs no piece again
            assert codec.encode("And and") == tok.encode("and and", add_special_tokens=False).ids and not codec.packed.known


def test_new_words_are_merged_together_without_the_library(monkeypatch):
    import pyarrow.parquet as pq

    rnd = random.Random(6)
    signs = [chr(c) for c in range(32, 127)] * 2 + [chr(c) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))] + list("\t\n\r'  stremvld") + ["'"] * 3
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 300))) for _ in range(500)]
    texts += ["'s", "''S", "'s 'T'x'LL", "aaaaaaa " + "ha" * 32, "a,b;" * 100, "'" * 60 + "s", "\n\n", " ", "", None]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:200]
    tok = bpe.load(VOCAB)
    texts = [t for t in texts if "<|" not in (t or "")]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for together in (7, 10_000):
        monkeypatch.setattr(bpe, "MERGED_WORDS", together, raising=False)
        codec = bpe.Codec(VOCAB)
        codec.packed.tok = None  # the library is not asked
        assert list(codec.encode_many(texts)) == want
    # Long words and pieces, and other characters, still need it; nothing of a full cache is lost.
    odd = ["x" * 65 + "'ll Y", "é" * 300, "漢 and and", "<| a <|endoftext|>", "b " * 40 + "c" * 64]
    codec = bpe.Codec(VOCAB, 3)
    for _ in range(2):
        assert list(codec.encode_many(odd + texts)) == [tok.encode(t, add_special_tokens=False).ids for t in odd] + want
    assert len(codec.packed.words) == 3
    rules = {"type": "BPE", "vocab": {}, "merges": []}
    assert not bpe.Merges.hold(rules) and not bpe.Merges.hold(rules | {"type": "WordPiece"})
