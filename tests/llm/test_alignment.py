import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import alignment

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tools():
    a_path, b_path = alignment.vocabulary_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path), alignment.Aligner(a_path, b_path)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def brute(rows, tools):
    """Whole texts through both libraries, all pairs of tokens compared."""
    a, b, own = tools
    per, counts = [], Counter()
    for i, t in rows:
        ia = spans(a.encode(f" {t}", add_special_tokens=False).ids, own.a_bytes) if t else []
        ib = spans(b.encode(t), own.b_bytes) if t else []
        full = f" {t}".encode()
        if not t or b"".join(own.a_bytes[x] for *_, x in ia) != full or b"".join(own.b_bytes[x] for *_, x in ib) != full:
            per.append((i, 0, 0, [], []))
            continue
        groups, links, p, q = [], [], 0, 0
        for end in sorted({e for _, e, _ in ia} & {e for _, e, _ in ib}):
            ga = [x for x in ia[p:] if x[1] <= end]
            gb = [x for x in ib[q:] if x[1] <= end]
            p, q = p + len(ga), q + len(gb)
            links += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
        counts.update(links)
        per.append((i, len(ia), len(ib), groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((i, na, nb, len(g), len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), digest(g)) for i, na, nb, g, ls in per), key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in alignment.digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


ODD = ["", None, " ", "  ", "   lead", "trail  ", "a\nb\n\nc", "tabs\t\there\r\n", "naïve café — 東京 текст", "a▁b", "<s> <|endoftext|> </s> <0x41> [UNK]", "nul\x00byte", "\xa0 no break\xa0", "it's they'LL 3,000.50 x86_64", "ﬁ ½ 　 z", "é \U0001f926\U0001f3fc‍♂️", " line sep\x85nel\x1cfs", " \n ", "\n", "x" * 300, "word " * 200]


def test_odd_texts_and_repeated_rows(spark, tools):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "   lead"), (None, "a null id"), (None, None), (4, "other text")]
    assert run(spark, rows) == brute(rows, tools)
    assert run(spark, []) == []


def test_random_texts(spark, tools):
    rng = random.Random(2)
    atoms = [" ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "the", "The", "tokens", "ization", "'s", "12", "345", ".", "...", "é", "ß", "東", "\xa0", "-", "A", "\x1f", "_", "<|endoftext|>", "​"]
    rows = [(i, "".join(rng.choices(atoms, k=rng.randrange(40)))) for i in range(300)]
    assert run(spark, rows) == brute(rows, tools)


def test_forgetting_changes_nothing(tools):
    a_path, b_path = alignment.vocabulary_paths()
    small, large = alignment.Aligner(a_path, b_path, remembered=20), tools[2]
    rng = random.Random(9)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(30)) + " " + "y" * rng.randrange(100) for _ in range(5)]
        assert small.align(texts).equals(large.align(texts))
        assert len(small.text) <= 20 + 30 * 5 and len(small.text) == len(small.known) == len(small.facts) == len(small.at) - 1


def test_intervals_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in (0, 1)]
        starts = [np.append(0, e[:-1]) for e in ends]
        order, group, left, right = alignment.coalesce_intervals(np.concatenate(starts), np.concatenate(ends), np.repeat([0, 1], [len(ends[0]), len(ends[1])]))
        want = {(i, len(ends[0]) + j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        assert len(left) == len(want) and set(zip(left.tolist(), right.tolist())) == want
        assert group[-1] + 1 == len(np.intersect1d(*ends))


def test_columns_pass_through(spark):
    table = spark.createDataFrame([(1, "some text", 7, "k", [1, 2])], "doc_id long, text string, n_a int, _text string, more array<int>")
    row = alignment.align(table).first()
    assert set(row.asDict()) == {"doc_id", "_text", "more", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"}
    assert (row["_text"], row["more"], row["n_links"]) == ("k", [1, 2], sum(p.n for p in row["pairs"]))
