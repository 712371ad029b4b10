"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are the spans of four strict patterns (the base, which always stays), those of
their matches that fail the strict check without being absurd, and the spans of one looser
pattern per kind, credentials included.  Five labelers vote on every candidate (for, against,
or not at all), each on its own grounds: the strict rule and its checksum, the canonical
written form, a gazetteer of domains, prefixes and reserved ranges, cue words before the span,
and its boundaries.  Expectation-maximisation over the counts of vote patterns estimates for
every kind how reliable each labeler is and how likely each pattern is personal data; a
logistic classifier over votes, length and kind is trained on those soft labels and decides
on all candidates outside the base.  Vote patterns are at most 7290 for any amount of text,
so only they reach the driver; every candidate of every row is counted.

Start of a match: the patterns begin where the previous match ended or where no character of
the leading class stands before, which gives the same leftmost matches as without that
condition but in linear time on runs of any length.

Nulls: a null text counts as empty and has no spans.  Texts of any length are read whole.
Repeated rows each get a row; ties between spans go by start, then kind.  An empty table gives
an empty result.  Other columns, whatever their names, are ignored by the query and passed
through by :func:`redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.columns import free
from gridloom.plans.scratch import materialise

#: The kinds of the base come first.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Characters before a span that cue words are looked for in.
CONTEXT = 32
VOTES = ("strict", "form", "gazetteer", "context", "edges")
_LENGTHS = 6

# The patterns of the base rules (possessive where that matches alike).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+={0,2}",
}
#: What a text must hold for the pattern to match at all.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
}
NEEDS_LOOSE = {
    "email": r"[\[(]at[\])]", "ip": r"(?:[0-9A-Fa-f]{1,4}:){7}", "card": r"[0-9]{4}[./_][0-9]{4}[./_]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": r"[A-Za-z0-9_/+-]{20}",
}
#: The usual written form of each kind.
FORMS = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)*(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]+)$",
    "card": r"^(?:[0-9]{15,16}|[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,4}$",
    "secret": r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16})$",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|courriel|correo)[^a-z]*$",
    "ip": r"(?i)(?:ip|address|host|server|client|from|adresse)[^a-z]*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|karte|carte|tarjeta)[^a-z]*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|telefon|telefono|contact)[^a-z]*$",
    "secret": r"(?i)(?:token|key|secret|passw(?:or)?d|bearer|credential)[^a-z]*$",
}
AGAINST = r"(?i)(?:version|release|build|sha|sha1|md5|commit|digest|checksum|isbn|order|invoice|section|chapter|page)[^a-z]*$"
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "eu", "us", "ca")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substr(bare, F.lit(1), F.lit(3))).cast("int") <= 255)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _small)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _worth_a_vote(kind: str, m: Column) -> Column:
    """Of the matches that fail the strict check, those that the labelers are asked about."""
    n = F.length(_digits(m))
    return {"card": n.between(12, 19), "phone": n.between(7, 8), "ip": F.length(m) <= 15}.get(kind, F.lit(False))


def _strict(kind: str, m: Column, passed: Column | bool, from_base: bool) -> Column:
    """The strict rule and its checksum: for, against, or silent on forms that it does not know."""
    if from_base:
        return F.when(passed, 1).otherwise(-1)
    if kind == "card":
        return F.when(_luhn(_digits(m)), 1).otherwise(-1)
    return F.lit(0)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-9]|[3-9][0-9]{2})\."), -1).when(m.rlike(r"^0*:|^[fF][fF]"), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(m).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(F.length(_digits(m)).between(10, 13), 1).otherwise(-1)
    mixed = m.rlike("[0-9]") & (m.rlike("[A-Za-z].*[0-9].*[A-Za-z]") | m.rlike("[0-9].*[A-Za-z].*[0-9]"))
    return F.when(m.rlike(r"^/|//|^https?|(.)\1{5}|[a-z]-[a-z]+-[a-z]"), -1).when(mixed, 1).otherwise(-1)


def _found(text: Column, kind: str, from_base: bool) -> Column:
    """Array of candidate structs of one pattern, in order of place."""
    pattern, need = (BASE[kind], NEEDS[kind]) if from_base else (LOOSE[kind], NEEDS_LOOSE[kind])
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<at:int,before:string,m:string,after:string>>")
    begin = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def walk(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        one = F.struct(at.alias("at"), F.substr(x["gap"], F.lit(-CONTEXT)).alias("before"), x["hit"].alias("m"), x["next"].alias("after"))
        return F.struct((at + F.length(x["hit"])).alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    after = F.transform(F.slice(gaps, 2, F.size(hits)), lambda g: F.substr(g, F.lit(1), F.lit(1)))
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), after.alias("next")), lambda z: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), z["next"].alias("next")))
    raw = F.aggregate(rows, begin, walk, lambda acc: acc["out"])
    if from_base:
        raw = F.filter(raw, lambda c: _valid(kind, c["m"]) | _worth_a_vote(kind, c["m"]))

    def vote(c: Column) -> Column:
        context = F.when(c["before"].rlike(CUES[kind]), 1).when(c["before"].rlike(AGAINST), -1).otherwise(0)
        glued = c["before"].rlike(r"[A-Za-z0-9]$") | c["after"].rlike(r"^[A-Za-z0-9]")
        length, passed = F.length(c["m"]), _valid(kind, c["m"]) if from_base else F.lit(False)
        return F.struct(
            c["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (c["at"] + length).alias("end"), passed.alias("base"),
            _strict(kind, c["m"], passed, from_base).alias("strict"), F.when(c["m"].rlike(FORMS[kind]), 1).otherwise(-1).alias("form"),
            _gazetteer(kind, c["m"]).alias("gazetteer"), context.alias("context"), F.when(glued, -1).otherwise(1).alias("edges"),
            F.least(F.floor(length / 6), F.lit(_LENGTHS - 1)).cast("int").alias("length"),
        )

    shape = "array<struct<start:int,kind:int,end:int,base:boolean,strict:int,form:int,gazetteer:int,context:int,edges:int,length:int>>"
    some = text.contains("@") if need == "@" else text.rlike(need)
    return F.when(some, F.transform(raw, vote).cast(shape)).otherwise(F.array().cast(shape))


def candidates(docs: DataFrame, base_col: str, loose_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with two arrays of candidate spans and their votes: the base, and others apart from it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    strict = F.concat(*[_found(text, k, True) for k in BASE])
    marked = docs.withColumn(base_col, strict).withColumn(loose_col, F.concat(*[_found(text, k, False) for k in LOOSE]))
    rest = F.filter(base_col, lambda c: ~c["base"])
    marked = marked.withColumn(loose_col, F.concat(loose_col, rest)).withColumn(base_col, F.array_sort(F.filter(base_col, lambda c: c["base"])))
    apart = lambda c: ~F.exists(base_col, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return marked.withColumn(loose_col, F.filter(loose_col, apart))


def pattern_counts(marked: DataFrame, base_col: str, loose_col: str) -> list[tuple[tuple, int]]:
    """((kind, votes.., length), n) over all candidates; bounded by the number of patterns."""
    c = marked.select(F.explode(F.concat(base_col, loose_col)).alias("c")).select("c.*")
    rows = c.groupBy("kind", *VOTES, "length").agg(F.count("*").alias("n")).collect()
    return sorted((tuple(r)[:-1], r["n"]) for r in rows)


#: What the labelers count as before any data: right four times, silent twice, wrong once.
_TRUST = {1: 4.0, 0: 2.0, -1: 1.0}


def reliabilities(counts: list[tuple[tuple, int]], rounds: int = 50) -> dict[tuple, float]:
    """Posterior of each (kind, votes) pattern by expectation-maximisation, labelers independent given the truth.

    Every kind has its own vote tables, as a checksum says much about one kind and nothing
    about another.  The start is that labelers are rather right than wrong (``_TRUST``).
    """
    post: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        groups: dict[tuple, int] = {}
        for key, n in counts:
            if key[0] == kind:
                groups[key[1 : 1 + len(VOTES)]] = groups.get(key[1 : 1 + len(VOTES)], 0) + n
        total = sum(groups.values())
        mine = {votes: 1 / (1 + math.exp(-sum(votes))) for votes in groups}
        for _ in range(rounds):
            # A tenth of the candidates weighs as much as what is believed beforehand.
            scale = max(1.0, total / 70)
            table = [[{v: scale * _TRUST[v if y else -v] for v in (-1, 0, 1)} for _ in VOTES] for y in (0, 1)]
            share = [scale, scale]
            for votes, n in groups.items():
                for y, p in ((1, mine[votes]), (0, 1 - mine[votes])):
                    share[y] += n * p
                    for j, v in enumerate(votes):
                        table[y][j][v] += n * p
            for votes in groups:
                z = math.log(share[1] / share[0])
                for j, v in enumerate(votes):
                    z += math.log(table[1][j][v] / sum(table[1][j].values())) - math.log(table[0][j][v] / sum(table[0][j].values()))
                mine[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        post |= {(kind, *votes): p for votes, p in mine.items()}
    return post


def _features(key: tuple) -> list[float]:
    kind, *votes, length = key
    return [1.0, *map(float, votes), length / _LENGTHS, *[float(kind == k) for k in range(len(KINDS))]]


def train(counts: list[tuple[tuple, int]], steps: int = 300) -> list[float]:
    """Weights of the span classifier, fitted on the soft labels of all patterns; a pattern weighs the root of its count."""
    post = reliabilities(counts)
    rows = [(_features(k), post[k[: 1 + len(VOTES)]], math.sqrt(n)) for k, n in counts]
    w = [0.0, *[1.0] * len(VOTES), 0.0, *[0.0] * len(KINDS)]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        g = [1e-3 * x for x in w]
        for f, p, n in rows:
            z = max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f))))
            d = (1 / (1 + math.exp(-z)) - p) * n / total
            for j, x in enumerate(f):
                g[j] += d * x
        w = [a - 0.5 * b for a, b in zip(w, g)]
    return w


def _accepted(c: Column, w: list[float]) -> Column:
    z = F.lit(w[0]) + c["length"] * (w[1 + len(VOTES)] / _LENGTHS)
    for j, vote in enumerate(VOTES):
        z = z + c[vote] * w[1 + j]
    for k in range(len(KINDS)):
        z = z + F.when(c["kind"] == k, w[2 + len(VOTES) + k]).otherwise(0.0)
    return z >= 0


def _is_kind(k: int):
    return lambda c: c["kind"] == k


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def with_spans(docs: DataFrame, base_col: str, spans_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the base spans and all spans (base and accepted candidates), both in order."""
    loose = free(docs, base_col, spans_col, "_loose")[-1]
    marked = materialise(candidates(docs, base_col, loose, text_col), "pii-candidates")
    w = train(pattern_counts(marked, base_col, loose))
    return marked.withColumn(spans_col, F.array_sort(F.concat(base_col, F.filter(loose, lambda c: _accepted(c, w))))).drop(loose)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``; the first counts are of base spans."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = materialise(candidates(slim, "_base", "_loose", "_text").drop("_text"), "pii-candidates")
    w = train(pattern_counts(marked, "_base", "_loose"))
    added = F.filter("_loose", lambda c: _accepted(c, w))
    n = [F.size(F.filter("_base", _is_kind(KINDS.index(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    spans = _listed(F.array_sort(F.concat("_base", added)))
    return marked.select(F.col("_id").alias(id_col), *n, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), spans.alias("spans"), F.size(added).cast("long").alias("n_added"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>``; overlapping spans become one, named by the first.

    ``length_col``, if named, is set to the number of characters of a changed text.
    """
    base_col, spans_col = free(docs, "_base", "_spans")
    marked = with_spans(docs, base_col, spans_col, text_col)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.coalesce(F.col(text_col), F.lit(""))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def walk(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"])
        fresh = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(gap, F.element_at(names, s["kind"] + 1))).alias("out"))
        more = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], fresh).otherwise(more)

    build = F.aggregate(spans_col, begin, walk, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1)))
    changed = F.size(spans_col) > 0
    out = marked.withColumn(text_col, F.when(changed, build).otherwise(F.col(text_col)))
    if length_col:
        n = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(changed, n).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
