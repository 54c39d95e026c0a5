r"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from four exact patterns (the base kinds) and three wide
ones that also take in much that is no personal data: numbers in groups, the
near misses of the base kinds among them, long tokens of letters and digits,
and pairs of capitalised words. Five labelers vote yes, no or nothing on each
candidate: format, gazetteer, words before, what comes after, shape.
Expectation maximisation over the counts of vote patterns estimates how
reliable each labeler is and how frequent true spans are in each kind, and a
logistic span classifier is fitted to the posteriors. Base spans always stay;
the classifier decides about the others.

Only counts by kind, vote pattern and length class reach the driver: at most
7 * 3**5 * 4, however large the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitmesh.llm.frames import Scratch, once

#: Kinds in their order (fixed values). The first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "id", "secret", "name"]
BASE = KINDS[:4]
LOCAL = r"[A-Za-z0-9._%+-]"
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)"
#: The base patterns, in possessive form where a run can't be given back, so that no text makes them slow. \G lets a match begin right after the one before.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![\p{L}0-9.,+-])[0-9]{2,}+(?:[\x20./-][0-9]++){0,6}+(?![\p{L}0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,63}[0-9])(?=[0-9_+/-]{0,63}[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}+",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE}\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?|\p{{Lu}}\p{{Ll}}++\x20\p{{Lu}}\p{{Ll}}++)",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "id": "[0-9]{2}", "secret": r"[A-Za-z0-9_+/-]{16}", "name": r"\p{Ll}\x20\p{Lu}\p{Ll}"}
#: Given names of the gazetteer (fixed values).
GIVEN = [
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara",
    "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Hans", "Peter", "Klaus", "Ursula", "Monika",
    "Jürgen", "Petra", "Sabine", "Jean", "Marie", "Pierre", "Michel", "Nathalie", "Isabelle", "Philippe", "Antonio", "José",
    "Carmen", "Manuel", "Ana", "Francisco", "Pilar", "Javier", "Lucía",
]
#: Words that no person is called (fixed values).
COMMON = [
    "The", "And", "Of", "To", "In", "That", "Is", "Was", "He", "For", "It", "With", "As", "On", "Be", "At", "By", "This", "Not", "Are",
    "But", "From", "Or", "Have", "An", "They", "Which", "Der", "Die", "Das", "Und", "Den", "Von", "Zu", "Mit", "Sich", "Des", "Auf",
    "Ist", "Im", "Dem", "Nicht", "Ein", "Eine", "Als", "Auch", "Es", "Le", "La", "Les", "Et", "En", "Un", "Une", "Du", "Que", "Qui",
    "Dans", "Est", "Pour", "Sur", "Pas", "Au", "El", "Los", "Las", "De", "Se", "Del", "Por", "Con", "Una", "Su", "Para", "Al", "Lo",
    "Como", "License", "Public", "Version", "Copyright", "University", "Street", "Monday", "January", "Read", "Home", "About",
]
#: Words that speak for personal data when they stand before a candidate, and for something else (fixed values).
FOR = r"(?i)\b(?:tel|phone|telefon|téléphone|teléfono|call|mobile|fax|e-?mail|contact|card|visa|karte|carte|tarjeta|ip|address|adresse|name|nombre|nom|ssn|passport|iban|account|konto|born|signed)\b[^\p{L}]{0,12}\z"
AGAINST = r"(?i)(?:\b(?:token|sha|hash|version|isbn|issue|page|seite|pp|vol|chapter|figure|table|year|row|order|no|id)\b[^\p{L}]{0,6}|[$€£#=]\x20?)\z"
SECRET_FOR = r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|key|apikey|auth|bearer|credentials?)\b[^\p{L}]{0,8}\z"
SECRET_AGAINST = r"(?i)\b(?:sha1?|sha256|md5|commit|hash|checksum|digest|etag|revision|file|path|url)\b[^\p{L}]{0,8}\z"
SENTENCE_START = r"(?:\A|[.!?…:]|\n)[\s\"'“«]{0,3}\z"
UNITS = r"(?i)\A\x20?(?:%|km|kg|cm|mm|mb|gb|eur|usd|euro|dollars?|years?|percent|€|\$)"
CONTACT = r"(?i)\A[)\]]?[,;]?\x20?(?:phone|tel|ssn|e-?mail|mail|born|mobile|home|work|cell|fax|now)\b"
LABELERS = ["format", "gazetteer", "before", "after", "shape"]
YES, NO, SILENT = 1, 0, 2
#: A candidate beyond the base kinds is taken from this probability on.
ACCEPT = 0.9
ROUNDS = 25
CONTEXT = 40


def _found(kind: str) -> Column:
    """The pattern's matches with their code point borders: array<struct<s, e, m>>. Matches and the pieces between them add up to the text."""
    pattern = PATTERNS[kind]
    m = F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))
    between = F.split("__t", pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(m)).alias("p"), m.alias("m"))
    shape = "array<struct<s:int,e:int,m:string>>"
    steps = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("s"), (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    need = F.instr("__t", "@") > 0 if kind == "email" else F.col("__t").rlike(NEEDS[kind])
    return F.when(need, steps).otherwise(F.array().cast(shape))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise((F.substring(d, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(d, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The check that a match of a base kind has to pass."""
    if kind == "ip":
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, r"\A0+(?=[0-9])", "")), lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(YES))
    return (out.when(no, F.lit(NO)) if no is not None else out).otherwise(F.lit(SILENT))


def _format(kind: str, m: Column, d: Column) -> Column:
    """The labeler of full formats: stricter than the patterns that find candidates. A bare hexadecimal token may be a digest as well as a key, so its format tells nothing."""
    n = F.length(d)
    return {
        "email": lambda: _vote(m.rlike(r"\A[A-Za-z0-9_+-][A-Za-z0-9._%+-]{0,63}@[^@]*\.[A-Za-z]{2,24}\z"), F.lit(True)),
        "ip": lambda: _vote(~m.rlike(r"(?:\A|\.)0[0-9]"), F.lit(True)),
        "card": lambda: _vote(m.rlike(r"\A(?:[0-9]{13,19}|[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}\x20[0-9]{6}\x20[0-9]{5})\z")),
        "phone": lambda: _vote(n >= 10, m.rlike(r"\.[0-9]\.|--|\x20\x20")),
        "id": lambda: _vote(m.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), (n < 7) | (n >= 12) | m.rlike(r"[./]")),
        "secret": lambda: _vote(m.rlike(r"\A(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]+)\z"), m.rlike(r"/[^/]*/|\A[a-z]+(?:-[a-z0-9]+)+\z")),
        "name": lambda: _vote(m.rlike(rf"\A{TITLE}\.?\x20")),
    }[kind]()


def _gazetteer(kind: str, m: Column) -> Column:
    """The labeler of lists: domains, address blocks, issuers, country codes, given names and common words."""
    return {
        "email": lambda: _vote(m.rlike(r"\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|io)\z")),
        "ip": lambda: _vote(~m.rlike(r"\A0*(?:0|10|127|255)\.|\A192\.168\."), F.lit(True)),
        "card": lambda: _vote(m.rlike(r"\A(?:4|5[1-5]|2[2-7]|3[47]|35|6)"), F.lit(True)),
        "phone": lambda: _vote(m.rlike(r"\A\+(?:1|33|34|44|49)")),
        "id": lambda: _vote(m.rlike(r"\A(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\z"), m.rlike(r"\A(?:1[5-9]|20)[0-9]{2}(?:[./-]|\z)")),
        "secret": lambda: F.lit(SILENT),
        "name": lambda: _vote(m.rlike(rf"(?:\A|\x20)(?:{'|'.join(GIVEN)})(?:\x20|\z)"), m.rlike(rf"(?:\A|\x20)(?:{'|'.join(COMMON)})(?:\x20|\z)")),
    }[kind]()


def _votes(kind: str, x: Column) -> Column:
    """Votes of the five labelers on a candidate, and its length class."""
    m, d = x["m"], _digits(x["m"])
    start = F.greatest(x["s"] - CONTEXT, F.lit(0))
    left = F.substring(F.col("__t"), start + 1, x["s"] - start)
    right = F.substring(F.col("__t"), x["e"] + 1, F.lit(12))
    if kind == "secret":
        before = _vote(left.rlike(SECRET_FOR), left.rlike(SECRET_AGAINST))
        after = _vote(right.rlike(r"\A[\"'`]"))
        shape = _vote(5 * F.length(d) >= F.length(m), F.lit(True))
    elif kind == "name":
        before = _vote(left.rlike(FOR), left.rlike(SENTENCE_START))
        after = _vote(right.rlike(CONTACT), right.rlike(r"\A\x20\p{Lu}"))
        shape = _vote(F.lit(False), m.rlike(r"\A(\p{L}+)\x20\1\z") | (F.length(m) > 40))
    else:
        before = _vote(left.rlike(FOR), left.rlike(AGAINST))
        after = _vote(right.rlike(CONTACT), right.rlike(UNITS))
        if kind == "email":
            shape = _vote(F.length(m) <= 64, F.lit(True))
        else:
            same = d.rlike(r"\A([0-9])\1+\z")
            shape = _vote(F.length(d).between(5 if kind == "ip" else 7, 19) & ~same, same | (F.length(d) < 7))
    return F.struct(
        F.array(_format(kind, m, d), _gazetteer(kind, m), before, after, shape).alias("v"),
        F.least(F.floor(F.length(m) / 8), F.lit(3)).cast("int").alias("n"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, extra``: arrays of candidates with kind, borders, votes and length class; extra ones overlap no base span."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    for kind in KINDS:
        df = once(df, **{f"__{kind}": _found(kind)})

    def valid(k: str) -> Column:
        return F.filter(f"__{k}", lambda x: _valid(k, x["m"]))

    def told(k: str) -> Column:
        one = lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e"), _votes(k, x).alias("w"))
        return F.transform(valid(k) if k in BASE else f"__{k}", one)

    df = once(df, base=F.concat(*[told(k) for k in BASE]), more=F.concat(*[told(k) for k in KINDS[4:]]))
    clear = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return df.select("doc_id", "base", clear.alias("extra"))


Cell = tuple[int, tuple[int, ...]]


def reliabilities(cells: dict[Cell, int], rounds: int = ROUNDS) -> dict[Cell, float]:
    """Posterior of each (kind, vote pattern) by expectation maximisation, under labelers that are independent given the truth.

    Labelers have one table for all kinds, true spans a share of their own in
    each kind. It starts from the share of yes among the votes cast, with a
    vote pattern without any at a quarter; every table of probabilities is
    smoothed with one pseudo-count, so that nothing is 0.
    """
    post = {c: (sum(v == YES for v in c[1]) + 0.5) / (sum(v != SILENT for v in c[1]) + 2 - (YES in c[1])) for c in cells}
    for _ in range(rounds):
        weight = {y: 0.0 for y in (0, 1)}
        share = {(k, y): 1.0 for k in range(len(KINDS)) for y in (0, 1)}
        table = [[[1.0] * 3 for _ in LABELERS] for _ in range(2)]
        for c, n in cells.items():
            for y in (0, 1):
                own = n * (post[c] if y else 1 - post[c])
                weight[y] += own
                share[c[0], y] += own
                for k, v in enumerate(c[1]):
                    table[y][k][v] += own
        for c in cells:
            logs = [math.log(share[c[0], y]) + sum(math.log(table[y][k][v] / (weight[y] + 3)) for k, v in enumerate(c[1])) for y in (0, 1)]
            post[c] = 1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1]))))
    return post


def _features(kind: int, votes: tuple[int, ...], length: int) -> list[int]:
    """Active features: the bias, each vote that was cast, the length class, the kind."""
    base = 1 + 2 * len(LABELERS)
    return [0, *(1 + 2 * k + v for k, v in enumerate(votes) if v != SILENT), base + length, base + 4 + kind]


def train(cells: dict[tuple[int, tuple[int, ...], int], int], steps: int = 300) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, by gradient steps over the counted cells.

    Each kind weighs the same in all, so that the many pairs of capitalised
    words don't drown the few numbers.
    """
    merged: dict[Cell, int] = {}
    size: dict[int, int] = {}
    for (kind, votes, _), n in cells.items():
        merged[kind, votes] = merged.get((kind, votes), 0) + n
        size[kind] = size.get(kind, 0) + n
    post = reliabilities(merged) if merged else {}
    weights = [0.0] * (1 + 2 * len(LABELERS) + 4 + len(KINDS))
    for _ in range(steps):
        gradient = [1e-3 * w for w in weights]
        for (kind, votes, length), n in cells.items():
            active = _features(kind, votes, length)
            error = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(weights[f] for f in active))))) - post[kind, votes]
            for f in active:
                gradient[f] += error * n / size[kind] / len(size)
        weights = [w - 2.0 * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def _score(x: Column, weights: list[float]) -> Column:
    out = F.lit(weights[0])
    for k in range(len(LABELERS)):
        out = out + F.when(x["w"]["v"][k] == YES, F.lit(weights[2 + 2 * k])).when(x["w"]["v"][k] == NO, F.lit(weights[1 + 2 * k])).otherwise(F.lit(0.0))
    base = 1 + 2 * len(LABELERS)
    return out + F.get(F.array(*map(F.lit, weights[base : base + 4])), x["w"]["n"]) + F.get(F.array(*map(F.lit, weights[base + 4 :])), x["k"])


def find_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, base, spans``: sorted arrays of struct<s, k, e>, k a number of KINDS.

    A null text is empty and has no spans. Rows are independent but for the
    shared model: repeated rows get the same spans; null doc_ids stay; an
    empty table stays empty; other columns are ignored. Spans of different
    kinds may overlap; spans of one kind don't.
    """
    found = Scratch(docs.sparkSession).keep(candidates(docs))
    every = found.select(F.explode(F.concat("base", "extra")).alias("x"))
    cells = every.groupBy(F.col("x.k").alias("k"), F.col("x.w.v").alias("v"), F.col("x.w.n").alias("n")).agg(F.count("*").alias("c")).collect()
    weights = train({(r["k"], tuple(r["v"]), r["n"]): r["c"] for r in sorted(cells, key=lambda r: (r["k"], r["v"], r["n"]))})
    limit = math.log(accept / (1 - accept))
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    more = F.transform(F.filter("extra", lambda x: _score(x, weights) >= limit), plain)
    base = F.transform("base", plain)
    return found.select("doc_id", F.sort_array(base).alias("base"), F.sort_array(F.concat(base, more)).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = find_spans(docs)

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")

    other = (F.size("spans") - F.size("base")).cast("long").alias("n_other")
    return out.select("doc_id", *map(count, BASE), other, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
