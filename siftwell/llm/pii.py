r"""Personal data by weak supervision, with DataFrame expressions only.

Candidates are the matches of the base patterns and those of looser ones
(obfuscated addresses, national phone numbers, IPv6, keys and tokens).  Four labelers vote on
each candidate, for (2), against (0) or abstaining (1): its format, a gazetteer, the words
before it and its surroundings.  Counts of the vote patterns, of which there
are a fixed number, come to the driver; expectation-maximisation estimates
there how reliable each labeler is for each kind, without labels.  The
posteriors train a logistic span classifier on votes and shape, and its
weights are applied as a column expression.  Base spans always stay; other
candidates stay where the classifier is sure.

Patterns are written so that no text makes them backtrack over a run or recurse
for each repetition: a match can only start where its run does, and
repetitions are possessive.  They match exactly what the plain forms match.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, text_of

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")  # the last one has added spans only
CONTEXT = 40  # characters before a candidate that its context labeler reads: room for the few words that introduce such data
SURE = 0.5

_LOCAL = "A-Za-z0-9._%+-"
#: Patterns: kind, pattern, and texts of which a match in lower case has one at least.
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
LOOSE = {
    "email": (rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++", "(at [at"),
    "ip": (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", ":"),
    "phone": (r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", ""),
    "secret": (r"(?:(?i:token|secret|password|passwd|credential|api_?-?key|access_?-?key|private_?-?key)[\"']?\x20?[:=]\x20?[\"']?|(?<![A-Za-z0-9])(?=AKIA|gh[ops]_|sk-|xox[bp]-))[A-Za-z0-9+/_-]{16,}+", "token secret passw credential key akia ghp_ gho_ ghs_ sk- xoxb- xoxp-"),
}
SECRET_VALUE = "[A-Za-z0-9+/_-]++$"  # the end of a match that is the secret itself
#: Gazetteers: top-level domains, first digits of card numbers, calling codes.
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|ch|at|be|pl|pt|se|us|ca|mx|br|ar|au|jp|cn|in"
WORDS = {
    "email": (r"(?i)mail|contact|kontakt|correo|courriel|write|reach", r"(?i)git@|ssh"),
    "ip": (r"(?i)\bip\b|address|server|host|client|adresse", r"(?i)version|release|section|chapter|build"),
    "card": (r"(?i)card|visa|master|karte|carte|tarjeta|payment|credit", r"(?i)isbn|order|serial|tracking|invoice"),
    "phone": (r"(?i)phone|tel|call|mobile|cell|fax|telefon|tel[ée]fono", r"(?i)isbn|part|model|order"),
    "secret": (r"(?i)auth|bearer|secret|login|api|clave|schl[üu]ssel|\bcl[ée]\b", r"(?i)example|sample|placeholder|checksum|commit"),
}
LABELERS = ("format", "gazetteer", "context", "surroundings")


def _matches(text: Column, low: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """The matches of a pattern and the texts between them; texts that can't have one, by their lower case, are not searched."""
    can = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in needs.split())) if needs else text.rlike("[0-9]")
    found = F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return found, F.when(can, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _placed(found: Column, between: Column) -> Column:
    """array<struct<start, match, before, after>> in code points, from the lengths of what lies between matches."""
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.char_length(b).alias("lead"), F.char_length(m).alias("size")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(steps, zero, lambda s, x: F.struct((s["at"] + x["lead"] + x["size"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["lead"])).alias("starts")), lambda s: s["starts"])
    return F.transform(
        found,
        lambda m, i: F.struct(F.get(starts, i).alias("start"), m.alias("match"), F.right(F.get(between, i), F.lit(CONTEXT)).alias("before"), F.substring(F.get(between, i + 1), 1, 1).alias("after")),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def worth(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """What a base match must fulfil beyond its pattern."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        count = F.char_length(_digits(match))
        return F.when(count.between(16, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(8, 15)
    return F.lit(True)


def _known(kind: str, match: Column) -> Column:
    """The gazetteer's vote, 2 or 0."""
    if kind == "email":
        yes = match.rlike(rf"(?i)(?:\.|[\])])\x20?(?:{DOMAINS})$")
    elif kind == "ip":
        yes = ~match.rlike(r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")
    elif kind == "card":
        yes = match.rlike("^[2-6]")
    elif kind == "secret":  # issuers' prefixes, digests in hex, and long strings of mixed signs
        yes = match.rlike(r"(?:AKIA|gh[ops]_|sk-|xox[bp]-)|(?:^|[^0-9A-Za-z])[0-9a-f]{32,}$") | (match.rlike(r"[0-9][^0-9]*[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z][^\"':=]*$"))
    else:
        yes = match.rlike(r"^\+?\(?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])") & ~match.rlike(r"^\+?([0-9])(?:[^0-9]*\1)+$")
    return F.when(yes, 2).otherwise(0)


def _votes(kind: str, base: bool, c: Column) -> Column:
    yes, no = WORDS[kind]
    context = F.when(c["before"].rlike(no), 0).when(c["before"].rlike(yes), 2).otherwise(1)
    beside = c["before"].rlike(r"[A-Za-z0-9]$") | c["after"].rlike(r"^[A-Za-z0-9]")
    form = F.when(c["match"].rlike(r"[0-9][A-Za-z0-9+/_-]*$"), 2).otherwise(0) if kind == "secret" else F.lit(2 if base else 1)
    return F.array(form, _known(kind, c["match"]), context, F.when(beside, 0).otherwise(2))


def _valid_match(kind: str, c: Column) -> Column:
    return valid(kind, c["match"])


def _span(kind: str, base: bool, c: Column) -> Column:
    size = F.char_length(c["match"])
    held = F.char_length(F.regexp_extract(c["match"], SECRET_VALUE, 0)) if kind == "secret" else size
    shape = F.when(size < 12, 0).when(size < 16, 1).when(size < 24, 2).otherwise(3)
    return F.struct(F.lit(ALL_KINDS.index(kind)).alias("kind"), (c["start"] + size - held).alias("start"), (c["start"] + size).alias("end"), F.lit(base).alias("base"), _votes(kind, base, c).alias("votes"), shape.alias("shape"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end, base, votes, shape>>: kind counts from 0, shape is 0 to 3 by length."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("low", F.lower("text"))
    sets = [(k, True, *BASE[k]) for k in KINDS] + [(k, False, *LOOSE[k]) for k in ALL_KINDS if k in LOOSE]
    found = []
    for n, (_, _, pattern, needs) in enumerate(sets):
        a, b = _matches(text, F.col("low"), pattern, needs)
        found += [a.alias(f"m{n}"), b.alias(f"b{n}")]
    rows = rows.select("doc_id", *found)
    rows = rows.select("doc_id", *(_placed(F.col(f"m{n}"), F.col(f"b{n}")).alias(f"c{n}") for n in range(len(sets))))
    spans = []
    for n, (kind, base, _, _) in enumerate(sets):
        held = F.filter(f"c{n}", partial(_valid_match, kind)) if base else F.col(f"c{n}")
        spans.append(F.transform(held, partial(_span, kind, base)))
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation over vote patterns of one kind: the share of true candidates, and each labeler's chances of a vote (0, 1, 2) by the truth."""
    labelers = len(next(iter(counts)))
    share, chance = 0.7, [[[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]] for _ in range(labelers)]
    for _ in range(rounds):
        seen = [[[1.0, 1.0, 0.5], [0.5, 1.0, 1.0]] for _ in range(labelers)]  # a prior: labelers are better than chance
        true, total = 1.0, 2.0
        for votes, n in counts.items():
            p = posterior(votes, share, chance)
            true, total = true + n * p, total + n
            for j, v in enumerate(votes):
                seen[j][1][v] += n * p
                seen[j][0][v] += n * (1 - p)
        share = true / total
        chance = [[[x / sum(row) for x in row] for row in labeler] for labeler in seen]
    return share, chance


def posterior(votes: tuple[int, ...], share: float, chance: list[list[list[float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(chance[j][1][v] / chance[j][0][v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(patterns: list[tuple[int, bool, tuple[int, ...], int, int]], rounds: int = 300) -> dict[str, float]:
    """Weights of the span classifier from counted patterns (kind, base, votes, shape, n); features are k (kind), v (kind, labeler, vote) and s (kind, shape)."""
    by_kind: dict[int, dict[tuple[int, ...], float]] = defaultdict(lambda: defaultdict(float))
    for kind, _, votes, _, n in patterns:
        by_kind[kind][votes] += n
    model = {kind: reliabilities(counts) for kind, counts in by_kind.items()}
    rows = [(features(kind, votes, shape), posterior(votes, *model[kind]), n) for kind, _, votes, shape, n in patterns]
    weights: dict[str, float] = {f: 0.0 for names, _, _ in rows for f in names}
    total = sum(n for _, _, n in rows) or 1
    for _ in range(rounds):
        gradient: dict[str, float] = defaultdict(float)
        for names, target, n in rows:
            p = 1 / (1 + math.exp(-sum(weights[f] for f in names)))
            for f in names:
                gradient[f] += n / total * (target - p)
        for f in weights:
            weights[f] += 2.0 * gradient[f] - 1e-4 * weights[f]
    return weights


def features(kind: int, votes: tuple[int, ...], shape: int) -> list[str]:
    return [f"k{kind}", f"s{kind}{shape}", *(f"v{kind}{j}{v}" for j, v in enumerate(votes))]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, array<struct<kind, start, end, base, score>> ordered by kind and start.

    Starts and ends count code points, end exclusive.  All base spans are
    there; added spans don't overlap a base span of any kind.  A null or empty
    text has no spans; a null id is carried, and rows that repeat an id are
    searched each.  Other columns are not read; an empty table gives an empty
    result.
    """
    found = cut(candidates(docs, id_col, text_col))
    s = F.col("s")
    patterns = found.select(F.explode("spans").alias("s")).groupBy(s["kind"].alias("kind"), s["base"].alias("base"), s["votes"].alias("votes"), s["shape"].alias("shape")).count()
    counted = [(r[0], r[1], tuple(r[2]), r[3], r[4]) for r in patterns.collect()]  # at most 5 * 2 * 3 ** 4 * 4 rows
    weights = train(counted)
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.lit(None).cast("map<string,double>")

    def score(x: Column) -> Column:
        kind = x["kind"].cast("string")
        names = F.concat(F.array(F.concat(F.lit("k"), kind), F.concat(F.lit("s"), kind, x["shape"].cast("string"))), F.transform(x["votes"], lambda v, j: F.concat(F.lit("v"), kind, j.cast("string"), v.cast("string"))))
        return 1 / (1 + F.exp(-F.aggregate(names, F.lit(0.0), lambda a, f: a + F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == f)), F.lit(0)), F.lit(0.0)))))

    bases = F.filter("spans", lambda x: x["base"])
    others = F.filter("spans", lambda x: ~x["base"])
    others = F.filter(others, lambda x: ~F.exists(bases, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & (score(x) >= sure))
    whole = F.array_sort(F.concat(bases, others))
    named = F.transform(whole, lambda x: F.struct(F.get(F.array(*map(F.lit, ALL_KINDS)), x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), score(x).alias("score")))
    return found.select("doc_id", named.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _base_of(kind: str, x: Column) -> Column:
    return x["base"] & (x["kind"] == kind)


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter("spans", partial(_base_of, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    secrets = F.size(F.filter("spans", lambda x: x["kind"] == "secret")).cast("long")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), secrets.alias("n_secret"))
