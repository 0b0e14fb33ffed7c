"""Personal data by weak supervision, in DataFrame functions only.

Patterns find the certain spans (``base``) and further candidates: written-out
addresses, telephone numbers without a plus, card-like numbers, cards beside
other numbers, long IP addresses. Labelers (pattern, check, gazetteer, context before, context after)
vote for, against or not at all on every candidate. Expectation-maximisation
estimates how reliable each labeler is for each kind from the counts of vote
patterns (at most 4 * 3^5, so the driver gets a table of bounded size), and a
logistic classifier is trained on its probabilities. It decides on the spans
that are added; base spans stay in any case.

Positions are code points, ends are exclusive. Matches are found from the left
without overlap, by cutting the text at them and adding up lengths.

Defined results: null text counts as empty and has no spans. Repeated rows get
equal results. With no candidates nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5

# Possessive forms of the patterns: the same matches without backtracking. A
# match may begin at the start of a run or where the last match ended, never
# later in a run, because what follows the run decides for all of it.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])[0-9](?:[ -]?+[0-9]){12,}+"
_GROUPED_CARD = r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_AT, _DOT = r"(?:\[at\]|\(at\)|\{at\})", r"(?:\.|\[dot\]|\(dot\)|\{dot\})"
_SPELLED = rf"(?i)(?<!{_LOCAL}){_LOCAL}++ ?{_AT} ?[a-z0-9-]++(?: ?{_DOT} ?[a-z0-9-]++)++"
_LOCAL_PHONE = r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
_LONG_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"

# Gazetteers: frequent top-level domains, calling codes, and leading digits of cards.
_DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|ch|at|it|nl|us|ca|au|jp|cn|in|br|ru"
_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"

_BEFORE = {
    "email": (r"(?i)(?:e-?mail|mail|contact|write|reach|courriel|correo)\W*\w*\W*$", r"(?i)(?:example of|syntax|regex)\W*$"),
    "ip": (r"(?i)(?:\bip\b|address|host|server|login|from|client)\W*$", r"(?i)(?:version|release|section|chapter|\bv)\W*$"),
    "card": (r"(?i)(?:card|visa|master|credit|debit|payment|paid)\W*\w*\W*$", r"(?i)(?:isbn|order|invoice|serial|\bid|\bno|number|tracking)\W*$"),
    "phone": (r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|telefon)\W*\w*\W*$", r"(?i)(?:order|invoice|isbn|serial|part|\bid)\W*$"),
}


def found(text: Column, pattern: str, guard: Column) -> Column:
    """Matches of ``pattern`` as array of (s, e, m), where ``guard`` holds."""
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("g"), m.alias("m"))
    )
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(held: Column, part: Column) -> Column:
        start = held["at"] + F.length(part["g"])
        end = start + F.length(part["m"])
        span = F.struct(start.alias("s"), end.alias("e"), part["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(span)).alias("out"))

    matched = F.filter(parts, lambda p: p["m"].isNotNull())
    spans = F.aggregate(matched, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda held: held["out"])
    return F.when(guard, spans).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), "(?!$)(?<=.)"),
        lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(m: Column) -> Column:
    return F.forall(
        F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.regexp_replace(p, "^0+", "0").cast("bigint") <= 255)
    )


def _holds(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern is a base span."""
    size = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": _small_parts(m),
        "card": (size >= 13) & (size <= 19) & luhn(_digits(m)),
        "phone": (size >= 9) & (size <= 15),
    }[kind]


def _kept(column: str, kind: str, holds: bool = True) -> Column:
    return F.filter(column, lambda x: _holds(kind, x["m"]) == F.lit(holds))


def _clear_of(spans: Column, others: list[Column]) -> Column:
    """The spans that touch none of the others."""
    every = F.concat(*others)
    return F.filter(spans, lambda x: ~F.exists(every, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))


def _marked(docs: DataFrame) -> DataFrame:
    """Add arrays ``_base_<kind>`` and ``_more_<kind>`` of (s, e, m)."""
    text = F.col("_text")
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    matched = {
        "email": found(text, _EMAIL, at),
        "ip": found(text, _IP, digit & text.rlike(r"[0-9]\.[0-9]")),
        "card": found(text, _CARD, digit & text.rlike(_CARD)),
        "phone": found(text, _PHONE, F.contains(text, F.lit("+"))),
    }
    more = {
        "email": found(text, _SPELLED, text.rlike(r"(?i)[\[({]at[\])}]")),
        "ip": found(text, _LONG_IP, F.contains(text, F.lit(":")) & text.rlike(_LONG_IP)),
        "card": found(text, _GROUPED_CARD, digit & text.rlike(_GROUPED_CARD)),
        "phone": found(text, _LOCAL_PHONE, digit & text.rlike(r"[0-9]{3}[ .-][0-9]{4}")),
    }
    docs = docs.withColumns({f"_all_{k}": v for k, v in matched.items()} | {f"_found_{k}": v for k, v in more.items()})
    docs = docs.withColumns({f"_base_{k}": _kept(f"_all_{k}", k) for k in KINDS})
    failed = {k: _kept(f"_all_{k}", k, False) for k in ("ip", "card")}
    base = [F.col(f"_base_{k}") for k in KINDS]
    wide = {
        "email": F.col("_found_email"),
        "ip": F.concat(failed["ip"], "_found_ip"),
        # A card beside another number is part of a longer match that fails.
        "card": F.concat("_found_card", _clear_of(failed["card"], [F.col("_found_card")])),
        "phone": F.col("_found_phone"),
    }
    # Candidates of different kinds that overlap: the earlier kind has the span.
    for i, kind in enumerate(KINDS):
        docs = docs.withColumn(f"_more_{kind}", _clear_of(wide[kind], base + [F.col(f"_more_{k}") for k in KINDS[:i]]))
    return docs.drop(*[f"_all_{k}" for k in KINDS], *[f"_found_{k}" for k in more])


def _votes(kind: str, x: Column, is_base: bool) -> list[Column]:
    """One vote per labeler: 1, -1 or 0."""
    text, m = F.col("_text"), x["m"]
    digits = _digits(m)
    before = F.substring(text, F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40)))
    after = F.substring(text, x["e"] + 1, F.lit(2))

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out.when(no, -1) if no is not None else out).otherwise(0)

    pattern = F.lit(1) if is_base else {"card": vote(m.rlike(f"^{_GROUPED_CARD}$"), ~m.rlike(f"^{_GROUPED_CARD}$")), "ip": vote(m.rlike(":"), ~m.rlike(":"))}.get(kind, F.lit(0))
    check = {
        "email": vote(m.rlike(rf"(?i)[a-z0-9]{_LOCAL}*\W"), m.rlike(r"\.\.|^[.-]")),
        "ip": vote(m.rlike(":") | (_small_parts(m) & ~m.rlike("^(?:0|127)[.]")), ~m.rlike(":") & ~_small_parts(m)),
        "card": vote(_holds("card", m), ~_holds("card", m)),
        "phone": vote((F.length(digits) >= 10) & (F.length(digits) <= 13), F.length(digits) < 7),
    }[kind]
    gazetteer = {
        "email": vote(m.rlike(rf"(?i)(?:\.|dot[\])}}]) ?(?:{_DOMAINS})$")),
        "ip": vote(m.rlike(r"^(?:10|172|192)\.") | m.rlike(":")),
        "card": vote(m.rlike(f"^(?:{_ISSUERS})"), m.rlike("^0")),
        "phone": vote(m.rlike(rf"^\+ ?(?:{_CODES})\b|^\+(?:{_CODES})") | m.rlike(r"^\([0-9]{3}\)"), m.rlike("^000")),
    }[kind]
    yes, no = _BEFORE[kind]
    return [pattern, check, gazetteer, vote(before.rlike(yes), before.rlike(no)), vote(after.rlike(r"^[ ,;.)!?\n\"]|^$"), after.rlike("^[0-9A-Za-z%/=_]"))]


def _voted(kind: str, spans: Column, is_base: bool) -> Column:
    def row(x: Column) -> Column:
        votes = [v.cast("int").alias(f"v{i}") for i, v in enumerate(_votes(kind, x, is_base))]
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), *votes)

    return F.transform(spans, row)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(kind, v0 .. v4, n): how many candidates have each vote pattern."""
    marked = _marked(docs.select(F.coalesce("text", F.lit("")).alias("_text")))
    rows = F.concat(*[_voted(k, F.col(f"_{part}_{k}"), part == "base") for k in KINDS for part in ("base", "more")])
    votes = [f"v{i}" for i in range(LABELERS)]
    return marked.select(F.explode(rows).alias("x")).select("x.kind", *[f"x.{v}" for v in votes]).groupBy("kind", *votes).agg(F.count(F.lit(1)).alias("n"))


def reliabilities(rows: list[tuple[tuple[int, ...], int]], steps: int = 30) -> tuple[float, list[dict], list[float]]:
    """Expectation-maximisation over vote patterns of one kind.

    A labeler that does not vote says nothing. Returns the share of true spans,
    per labeler and class the chances of its votes, and each pattern's probability of being personal data.
    """
    total = sum(n for _, n in rows)
    chance = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in rows]
    share, tables = 0.5, []
    for _ in range(steps):
        share = (sum(p * n for p, (_, n) in zip(chance, rows)) + 1) / (total + 2)
        tables = []
        for i in range(LABELERS):
            # Prior votes say that labelers are better than chance.
            held = {(1, 1): 8.0, (1, -1): 1.0, (0, 1): 1.0, (0, -1): 8.0}
            for p, (votes, n) in zip(chance, rows):
                if votes[i]:
                    held[1, votes[i]] += p * n
                    held[0, votes[i]] += (1 - p) * n
            tables.append({(c, v): x / (held[c, 1] + held[c, -1]) for (c, v), x in held.items()})
        chance = []
        for votes, _ in rows:
            yes = math.log(share) + sum(math.log(t[1, v]) for t, v in zip(tables, votes) if v)
            no = math.log(1 - share) + sum(math.log(t[0, v]) for t, v in zip(tables, votes) if v)
            chance.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
    return share, tables, chance


def fit(docs: DataFrame, passes: int = 400, rate: float = 0.5) -> dict[str, tuple[float, list[dict[int, float]]]]:
    """Bias and a weight per labeler and vote, of the classifier of each kind.

    A logistic regression of the patterns' probabilities on their votes,
    weighted by the damped number of spans.
    """
    by_kind: dict[str, list] = {}
    votes = [f"v{i}" for i in range(LABELERS)]
    for r in vote_patterns(docs).collect():
        by_kind.setdefault(r["kind"], []).append((tuple(r[v] for v in votes), r["n"]))
    models = {}
    for kind, rows in by_kind.items():
        rows.sort()
        chance = reliabilities(rows)[2]
        weight = [1 + math.log(n) for _, n in rows]
        bias, weights, total = 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(LABELERS)], sum(weight)
        for _ in range(passes):
            errors = []
            for (v, _), target, w in zip(rows, chance, weight):
                raw = bias + sum(t[x] for t, x in zip(weights, v))
                errors.append((1 / (1 + math.exp(-raw)) - target) * w / total)
            bias -= rate * sum(errors)
            for i, t in enumerate(weights):
                for x in (-1, 1):
                    t[x] -= rate * (sum(e for e, (v, _) in zip(errors, rows) if v[i] == x) + 1e-3 * t[x])
        models[kind] = (bias, weights)
    return models


def _likely(bias: float, weights: list[dict[int, float]], limit: float) -> Callable[[Column], Column]:
    def decide(x: Column) -> Column:
        parts = [F.when(x[f"v{i}"] == 1, t[1]).when(x[f"v{i}"] == -1, t[-1]).otherwise(t[0]) for i, t in enumerate(weights)]
        return reduce(Column.__add__, parts, F.lit(bias)) >= limit

    return decide


def _spans(docs: DataFrame, threshold: float) -> DataFrame:
    """(_row, base_<kind>, all_<kind>): whole rows as structs, so that no column of ``docs`` clashes, and their spans."""
    models = fit(docs)
    marked = _marked(docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text")))
    limit = math.log(threshold / (1 - threshold))

    def narrow(column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    for kind in KINDS:
        base = narrow(F.col(f"_base_{kind}"))
        marked = marked.withColumn(f"base_{kind}", base)
        if kind not in models:
            marked = marked.withColumn(f"all_{kind}", base)
            continue
        added = narrow(F.filter(_voted(kind, F.col(f"_more_{kind}"), False), _likely(*models[kind], limit)))
        marked = marked.withColumn(f"all_{kind}", F.array_sort(F.concat(base, added)))
    return marked.drop("_text", *[f"_{part}_{k}" for k in KINDS for part in ("base", "more")])


def _of_row(name: str) -> Column:
    return F.col("_row").getField(name).alias(name)


def spans(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Add ``base_<kind>`` and ``all_<kind>``: arrays of (s, e) in text order, for each kind.

    Columns of ``docs`` that have these names are replaced.
    """
    made = [f"{part}_{k}" for k in KINDS for part in ("base", "all")]
    kept = [_of_row(c) for c in docs.columns if c.lower() not in made]
    return _spans(docs, threshold).select(*kept, *made)


def _listed(part: str) -> Column:
    def name(kind: str) -> Column:
        return F.transform(f"{part}_{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    named = [name(k) for k in KINDS]
    return F.concat_ws(",", F.concat(*named))


def digests(marked: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    return marked.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
        _listed("all").alias("spans"),
    )


def redacted(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in angle brackets."""
    text = F.col("_row").getField("text")

    def tagged(kind: str) -> Column:
        return F.transform(f"all_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("tag")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        gap = F.substring(text, held["at"] + 1, x["s"] - held["at"])
        out = F.when(x["s"] >= held["at"], F.concat(held["out"], F.array(gap, x["tag"]))).otherwise(held["out"])
        return F.struct(F.greatest(held["at"], x["e"]).alias("at"), out.alias("out"))

    def finish(held: Column) -> Column:
        return F.concat(F.array_join(held["out"], ""), F.substring(text, held["at"] + 1, F.length(text)))

    every = F.array_sort(F.concat(*[tagged(k) for k in KINDS]))
    cut = F.when(F.size(every) > 0, F.aggregate(every, start, step, finish)).otherwise(text)
    return _spans(docs, threshold).select(*[cut.alias(c) if c == "text" else _of_row(c) for c in docs.columns])
