"""Personal data: base patterns, and further spans by weak supervision.

Base spans come from strict patterns and always stay. Wider patterns propose
further spans. Labelers of three sorts (regex, gazetteer, context) vote on every
span; expectation-maximisation estimates how reliable each labeler is for each
kind, from how often votes coincide; the posteriors train a classifier, the votes'
log-odds plus the mean log-odds of a span's shape and neighbours, which decides on
the further ones. DataFrame functions throughout.

Texts are read once, in the tasks that hold them; only spans are shuffled, and
only counts of vote patterns and of features, both of bounded number, meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 25
CONTEXT = 32

# Stands for a separator between two characters of a span while patterns look at
# the text, so that they need no repeated groups; a text's own is set aside.
JOIN, ASIDE = "", ""

# The base patterns, with separators joined.
_LOCAL = rf"A-Za-z0-9._%+\-{JOIN}"
_SITE = r"A-Za-z0-9\-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_SITE}]++{JOIN}[{_SITE}{JOIN}]*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{JOIN}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
JOINED = {
    "email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
    "card": r"(?<=[0-9])[\x20-](?=[0-9])",
}
# Wider patterns: written-out addresses, eight-part addresses, other separators,
# numbers without a country code. Repeats are bounded.
_AT, _DOT = r"(?:@|\x20?[\[({]at[\])}]\x20?)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?)"
WIDER = {
    "email": rf"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{{1,64}}+{_AT}[A-Z0-9-]{{1,63}}(?:{_DOT}[A-Z0-9-]{{1,63}}){{1,6}}",
    "ip": r"(?i)(?<![0-9A-F:.])(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}(?![0-9A-F:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?|00[0-9]{1,3}[\x20./-]|[0-9]{2,4}[\x20./-])(?:[0-9]{2,4}[\x20./-]){1,3}[0-9]{2,4}(?![0-9A-Za-z])",
}
# Texts that cannot hold a span of the kind are passed over.
MAY_HOLD = {
    "email": r"@|[\[({](?i:at)[\])}]",
    "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]",
    "card": r"[0-9]",
    "phone": r"[0-9]",
}
# Gazetteers.
TOP_DOMAINS = ("com org net edu gov info biz io eu uk us de fr es it nl ch at se no pl pt br mx in jp cn ru".split())
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split()
# Words near a span that speak for it, and against any.
NEAR = {
    "email": r"mail|contact|write|kontakt|correo|courriel|@",
    "ip": r"\bip\b|host|server|addr|login|ping",
    "card": r"card|visa|master|amex|credit|karte|tarjeta|carte|pay",
    "phone": r"phone|tel\b|tel\.|call|fax|mobil|cell|whatsapp|telefon",
}
AGAINST = r"version|license|licence|isbn|issn|invoice|order|article|page|token|figure|table|\bv\.?$"

_SPAN = "struct<a:int,b:int,s:string,before:string,after:string>"


# Matches of a text that are placed together: arrays grow by copying.
TOGETHER = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """All matches from left to right with offsets in code points and neighbourhoods.

    Time is in proportion to the text and its matches (up to many thousands of them).
    """
    parts = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        parts.alias("p"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))).alias("q"),
    )
    spans = f"array<{_SPAN}>"

    def step(state: Column, x: Column) -> Column:
        a = state["at"] + F.length(x["p"])
        b = a + F.length(x["m"])
        span = F.struct(
            a.alias("a"),
            b.alias("b"),
            x["m"].alias("s"),
            F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"),
            F.substring(x["q"], 1, CONTEXT).alias("after"),
        )
        return F.when(x["m"].isNull(), state).otherwise(
            F.struct(b.alias("at"), F.array_append(state["out"], span).alias("out"))
        )

    def placed(all_parts: Column) -> Column:
        def group(state: Column, g: Column) -> Column:
            start = F.struct(state["at"].alias("at"), F.array().cast(spans).alias("out"))
            some = F.slice(all_parts, g * TOGETHER + 1, F.lit(TOGETHER))
            return _once(
                F.aggregate(some, start, step),
                lambda y: F.struct(
                    y["at"].alias("at"), F.array_append(state["outs"], y["out"]).alias("outs")
                ),
            )

        groups = F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / TOGETHER).cast("int"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("outs"))
        return F.aggregate(groups, zero, group, lambda state: F.flatten(state["outs"]))

    return _once(zipped, placed)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
            (d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(
            F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        )
    n = F.length(digits(s))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(s))).otherwise(False)
    return n.between(9, 15)


def base_spans(kind: str, text: Column) -> Column:
    """Leftmost matches that do not overlap; those that fail the check are left out."""
    if kind in JOINED:
        text = F.regexp_replace(F.translate(text, JOIN, ASIDE), JOINED[kind], JOIN)
    return F.filter(_found(text, BASE[kind]), lambda x: _valid(kind, x["s"]))


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Base and further spans of every row, in one pass over the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    holds = {k: body.rlike(MAY_HOLD[k]) for k in KINDS}
    columns = {f"base_{k}": F.when(holds[k], base_spans(k, body)).otherwise(none) for k in KINDS}
    columns |= {f"more_{k}": F.when(holds[k], _found(body, WIDER[k])).otherwise(none) for k in KINDS}
    return docs.select(
        F.col(doc_id).alias("_doc"),
        F.monotonically_increasing_id().alias("_at"),
        F.xxhash64(F.col(doc_id), body).alias("_h1"),
        F.xxhash64(F.lit("text"), F.col(doc_id), body).alias("_h2"),
        *[c.alias(name) for name, c in columns.items()],
    )


def _spans(found: DataFrame) -> DataFrame:
    """One row for every span: base ones, and further ones beside all base ones."""

    def labelled(prefix: str, is_base: bool) -> list[Column]:
        def named(i: int):
            return lambda x: F.struct(F.lit(i).alias("kind"), F.lit(is_base).alias("is_base"), x.alias("x"))

        return [F.transform(f"{prefix}_{k}", named(i)) for i, k in enumerate(KINDS)]

    every = F.concat(*labelled("base", True), *labelled("more", False))
    rows = found.select("_at", "_h1", "_h2", F.explode(every).alias("y")).select(
        "_at", "_h1", "_h2", "y.kind", "y.is_base", "y.x.a", "y.x.b",
        F.translate("y.x.s", JOIN, "").alias("s"), F.col("y.x.s").alias("raw"), "y.x.before", "y.x.after",
    )
    # Base spans that start no later, and no earlier: their last end and first start.
    text = Window.partitionBy("_at")
    upto = text.orderBy(F.col("a").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = text.orderBy(F.col("a").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.when(F.col("is_base"), F.col("b"))).over(upto)
    begun = F.min(F.when(F.col("is_base"), F.col("a"))).over(back)
    beside = (F.coalesce("_ended", F.lit(0)) <= F.col("a")) & (F.coalesce("_begun", F.col("b")) >= F.col("b"))
    return (
        rows.withColumns({"_ended": ended, "_begun": begun})
        .where(F.col("is_base") | beside)
        .drop("_at", "_ended", "_begun")
    )


def _by_kind(choices: dict[str, Column]) -> Column:
    out = F.lit(None)
    for i, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == i, choices[kind]).otherwise(out)
    return F.coalesce(out, F.lit(False))


def votes() -> Column:
    """One 0 or 1 per labeler: two regexes, two gazetteers, two of context."""
    s, number = F.col("s"), digits(F.col("s"))
    n = F.length(number)
    raw = F.col("raw")
    tail = F.lower(F.regexp_extract(raw, r"([A-Za-z]+)$", 1))
    near, after = F.lower(F.col("before")), F.lower(F.col("after"))
    shape = _by_kind({
        "email": raw.rlike(r"^[A-Za-z0-9]"),
        "ip": n >= 4,
        "card": luhn(number),
        "phone": n.between(10, 13),
    })
    whole = ~F.col("before").rlike(r"[0-9A-Za-z]$") & ~F.col("after").rlike(r"^[0-9A-Za-z]")
    listed = _by_kind({
        "email": tail.isin(TOP_DOMAINS),
        "ip": F.regexp_extract(s, "^([0-9]{1,3})", 1).try_cast("int").between(1, 223),
        "card": number.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": s.rlike(r"^\+(" + "|".join(COUNTRY_CODES) + r")\b"),
    })
    written = _by_kind({
        "email": raw.rlike("@"),
        "ip": ~s.rlike(r"^[0-9]\.[0-9]\."),
        "card": n.isin(15, 16),
        "phone": s.rlike(r"^[+(]|^00"),
    })
    speaks = _by_kind({k: near.rlike(NEAR[k]) | after.rlike(NEAR[k]) for k in KINDS})
    clear = ~near.rlike(AGAINST)
    return F.array(*[c.cast("int") for c in (shape, whole, listed, written, speaks, clear)])


LABELERS = 6


def _posterior(state: Column, fired: Column) -> Column:
    """P(personal data | votes) under the reliabilities in ``state``."""
    odds = F.aggregate(
        F.arrays_zip(fired.alias("v"), state["hit"].alias("hit"), state["miss"].alias("miss")),
        F.log(state["prior"]) - F.log(1 - state["prior"]),
        lambda total, x: total
        + F.when(x["v"] == 1, F.log(x["hit"]) - F.log(x["miss"])).otherwise(
            F.log(1 - x["hit"]) - F.log(1 - x["miss"])
        ),
    )
    return 1 / (1 + F.exp(-odds))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """How often each labeler fires on personal data and on other spans, per kind.

    ``patterns`` has one row per kind and vote pattern with its count ``n``: at
    most 4 * 2^6 rows. Expectation-maximisation for a fixed number of rounds,
    from labelers that are right more often than not; counts are smoothed.
    """
    start = F.struct(
        F.lit(0.5).alias("prior"),
        F.array_repeat(F.lit(0.8), LABELERS).alias("hit"),
        F.array_repeat(F.lit(0.3), LABELERS).alias("miss"),
    )

    def step(state: Column, _: Column) -> Column:
        judged = F.transform(
            "_patterns",
            lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), _posterior(state, p["v"]).alias("q")),
        )

        def total(part) -> Column:
            return F.aggregate(judged, F.lit(0.0), lambda t, p: t + part(p))

        yes, no = total(lambda p: p["n"] * p["q"]), total(lambda p: p["n"] * (1 - p["q"]))
        each = F.sequence(F.lit(0), F.lit(LABELERS - 1))
        return F.struct(
            ((yes + 1) / (yes + no + 2)).alias("prior"),
            F.transform(
                each, lambda j: (total(lambda p: p["n"] * p["q"] * F.get(p["v"], j)) + 1.6) / (yes + 2)
            ).alias("hit"),
            F.transform(
                each, lambda j: (total(lambda p: p["n"] * (1 - p["q"]) * F.get(p["v"], j)) + 0.6) / (no + 2)
            ).alias("miss"),
        )

    listed = patterns.groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("_patterns")
    )
    return listed.select(
        "kind", "_patterns", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("state")
    )


def features() -> Column:
    """Shape, size and neighbours of a span, as keys of bounded number."""
    shape = F.regexp_replace(F.regexp_replace("raw", "[0-9]+", "9"), "[A-Za-z]+", "a")
    marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("raw", "[0-9A-Za-z]", ""), ""))), "")
    edges = [
        F.when(c == "", "none").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike(r"\s"), "white").otherwise("mark")
        for c in (F.substring("before", -1, 1), F.substring("after", 1, 1))
    ]
    parts = [
        F.pmod(F.xxhash64(shape), F.lit(256)),
        F.pmod(F.xxhash64(marks), F.lit(64)),
        F.least(F.length(digits(F.col("raw"))), F.lit(24)),
        *edges,
        F.lower("before").rlike(AGAINST),
    ]
    return F.array(*[F.concat_ws(":", F.col("kind"), F.lit(i), p.cast("string")) for i, p in enumerate(parts)])


def _more_spans(spans: DataFrame) -> DataFrame:
    """Further spans the classifier accepts, per row of the documents."""
    spans = stored(spans.withColumns({"votes": votes(), "features": features()}), "pii-spans")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    learned = stored(reliabilities(patterns), "pii-reliabilities")
    posteriors = learned.select("kind", "state", F.explode("_patterns").alias("p")).select(
        "kind", F.col("p.v").alias("votes"), _posterior(F.col("state"), F.col("p.v")).alias("q")
    )
    # At most 256 rows.
    judged = spans.join(F.broadcast(posteriors), ["kind", "votes"])
    sums = [F.sum(F.floor(F.col("q") * 1e6)) / 1e6, F.sum(F.floor((1 - F.col("q")) * 1e6)) / 1e6]
    weights = judged.select("q", F.explode("features").alias("key")).groupBy("key").agg(
        F.log((sums[0] + 1) / (sums[1] + 1)).alias("w")
    )
    # A few rows per kind and feature: the bounds are in features().
    table = stored(weights, "pii-weights")
    lookup = table.agg(F.map_from_entries(F.collect_list(F.struct("key", "w")))).scalar()
    more = judged.where(~F.col("is_base")).withColumn("_w", lookup)
    learned_odds = F.aggregate(
        "features", F.lit(0.0), lambda total, key: total + F.coalesce(F.try_element_at("_w", key), F.lit(0.0))
    )
    score = F.log(F.col("q") / (1 - F.col("q"))) + learned_odds / F.size("features")
    # What fails the base check of its kind is never taken, whatever its neighbours.
    sound = _by_kind({k: _valid(k, F.col("s")) if k != "ip" else F.lit(True) for k in KINDS})
    return more.where((score > 0) & sound).groupBy("_h1", "_h2").agg(F.collect_set(F.struct("kind", "a", "b")).alias("_more"))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row.

    Both are sorted arrays of (kind, a, b): the kind's place in KINDS, first and
    end in code points. ``spans`` holds the base spans and those added.

    Null is the empty text. Rows of one id and one text have the same spans; rows
    without an id are read like others. Without spans nothing is learned and the
    arrays are empty. Other columns are not read.
    """
    found = stored(_scan(docs.select(doc_id, text), doc_id, text), "pii-found")
    more = stored(_more_spans(_spans(found)), "pii-more")

    def placed(i: int):
        return lambda x: F.struct(F.lit(i).alias("kind"), x["a"].alias("a"), x["b"].alias("b"))

    base = F.concat(*[F.transform(f"base_{k}", placed(i)) for i, k in enumerate(KINDS)])
    rows = found.select("_doc", "_h1", "_h2", base.alias("base")).join(more, ["_h1", "_h2"], "left")
    both = F.array_sort(F.concat("base", F.coalesce("_more", F.expr("filter(base, x -> false)"))))
    return rows.select(F.col("_doc").alias(doc_id), "base", both.alias("spans"))


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    at = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["kind"] == at)).cast("long")


def as_text(spans: str) -> Column:
    """kind:first:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["a"], x["b"])), ","
    )
