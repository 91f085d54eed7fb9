"""Personal data by candidate gradient boosting, in DataFrame, SQL and spark.ml functions only.

High-recall generators propose spans: the four stated forms (whether or not they are valid) and looser ones, such as spelled-out
addresses, national telephone numbers and shorter or otherwise separated card numbers. Valid stated forms are always kept.

The checks (octets at most 255, a Luhn sum, counts of digits, a host that ends in letters) are part of the generators of loose forms, so what is left
to the trees is what no check tells: whether a run of digits is a card or an order number, four octets an address or a section. Texts have no labels for that, so
examples are made from the texts themselves: a valid stated span that is written in a loose form where it stands, as it is or behind words that announce its kind, is
a positive; a decoy in its place is a negative, a string that passes the same checks and means something else: versions and sections, times, order, part and serial
numbers with a right check digit, and prose with "at" and "dot". They come with the words that announce such things.

Boosted trees learn from format and context. Texts of one share are held out; on their examples each kind gets its threshold: half way below the lowest score from which on
PRECISION of the accepted ones are positives. A kind that no score serves so well, or without examples, adds nothing. Looser candidates that reach their kind's threshold and
touch no kept span are added. The trees are applied as one SQL expression inside the span arrays, so finding spans is one pass over the texts without a shuffle.

Patterns that the rules state are written here with possessive parts and look-behinds: they match the same, but neither
recurse nor restart inside a run, however long a text is.

Defined cases: a null text is empty; equal rows are judged alike; without candidates of both outcomes no span is added; all
columns stay; an empty table gives an empty table. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import logging

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut, documents, free_name

LOG = logging.getLogger(__name__)
KINDS = ("email", "ip", "card", "phone")
STATED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){16})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:[(\[{]at[)\]}]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[{]dot[)\]}]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9]?[\x20.-][0-9](?:[\x20.-]?[0-9]){6,12}(?![0-9])",
}
#: Something that every match of a pattern has; the pattern runs only on texts with it.
NEEDS = {
    ("email", True): r"@[A-Za-z0-9-]",
    ("ip", True): r"[0-9]\.[0-9]",
    ("card", True): r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    ("phone", True): r"\+[0-9]",
    ("email", False): r"(?s)^(?=.*(?:[(\[{]at[)\]}]|\x20at\x20)).*(?:[(\[{]dot[)\]}]|\x20dot\x20)",
    ("ip", False): r"[0-9](?:\[\.\]|\(\.\))[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    ("card", False): r"[0-9][\x20./-]?[0-9][\x20./-]?[0-9][\x20./-]?[0-9][\x20./-]?[0-9][\x20./-]?[0-9]",
    ("phone", False): r"[0-9]{3}[\x20.-][0-9]{4}|00[1-9]",
}
#: Words before a span that speak for a kind, and such as speak for something else.
CONTEXT = {"email": r"(?i)mail|contact|write|reach", "ip": r"(?i)\bip\b|host|server|addr|ping", "card": r"(?i)card|visa|credit|pay|debit", "phone": r"(?i)phone|call|tel|fax|mobile|dial"}
AGAINST = {"thing": r"(?i)order|part|item|serial|ticket|invoice|parcel|track|isbn|ref\b|case|lot\b", "place": r"(?i)version|release|section|chapter|clause|time|log\b|from", "count": r"(?i)total|sum\b|about|pages|no\.|nr\.|#"}
#: What announces a positive of each kind, and a decoy; an empty one leaves the text's own words before it.
LEADS = {"email": ("mail ", "contact: ", "write to ", "", ""), "ip": ("ip ", "server ", "host: ", "", ""), "card": ("card ", "visa: ", "paid by ", "", ""), "phone": ("call ", "phone: ", "fax ", "", "")}
DECOY_LEADS = {"email": ("", "", "look "), "ip": ("version ", "section ", "chapter "), "card": ("order ", "serial no. ", "parcel ", "isbn "), "phone": ("order ", "part no. ", "ticket ", "invoice ")}
TLD = r"(?i)^(com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|example)$"
#: Characters before a span that features see, and that decoys of prose take their words from.
WINDOW, NEAR = 24, 400
#: Examples that the trees are trained and calibrated on, and how many of each outcome a span gives; share for calibration; trees and their depth.
SAMPLE, VARIANTS, HELD_SHARE, TREES, DEPTH, PRECISION, SEED = 20_000, 4, 0.3, 20, 5, 0.98, 11
FEATURES = (
    "n_letters", "n_digits", "n_marks", "n_groups", "longest", "n_blanks", "opens", "round", "plus", "tld", "user_marks", "colons", "even", "stuck_before", "stuck_after", "colon_before", "line_start", "sentence_end",
    *(f"is_{k}" for k in KINDS), *(f"near_{k}" for k in KINDS), *(f"against_{k}" for k in AGAINST),
)
#: Matches of a text whose places are added up in one array.
PLACED = 256
NONE = "cast(array() as array<struct<kind: int, stated: boolean, start: int, end: int, body: string>>)"


def matches(text: Column, kind: str, stated: bool) -> Column:
    """All leftmost matches of a pattern with their places: what a split leaves between matches gives the distances."""
    pattern = (STATED if stated else LOOSE)[kind]
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(F.coalesce(pair["between"], F.lit("")))
        end = begin + F.length(F.coalesce(pair["found"], F.lit("")))
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(stated).alias("stated"), begin.alias("start"), end.alias("end"), pair["found"].alias("body"))
        return F.struct(end.alias("at"), F.when(pair["found"].isNotNull(), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    # places within runs of PLACED matches first, then the places of the runs, so that work stays in proportion to the matches
    pairs = F.arrays_zip(found.alias("found"), between.alias("between"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PLACED).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * PLACED + 1, F.lit(PLACED)), F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("out")), step))
    begins = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"]
    )
    moved = lambda r, at: F.transform(r["out"], lambda x: F.struct(x["kind"].alias("kind"), x["stated"].alias("stated"), (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["body"].alias("body")))
    spans = F.flatten(F.zip_with(runs, begins, moved))
    return F.when(text.rlike(NEEDS[kind, stated]), spans).otherwise(F.expr(NONE))


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(body: Column) -> Column:
    number = digits(body)

    def add(total: Column, i: Column) -> Column:
        own = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + own - F.when(own > 9, 9).otherwise(0)

    return (F.length(number) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda t, i: F.coalesce(add(t, i), t)) % 10 == 0)


def octets(body: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(part.rlike("^[0-9]+$") & (F.length(bare) <= 3), F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(F.regexp_replace(body, r"[\[\]()]", ""), r"\."), small)


def valid(span: Column) -> Column:
    count = F.length(digits(span["body"]))
    return (
        F.when(span["kind"] == 0, F.lit(True))
        .when(span["kind"] == 1, octets(span["body"]))
        .when(span["kind"] == 2, count.between(16, 19) & luhn(span["body"]))
        .otherwise(count.between(8, 15))
    )


def passes(span: Column) -> Column:
    """The checks for a candidate in a loose form."""
    count = F.length(digits(span["body"]))
    return (
        F.when(span["kind"] == 0, F.regexp_extract(span["body"], "[A-Za-z0-9-]*$", 0).rlike("^[A-Za-z]{2,24}$"))
        .when(span["kind"] == 1, span["body"].contains(":") | octets(span["body"]))
        .when(span["kind"] == 2, count.between(13, 19) & luhn(span["body"]))
        .otherwise(count.between(10, 15))
    )


def pick(choice: Column, *forms: Column) -> Column:
    return F.element_at(F.array(*forms), (F.pmod(choice, F.lit(len(forms))) + 1).cast("int"))


def loosely(span: Column, choice: Column) -> Column:
    """The body of a stated candidate in one of the loose forms of its kind."""
    body, number = span["body"], digits(span["body"])
    user, host = F.substring_index(body, "@", 1), F.substring_index(body, "@", -1)
    user = pick(F.shiftright(choice, 16), user, F.coalesce(F.nullif(F.regexp_replace(user, "[^A-Za-z]", ""), F.lit("")), user))  # some have letters only
    bare = F.regexp_replace(host, "[0-9]", "")
    host = pick(F.shiftright(choice, 20), host, F.when(bare.rlike(r"^[A-Za-z]") & ~F.contains(bare, F.lit("..")), F.substring_index(bare, ".", -2)).otherwise(host))
    at, dot = pick(choice, *map(F.lit, (" (at) ", " at ", "[at]", "{at}"))), pick(F.shiftright(choice, 8), *map(F.lit, (" (dot) ", " dot ", "[dot]", " [dot] ", "{dot}")))
    area, local, line = F.substring(number, -10, 3), F.substring(number, -7, 3), F.substring(number, -4, 4)
    dialled = pick(choice, F.concat(F.lit("("), area, F.lit(") "), local, F.lit("-"), line), F.concat_ws(".", area, local, line), F.concat_ws("-", area, local, line))
    return (
        F.when(span["kind"] == 0, F.concat(user, at, F.regexp_replace(host, F.lit(r"\."), dot)))
        .when(span["kind"] == 1, F.regexp_replace(body, F.lit(r"\."), pick(choice, F.lit("[.]"), F.lit("(.)"))))
        .when(span["kind"] == 2, F.regexp_replace(number, F.lit("([0-9]{4})(?=[0-9])"), pick(choice, *map(F.lit, ("$1.", "$1/")))))
        .otherwise(F.when(F.length(number) >= 10, dialled).otherwise(number))
    )


def decoy(near: Column, span: Column, choice: Column) -> Column:
    """Something else that the loose generator of the span's kind would propose, and whose checks it passes; prose is of the words in ``near``."""
    draw = lambda k, low, high: (F.pmod(F.xxhash64(choice, F.lit(k)), F.lit(high - low + 1)) + low).cast("string")
    words = F.filter(F.split(F.regexp_replace(near, "[^A-Za-z]+", " "), " "), lambda w: F.length(w) > 1)
    word = lambda k: F.coalesce(F.get(words, F.pmod(F.xxhash64(choice, F.lit(k)), F.greatest(F.size(words), F.lit(1))).cast("int")), F.lit("it"))
    prose = pick(choice, F.concat(word(1), F.lit(" at "), word(2), F.lit(" dot "), word(3)), F.concat(word(1), F.lit(" at "), word(2), F.lit(" dot "), word(3), F.lit(" dot "), word(4)))
    place = F.array_join(F.array(*[draw(k, 1, 24) for k in range(4)]), "(.)")
    clock = F.array_join(F.array(*[F.lpad(draw(k, 0, 59), 2, "0") for k in range(8)]), ":")
    # a number of 12 to 15 digits and the one digit that makes its Luhn sum right, in groups that no card has
    bare = F.concat(*[draw(k, 1, 9) for k in range(12)], F.substring(F.concat(draw(20, 0, 9), draw(21, 0, 9), draw(22, 0, 9)), F.lit(1), F.pmod(choice, F.lit(4)).cast("int")))
    number = F.concat(bare, F.element_at(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: luhn(F.concat(bare, d))), 1))
    serial = pick(F.shiftright(choice, 4), number, F.regexp_replace(number, F.lit("([0-9]{3})(?=[0-9])"), F.lit("$1.")), F.regexp_replace(number, F.lit("([0-9]{5})(?=[0-9])"), F.lit("$1/")), F.regexp_replace(number, F.lit("([0-9]{4})(?=[0-9])"), F.lit("$1.")))
    parts = draw(1, 100, 999), draw(2, 100, 999), draw(3, 1000, 9999)
    part = pick(choice, F.concat_ws("-", *parts), F.concat_ws(".", *parts))
    return F.when(span["kind"] == 0, prose).when(span["kind"] == 1, pick(choice, place, place, clock)).when(span["kind"] == 2, serial).otherwise(part)


def features(body: Column, kind: Column, before: Column, after: Column) -> Column:
    """A struct of numbers about the format of a span and the text around it."""
    groups = F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, F.length)
    numbers = {
        "n_letters": F.length(F.regexp_replace(body, "[^A-Za-z]", "")),
        "n_digits": F.length(digits(body)),
        "n_marks": F.length(F.regexp_replace(body, r"[A-Za-z0-9\x20]", "")),
        "n_groups": F.size(groups),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "n_blanks": F.length(F.regexp_replace(body, r"[^\x20]", "")),
        "opens": body.rlike(r"[(\[{]"),
        "round": body.rlike(r"\(\.\)"),
        "plus": body.startswith("+"),
        "tld": F.regexp_extract(body, "[A-Za-z]*$", 0).rlike(TLD),
        "user_marks": F.regexp_extract(body, r"^[^\x20(\[{]*", 0).rlike("[0-9._%+-]"),
        "colons": body.contains(":"),
        "even": (F.size(groups) > 1) & (F.element_at(sizes, 1) == 4) & F.forall(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(1))), lambda n: n == 4),
        "stuck_before": before.rlike("[A-Za-z0-9]$"),
        "stuck_after": after.rlike("^[A-Za-z0-9]"),
        "colon_before": before.rlike(r":\s*$"),
        "line_start": before.rlike(r"(^|\n)\s*$"),
        "sentence_end": after.rlike(r"^\.(\s|$)"),
    }
    numbers |= {f"is_{k}": kind == i for i, k in enumerate(KINDS)}
    numbers |= {f"near_{k}": before.rlike(CONTEXT[k]) for k in KINDS} | {f"against_{k}": before.rlike(AGAINST[k]) for k in AGAINST}
    return F.struct(*[F.coalesce(numbers[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


def around(text: Column, span: Column) -> tuple[Column, Column]:
    """The characters before and after a span."""
    return F.substring(text, F.greatest(span["start"] - WINDOW + 1, F.lit(1)), F.least(span["start"], F.lit(WINDOW))), F.substring(text, span["end"] + 1, F.lit(2))


def of_span(text: Column, span: Column) -> Column:
    return features(span["body"], span["kind"], *around(text, span))


def tree_sql(node, row: str) -> str:
    """A trained regression tree as a SQL expression over the features of ``row``."""
    if node.subtreeDepth() == 0:
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"CASE WHEN {row}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {tree_sql(node.leftChild(), row)} ELSE {tree_sql(node.rightChild(), row)} END"


def ensemble_sql(model, row: str) -> str:
    parts = [f"{weight!r}D * ({tree_sql(tree._call_java('rootNode'), row)})" for weight, tree in zip(model.treeWeights, model.trees)]
    return " + ".join(parts)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``body_``, the text, ``stated_``, the spans of the stated forms, and ``loose_``, the looser ones that pass their checks."""
    body = docs.withColumn("body_", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for name, stated in (("stated_", True), ("loose_", False)):
        body = body.withColumns({f"{name}{k}": matches(F.col("body_"), k, stated) for k in KINDS})
    every = {n: F.concat(*[F.col(f"{n}{k}") for k in KINDS]) for n in ("stated_", "loose_")}
    body = body.withColumns(every).drop(*[f"{n}{k}" for n in ("stated_", "loose_") for k in KINDS])
    return body.withColumn("loose_", F.when(F.size("loose_") > 0, F.filter("loose_", passes)).otherwise(F.col("loose_")))


def examples(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> DataFrame:
    """About ``most`` examples in hash order, of each valid stated span VARIANTS positives and as many decoys: ``kind, label, held`` and their features."""
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body_"))
    found = body.withColumns({f"s{i}": matches(F.col("body_"), k, True) for i, k in enumerate(KINDS)})
    found = found.select("body_", F.xxhash64(F.lit(SEED), "body_").alias("print_"), F.explode(F.filter(F.concat(*[F.col(f"s{i}") for i in range(len(KINDS))]), valid)).alias("span"))
    key = F.xxhash64("print_", "span.start", "span.kind")
    # of a text only what stands around the span goes on
    before, after = around(F.col("body_"), F.col("span"))
    near = F.substring("body_", F.greatest(F.col("span.start") - NEAR, F.lit(1)), F.lit(NEAR))
    span = found.select("print_", "span", key.alias("key"), before.alias("before"), after.alias("after"), near.alias("near")).orderBy("key").limit(-(-most // (2 * VARIANTS)))
    span = span.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.lit(VARIANTS)), lambda v: F.xxhash64("key", v))))

    def one(label: float, written: Column, leads: dict) -> Column:
        lead = F.lit("")
        for i, k in enumerate(KINDS):
            lead = F.when(F.col("span.kind") == i, pick(F.xxhash64("key", F.lit(label)), *map(F.lit, leads[k]))).otherwise(lead)
        return F.struct(F.lit(label).alias("label"), written.alias("body"), F.right(F.concat("before", lead), F.lit(WINDOW)).alias("before"), F.col("after").alias("after"))

    pair = F.explode(F.array(one(1.0, loosely(F.col("span"), F.abs(F.shiftright("key", 1))), LEADS), one(0.0, decoy(F.col("near"), F.col("span"), F.abs(F.shiftright("key", 1))), DECOY_LEADS))).alias("e")
    rows = span.select(F.col("span.kind").alias("kind"), (F.pmod("print_", F.lit(1000)) < int(1000 * HELD_SHARE)).alias("held"), pair)  # copies of a text are in one fold
    judged = F.struct("kind", F.lit(False).alias("stated"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("e.body").alias("body"))
    return rows.where(passes(judged)).select("kind", "held", F.col("e.label").alias("label"), features(F.col("e.body"), F.col("kind"), F.col("e.before"), F.col("e.after")).alias("f")).select("kind", "held", "label", "f.*")


def fit_spans(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> tuple[str, dict[int, float]] | None:
    """The trees' sum as SQL over ``f``, and a threshold for each kind; None without examples of both outcomes to learn from."""
    sample = cut(examples(docs, text, most))  # ``most`` rows, about
    train = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.where(~F.col("held"))).select("features", "label").coalesce(2))
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(train)
    sql = ensemble_sql(model, "f")
    judged = sample.where("held").select("kind", "label", F.expr(sql.replace("f.", "")).alias("score")).collect()  # part of them
    limits = {}
    for k, kind in enumerate(KINDS):
        own = [(r["score"], r["label"]) for r in judged if r["kind"] == k]
        limits[k] = threshold(own)
        taken = [label for score, label in own if score >= limits[k]]
        LOG.info("%s: threshold %s from %d held-out positives and %d decoys; it accepts %d and %d", kind, limits[k], sum(x for _, x in own), sum(1 - x for _, x in own), sum(taken), len(taken) - sum(taken))
    return sql, limits


def threshold(scored: list[tuple[float, float]]) -> float:
    """Half way below the lowest score from which on PRECISION of the candidates are right, equal scores all or none; infinite where no score does."""
    best, good, ordered = float("inf"), 0.0, sorted(scored, reverse=True)
    for n, (score, label) in enumerate(ordered, 1):
        good += label
        if good >= PRECISION * n and (n == len(ordered) or ordered[n][0] < score):
            best = score if n == len(ordered) else (score + ordered[n][0]) / 2
    return best


def apart(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def find_personal_data(docs: DataFrame, model: tuple[str, dict[int, float]] | None, text: str = "text", into: str = "personal") -> DataFrame:
    """``docs`` with a struct of two span arrays: ``base``, the valid stated ones, and ``spans``, these and the added ones."""
    found = candidates(docs, text).withColumn("base_", F.filter("stated_", valid))
    if model is None:
        found = found.withColumn("more_", F.expr(NONE))
    else:
        sql, limits = model
        marked = F.transform("loose_", lambda s: F.struct(s.alias("s"), of_span(F.col("body_"), s).alias("f")))
        found = found.withColumn("loose_", F.when(F.size("loose_") > 0, F.filter(marked, lambda c: apart(c["s"], F.col("base_")))).otherwise(F.slice(marked, 1, 0)))
        limit = " ".join(f"WHEN {k} THEN {v!r}D" if v != float("inf") else f"WHEN {k} THEN double('Infinity')" for k, v in limits.items())
        picked = F.expr(f"transform(filter(loose_, c -> ({sql.replace('f.', 'c.f.')}) >= CASE c.s.kind {limit} END), c -> c.s)")
        found = found.withColumn("picked_", picked)
        # of added spans that overlap, the first stays: the earliest, then the longest
        ordered = F.array_sort("picked_", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["kind"] - b["kind"]))
        more = F.aggregate(ordered, F.expr(NONE), lambda out, s: F.when(apart(s, out), F.concat(out, F.array(s))).otherwise(out))
        found = found.withColumn("more_", more)
    place = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    result = F.struct(place(F.col("base_")).alias("base"), place(F.concat("base_", "more_")).alias("spans"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(free_name(docs, into)))


def redact(docs: DataFrame, text: str = "text", into: str = "personal") -> DataFrame:
    """``docs`` with every span of ``into`` replaced by its kind in brackets."""
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    ordered = F.array_sort(F.col(f"{into}.spans"), lambda a, b: a["start"] - b["start"])
    body = F.coalesce(F.col(text), F.lit(""))

    def step(state: Column, span: Column) -> Column:
        return F.struct(
            F.concat(state["out"], F.substring(body, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))), F.element_at(name, span["kind"] + 1)).alias("out"), F.greatest(span["end"], state["at"]).alias("at")
        )

    return docs.withColumn(text, F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body)))))


def digest(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def kind_counts(spans: Column) -> list[Column]:
    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = find_personal_data(docs, fit_spans(docs))
    return found.select("doc_id", *kind_counts(F.col("personal.base")), F.sha2(digest(F.col("personal.base")), 256).alias("base_sha256"), digest(F.col("personal.spans")).alias("spans"))
