"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-ins only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import let

# Base kinds in their order, then the kinds added here. Patterns start where a run of their first
# characters starts (or where the last match ended), which finds the same leftmost matches in linear time. Repeats are
# possessive: what follows a repeat never begins like its body, so nothing is lost, and no repeat keeps a stack frame.
LOCAL_PART = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL_PART}]))[{LOCAL_PART}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A text without this string or character class holds no match, so its pattern is not run.
GATES = {"email": "@", "phone": "+"}
#: Score of a pattern alone, what a passed checksum adds, what a context word nearby adds; added kinds need THRESHOLD.
PATTERN_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.5, "phone": 0.7, "iban": 0.3, "ssn": 0.4}
CHECKED, NEARBY, THRESHOLD, CONTEXT_CHARS = 0.4, 0.3, 0.6, 40
CONTEXT = {
    "email": "e-?mail|contact|write to",
    "ip": "address|host|server|\\bip\\b",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social security|tax id",
}
GROUP = 512


def cut_up(text: Column) -> Column:
    """The text in pieces of ``GROUP`` code points: a ``substr`` of the whole text would walk it from its start each time."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % GROUP), 0)


def part_of(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text that ``cut_up`` has cut."""
    first = F.floor(start / GROUP)
    near = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor(end / GROUP) - first + 1).cast("int")), "")
    return near.substr((start - first * GROUP + 1).cast("int"), (end - start).cast("int"))


def group_numbers(values: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / GROUP), F.lit(0)).cast("int"))


def group_of(values: Column, g: Column) -> Column:
    return F.slice(values, g * GROUP + 1, GROUP)


def before_each(values: Column, first: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of ``first`` and all values before each position. For at most some thousand values, as appending to an array
    copies it; longer arrays go in two levels of ``GROUP``."""
    zero = F.struct(first.cast("long").alias("so_far"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct(join(acc["so_far"], x).alias("so_far"), F.array_append(acc["out"], acc["so_far"]).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def total(d: Column) -> Column:
        def worth(i: Column) -> Column:
            x = F.substring(d, 1, 999).substr(i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0

    return let(digits, lambda d: F.when(F.char_length(d).between(12, 19), total(d)).otherwise(F.lit(False)))


def mod97(match: Column) -> Column:
    """The account number's check: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.translate(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def accepted(kind: str, match: Column) -> Column:
    """The kind's own condition on a match."""
    n_digits = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.char_length(d) <= 3) & (F.coalesce(F.expr("0") + F.when(d != "", d).cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return n_digits.between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def proposed(docs: DataFrame) -> DataFrame:
    """Adds ``__found``, accepted matches as (start, kind_no, end, kind, match) kind by kind, leftmost first. ``split`` and
    ``regexp_extract_all`` walk the same matches, so lengths of both give the places in code points. All kinds share each
    expression, and each step is a projection: what nests deeper takes the analyser many times longer. ``let`` binds each
    column that a lambda reads, as the optimiser may put the column's expression in its place."""
    body, no_text = F.col("__text"), F.filter(F.array(F.lit("")), lambda x: F.lit(False))
    digits = body.rlike("[0-9]")
    gate = lambda k: F.contains(body, F.lit(GATES[k])) if k in GATES else digits
    matches = F.array(*[F.when(gate(k), F.regexp_extract_all(body, F.lit(PATTERNS[k]), 0)).otherwise(no_text) for k in KINDS])
    between = F.array(*[F.when(gate(k), F.split(body, PATTERNS[k], -1)).otherwise(no_text) for k in KINDS])
    chars = lambda x: F.coalesce(F.char_length(x), F.lit(0)).cast("long")
    own = lambda between, m, k: F.flatten(F.transform(F.get(between, k), lambda p, i: F.array(chars(p), chars(F.get(m, i)))))
    lengths = let(F.col("__between"), lambda between: F.transform(F.col("__matches"), lambda m, k: own(between, m, k)))
    plus = lambda a, x: a + x
    sums = F.transform(F.col("__lengths"), lambda v: F.transform(group_numbers(v), lambda g: F.aggregate(group_of(v, g), F.lit(0).cast("long"), plus)))
    firsts = F.transform(F.col("__sums"), lambda v: before_each(v, F.lit(0), plus))
    inside = lambda v, firsts: F.flatten(F.transform(firsts, lambda first, g: before_each(group_of(v, g), first, plus)))
    starts = let(F.col("__firsts"), lambda firsts: F.transform(F.col("__lengths"), lambda v, k: inside(v, F.get(firsts, k))))
    names = F.array(*[F.lit(k) for k in KINDS])

    def place(starts: Column, m: Column, i: Column, k: Column) -> Column:
        start = F.get(F.get(starts, k), i * 2 + 1)
        return F.struct(start.alias("start"), k.alias("kind_no"), (start + F.char_length(m)).alias("end"), F.get(names, k).alias("kind"), m.alias("match"))

    spans = let(F.col("__starts"), lambda at: F.flatten(F.transform(F.col("__matches"), lambda ms, k: F.transform(ms, lambda m, i: place(at, m, i, k)))))

    def good(s: Column) -> Column:
        out = F.lit(True)
        for k in KINDS:
            if k != "email":
                out = F.when(s["kind"] == k, accepted(k, s["match"])).otherwise(out)
        return out

    out = docs.select("*", matches.alias("__matches"), between.alias("__between")).select("*", lengths.alias("__lengths"))
    out = out.select("*", sums.alias("__sums")).select("*", firsts.alias("__firsts")).select("*", starts.alias("__starts"))
    return out.select(*docs.columns, spans.alias("__spans")).select(*docs.columns, F.filter("__spans", good).alias("__found"))


def scored(docs: DataFrame) -> DataFrame:
    """Adds ``__scored``: the spans with their score from pattern, checksum, and context words within ``CONTEXT_CHARS``
    before."""
    base = F.create_map(*[v for k in KINDS for v in (F.lit(k), F.lit(PATTERN_SCORE[k] + (CHECKED if k in ("card", "iban") else 0)))])
    before = lambda pieces, s: F.lower(part_of(pieces, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]))

    def score(s: Column) -> Column:
        near = F.lit(False)
        for k in KINDS:
            near = near | ((s["s"]["kind"] == k) & s["before"].rlike(CONTEXT[k]))
        points = F.least(F.lit(1.0), base[s["s"]["kind"]] + F.when(near, F.lit(NEARBY)).otherwise(F.lit(0.0)))
        return F.struct(*[s["s"][n].alias(n) for n in ("start", "kind_no", "end", "kind")], points.alias("score"))

    beside = let(F.col("__pieces"), lambda pieces: F.transform("__found", lambda s: F.struct(s.alias("s"), before(pieces, s).alias("before"))))
    return docs.select("*", beside.alias("__beside")).select(*docs.columns, F.transform("__beside", score).alias("__scored")).drop("__found")


def with_furthest(docs: DataFrame, values: Column, name: str) -> DataFrame:
    """Adds ``name``: the largest of ``values`` before each position, 0 before the first."""
    most = lambda a, x: F.greatest(a, x)
    tops = let(F.col("__values"), lambda v: F.transform(group_numbers(v), lambda g: F.coalesce(F.array_max(group_of(v, g)), F.lit(0).cast("long"))))
    firsts = before_each(F.col("__tops"), F.lit(0), most)
    out = let(F.col("__values"), lambda v: F.flatten(F.transform("__first_tops", lambda first, g: before_each(group_of(v, g), first, most))))
    docs = docs.select("*", values.alias("__values")).select("*", tops.alias("__tops")).select("*", firsts.alias("__first_tops"))
    return docs.select("*", out.alias(name)).drop("__values", "__tops", "__first_tops")


def with_spans(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` with the text, its pieces, ``base_spans`` and ``pii_spans``.

    An added span must be apart from all base spans: base spans by start and added ones by end are sorted together, and one
    overlaps if the furthest end of the base spans before it lies beyond its start.
    """
    cut = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).select("*", cut_up(F.col("__text")).alias("__pieces"))
    is_base = lambda s: s["kind_no"] < len(BASE_KINDS)
    split = scored(proposed(cut)).select(
        *keep, "__text", "__pieces", F.sort_array(F.filter("__scored", is_base)).alias("base_spans"),
        F.filter("__scored", lambda s: ~is_base(s) & (s["score"] >= THRESHOLD)).alias("__more"),
    )
    event = lambda at, base: lambda s: F.struct(s[at].alias("at"), F.lit(base).alias("base"), s.alias("span"))
    events = F.when(F.size("__more") > 0, F.sort_array(F.concat(F.transform("base_spans", event("start", 1)), F.transform("__more", event("end", 0)))))
    swept = with_furthest(split.select("*", events.alias("__events")), F.transform("__events", lambda e: F.when(e["base"] == 1, e["span"]["end"]).otherwise(F.lit(0).cast("long"))), "__reach")
    free = let(F.col("__reach"), lambda reach: F.filter("__events", lambda e, i: (e["base"] == 0) & (F.get(reach, i) <= e["span"]["start"])))
    spans = F.when(F.size("__more") > 0, F.sort_array(F.concat("base_spans", F.transform("__free", lambda e: e["span"])))).otherwise(F.col("base_spans"))
    return swept.select("*", free.alias("__free")).select(*keep, "__text", "__pieces", "base_spans", spans.alias("pii_spans"))


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``base_spans`` and ``pii_spans``, arrays of (start, kind_no, end, kind, score) by start, then kind.

    Base kinds keep every accepted match; added kinds (iban, ssn) need the threshold and no overlap with a base span.
    Row by row: no shuffle, no Python; work grows with the length of a text, whatever repeats in it. A null text counts as
    empty and has no spans; repeated rows and further columns change nothing. Places are code points, end exclusive.
    """
    return with_spans(docs, keep, text).select(*keep, "base_spans", "pii_spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The documents contract: counts of base spans, their digest and all spans."""
    found = find_pii(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(spans_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("pii_spans")).alias("spans"),
    )


def mask_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the text with every span that ``find_pii`` reports replaced by its kind in brackets; spans that overlap
    become one mask of the first one's kind. A null text stays null."""
    spans, pieces = F.col("pii_spans"), F.col("__pieces")
    ends = F.transform(spans, lambda s: s["end"])
    found = with_spans(docs.select(*keep, text, F.col(text).isNull().alias("__null")), [*keep, "__null"], text)
    lead = let(F.col("__before"), lambda before: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(before, i).alias("from"))))
    ahead = with_furthest(found, ends, "__before").select("*", lead.alias("__lead"))
    part = lambda p, s: F.concat(part_of(p, s["from"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    parts = let(pieces, lambda p: F.transform(F.filter("__lead", lambda s: s["start"] >= s["from"]), lambda s: part(p, s)))
    masked = F.concat(F.array_join(parts, ""), part_of(pieces, F.array_max(ends), F.char_length("__text").cast("long")))
    return ahead.select(*keep, F.when(~F.col("__null"), F.when(F.size(spans) == 0, F.col("__text")).otherwise(masked)).alias(text))
