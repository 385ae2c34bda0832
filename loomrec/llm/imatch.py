"""I-Match fingerprints: terms of a band of inverse document frequency, sorted, hashed over randomised subsets of the lexicon.

A term's hash says which of ``LEXICONS`` random subsets it belongs to and, by further bits, down to which density it stays in it:
density l keeps one term in 4^l. A text is hashed at the density where a subset holds about one of its terms or less, and at the next
thinner one, so that texts of any length have subsets that an edit leaves alone. Two texts are compared at the densities they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrec.llm.common import let, partitions, stored, text_or_empty

LEXICONS = 32
LEXICON_BITS = 5
#: The band: terms of at least this many documents and of at most this share of them.
LEAST_DOCUMENTS = 2
MOST_SHARE = 0.1
#: Which of a row's texts a term was found in.
OWN, EDITED, NEXT = 1, 2, 4
#: Hex digits kept of each subset's hash; a subset without terms.
DIGITS = 8
NONE = "-"
#: What is carried once per document beside its terms.
HEAD = "struct<doc_id:bigint,n_chars:bigint,edited_sha256:string,own:int,edited:int,next:int>"


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms: runs of letters and digits, in lower case. A text without any has one, of itself."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.xxhash64(text))))


def density(n_terms: Column) -> Column:
    """floor(log4(4 n / LEXICONS)), at least 0: a subset of a text of LEXICONS terms or more holds a quarter of a term to one."""
    quarters = F.greatest(F.lit(1), (n_terms * 4 / LEXICONS).cast("long"))
    return F.floor((F.length(F.bin(quarters)) - 1) / 2).cast("int")


def stays(term: Column, level: Column) -> Column:
    """True if the term's bits keep it at density ``level``."""
    return F.shiftrightunsigned(term, LEXICON_BITS).bitwiseAND((F.pow(F.lit(4.0), level) - 1).cast("long")) == 0


def sampled(text: Column) -> Column:
    """(level, terms): the text's density and the terms that stay at it, whatever their document frequency."""

    def cut(h: Column) -> Column:
        return let(density(F.size(h)), lambda n: F.struct(n.alias("level"), F.filter(h, lambda t: stays(t, n)).alias("terms")))

    return let(term_hashes(text), cut)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents, summed in the map tasks first."""
    return docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts (sorted, distinct) at or below ``key``, by binary search."""
    if not cuts:
        return F.lit(0)
    values, steps = F.array(*[F.lit(c) for c in cuts]), [1 << b for b in reversed(range(len(cuts).bit_length()))]

    def step(at: Column, wide: Column) -> Column:
        return F.when(F.coalesce(F.get(values, at + wide - 1) <= key, F.lit(False)), at + wide).otherwise(at)

    return F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, n, doc_id, text, next_text, last): every document beside the one after it by (doc_id, text), the last beside the first.

    Documents are dealt into ranges of doc_id, cut at quantiles, numbered and looking one row ahead in their range; the last of a
    range takes the first of the next range that has rows, from a table of one row a range.
    """
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = keyed.select(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    keyed = keyed.withColumn("part", range_of(F.col("k"), sorted(set(cuts))))
    w = W.partitionBy("part").orderBy("k", "text")
    look = keyed.withColumns({"n": F.row_number().over(w), "after": F.lead("text").over(w)})
    least = keyed.groupBy("part").agg(F.min("k").alias("k"))
    firsts = keyed.join(F.broadcast(least), ["part", "k"]).groupBy("part").agg(F.min("text").alias("text"))  # broadcast: one row a range
    ring = W.orderBy("part")  # one row a range
    firsts = firsts.select("part", F.coalesce(F.lead("text").over(ring), F.first("text").over(ring)).alias("over"))
    return look.join(firsts, "part").select(
        "part", "n", "doc_id", "text", F.coalesce("after", "over").alias("next_text"), F.col("after").isNull().alias("last"))


def edited(text: Column, after: Column) -> Column:
    """The text whose last floor(n / 4) characters give way to as many of the next text's first, or to all of them."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))


def subset_hashes(terms: Column, level: Column) -> Column:
    """Two arrays, of density ``level`` and the next: per subset the hash of its sorted terms, or a mark for none."""

    def one(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(LEXICONS - 1)),
            lambda r: let(
                F.filter(found, lambda t: t.bitwiseAND(LEXICONS - 1) == r),
                lambda s: F.when(F.size(s) == 0, NONE).otherwise(F.right(F.concat(F.lit("0" * DIGITS), F.lower(F.hex(F.xxhash64(s)))), F.lit(DIGITS)))))

    return F.array(one(terms), one(F.filter(terms, lambda t: stays(t, level + 1))))


def print_of(found: Column, kind: int, level: Column) -> Column:
    """(level, subsets) of one of the row's texts. Terms of the band count; where it has none, all sampled terms do."""
    mine = F.filter(found, lambda x: x["mask"].bitwiseAND(kind) != 0)

    def hashed(m: Column) -> Column:
        band = F.filter(m, lambda x: x["band"])
        return subset_hashes(F.transform(F.when(F.size(band) > 0, band).otherwise(m), lambda x: x["term"]), level)

    return F.struct(level.alias("level"), let(mine, hashed).alias("subsets"))


def written(p: Column) -> Column:
    """The fingerprint as text: density, then the subsets of both densities."""
    return F.concat_ws("|", p["level"].cast("string"), F.array_join(p["subsets"][0], ","), F.array_join(p["subsets"][1], ","))


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with the same hash among those that either text has terms in, over the densities both are hashed at: an
    estimate of the share of terms in common. No common density, or no such subset there: 0; equal fingerprints: 1."""
    pairs = None
    for i in (0, 1):
        for j in (0, 1):
            z = F.when(a["level"] + i == b["level"] + j, F.arrays_zip(a["subsets"][i].alias("a"), b["subsets"][j].alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
            pairs = z if pairs is None else F.concat(pairs, z)

    def share(p: Column) -> Column:
        some = F.size(F.filter(p, lambda x: (x["a"] != NONE) | (x["b"] != NONE)))
        same = F.size(F.filter(p, lambda x: (x["a"] != NONE) & (x["a"] == x["b"])))
        return F.when(some == 0, 0.0).otherwise(same / some)

    return F.when(written(a) == written(b), 1.0).otherwise(let(pairs, share))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    docs: (doc_id, text); further columns are dropped. A null text is empty. A text without letters and digits is its own only
    term. Repeated rows stay rows and follow each other; documents with one id are ordered by text, a null id comes first.
    A single document is followed by itself; an empty table gives no rows. Equal texts have equal fingerprints.

    Built-ins only. One shuffle of the texts, by range of ids; one of the sampled terms by term, to meet the band; one of the same
    terms back to the range. A text has some 32 sampled terms or fewer, however long it is. Terms above the band, which could make
    a hot key, are broadcast: with m terms in the mean document there are m / MOST_SHARE of them at most. What they match goes to
    keys of its own in the join by term.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    lexicon = stored(document_frequencies(plain).filter(F.col("df") >= LEAST_DOCUMENTS), "lexicon")
    most = MOST_SHARE * plain.count()
    above = lexicon.filter(F.col("df") > most).select("term", F.lit(True).alias("above"))
    band = lexicon.filter(F.col("df") <= most).select(F.col("term").alias("key"), F.lit(True).alias("band"))

    rows = with_next(plain, 4 * partitions(docs.sparkSession)).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "part", "n", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        sampled(F.col("text")).alias("own"), sampled(F.col("edit")).alias("edited"), F.when(F.col("last"), sampled(F.col("next_text"))).alias("next"))
    names = {"own": OWN, "edited": EDITED, "next": NEXT}
    terms = {x: F.coalesce(F.col(f"{x}.terms"), F.array().cast("array<bigint>")) for x in names}
    mask = lambda t: sum((F.when(F.array_contains(terms[x], t), bit).otherwise(0) for x, bit in names.items()), F.lit(0))
    every = F.array_union(F.array_union(terms["own"], terms["edited"]), terms["next"])
    head = F.struct("doc_id", "n_chars", "edited_sha256", *[F.col(f"{x}.level").alias(x) for x in names])
    first = F.struct(F.lit(None).cast("long").alias("term"), F.lit(0).alias("mask"), head.alias("head"))
    cells = F.concat(F.array(first), F.transform(every, lambda t: F.struct(t.alias("term"), mask(t).alias("mask"), F.lit(None).cast(HEAD).alias("head"))))
    long = rows.select("part", "n", F.explode(cells).alias("c")).select("part", "n", "c.*").join(F.broadcast(above), "term", "left")
    key = F.when(F.col("term").isNull() | F.col("above"), F.xxhash64(F.lit("apart"), "part", "n", "term")).otherwise(F.col("term"))
    judged = long.withColumn("key", key).join(band, "key", "left")
    inside = F.coalesce(F.col("band") & F.col("above").isNull(), F.lit(False))
    cell = F.when(F.col("term").isNotNull(), F.struct("term", "mask", inside.alias("band")))
    whole = judged.select("part", "n", "head", cell.alias("cell")).repartition("part").groupBy("part", "n").agg(
        F.max("head").alias("head"), F.sort_array(F.collect_list("cell")).alias("found"))
    prints = whole.select("part", "n", "head", *[print_of(F.col("found"), bit, F.col(f"head.{x}")).alias(x) for x, bit in names.items()])
    after = F.lead("own").over(W.partitionBy("part").orderBy("n"))
    return prints.withColumn("after", F.coalesce(after, "next")).select(
        "head.doc_id", "head.n_chars", "head.edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
