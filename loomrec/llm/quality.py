"""Line-first quality cleaning: judge each line, remove the failures, reject documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import let, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Shares and counts of the line rules.
MAX_LOSS = 0.5
MAX_MARKED_WORDS = 0.3
MIN_SEPARATORS = 3
MIN_UNFINISHED_WORDS = 8
MIN_SHOUTED = 20
MAX_SHOUTED = 0.7
#: Marks between menu items; characters that may end a sentence.
SEPARATORS = "|•·»"
ENDINGS = list(""".!?…:;"'”’»)]。！？""")
#: Phrases of page furniture, lower case, matched anywhere in a line of at most this many words.
BOILERPLATE_WORDS = 30
BOILERPLATE = [
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot password",
    "log in to", "lorem ipsum", "privacy policy", "read more", "share this", "sign up", "skip to content",
    "subscribe to", "terms of service", "terms of use", "use of cookies", "we use cookies",
]


def _count(line: Column, chars: str) -> Column:
    return F.char_length(line) - F.char_length(F.translate(line, chars, ""))


def line_fails(line: Column, furnished: Column) -> Column:
    """True if any rule rejects the line, which has a word: navigation (separators between short items), punctuation
    (marked words, shouting, unfinished sentences) or boilerplate phrases.

    furnished: whether the text holds any boilerplate phrase at all. Words are counted only behind cheap tests.
    """
    n = F.size(words_of(line))
    separators = _count(line, SEPARATORS)
    marked = F.size(F.split(line, r"[#*$%&<>!?]{2,}(?=[\s.,;:]|$)")) - 1
    upper = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    letters = F.char_length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    last = F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1)
    return (
        (~last.isin(*ENDINGS) & (n >= MIN_UNFINISHED_WORDS))
        | ((separators >= MIN_SEPARATORS) & (separators * 5 >= n))
        | (line.rlike("[#*$%&<>!?]{2}") & (marked > n * MAX_MARKED_WORDS))
        | (line.rlike(r"\p{Lu}{3}") & (letters >= MIN_SHOUTED) & (upper > letters * MAX_SHOUTED))
        | (furnished & line.rlike("(?i)" + "|".join(BOILERPLATE)) & (n <= BOILERPLATE_WORDS))
    )


def has_furniture(text: Column) -> Column:
    def any_phrase(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(low, F.lit(phrase))
        return found

    return let(F.lower(text), any_phrase)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are 64-bit hashes chained word by word; only
    texts with a repeat sort them."""

    def covered(found: Column) -> Column:
        m = F.size(found)
        steps = F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.least(F.lit(3), F.get(found, k) - F.get(found, k - 1)))
        return F.when(m == 0, F.lit(0)).when(m == 1, F.lit(3)).otherwise(F.aggregate(steps, F.lit(3), lambda a, x: a + x))

    def sort_and_cover(windows: Column) -> Column:
        def near(s: Column, j: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            return same(j, j - 1) | same(j, j + 1)

        tagged = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(
            F.sort_array(tagged),
            lambda s: let(
                F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(near(s, j), x["i"])), lambda i: i.isNotNull())), covered
            ),
        )

    def count(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(
            let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(sort_and_cover(h)))
        )

    return let(words, count)


def line_first_clean(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Adds the base counts, ``clean_text`` (the lines that pass, in order), ``kept_chars`` and the verdict ``kept``.

    Every expression is a built-in evaluated row by row: no shuffle, no Python, memory in proportion to one text. A null
    or empty text has no words, fails the base rule (n_words < 50) and cleans to the empty text. Repeated rows and other
    columns change nothing; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)
    counted = docs.select(
        *keep,
        let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.char_length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        _count(body, SYMBOLS).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: let(
                has_furniture(body),
                lambda known: F.struct(
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                    F.array_join(F.filter(x, lambda y: ~line_fails(y, known)), "\n").alias("clean"),
                ),
            ),
        ).alias("l"),
    )
    flat = counted.select(
        *keep, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"), F.col("l.clean").alias("clean_text"),
    )
    return (
        flat.withColumn("kept_chars", F.char_length(F.translate("clean_text", SPACES, "")).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= (1 - MAX_LOSS) * F.col("word_chars")))
    )
