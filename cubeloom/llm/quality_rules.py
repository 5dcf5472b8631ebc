"""Quality rules, line first (built-in functions only).

Every line is judged on its own: lines of navigation, of boilerplate, of shouting or of
symbols are removed.  Lines without an end mark that are too short for wrapped prose are
removed where two or more follow each other (menus; blank lines between them, up to two,
don't count); a single one may be a heading and stays.  A document is then rejected if it loses more than ``MOST_LOST`` of
its non-blank characters, or if a document rule (too few words, too much repetition)
fails on the input text.

Null text counts as empty: no words, rejected.  Null and repeated ids are kept, one result
per row.  An empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import SPACE_RE, WORD_RE, let, packed, text_or_empty, unpacked, words_of

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
MOST_LOST = 0.5
#: A line is navigation with this many separators between words.
LEAST_SEPARATORS = 3
NAVIGATION = "[|\\u00bb\\u203a\\u2022]"
#: Symbols that end or form words of junk lines, and shouting.
JUNK_WORD = "(?:[#*$%&<>|~^]{2,}|[A-Z]{2,}[,.]?!!)"
#: Punctuation and symbols of any script; a line is junk if they are over half of its characters, or over MOST_MARKS of it from LEAST_MARKS on.
MARKS = "[\\p{P}\\p{S}]"
LEAST_MARKS = 8
MOST_MARKS = 0.3
#: A line is shouting if so much of its cased letters is capitals, from LEAST_LETTERS on, or from LEAST_SHOUTED on where it has an exclamation mark.
MOST_CAPITALS = 0.7
#: Marks and capitals: separators, each junk word's last two symbols and all that punctuation rules count are among them.
SIGNS = "[\\p{P}\\p{S}\\p{Lu}]"
LEAST_LETTERS = 20
LEAST_SHOUTED = 8
#: What a line of prose ends with, closing marks aside; with commas and colons, after which prose goes on.
END_MARK = "[.!?\\u2026\\u3002\\uff01\\uff1f\\u0964\\u0965\\u061f\\u06d4,;:\\uff0c\\uff1a\\uff1b\\u3001\\u060c-][\\p{Pe}\\p{Pf}\\p{Pi}\"'*_\\x20\\x09-\\x0D]*$"
#: A line without an end mark is no part of a menu if it has so many words, or characters (scripts without spaces).
LEAST_LINE_WORDS = 6
LEAST_LINE_CHARS = 60
#: A line with a phrase of boilerplate is removed up to so many words and characters, or where phrases are so large a part of it.
MOST_PHRASE_WORDS = 20
MOST_PHRASE_CHARS = 200
LEAST_PHRASES = 0.25
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here to",
    "sign up for our newsletter",
    "share on facebook",
    "back to top",
)


def solid(text: Column) -> Column:
    """Number of characters that aren't blank."""
    return F.char_length(F.regexp_replace(text, SPACE_RE, ""))


def boilerplate(line: Column) -> Column:
    """Whether a line has a phrase of boilerplate and is short, or phrases are a large share of it: prose may mention one."""
    phrases = "(?i)" + "|".join(BOILERPLATE)
    rest = F.char_length(F.regexp_replace(line, phrases, ""))
    short = (F.char_length(line) <= MOST_PHRASE_CHARS) & (F.regexp_count(line, F.lit(WORD_RE)) <= MOST_PHRASE_WORDS)
    return line.rlike(phrases) & (short | (F.char_length(line) - rest >= F.char_length(line) * LEAST_PHRASES))


def mostly_marks(line: Column) -> Column:
    """Whether a line is mostly marks."""
    n_marks, n_solid = F.regexp_count(line, F.lit(MARKS)), solid(line)
    return (n_marks * 2 > n_solid) | ((n_marks >= LEAST_MARKS) & (n_marks > n_solid * MOST_MARKS))


def shouting(line: Column) -> Column:
    """Whether most of a line's cased letters are capitals."""
    capitals, letters = F.regexp_count(line, F.lit("\\p{Lu}")), F.regexp_count(line, F.lit("[\\p{Lu}\\p{Ll}]"))
    least = F.when(line.rlike("[!\\uff01]"), LEAST_SHOUTED).otherwise(LEAST_LETTERS)
    # Capitals alone rule out most lines: every match of the other letters would be copied.
    return (capitals > LEAST_SHOUTED * MOST_CAPITALS) & (letters >= least) & (capitals > letters * MOST_CAPITALS)


def stub(line: Column) -> Column:
    """Whether a line is short and without an end mark; null for a blank line."""
    short = (F.char_length(line) < LEAST_LINE_CHARS) & (F.regexp_count(line, F.lit(WORD_RE)) < LEAST_LINE_WORDS)
    return F.when(line.rlike(WORD_RE), short & ~line.rlike(END_MARK))


def in_menu(stubs: Column, i: Column) -> Column:
    """Whether line i and a non-blank line next to it are stubs."""
    before, after = (F.coalesce(*[F.get(stubs, i + side * k) for k in (1, 2, 3)], F.lit(False)) for side in (-1, 1))
    return F.get(stubs, i) & (before | after)


def bad_line(line: Column) -> Column:
    """Whether a non-blank line is to be removed: bad punctuation, navigation, boilerplate, or mostly junk words."""

    def by_signs(n: Column) -> Column:
        """The rules that need signs, each only where the line has enough of them."""
        n_words = F.regexp_count(line, F.lit(WORD_RE))
        n_separators = F.regexp_count(line, F.lit(NAVIGATION))
        nav = (n >= LEAST_SEPARATORS) & (n_separators >= LEAST_SEPARATORS) & (n_separators >= n_words / 4)
        junk = (n >= 2) & line.rlike(JUNK_WORD) & (F.regexp_count(line, F.lit(JUNK_WORD)) * 2 > n_words)
        marks = ((n >= LEAST_MARKS) | (n * 2 > solid(line))) & mostly_marks(line)
        return nav | junk | marks | ((n > LEAST_SHOUTED * MOST_CAPITALS) & shouting(line))

    return let(F.regexp_count(line, F.lit(SIGNS)), by_signs) | boilerplate(line)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Number of words in k-word windows (k a power of two) found at least twice in the array, first ones included."""

    def partial_double(step: int):
        def double(h: Column) -> Column:
            n = F.size(h) - step
            pairs = F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(1))), F.slice(h, step + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
            return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(pairs)

        return double

    def of_windows(w: Column) -> Column:
        def slow(w: Column) -> Column:
            placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def twins(p: Column) -> Column:
                same = F.transform(p, lambda x, i: F.when((x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]), x["i"]))
                return F.array_sort(F.array_compact(same))

            def cover(at: Column) -> Column:
                gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), at, lambda b, a: F.least(b - a, F.lit(k)))
                return F.aggregate(gaps, F.lit(0), lambda s, g: s + F.coalesce(g, F.lit(k)))

            return let(let(placed, twins), cover)

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(slow(w))

    h, step = F.transform(words, lambda x: F.xxhash64(x)), 1
    while step < k:
        h = let(h, partial_double(step))
        step *= 2
    return let(h, of_windows).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _clean (the text without bad lines), the counts of the rules, base_failed, lost and kept."""
    text = F.col("_text")
    step = docs.withColumn("_text", text_or_empty())
    step = step.withColumn("_words", words_of(text)).withColumn("_lines", F.split(text, "\n", -1))
    step = step.withColumn("_full", F.filter("_lines", lambda x: x.rlike(WORD_RE)))
    step = step.withColumn("_stubs", F.transform("_lines", stub))
    step = step.withColumn("_kept", F.filter("_lines", lambda x, i: ~x.rlike(WORD_RE) | ~(bad_line(x) | in_menu(F.col("_stubs"), i))))
    n_words = F.size("_words").cast("long")
    step = (
        step.withColumn("n_words", n_words)
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
        .withColumn("_clean", F.when(F.size("_kept") == F.size("_lines"), text).otherwise(F.array_join("_kept", "\n")))
    )
    lost = F.when(F.size("_kept") == F.size("_lines"), F.lit(0.0)).otherwise(1.0 - solid(F.col("_clean")) / F.greatest(F.col("word_chars"), F.lit(1)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    step = step.withColumn("lost", lost).withColumn("base_failed", failed)
    return step.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MOST_LOST)).drop("_text", "_words", "_lines", "_full", "_stubs", "_kept")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the rules' counts and the verdict."""
    return measured(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their bad lines; n_chars, where there is one, follows a changed text."""
    # As a generator's output: a condition on plain columns is pushed below them, and all they are made of is computed again, for every line.
    out = measured(packed(docs, "text")).select("_row", "text", F.inline(F.array(F.struct("_clean", "kept")))).where("kept")
    same = F.col("text") == F.col("_clean")
    n_chars = F.when(same, F.col("_row")["n_chars"]).otherwise(F.char_length("_clean").cast("long")) if "n_chars" in docs.columns else F.lit(None)
    return out.select(unpacked(docs, text=F.col("_clean"), n_chars=n_chars))
