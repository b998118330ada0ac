"""Line-first quality rules, in built-in expressions only.

Every line is judged on its own: symbols, navigation, shouting, stuttering, boilerplate phrases and missing
sentence punctuation. Failing lines are removed; a document that loses too much of its text that way, or fails
the plain counts over the whole text, is rejected. Everything about a document is worked out within its row, so
there is no shuffle and no join, whatever the sizes.

Defined results: a null text is an empty one; an empty or blank text has no words and is rejected; lines without
a word are neither judged nor counted; repeated rows are judged alike; an empty table gives an empty table; other
columns, whatever their names, pass through ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.columns import SPACE, let, trimmed, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected when its failing lines hold more than this share of its word characters.
MAX_LOSS_PERCENT = 40
WINDOW = 8

SYMBOLS = r"[^#*$%&|<>]+"
LINE_SYMBOLS = r"[^#*$%&|<>{}\\^~=_]+"
SEPARATORS = r"[^|»›•·]+"
BOILERPLATE = (
    r"(?i)(\bcookies?\b|\bjavascript\b|all rights reserved|privacy policy|terms of (use|service)|\bsubscribe\b"
    r"|\bsign (in|up)\b|\blog ?in\b|read more|click here|(licensed|released) under|\bcopyright\b|©)"
)
BOILERPLATE_WORDS = 20
SENTENCE_END = r"[.!?…。！？:;](?:[\"')\]»”’]|\x20)*(?:[\x20\x09-\x0D]|$)"


def _left(text: Column, others: str) -> Column:
    """How many characters are left when the runs of ``others`` go."""
    return F.length(F.regexp_replace(text, others, ""))


def repeat_words(w: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the list, first occurrence included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only lists with a repeated window pay
    for the sort that finds where the repeated ones are.
    """

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(z: Column) -> Column:
            def repeated(x: Column, k: Column) -> Column:
                before = F.get(z, k - 1)["g"]
                after = F.get(z, k + 1)["g"]
                return F.coalesce(x["g"] == before, F.lit(False)) | F.coalesce(x["g"] == after, F.lit(False))

            return F.sort_array(F.transform(F.filter(z, repeated), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(
                p, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1)))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

        return let(let(ordered, starts), total)

    def of_hashes(h: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )
        none = F.lit(0).cast("long")
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(covered(g)))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks one of the line rules."""

    def judged(t: Column, w: Column) -> Column:
        size = F.size(w)
        characters = _left(t, SPACE)
        symbols = _left(t, LINE_SYMBOLS) * 10 > characters
        separators = _left(t, SEPARATORS)
        navigation = (separators >= 2) & (separators * 4 >= size)
        upper = _left(t, r"\P{Lu}+")
        shouting = (upper >= 10) & (upper * 2 > _left(t, r"\P{L}+"))
        same = F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
        stutter = (size >= 5) & (same * 3 > size)
        boilerplate = (size <= BOILERPLATE_WORDS) & t.rlike(BOILERPLATE)
        unpunctuated = ~t.rlike(SENTENCE_END)
        return unpunctuated | symbols | navigation | shouting | stutter | boilerplate

    return let(trimmed(line), lambda t: let(F.split(t, SPACE), lambda w: judged(t, w)))


def assessment(text: Column) -> Column:
    """One struct with the counts, the line verdicts and the verdict on the document."""
    text = F.coalesce(text, F.lit(""))

    def with_lines(t: Column, lines: Column, w: Column) -> Column:
        spoken = F.filter(lines, lambda l: trimmed(l) != "")
        judged = F.transform(
            spoken, lambda l: F.struct(_left(l, SPACE).alias("chars"), line_fails(l).alias("fails"))
        )

        def result(spoken: Column, judged: Column) -> Column:
            failing = F.filter(judged, lambda j: j["fails"])
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                _left(t, SPACE).cast("long").alias("word_chars"),
                _left(t, SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long").alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                F.size(spoken).cast("long").alias("n_lines"),
                F.size(failing).cast("long").alias("n_failed_lines"),
                F.aggregate(failing, F.lit(0).cast("long"), lambda a, j: a + j["chars"]).alias("failed_chars"),
            )

        return let(spoken, lambda s: let(judged, lambda j: result(s, j)))

    counts = let(F.split(text, "\n"), lambda lines: let(words(text), lambda w: with_lines(text, lines, w)))

    def verdict(q: Column) -> Column:
        base_failed = (q["n_words"] < MIN_WORDS) | (
            q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT
        )
        loses = q["failed_chars"] * 100 > q["word_chars"] * MAX_LOSS_PERCENT
        return q.withField("base_failed", base_failed).withField("kept", ~base_failed & ~loses)

    return let(counts, verdict)


def cleaned(text: Column) -> Column:
    """The text without its failing lines; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.filter(lines, lambda l: (trimmed(l) == "") | ~line_fails(l)), "\n")


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_failed_lines", "failed_chars", "base_failed", "kept",
)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the columns of ``COUNTS`` for every row."""
    rows = docs.select(F.col(id_col), assessment(F.col(text_col)).alias("q"))
    return rows.select(F.col(id_col), *[F.col("q")[name].alias(name) for name in COUNTS])


def clean(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The documents that pass, without their failing lines; all columns stay, ``size_col`` follows the text."""
    hidden = "quality rules result"
    text = F.col(text_col)
    outcome = let(
        assessment(text),
        lambda q: F.struct(
            q["kept"].alias("kept"),
            F.when(q["kept"] & (q["n_failed_lines"] > 0), cleaned(text)).otherwise(text).alias("text"),
        ),
    )
    # Generated, not filtered: a filter would be pushed below the projection and run the rules twice.
    passed = docs.select("*", F.explode(F.filter(F.array(outcome), lambda q: q["kept"])).alias(hidden))
    new = {text_col: F.col(f"`{hidden}`.text")}
    if size_col in docs.columns:
        new[size_col] = F.length(F.col(f"`{hidden}`.text")).cast(docs.schema[size_col].dataType)
    return passed.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
