"""Quality rules and temperature mixing: counts against brute force, odd inputs, limits."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from namesieve.llm import quality_rules, temperature_mix

WORD = r"[^\x20\x09-\x0D]+"
ODD = [
    None, "", " \n\t ", "a b c d e f g h i a b c d e f g h", "x " * 60, "\n\na b\x0bc\n\n" + " z\n" * 3,
    "One two.\nOne two.\n\nThree.", "€ ü x # $ | <>", "w " + " ".join(f"n{i % 37}" for i in range(3000)),
]
CLEAN = "The river rose in the night, and by morning the lower fields were under water. " * 1 + (
    "Nobody was hurt.\nThe bridge held, though two of its planks were lost and had to be replaced in spring.\n"
    "People came from the next village to help with the animals, which took most of the day."
)


def base(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in quality_rules.assess(rows).collect():
        want = base(ODD[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (r.kept <= (not r.base_failed))


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("It rained all day, and nobody went out.", False),
        ("He said “no”.", False),
        ("Home | News | Sport | Weather | Contact", True),
        ("WHAT THEY SAID ABOUT THIS WAS NOT TRUE AT ALL!!", True),
        ("the the the the the the the the end.", True),
        ("and### so%%% it*** went&&& on$$$ for.### ever%%%", True),
        ("We use cookies to improve this site.", True),
        ("A title without an end", True),
        ("Was that 100% true? Yes.", False),
    ],
)
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "t string").select(quality_rules.line_fails(F.col("t"))).first()[0] is fails


def test_clean_keeps_good_documents_and_all_columns(spark):
    junk = "Home | News | Sport | Weather | Contact\n" * 9
    rows = [(1, CLEAN, "a", 7), (2, junk, "b", 7), (3, f"{CLEAN}\nRead more", None, 7), (None, CLEAN, "x", 7), (5, None, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars int")
    out = quality_rules.clean(docs, size_col="n_chars")
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(1, CLEAN, "a", len(CLEAN)), (3, CLEAN, None, len(CLEAN)), (None, CLEAN, "x", len(CLEAN))]
    assert got == sorted(want, key=str)
    assert quality_rules.clean(docs.limit(0)).count() == 0 and quality_rules.assess(docs.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, capsys):
    docs = spark.createDataFrame([(1, CLEAN, "a")], "doc_id long, text string, source string")
    for df in (quality_rules.assess(docs), quality_rules.clean(docs), temperature_mix.mix(docs)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def corpus(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(600)]
    rows += [(1000 + i, "w w", "small") for i in range(9)] + [(2000, None, "empty"), (2001, " ", "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_default_mix_uses_everything_within_the_limit(spark):
    docs, rows = corpus(spark)
    out = temperature_mix.mix(docs.withColumn("weight", F.lit("own")), max_repeats=3.0)
    assert out.columns == ["doc_id", "text", "source", "weight", "mixed"]
    got = collections.Counter(r.doc_id for r in out.collect())
    assert set(got) == {r[0] for r in rows} and max(got.values()) <= 3
    assert {got[i] for i, _, s in rows if s == "big"} == {1} and {got[i] for i, _, s in rows if s == "empty"} == {1}
    plan = {r.source: r for r in out.select("source", "mixed.weight", "mixed.epochs").distinct().collect()}
    assert plan["small"].epochs == pytest.approx(3.0, abs=1e-6) and plan["big"].epochs == 1.0
    assert sum(r.weight for r in plan.values()) == pytest.approx(1.0)


def test_entropy_target_and_budget(spark):
    docs, rows = corpus(spark)
    weights = {r.source: r.weight for r in temperature_mix.mix(docs, entropy=1.2).select("source", "mixed.weight").distinct().collect()}
    assert -sum(w * math.log(w) for w in weights.values() if w) == pytest.approx(1.2, abs=1e-6)
    part = temperature_mix.mix(docs, budget=300, max_repeats=1.0)
    tokens = sum(len((r.text or "").split()) for r in part.collect())
    assert 150 < tokens <= 300


def test_mix_of_nothing_and_of_repeated_rows(spark):
    docs, _ = corpus(spark)
    assert temperature_mix.mix(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b", None)] * 4, "doc_id long, text string, source string")
    assert temperature_mix.mix(same).count() == 4
