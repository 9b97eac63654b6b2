"""Brand joins against a scan of the whole dictionary."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrain.functions import fuzzy
from tallygrain.functions.text import fold
from tallygrain.operators import brands
from tallygrain.plans import match


def names_of(spark, names):
    return brands.dictionary(spark.createDataFrame([(n,) for n in names], "brandname_en string"))


def ordered(names):
    return sorted({n.strip() for n in names if n and n.strip()}, key=lambda b: (-len(b), b.lower(), b))


def scan(text, names):
    """One alternation of all names, longest first, whole words only."""
    table = {}
    for n in ordered(names):
        table.setdefault(fold(n), n)
    found = re.findall(r"(?<!\w)(" + "|".join(re.escape(k) for k in sorted(table, key=lambda k: (-len(k), k)) if k) + r")(?!\w)", fold(text))
    return list(dict.fromkeys(table[k] for k in found))


def literal(spark, texts, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return [r.b for r in brands.with_brands(df, "t", names_of(spark, names), "b", literal=True).orderBy("i").collect()]


def test_literal_names(spark):
    names = ["Tetley", "Tropical", "Coca-Cola", "3M", "L'Oréal", "C++", "  ", None, "Acme", "Acme Tools", "tools"]
    texts = ["Tetley 20 Supergreen Tropical Tea", "loreal shampoo L'ORÉAL", "x3M 3m tape", "", None, "c++ book", "acme tools, ACME; toolss Acme", "coca-cola-x cocacola", "c+++ xc++", "tools acme tools tools"]
    want = [["Tetley", "Tropical"], ["L'Oréal"], ["3M"], [], [], ["C++"], ["Acme Tools", "Acme"], ["Coca-Cola"], ["C++"], ["tools", "Acme Tools"]]
    assert literal(spark, texts, names) == want
    assert [scan(t, names) for t in texts if t] == [w for t, w in zip(texts, want) if t]
    assert literal(spark, ["a b"], []) == [[]] and literal(spark, [], ["a"]) == []


def test_literal_names_are_the_alternations(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice(["a", "b", "ab", "é", " ", "-", "+", "'", "7", "  "]) for _ in range(rng.randint(1, n)))
    names = [piece(5) for _ in range(120)]
    texts = [piece(30) for _ in range(300)]
    assert literal(spark, texts, names) == [scan(t, names) if t.strip() else [] for t in texts]


def test_a_million_names(spark):
    """No pattern, no literal and no driver's list of names: the search is a join."""
    names = spark.range(1_000_000).select(F.concat(F.lit("Brand "), F.hex("id")).alias("brandname_en"))
    df = spark.createDataFrame([(i, f"new brand {i:X}, brand {i:x}00 box") for i in range(0, 4000, 7)], "i int, t string")
    got = brands.with_brands(df, "t", brands.dictionary(names), "b", literal=True).collect()
    assert len(got) == 572 and all(r.b == [f"Brand {r.i:X}", f"Brand {r.i:X}00"][: 2 if 0 < r.i * 256 < 1_000_000 else 1] for r in got)


def nearest_scan(text, names, cutoff):
    """All names scored, the first of the best."""
    f = " ".join(fold(text).split())
    best = (cutoff, None)
    for n in ordered(names):
        if len(n) >= 4 and re.search("[A-Za-z]", n):
            s = fuzzy.weighted_ratio(f, " ".join(fold(n).split()))
            if s > best[0] or s == best[0] and best[1] is None:
                best = (s, n)
    return best[1]


@pytest.mark.parametrize("cutoff", [88, 93, 86])
def test_nearest_names_are_a_full_scans(spark, cutoff):
    rng = random.Random(cutoff)
    syllables = ["ber", "ley", "ton", "vic", "ström", "ma", "ko", "Ha", "al", "7", "-"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    name = lambda: " ".join(word() for _ in range(rng.choice([1, 1, 2, 3])))
    names = [name() for _ in range(150)] + ["tom tom", "ber ber ber ley", "".join(word() for _ in range(14)), " ".join(word() for _ in range(16)), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = []
    for _ in range(260):
        t = list(rng.choice(names))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", " "])
        t = "".join(t)
        texts.append(rng.choice([t, " ".join(rng.sample(t.split(), len(t.split()))), t + " " + word(), "zz" + t + "yyyyyyyyyy", t[: rng.randint(1, 9)], name(), "  " + t.upper() + "  "]))
    texts += ["b", "é", "tom", "tom tom tom", "ley ber", "a" * 31, "a" * 70, "7777", "   "]
    texts = list(dict.fromkeys(texts))
    got = {r.text: r.name for r in brands.nearest_names(spark.createDataFrame([(t,) for t in texts], "text string"), names_of(spark, names), cutoff).collect()}
    want = {t: n for t in texts if (n := nearest_scan(t, names, cutoff)) is not None and t.strip()}
    assert got == want
    assert len(want) > 60


def test_a_cutoff_that_pairs_cannot_vouch_for_is_refused(spark):
    with pytest.raises(ValueError):
        brands.nearest_names(spark.createDataFrame([("a",)], "text string"), names_of(spark, ["abcd"]), 70)


def test_brands_in_order_of_trust(spark):
    df = spark.createDataFrame([("Tetley tea", None), ("Tetly", None), ("ACME thing", None), ("12 thing", None), ("x", " Own "), ("Tetley", "  "), (None, None)], "t string, s string")
    got = brands.with_brands(df, "t", names_of(spark, ["Tetley"]))
    rows = {r.t: r.b for r in got.select("t", match.supplied_or(F.col("s"), F.col("brands")).alias("b")).collect()}
    assert rows == {"Tetley tea": ["Tetley"], "Tetly": ["Tetley"], "ACME thing": ["ACME"], "12 thing": [], "x": ["Own"], "Tetley": [], None: []}


def test_the_dictionary_and_its_order(spark):
    names = names_of(spark, [" Ab ", "Abc", None, "", "Abc", "1234", "abd", "Zyxw", "ÄB"])
    got = [(r.name, r.fuzzy_safe) for r in brands.positions(names).orderBy("position").collect()]
    assert got == [("1234", False), ("Zyxw", True), ("Abc", False), ("abd", False), ("Ab", False), ("ÄB", False)]


def test_scores_of_batches_are_those_of_pairs():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, n)))
    pairs = [(a, "".join(c for c in a if rng.random() < 0.9) + rng.choice(["", " x", "aa"]) if rng.random() < 0.5 else word(90)) for a in (word(rng.choice([3, 12, 40, 64, 65, 90])) for _ in range(1500))]
    assert list(fuzzy.weighted_ratios(pairs)) == pytest.approx([fuzzy.weighted_ratio(*p) for p in pairs])
    assert list(fuzzy.weighted_ratios([])) == []


def test_few_pairs_are_scored(spark, monkeypatch):
    """Names of few syllables have many letter pairs in common; texts are not scored against a share of them all."""
    rng = random.Random(11)
    part = lambda *n: "".join(rng.choice(["ley", "ber", "ström", "vic", "son", "ren", "ma", "ko", "lo", "gu", "ni", "ez", "ham", "or"]) for _ in range(rng.choice(n)))
    names = sorted({f"{part(2, 3)} {part(3)}".title() for _ in range(200)})
    texts = [[n + "q", f"##{n}qqqq,qqqqqqqqqqqqq", " ".join(reversed(n.split())), n.upper(), f"??{i}??"][i % 5] for i, n in enumerate(names)]
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series(fuzzy.weighted_ratios(list(zip(a.map(fold), b.map(fold)))))

    monkeypatch.setattr(brands, "weighted_ratio_udf", counted)
    got = {r.text: r.name for r in brands.nearest_names(spark.createDataFrame([(t,) for t in texts], "text string"), names_of(spark, names)).collect()}
    assert got == {t: w for t in texts if (w := nearest_scan(t, names, 88)) is not None}
    assert len(got) > 0.75 * len(texts) and scored.value < 10 * len(texts)
