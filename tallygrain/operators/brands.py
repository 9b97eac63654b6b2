"""Brand names in texts, as joins: the dictionary is a table, never held in a driver or a plan.

Texts and names are cut into atoms, runs of word characters and single other characters. A name stands in a text as a whole word
exactly where its atoms follow one another there and, at an end that is no word character, none follows or precedes. So
whole-word search of any number of names is an equality join on runs of atoms.

The nearest name of a text is a similarity join, at a high cutoff first and at the lower one for texts without a name there. At a
cutoff, a known number of letters differs at most. So where a name is cut into one piece more, one piece stands in the text about
where it stands in the name, and pairs are joined by pieces; by rare words or runs of letters where words or windows are compared.
Only pairs that survive a bound are scored. Nothing that could reach the cutoff is left out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain import config
from tallygrain.functions.fuzzy import weighted_ratio_udf
from tallygrain.functions.text import leading_token, normalize
from tallygrain.session import saved

#: A run of word characters, or one other character.
ATOM = r"(?U)\w+|[^\w]"
#: Cutoffs below this let scores of unequal lengths in that no letter pairs vouch for.
LEAST_CUTOFF = 86.0
#: What the scorer takes off for other orders of words, and for texts of half as long again and more.
ORDERED, UNEVEN = 0.95, 0.9
#: Texts are first held against names at these, for a higher cutoff leaves far fewer pairs.
CUTOFFS = (95.0,)
#: Letters of the runs that lead from a text to longer ones.
GRAM = 6
#: Dictionaries of so many names at most are broadcast.
FEW = 10_000
EVEN = "2 * greatest(size_a, size_b) < 3 * least(size_a, size_b)"


def dictionary(brands: DataFrame, column: str = "brandname_en") -> DataFrame:
    """name (trimmed, distinct, not blank), folded (accents off, lower case) and fuzzy_safe (four characters and a letter)."""
    names = brands.select(F.trim(F.col(column).cast("string")).alias("name")).where("name <> ''").distinct()
    return names.select("name", normalize(F.col("name")).alias("folded"), ((F.length("name") >= 4) & F.col("name").rlike("[A-Za-z]")).alias("fuzzy_safe"))


def order(name: Column) -> Column:
    """The dictionary's order: longest first, then by letters."""
    return F.struct((-F.length(name)).alias("shorter"), F.lower(name).alias("low"), name.alias("name"))


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def with_spellings(rows: DataFrame, column: str) -> DataFrame:
    """The rows with what searches in a dictionary of a column's names tell for each: folded; literal_name, of names that are alike
    but for case and accents; nearest_name, of those that are alike but for blanks too."""
    rows = rows.withColumn("folded", normalize(F.trim(column)))
    first = lambda *key: F.min_by(F.trim(column), order(F.trim(column))).over(Window.partitionBy(*key))
    return rows.withColumn("literal_name", first("folded")).withColumn("nearest_name", first(squeezed(F.col("folded"))))


def positions(names: DataFrame) -> DataFrame:
    """Each name's position, from 1, in the dictionary's order; lengths are ranked apart, so no task sorts all names."""
    lengths = names.groupBy(F.length("name").alias("size")).agg(F.count("*").alias("n"))
    longer = lengths.select("size", (F.sum("n").over(Window.orderBy(F.desc("size"))) - F.col("n")).alias("before"))  # a row for each length
    own = F.row_number().over(Window.partitionBy(F.length("name")).orderBy(F.lower("name"), "name"))
    return names.withColumn("own", own).withColumn("size", F.length("name")).join(longer, "size").withColumn("position", (F.col("before") + F.col("own")).cast("long")).drop("own", "size", "before")


def is_word(atom: Column) -> Column:
    return F.coalesce(atom.rlike(r"(?U)^\w"), F.lit(False))


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides both go through a shuffle: texts and dictionaries grow, and the driver would hold what is broadcast."""
    return left.join(right.hint("merge"), on, how)


def literal_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, brands: of distinct texts, those in which names stand as whole words, with the names' longest spellings.

    From the left, the longest name at a place, then on behind it; a name once. Columns: text; name and folded.
    """
    atoms = lambda c: F.regexp_extract_all(c, F.lit(ATOM), F.lit(0))
    table = names.where("folded <> ''").groupBy("folded").agg(F.min_by("name", order(F.col("name"))).alias("name"))
    table = table.select("folded", "name", atoms(F.col("folded")).alias("a")).select("folded", "name", F.size("a").alias("n"), F.col("a")[0].alias("first"))
    lengths = table.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    many, most = table.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    among = met if many > FEW else lambda x, y, on: x.join(F.broadcast(y), on)
    cut = texts.select("text", atoms(normalize(F.col("text"))).alias("all"))
    at = lambda i: F.get(F.col("all"), i)
    # at each atom, as many as the longest name has and one more
    places = F.transform(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.struct(i.alias("i"), at(i).alias("first"), is_word(at(i - 1)).alias("behind"), F.slice("all", i + 1, most + 1).alias("run")))
    places = cut.where(F.size("all") > 0).select("text", F.explode(F.filter(places, lambda p: p["first"] != " ")).alias("p")).select("text", "p.*")
    runs = among(places, lengths, "first").select("text", "i", "first", "behind", "run", F.explode("lengths").alias("n")).where("n <= size(run)")
    starts = is_word(F.col("first")) | ~F.col("behind")
    ends = is_word(F.get("run", F.col("n") - 1)) | ~is_word(F.get("run", F.col("n")))
    runs = runs.where(starts & ends).select("text", "i", "n", F.array_join(F.slice("run", F.lit(1), F.col("n")), "").alias("folded"))
    found = among(runs, table.select("folded", "name"), "folded").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("i", (-F.col("n")).alias("shorter"), "name"))).alias("m"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    step = lambda s, m: F.when(m["i"] >= s["end"], F.struct((m["i"] - m["shorter"]).alias("end"), F.concat(s["names"], F.array(m["name"])).alias("names"))).otherwise(s)
    return found.select("text", F.array_distinct(F.aggregate("m", none, step)["names"]).alias("brands"))


def whole(x: Column) -> Column:
    """The floor of a bound that a pair may just reach."""
    return F.floor(x + 1e-9).cast("int")


def pieces(rows: DataFrame, n: Column) -> DataFrame:
    """The rows (f, size) for each of n pieces of f of about equal length, with i, at (from 0) and length."""
    cut = lambda i: F.floor(i * F.col("size") / F.col("n")).cast("int")
    rows = rows.withColumn("n", n.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.withColumn("at", cut(F.col("i"))).withColumn("length", cut(F.col("i") + 1) - F.col("at")).drop("n")


def alike(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b: all pairs whose plain ratio is the cutoff or more, and few others. Columns of each side: f, size; more of them stay, by
    their own names.

    At a ratio of c, (1 - c) of both lengths are letters to delete or insert at most. The right text is cut into one piece more than
    that; one of them stands in the left text as it is, moved by no more letters than are inserted or deleted before it.
    """
    c = cutoff / 100
    faults = lambda size: whole(2 * (1 - c) / c * size)
    index = pieces(right, faults(F.col("size")) + 1).withColumn("piece", F.substring(F.col("f"), F.col("at") + 1, F.col("length")))
    index = index.drop("at", "length").withColumnRenamed("f", "b").withColumnRenamed("size", "size_b")
    sizes = F.sequence(F.ceil(F.col("own") * (c / (2 - c)) - 1e-9).cast("int"), whole(F.col("own") * ((2 - c) / c)))
    asked = left.withColumnRenamed("f", "a").withColumnRenamed("size", "own").withColumn("size", F.explode(sizes))
    asked = pieces(asked, faults(F.col("size")) + 1).withColumn("d", whole((1 - c) * (F.col("own") + F.col("size")))).withColumn("longer", F.col("own") - F.col("size"))
    moves = F.sequence(-F.floor((F.col("d") - F.col("longer")) / 2), F.floor((F.col("d") + F.col("longer")) / 2))
    asked = asked.withColumn("move", F.explode(moves)).withColumn("at", (F.col("at") + F.col("move")).cast("int")).where("at >= 0 AND at + length <= own")
    asked = asked.withColumn("piece", F.substring(F.col("a"), F.col("at") + 1, F.col("length"))).withColumnRenamed("size", "size_b").drop("at", "length", "longer", "move")
    pairs = met(asked, index, ["size_b", "i", "piece"]).where(F.expr("levenshtein(a, b, d)") >= 0)
    return pairs.drop("size_b", "i", "piece", "d").withColumnRenamed("own", "size_a")


def worded(rows: DataFrame) -> DataFrame:
    """f, size, words (distinct) and their length q, with a blank between each two."""
    rows = rows.select("f", "size", F.array_distinct(F.split("f", " ")).alias("words"))
    return rows.withColumn("q", F.length(F.array_join("words", " ")))


def rarest_first(rows: DataFrame, key: list[str], what: str, others: DataFrame) -> DataFrame:
    """The rows with rarity, in how many of the others what stands."""
    return met(rows, others.groupBy(what).agg(F.count("*").alias("rarity")), what, "left").fillna(0, ["rarity"])


def held_words(own: DataFrame, other: DataFrame, cutoff: float) -> DataFrame:
    """x, y: pairs of like lengths of which y has so many words of x that those against all of x reach the cutoff.

    Words of x that y lacks are 2 (1 - c) / (2 - c) of x at most. With the rarest words first, y has one of those that begin within.
    """
    c = cutoff / 100
    lacking = 2 * (1 - c) / (2 - c) * F.col("q") + 1e-9
    each = other.select(F.col("f").alias("y"), F.col("size").alias("size_b"), F.col("words").alias("others"), F.explode("words").alias("word"))
    rows = rarest_first(own.select("f", "size", "words", "q", F.explode("words").alias("word")), ["f"], "word", each)
    before = F.sum(F.length("word") + 1).over(Window.partitionBy("f").orderBy("rarity", "word").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") <= lacking) & (F.col("rarity") > 0)).select(F.col("f").alias("x"), F.col("size").alias("size_a"), "words", "q", "word")
    lacked = F.aggregate(F.array_except("words", "others"), F.lit(0), lambda n, w: n + F.length(w) + 1)
    return met(rows, each, "word").where(EVEN).where(lacked <= lacking).select("x", "y")


def like_rests(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b: pairs of like lengths that share a word and are alike, at the cutoff, with the common words first and the others behind.

    They differ in so many letters, of any order, at most; with the alphabet dealt to one group more, those of a group are the same.
    """
    c = cutoff / 100
    groups = lambda q: whole(2 * (1 - c) / c * q) + 1
    least, most = whole(F.ceil(F.col("q") * (c / (2 - c)) - 1e-9)), whole(F.col("q") * ((2 - c) / c))

    def keyed(rows: DataFrame, s: str) -> DataFrame:
        """A row for each word and group; of n groups."""
        letters = F.array_sort(F.filter(F.split(F.array_join("words", ""), ""), lambda x: x != ""))
        rows = rows.withColumn("letters", letters).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        rows = rows.withColumn("same", F.array_join(F.filter("letters", lambda x: F.crc32(x.cast("binary")) % F.col("n") == F.col("g")), ""))
        return rows.select(F.col("f").alias(s), F.col("size").alias(f"size_{s}"), F.col("words").alias(f"words_{s}"), F.col("q").alias(f"q_{s}"), "n", "g", "same", F.explode("words").alias("word"))

    asked = keyed(left.withColumn("n", F.explode(F.sequence(groups(least), groups(most)))), "a")
    pairs = met(asked, keyed(right.withColumn("n", groups(F.col("q"))), "b"), ["n", "g", "same", "word"]).where(EVEN)
    rest = lambda s, o: F.array_join(F.array_sort(F.array_except(f"words_{s}", f"words_{o}")), " ")
    pairs = pairs.withColumn("d", whole((1 - c) * (F.col("q_a") + F.col("q_b")))).withColumn("x", rest("a", "b")).withColumn("y", rest("b", "a"))
    return pairs.where(F.expr("levenshtein(x, y, d)") >= 0).select("a", "b")


def grams(rows: DataFrame, sizes: Column) -> DataFrame:
    """The rows (piece) for each distinct run of letters of each of some sizes that a piece has: gram."""
    every = lambda n: F.transform(F.sequence(F.lit(1), F.length("piece") - n + 1), lambda i: F.substring(F.col("piece"), i, n))
    each = F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length("piece")), every))
    return rows.withColumn("gram", F.explode(F.array_distinct(each)))


def windows(own: DataFrame, other: DataFrame, cutoff: float) -> DataFrame:
    """x, y: pairs of which y is longer by half to eight times and may have a window like x at the cutoff.

    x is cut into one piece more than faults are allowed; one stands in y, with its rarest run of letters.
    """
    c = cutoff / 100
    cut = pieces(own.select("f", "size"), whole(2 * (1 - c) * F.col("size")) + 1).withColumn("piece", F.substring(F.col("f"), F.col("at") + 1, F.col("length")))
    cut = grams(cut.withColumn("k", F.least(F.length("piece"), F.lit(GRAM))), F.array("k"))
    sizes = [r.k for r in cut.select("k").distinct().collect()]  # GRAM of them at most
    long = other.select(F.col("f").alias("y"), F.col("size").alias("longer"), F.col("f").alias("piece"))
    long = grams(long, F.array(*[F.lit(k) for k in sizes]) if sizes else F.array().cast("array<int>")).drop("piece")
    rare = rarest_first(cut, ["f"], "gram", long).groupBy("f", "size", "i").agg(F.min_by(F.struct("gram", "piece"), F.struct("rarity", "gram")).alias("r"))
    rare = rare.select(F.col("f").alias("x"), "size", "r.*")
    return met(rare, long, "gram").where("2 * longer >= 3 * size AND longer <= 8 * size").where(F.contains("y", "piece")).select("x", "y")


def candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b: all pairs that score the cutoff or more, each once, and few others. Columns of each side: f, size."""
    found = [alike(left, right, cutoff).select("a", "b")]
    a, b = worded(left), worded(right)
    if (c := cutoff / ORDERED) <= 100 + 1e-9:
        c = min(c, 100.0)
        ordered = lambda rows, s: rows.select(F.col("f").alias(s), F.array_join(F.array_sort(F.split("f", " ")), " ").alias("f"), "size")
        pairs = alike(ordered(left, "told_a"), ordered(right, "told_b"), c)
        found.append(pairs.select(F.col("told_a").alias("a"), F.col("told_b").alias("b")))
        found.append(held_words(a, b, c).select(F.col("x").alias("a"), F.col("y").alias("b")))
        found.append(held_words(b, a, c).select(F.col("y").alias("a"), F.col("x").alias("b")))
        if c < 100:
            found.append(like_rests(a, b, c))
    if (c := cutoff / UNEVEN) <= 100 + 1e-9:
        c = min(c, 100.0)
        found.append(windows(left, right, c).select(F.col("x").alias("a"), F.col("y").alias("b")))
        found.append(windows(right, left, c).select(F.col("y").alias("a"), F.col("x").alias("b")))
    return functools.reduce(DataFrame.unionAll, found).distinct()


def nearest_names(texts: DataFrame, names: DataFrame, cutoff: float = config.FUZZY_SAME) -> DataFrame:
    """text, name, score: of distinct texts, those that have a fuzzy-safe name at the cutoff or above, and the best of them, the
    first in the dictionary's order of equals.

    Columns: text; name, folded and fuzzy_safe. Texts that have a name at a higher cutoff are done with: no other name is better than
    all that reach it.
    """
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"names are found from a score of {LEAST_CUTOFF} on")
    sized = F.length("f").alias("size")
    left = saved(texts.select(squeezed(normalize(F.col("text"))).alias("f")).where("f <> ''").distinct().select("f", sized), "texts")
    right = names.where("fuzzy_safe").groupBy(squeezed(F.col("folded")).alias("f")).agg(F.min_by("name", order(F.col("name"))).alias("name")).where("f <> ''")
    right = saved(right.select("f", sized, "name"), "names")
    told = [saved(met(left, right.drop("size"), "f").select("f", "name", F.lit(100.0).alias("score")), "equal")]
    for c in sorted({*CUTOFFS, cutoff}, reverse=True):
        if c < cutoff:
            break
        left = saved(met(left, told[-1].select("f"), "f", "left_anti"), "texts")
        if left.isEmpty():
            break
        scored = candidates(left, right.select("f", "size"), c).withColumn("score", weighted_ratio_udf("a", "b")).where(F.col("score") >= c)
        best = met(scored, right.select(F.col("f").alias("b"), "name"), "b").groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("worse"), order(F.col("name")).alias("o"))).alias("x"))
        told.append(saved(best.select(F.col("a").alias("f"), F.col("x.o.name").alias("name"), (-F.col("x.worse")).alias("score")), "nearest"))
    return met(texts.select("text", squeezed(normalize(F.col("text"))).alias("f")), functools.reduce(DataFrame.unionAll, told), "f").select("text", "name", "score")


def near_turned(rows: DataFrame) -> DataFrame:
    """key: of distinct texts (key) with their words in another order (turned), those to whose turned form another text is as near.

    A text itself scores ORDERED of 100 with it. Another of like length does so if one of the two has all words of the other, or may do
    so if it is alike as it stands.
    """
    words = worded(saved(rows.select(F.col("key").alias("f"), F.length("key").alias("size")).distinct(), "keys"))
    within = held_words(words, words, 100.0).where("x != y").select(F.explode(F.array("x", "y")).alias("key"))
    turned = rows.select(F.col("turned").alias("f"), F.length("turned").alias("size"), "key").where("f <> ''")
    beside = alike(turned, words.select("f", "size"), 100 * ORDERED).where("b != key").select("key")
    return within.unionAll(beside).distinct()


def brands_of(texts: DataFrame, names: DataFrame, cutoff: float = config.FUZZY_SAME) -> DataFrame:
    """text, brands of each distinct text: all literal names, else the nearest one, else a leading word in capitals, else none."""
    texts = saved(texts.select("text").where("text <> ''").distinct(), "texts")
    names = saved(names, "names")
    literal = saved(literal_matches(texts, names), "literal")
    rest = met(texts, literal, "text", "left_anti")
    near = nearest_names(rest, names, cutoff).select("text", F.array("name").alias("near"))
    return met(met(texts, literal, "text", "left"), near, "text", "left").select("text", F.coalesce("brands", "near", leading_token(F.col("text"))).alias("brands"))


def with_brands(rows: DataFrame, text: str, names: DataFrame, out: str = "brands", literal: bool = False) -> DataFrame:
    """The rows with the brands of a text column (none: an empty array); each distinct text is searched once.

    literal: only names that stand in the text as they are.
    """
    texts = rows.select(F.col(text).alias("text")).where("text <> ''").distinct()
    found = literal_matches(texts, names) if literal else brands_of(texts, names)
    found = found.select(F.col("text").alias("brands_text"), F.col("brands").alias(out))
    joined = met(rows, found, F.col(text) == F.col("brands_text"), "left").drop("brands_text")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
