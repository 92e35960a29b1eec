"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a list of template tokens: numbers, capitalised words and units after a number
are replaced by typed placeholders, other words are lower-cased. Windows of WINDOW template
tokens are hashed, and documents look up all their windows among all windows of the benchmark.
For the documents with a hit, windows on one diagonal (position in the document less position in
the item) belong to one copy. A copy counts if it shares enough windows and its slots are
consistent: a value of the item always stands for one value in the document. So a question with
other names and numbers is found, and a chance likeness of placeholders is not.

A window with under MIN_LITERAL plain words says too little as a template: any row of numbers
would fit. It is compared by its words, so an identical row of sums is found. An item shorter
than a window is one window of its own length and is found anywhere in a text, but an item of
under MIN_ITEM tokens only as the whole text.

Null and empty texts have no windows. Rows without doc_id and items without item_id are not
reported; repeated rows are one document, texts of one doc_id are judged apart. Empty tables
give an empty result. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.llm.common import is_small, materialize, text_column, without_ids
from cellweek.operators.skew import lookup_join

WINDOW = 8
MIN_LITERAL = 4
MIN_ITEM = 3
MIN_WINDOWS = 6
MIN_CONSISTENT = 0.8
TOKEN = r"\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*"
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
# Units that follow a number.
UNITS = [
    "mm", "cm", "dm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "t", "lb", "lbs",
    "ounce", "ounces", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min",
    "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar",
    "dollars", "cent", "cents", "euro", "euros", "pound", "pounds", "usd", "eur", "gbp", "degree", "degrees", "kb", "mb", "gb", "tb",
]


def tokens(text: str) -> Column:
    return F.regexp_extract_all(text_column(text), F.lit(TOKEN), F.lit(0))


def templates(surface: Column) -> Column:
    """Template tokens of an array of tokens."""
    is_number = lambda t: (F.ascii(t) >= 48) & (F.ascii(t) <= 57)

    def one(t: Column, i: Column) -> Column:
        low = F.lower(t)
        rest = F.substr(t, F.lit(2))
        unit = low.isin(UNITS) & (i > 0) & is_number(F.get(surface, i - 1))
        name = (F.left(t, F.lit(1)) != F.left(low, F.lit(1))) & (rest != "") & (rest == F.lower(rest))
        return F.when(is_number(t), NUMBER).when(unit, UNIT).when(name, NAME).otherwise(low)

    return F.transform(surface, one)


def _literal(window: Column) -> Column:
    """Plain words of a window."""
    return F.size(F.filter(window, lambda t: ~t.isin(NUMBER, NAME, UNIT)))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda t: F.xxhash64(t))


def _window_hash(hashes: Column, size: Column | int, exact: Column | bool) -> Column:
    """Hash of a window from the hashes of its words; windows compared by words have hashes of their own."""
    flag = exact if isinstance(exact, Column) else F.lit(exact)
    length = size if isinstance(size, Column) else F.lit(size)
    return F.xxhash64(flag, length, hashes)


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """h, item_id, at, size, exact, item_words: all windows of the benchmark."""
    base = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), tokens(text).alias("surface"))
    base = base.where(F.size("surface") > 0).withColumn("template", templates(F.col("surface")))
    size = F.least(F.size("surface"), F.lit(window))
    wide = base.withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("surface") - F.col("size"))))
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    wide = wide.select("item_id", "at", "size", cut("surface").alias("item_words"), cut("template").alias("form"))
    wide = wide.withColumn("exact", _literal(F.col("form")) < F.least(F.lit(MIN_LITERAL), "size"))
    compared = F.when(F.col("exact"), F.transform("item_words", F.lower)).otherwise(F.col("form"))
    return wide.select(
        _window_hash(_hashes(compared), F.col("size"), F.col("exact")).alias("h"), "item_id", "at", "size", "exact", "item_words"
    ).distinct()


def _starts(size: int) -> Column:
    """Starts of the windows of one size in the array column surface."""
    n = F.size("surface")
    fits = n >= size if size >= MIN_ITEM else n == size
    return F.when(fits, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
    min_consistent: float = MIN_CONSISTENT,
) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots and consistent for each document that holds an item.

    The figures are those of the copy with most windows (then slots). A copy needs min_windows
    of the item's windows, or all that are compared as templates where these are fewer.
    """
    items = materialize(item_windows(benchmark, item_id, item_text, window))
    # The kinds of windows that some item has: at most two for each size up to the window.
    kinds = sorted((r["size"], r["exact"]) for r in items.select("size", "exact").distinct().collect())
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def with_hashes(texts: DataFrame) -> DataFrame:
        """surface, template, lowered words and the hashes of both, t_ of the template and x_ of the words."""
        cut = texts.withColumn("surface", tokens("text"))
        cut = cut.withColumns({"template": templates(F.col("surface")), "lowered": F.transform("surface", F.lower)})
        return cut.withColumns({"t_": _hashes(F.col("template")), "x_": _hashes(F.col("lowered"))})

    def looked_up(size: int, exact: bool) -> Column:
        hashes = "x_" if exact else "t_"
        return F.transform(_starts(size), lambda i: _window_hash(F.slice(hashes, i + 1, size), size, exact))

    nothing = F.array().cast("array<bigint>")
    every_window = F.concat(nothing, *(looked_up(*k) for k in kinds))
    hashes = with_hashes(source).select("doc_id", F.explode(every_window).alias("h"))
    keys = items.select("h").distinct()
    hits = materialize(lookup_join(hashes, keys, ["h"]).select("doc_id").distinct())

    near = source.join(F.broadcast(hits) if is_small(hits) else hits, "doc_id", "left_semi").distinct()
    near = with_hashes(near.select("doc_id", F.xxhash64("text").alias("copy"), "text"))

    def placed(size: int, exact: bool) -> Column:
        form = F.col("lowered" if exact else "template")
        part = lambda c, i: F.slice(c, i + 1, size)
        return F.transform(
            _starts(size),
            lambda i: F.struct(
                i.alias("pos"),
                part(form, i).alias("form"),
                part(F.col("surface"), i).alias("words"),
                _window_hash(part(F.col("x_" if exact else "t_"), i), size, exact).alias("h"),
            ),
        )

    no_window = F.array().cast("array<struct<pos: int, form: array<string>, words: array<string>, h: bigint>>")
    cut = near.select("doc_id", "copy", F.explode(F.concat(no_window, *(placed(*k) for k in kinds))).alias("w")).select("doc_id", "copy", "w.*")
    matched = materialize(
        lookup_join(cut, items, ["h"], stored=True).withColumn("diagonal", F.col("pos") - F.col("at"))
    )

    copy = ["doc_id", "copy", "item_id", "diagonal"]
    told = F.countDistinct(F.when(~F.col("exact"), F.col("at")))
    sizes = items.groupBy("item_id").agg(F.when(told > 0, told).otherwise(F.countDistinct("at")).alias("n_item"))
    runs = matched.groupBy(*copy).agg(F.countDistinct("at").alias("n_windows"))
    runs = runs.join(sizes, "item_id").where(F.col("n_windows") >= F.least(F.lit(min_windows), "n_item"))
    slots = (
        matched.select(*copy, F.explode(F.arrays_zip("form", "words", "item_words")).alias("s"))
        .where(F.col("s.form").isin(NUMBER, NAME, UNIT))
        .groupBy(*copy, F.col("s.form").alias("kind"), F.col("s.item_words").alias("value"))
        .agg(F.countDistinct("s.words").alias("values"))
        .groupBy(*copy)
        .agg(F.count(F.lit(1)).alias("n_slots"), F.sum((F.col("values") == 1).cast("int")).alias("single"))
    )
    judged = runs.join(slots, copy, "left").select(
        *copy,
        "n_windows",
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
        F.coalesce(F.col("single") / F.col("n_slots"), F.lit(1.0)).alias("consistent"),
    )
    best = F.max(F.struct("n_windows", "n_slots", "consistent")).alias("b")
    return (
        judged.where(F.col("consistent") >= min_consistent)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "b.n_windows", "b.n_slots", "b.consistent")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The documents that hold no benchmark item; rows without a doc_id stay."""
    found = contaminated(docs, benchmark, doc_id, **settings)
    return without_ids(docs, materialize(found.select(F.col("doc_id").alias(doc_id)).distinct()), doc_id)
