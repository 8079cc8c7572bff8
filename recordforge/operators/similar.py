"""Edit-similarity join: pairs of a block's texts that are alike, found by shared pieces where that makes fewer pairs than all.

Cut the shorter of two texts that are within e edits into e + 1 + SPARE pieces: then 1 + SPARE of them still stand in the
longer one, near their old places. So a text's SPARE commonest pieces needn't be looked for, and words that many texts
have make no candidates. How many edits a pair may have follows from the longer text, so the shorter one is cut for each
number that a partner may bring. Of a block whose pieces would make more pairs than there are, as in texts of few words,
all pairs are compared, in squares dealt over tasks, by the counts of their characters first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.functions.names import edits_allowed as _edits
from recordforge.functions.names import letters, may_be_alike
from recordforge.functions.nulls import bind
from recordforge.operators.matching import spread

#: Pieces of a text, its commonest ones, that are left out.
SPARE = 3
#: In a block of so few texts all pairs are compared, as they are fewer than the pieces would be.
FEW = 64
#: Against rounding of lengths times a threshold.
_SLACK = 1e-9


def _piece(length: Column, edits: Column, k: Column) -> tuple[Column, Column]:
    """Place and size of piece k of a text cut for so many edits; the last pieces are one longer where it doesn't come out even."""
    n = edits + 1 + SPARE
    size, rest = F.floor(length / n).cast("int"), length % n
    late = F.greatest(F.lit(0), k - (n - rest))
    return k * size + late, size + F.when(k >= n - rest, 1).otherwise(0)


def _key(length: str, place: Column, size: Column) -> Column:
    return F.xxhash64("block", length, "edits", "k", F.substring("form", place + 1, size))


def _pieces(forms: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pieces that texts are looked up by, (own_block, short, l, key), and places where they may stand in longer ones, (block, form, n, edits, key)."""
    rows = forms.select("block", "form", F.length("form").alias("n")).where("n > 0")
    longest = F.floor(F.col("n") / least + _SLACK)
    each = F.explode(F.sequence(F.lit(0), F.col("edits") + SPARE))
    cut = rows.withColumn("edits", F.explode(F.sequence(_edits(F.col("n"), least), _edits(longest, least)))).withColumn("k", each)
    pieces = cut.select(F.col("block").alias("own_block"), F.col("form").alias("short"), F.col("n").alias("l"), F.col("edits").alias("e"), "k", _key("n", *_piece(F.col("n"), F.col("edits"), F.col("k"))).alias("key"))
    common = F.row_number().over(Window.partitionBy("own_block", "short", "e").orderBy(F.desc("count"), "k"))
    pieces = pieces.join(pieces.groupBy("key").count(), "key").withColumn("common", common).where(F.col("common") > SPARE).select("own_block", "short", "l", "key")

    looked = rows.withColumn("edits", _edits(F.col("n"), least)).withColumn("more", F.explode(F.sequence(F.lit(0), F.least("edits", F.col("n") - 1)))).withColumn("l", F.col("n") - F.col("more"))
    looked = looked.withColumn("k", each)
    place, size = _piece(F.col("l"), F.col("edits"), F.col("k"))
    looked = looked.withColumns({"place": place, "size": size})
    # A piece that stands as it was has moved by what was put in before it less what was taken out, of at most ``edits`` edits in all.
    low = F.greatest(F.lit(0), F.col("place") - F.floor((F.col("edits") - F.col("more")) / 2))
    high = F.least(F.col("n") - F.col("size"), F.col("place") + F.floor((F.col("edits") + F.col("more")) / 2))
    looked = looked.withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("high >= low").withColumn("at", F.explode(F.sequence("low", "high")))
    return pieces, looked.select("block", "form", "n", "edits", _key("l", F.col("at"), F.col("size")).alias("key"))


def candidates(forms: DataFrame, least: float) -> DataFrame:
    """Pairs (block, short, form, edits) of texts of a block that share a piece; a pair may come more than once."""
    pieces, looked = _pieces(forms, least)
    dealt, copied = spread(looked, pieces, ["key"], "form", "short")
    both = dealt.join(copied, ["key", "_salt"])
    return both.where((F.col("block") == F.col("own_block")) & ((F.col("l") < F.col("n")) | (F.col("short") < F.col("form")))).select("block", "short", "form", "edits")


def _crowded(forms: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Blocks (block, texts) whose pieces would make more than half as many pairs as there are."""
    pieces, looked = _pieces(forms, least)
    met = looked.groupBy("block", "key").agg(F.count(F.lit(1)).alias("x")).join(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("y")), "key")
    return met.groupBy("block").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("pairs")).join(sizes, "block").where(F.col("pairs") > F.col("texts").cast("double") * F.col("texts") / 4).select("block", "texts")


#: Texts of a side of a square of pairs that one task compares.
SQUARE = 1000


def _all_pairs(forms: DataFrame, least: float) -> DataFrame:
    """Pairs (block, short, form, edits) of texts that may be alike of blocks (block, texts, form), each two compared once."""
    parts = F.ceil(F.col("texts") / SQUARE).cast("long")
    rows = forms.where("form <> ''").select("block", "form", parts.alias("parts"), F.pmod(F.xxhash64("form"), parts).alias("own"))
    rows = bind(rows, form_letters=letters(F.col("form")))
    every = lambda low, high: F.explode(F.sequence(low, high))
    upper = rows.withColumn("other", every(F.col("own"), F.col("parts") - 1)).select("block", F.col("own").alias("i"), F.col("other").alias("j"), F.col("form").alias("short"), F.col("form_letters").alias("short_letters"))
    lower = rows.withColumn("other", every(F.lit(0).cast("long"), F.col("own"))).select("block", F.col("other").alias("i"), F.col("own").alias("j"), "form", "form_letters")
    met = upper.hint("merge").join(lower.hint("merge"), ["block", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("short") < F.col("form"))) & may_be_alike("short", "form", least))
    return met.select("block", "short", "form", _edits(F.greatest(F.length("short"), F.length("form")), least).alias("edits"))


def similar_texts(forms: DataFrame, least: float) -> DataFrame:
    """Pairs (block, a, b, similarity) of different texts of a block, a before b, that are alike: 1 - edits / longer length >= least.

    forms: (block, form), distinct; a null block or form is like nothing, and an empty text is like no other. ``least`` is
    above 0. Blocks of up to FEW texts are compared whole, as are those whose pieces say little; the others by pieces, which
    lose no pair. Pieces that many texts have are spread over tasks.
    """
    if not 0 < least <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    forms = forms.where("block is not null and form is not null")
    sizes = forms.groupBy("block").agg(F.count(F.lit(1)).alias("texts"))
    few = forms.join(sizes.where(F.col("texts") <= FEW).select("block"), "block", "left_semi")
    many = forms.join(sizes.where(F.col("texts") > FEW).select("block"), "block", "left_semi")

    other = few.select("block", F.col("form").alias("short"))
    pairs = few.join(other, "block").where("(short < form) and short <> ''").withColumn("edits", _edits(F.greatest(F.length("short"), F.length("form")), least))
    pairs = pairs.where(F.abs(F.length("short") - F.length("form")) <= F.col("edits")).select("block", "short", "form", "edits")
    crowded = _crowded(many, sizes, least)
    pairs = pairs.unionByName(candidates(many.join(crowded, "block", "left_anti"), least)).unionByName(_all_pairs(many.join(crowded, "block"), least))
    found = pairs.withColumn("distance", F.call_function("levenshtein", "short", "form", "edits"))
    # The distance is of the pair, so the same pair comes with the same one.
    longer = F.greatest(F.length("short"), F.length("form"))
    alike = found.where(F.col("distance") >= 0).select("block", F.least("short", "form").alias("a"), F.greatest("short", "form").alias("b"), (1 - F.col("distance") / longer).alias("similarity"))
    return alike.where(F.col("similarity") >= least).distinct()


def fuzzy_pairs(rows: DataFrame, block: str, name: Column, *, least: float = 0.85, id_col: str = "id") -> DataFrame:
    """Pairs of rows (id, other_id, similarity) of a block whose forms ``name`` are alike; equal forms are, with 1.

    Forms are compared once, however many rows have them. Each pair of rows is given, as callers name pairs of rows; a
    form that many rows have makes as many as that takes, spread over tasks.
    """
    given = rows.select(F.col(id_col).alias("id"), F.col(block).alias("block"), name.alias("form")).where("block is not null and form is not null")
    alike = similar_texts(given.select("block", "form").distinct(), least)
    links = given.select("block", "form").distinct().select("block", F.col("form").alias("a"), F.col("form").alias("b"), F.lit(1.0).alias("similarity")).unionByName(alike)
    side = lambda form, out: given.select("block", F.col("form").alias(form), F.col("id").alias(out))
    left = links.join(side("a", "x"), ["block", "a"]).select("block", "b", "x", "similarity", (F.col("a") == F.col("b")).alias("same"))
    dealt, copied = spread(left, side("b", "y"), ["block", "b"], "x", "y")
    pairs = dealt.join(copied, ["block", "b", "_salt"]).where("not same or x < y")
    return pairs.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other_id"), "similarity")
