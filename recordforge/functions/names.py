"""Business names: three normal forms, and the rules by which two names are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordforge.functions.nulls import let
from recordforge.functions.text import squeeze, strip_marks, words_of

#: Legal forms and stop words that the duplicate form drops; stop words of matching; common last words;
#: words that are no evidence on their own.
LEGAL_FORMS = ("llc", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "lp", "llp", "pllc", "pc", "pa")
DEDUP_STOPS = ("the", "a", "an", "and", "&")
MATCH_STOPS = ("the", "a", "an", "of", "and", "co", "inc", "llc", "ltd", "limited", "corp", "corporation", "company")
SUFFIXES = (
    "restaurant", "cafe", "coffee", "bar", "grill", "salon", "spa", "studio", "gallery", "shop", "store", "boutique", "inc", "llc", "co", "company", "winery", "brewery", "distillery",
    "kitchen", "lounge", "club", "center", "centre", "hotel", "inn", "motel", "pub", "tavern", "bakery", "diner", "bistro", "eatery", "market", "shoppe", "academy", "llp",
)
GENERIC = (
    "the", "a", "an", "of", "and", "cafe", "bar", "grill", "salon", "spa", "studio", "gallery", "shop", "store", "restaurant", "kitchen", "lounge", "club", "hair", "beauty", "nail", "nails",
    "hotel", "inn", "boutique", "coffee", "tea", "food", "bistro", "academy", "atlanta", "nyc", "ny", "la", "sf", "boston", "miami", "brooklyn", "manhattan",
)


def match_form(name: Column) -> Column:
    """Lower case without marks and punctuation, ``&`` as a word, and runs of single letters as one word."""
    plain = F.regexp_replace(strip_marks(F.lower(F.coalesce(name, F.lit("")))), "&", " and ")
    return F.regexp_replace(squeeze(F.regexp_replace(plain, r"[\p{P}\p{S}]+", " ")), r"\b([a-z])\s(?=[a-z]\b)", "$1")


def dedup_form(name: Column) -> Column:
    """Words of a-z and 0-9 without legal forms and stop words."""
    plain = squeeze(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", " "))
    return F.array_join(F.filter(words_of(plain), lambda w: ~w.isin(*LEGAL_FORMS, *DEDUP_STOPS)), " ")


def promotion_form(name: Column) -> Column:
    """Lower case, punctuation as space."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\p{P}\p{S}]+", " "))


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when(
        (F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), F.substr(word, F.lit(1), F.length(word) - 1)
    ).otherwise(word)


def match_words(form: Column) -> Column:
    """Words that count in matching, in the singular."""
    return F.transform(F.filter(words_of(form), lambda w: ~w.isin(*MATCH_STOPS)), singular)


def without_last_words(words: Column, last: tuple[str, ...] = SUFFIXES) -> Column:
    """Words up to the last one that isn't in ``last``; the first word stays."""
    stays = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*last), i + 1).otherwise(F.lit(1))), lambda i: i > 0)
    return F.slice(words, 1, F.coalesce(F.array_max(stays), F.lit(0)))


def without_city(form: Column, city: Column) -> Column:
    cut = lambda c: F.when(c == "", form).when(form == c, "").when(form.endswith(F.concat(F.lit(" "), c)), F.trim(F.substr(form, F.lit(1), F.length(form) - F.length(c) - 1))).otherwise(form)
    return let(match_form(city), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of words; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two sets of words; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def compare_names(stored: Column, found: Column, city: Column | None = None, min_contains: int = 1) -> Column:
    """How two names match: struct(match, rule, score, stored_form, found_form); the first rule that holds decides.

    equal; contains (of at least ``min_contains`` characters); equal_suffixed: the same words but for common last ones,
    two at least; overlap: 0.6 of the smaller set, two of its words not generic; jaccard of 0.6; else no_match.
    """
    whole = F.struct(match_form(stored).alias("a"), match_form(found).alias("b"), (F.lit("") if city is None else F.coalesce(city, F.lit(""))).alias("city"))
    cut = lambda w: F.struct(w.alias("whole"), without_city(w["a"], w["city"]).alias("a"), without_city(w["b"], w["city"]).alias("b"))
    split = lambda f: F.struct(f.alias("form"), match_words(f["a"]).alias("a"), match_words(f["b"]).alias("b"))
    return let(whole, lambda w: let(cut(w), lambda f: let(split(f), lambda t: _judged(t, min_contains))))


def _judged(t: Column, min_contains: int) -> Column:
    f, words_a, words_b = t["form"], t["a"], t["b"]
    a, b, whole = f["a"], f["b"], f["whole"]
    measures = F.struct(
        without_last_words(words_a).alias("short_a"), without_last_words(words_b).alias("short_b"), overlap(words_a, words_b).alias("shared"), jaccard(words_a, words_b).alias("jaccard"),
        F.size(F.filter(F.array_intersect(words_a, words_b), lambda w: ~w.isin(*GENERIC))).alias("solid"), F.least(F.size(F.array_distinct(words_a)), F.size(F.array_distinct(words_b))).alias("small"),
    )

    def outcome(m: Column) -> Column:
        inside = (a.contains(b) | b.contains(a)) & (F.least(F.length(a), F.length(b)) >= min_contains)
        return (
            F.when((a == "") | (b == ""), _said("no_match", F.lit(0.0))).when(a == b, _said("equal", F.lit(1.0))).when(inside, _said("contains", F.lit(1.0)))
            .when((F.size(m["short_a"]) >= 2) & (m["short_a"] == m["short_b"]), _said("equal_suffixed", F.lit(0.95)))
            .when((m["shared"] >= 0.6) & (m["small"] >= 2) & (m["solid"] >= 2), _said("overlap", m["shared"])).when(m["jaccard"] >= 0.6, _said("jaccard", m["jaccard"]))
            .otherwise(_said("no_match", F.greatest(m["shared"], m["jaccard"])))
        )

    forms = (F.when(a != "", a).otherwise(whole["a"]).alias("stored_form"), F.when(b != "", b).otherwise(whole["b"]).alias("found_form"))
    return let(let(measures, outcome), lambda o: F.struct((o["rule"] != "no_match").alias("match"), o["rule"].alias("rule"), o["score"].alias("score"), *forms))


def _said(rule: str, score: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), score.cast("double").alias("score"))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance's share of the longer text; 1 for two empty texts, 0 for one."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def letters(form: Column) -> Column:
    """How often each character stands in a text, up to four times, as bits: struct(low, high), characters in 32 groups.

    An edit changes at most two bits.
    """
    long = lambda n: F.lit(n).cast("long")
    shift = lambda f, c, n: F.call_function(f, c, n)

    def counted(bits: Column, c: Column) -> Column:
        group = F.ascii(c) % 32
        at = (group % 16) * 4

        def one_more(half: Column) -> Column:
            have = shift("shiftrightunsigned", half, at).bitwiseAND(long(15))
            return half.bitwiseOR(shift("shiftleft", (have * 2 + 1).bitwiseAND(long(15)), at))

        return F.struct(F.when(group < 16, one_more(bits["low"])).otherwise(bits["low"]).alias("low"), F.when(group >= 16, one_more(bits["high"])).otherwise(bits["high"]).alias("high"))

    return F.aggregate(F.split(form, ""), F.struct(long(0).alias("low"), long(0).alias("high")), counted)


def edits_allowed(longest: Column, least: float) -> Column:
    """Edits that a pair may have whose longer text is this long, against rounding."""
    return F.floor((1 - least) * longest + 1e-9).cast("int")


def may_be_alike(a: str, b: str, least: float) -> Column:
    """False only where ``similarity`` is below ``least``, of forms in columns a and b with their ``letters`` in a_letters and b_letters.

    Cheap tests come first, and counting of edits stops at those that the longer text allows.
    """
    x, y = F.col(a), F.col(b)
    edits = edits_allowed(F.greatest(F.length(x), F.length(y)), least)
    differ = lambda half: F.bit_count(F.col(f"{a}_letters.{half}").bitwiseXOR(F.col(f"{b}_letters.{half}")))
    return (x == y) | (differ("low") + differ("high") <= 2 * edits) & (F.abs(F.length(x) - F.length(y)) <= edits) & (F.call_function("levenshtein", x, y, edits) >= 0)


def valid_place_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^ChIJ[A-Za-z0-9_-]+$"), F.lit(False))


#: Names that identify nothing.
GENERIC_NAMES = ("business", "store", "shop", "restaurant", "cafe", "company", "n/a", "na", "none", "null", "unknown", "test", "untitled")


def test_name(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)(?:test|testing|dummy|sample|asdf|xyzzy)"), F.lit(False))


def generic_name(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*GENERIC_NAMES)


def label_name(c: Column) -> Column:
    """A geographic label, one word of four or more capitals, or no letter at all; a blank name too."""
    t = F.trim(F.coalesce(c, F.lit("")))
    places = "atlanta|nyc|new york|manhattan|brooklyn|queens|bronx|staten island|downtown|midtown|uptown"
    return (t == "") | t.rlike(rf"(?i)^({places})[\s,-]") | t.rlike("^[A-Z]{4,}$") | ~t.rlike("[A-Za-z]")


def real_name(c: Column) -> Column:
    """Three characters or more, and no test name."""
    return F.coalesce(F.length(F.trim(c)) >= 3, F.lit(False)) & ~test_name(c)
