"""Benchmark leaks by template canonicalisation, in built-in expressions only.

Benchmark items and documents are rewritten alike: names (capitalised words inside a
sentence, and the same words at a sentence's start), numbers and units after numbers get a typed mark, the rest is lower-cased and
loses its punctuation. With the marked values cut off, windows of `WIDTH` words are
templates. Template windows of all documents are hash-joined with those of the items; the
hits of an item at one alignment must then agree in their slots: each value of the item
(a name, number or unit) stands for one value of the document wherever it recurs. Where
values clash, a value's binding is what it stands for in more than half of its places
(itself also in just half); the windows that keep to the bindings and those copied
verbatim count, the others do not. An item counts as leaked if consistent windows cover
at least min(`ENOUGH`, half of its windows). So questions with other names and numbers are
found, also with one value edited, and texts that share a frame by chance, with clashing
values, are not.

A window needs LITERALS words that are no slots, unless none of the item's windows has
them. Items shorter than a window are one window of their own length. An item with fewer
than LITERALS words that are no slots cannot be told from chance and is not judged
(`unjudged_items` lists them). Null and empty texts have no windows. Documents are keyed by a hash of
doc_id and text, so repeated doc_ids, null doc_ids and repeated rows are judged by their
own text. Extra columns are ignored; empty tables give no rows.
"""

from pyspark.sql import functions as F

from rollspan.functions.arrays import let
from rollspan.session import cut

WIDTH, ENOUGH, LITERALS = 8, 6, 3
BROADCAST_WINDOWS = 500_000
BROADCAST_IDS = 1_000_000
# Marks of the slot types: private-use characters that no text holds.
NAME, NUMBER, UNIT, INITIAL = "\ue000", "\ue001", "\ue002", "\ue003"
# Units of measure, as they follow a number.
UNITS = (
    "mm|cm|km|m|mg|kg|g|lb|lbs|oz|ml|cl|l|ms|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|"
    "months?|years?|miles?|feet|foot|ft|inch|inches|yards?|meters?|metres?|kilometers?|"
    "kilograms?|grams?|pounds?|liters?|litres?|dollars?|cents?|euros?|percent|degrees?|%"
)


def marked_words(text):
    """Words of a text with marks in front of names, numbers and units."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{NUMBER}{UNIT}{INITIAL}]", "")
    named = F.regexp_replace(plain, r"(\p{Lu})(?<=[\p{Ll}\d][,;:]? \p{Lu})(?=\p{Ll})", NAME + "$1")
    # Where there are names, capitals at a sentence's start may be some of them.
    start = rf"(?<![\p{{L}}{NAME}])(\p{{Lu}})(?=\p{{Ll}})"
    named = let(
        named,
        lambda t: F.when(F.contains(t, F.lit(NAME)), F.regexp_replace(t, start, INITIAL + "$1")).otherwise(t),
    )
    numbered = F.regexp_replace(named, r"(?<![\p{L}\d.,])(\d+(?:[.,]\d+)*)", NUMBER + "$1")
    united = F.regexp_replace(
        numbered, rf"({NUMBER}[\d.,]*\d) ?(?i:({UNITS}))(?![\p{{L}}\d])", f"$1 {UNIT}$2"
    )
    has_digit = F.rlike(plain, F.lit("[0-9]"))
    slots = F.when(has_digit, united).otherwise(named)
    bare = F.regexp_replace(F.lower(slots), r"[\p{P}\p{S}&&[^%]]+(?!\d)|(?<!\d)[\p{P}\p{S}&&[^%]]+", "")
    words = F.filter(F.split(bare, r"[\s\u0085 ]+"), lambda w: w != "")
    started = lambda w: w.startswith(INITIAL)
    return let(words, lambda w: F.when(F.exists(w, started), _settled(w)).otherwise(w))


def _settled(words):
    """Words with INITIAL as names if they are names elsewhere, else without the mark."""
    name = lambda w: F.concat(F.lit(NAME), F.substring(w, 2, 1_000_000))
    elsewhere = F.array_distinct(F.filter(words, lambda w: w.startswith(NAME)))
    return let(
        elsewhere,
        lambda names: F.transform(
            words,
            lambda w: F.when(~w.startswith(INITIAL), w)
            .when(F.array_contains(names, name(w)), name(w))
            .otherwise(F.substring(w, 2, 1_000_000)),
        ),
    )


def templates(words):
    """The words with slot values cut off: only the mark is left."""
    return F.transform(
        words,
        lambda w: F.when(
            w.startswith(NAME) | w.startswith(NUMBER) | w.startswith(UNIT), F.substring(w, 1, 1)
        ).otherwise(w),
    )


def _is_slot(w):
    return w.startswith(NAME) | w.startswith(NUMBER) | w.startswith(UNIT)


def _judged():
    """The item has enough words that are no slots."""
    return F.size(F.filter("item_words", lambda w: ~_is_slot(w))) >= LITERALS


def _item_words(benchmark):
    return benchmark.select(
        F.col("item_id").cast("long"), marked_words(F.col("text").cast("string")).alias("item_words")
    )


def unjudged_items(benchmark):
    """item_id of the items that are too short or have a null id."""
    return _item_words(benchmark).filter(~_judged() | F.col("item_id").isNull()).select("item_id")


def item_windows(benchmark, width=WIDTH):
    """Written tables: items with their marked words, and their template windows."""
    words = _item_words(benchmark).filter(_judged() & F.col("item_id").isNotNull())
    items = cut(
        words.withColumn("item", F.xxhash64("item_id", "item_words"))
        .withColumn("m", F.least(F.lit(width), F.size("item_words")))
        .dropDuplicates(["item"])
    )
    canon = items.withColumn("canon", templates(F.col("item_words")))
    at = F.posexplode(F.sequence(F.lit(1), F.size("canon") - F.col("m") + 1)).alias("i0", "pos_i")
    every = canon.select("item", "item_id", "m", "canon", at).withColumn(
        "window", F.slice("canon", F.col("pos_i"), F.col("m"))
    )
    literal = F.size(F.filter("window", lambda w: ~_is_slot(w))) >= F.least(F.lit(LITERALS), F.col("m"))
    every = every.select("item", "item_id", "m", "pos_i", F.xxhash64("window").alias("h"), literal.alias("literal"))
    some = every.groupBy("item").agg(
        F.max("literal").alias("any"), F.count(F.when(F.col("literal"), 1)).alias("literals"), F.count("*").alias("all")
    )
    windows = cut(
        every.join(some, "item")
        .filter(F.col("literal") | ~F.col("any"))
        .select("item", "item_id", "m", "pos_i", "h", F.when(F.col("any"), F.col("literals")).otherwise(F.col("all")).alias("item_windows"))
    )
    return items.select("item", "item_words"), windows


def _key(docs):
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _bounded(df, limit):
    """A broadcast hint if the table has at most `limit` rows of a few numbers."""
    return F.broadcast(df) if df.count() <= limit else df


def _windows_of(m):
    """All windows of m words of `canon`, hashed like those of the items."""

    def window(i):
        return F.struct(
            F.lit(m).alias("m"),
            i.alias("pos_d"),
            F.xxhash64(F.slice("canon", i, m)).alias("h"),
        )

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("canon") - (m - 1)))
    none = F.expr("cast(array() as array<struct<m:int,pos_d:int,h:bigint>>)")
    return F.when(F.size("canon") >= m, F.transform(starts, window)).otherwise(none)


def _pairs(places):
    """Distinct (item's value, document's value) of the slots in an alignment's windows."""

    def slots(p):
        both = F.arrays_zip(
            F.slice("item_words", p, F.col("m")).alias("i"),
            F.slice("doc_words", p + F.col("shift"), F.col("m")).alias("d"),
        )
        return F.filter(both, lambda z: _is_slot(z["i"]))

    return F.array_distinct(F.flatten(F.transform(places, slots)))


def _slots_at():
    """(place, item's value, document's value) of every slot in an alignment's windows."""
    covered = F.array_distinct(
        F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("m") - 1)))
    )
    every = F.transform(
        covered,
        lambda j: F.struct(
            j.alias("j"),
            F.element_at("item_words", j).alias("i"),
            F.element_at("doc_words", (j + F.col("shift")).cast("int")).alias("d"),
        ),
    )
    return F.filter(every, lambda z: _is_slot(z["i"]))


def _consistent():
    """The windows whose slots all have their value's majority binding, and the verbatim ones."""

    def stray(s):
        same = F.filter("at", lambda z: z["i"] == s["i"])
        twice = 2 * F.size(F.filter(same, lambda z: z["d"] == s["d"]))
        half = (twice == F.size(same)) & (s["i"] == s["d"])
        return ~((twice > F.size(same)) | half)

    def free_of(places):
        return F.filter("places", lambda p: ~F.exists(places, lambda j: j.between(p, p + F.col("m") - 1)))

    strays = F.transform(F.filter("at", stray), lambda s: s["j"])
    changed = F.transform(F.filter("at", lambda s: s["i"] != s["d"]), lambda s: s["j"])
    return F.array_union(free_of(strays), free_of(changed))


def leaks(docs, benchmark, width=WIDTH):
    """One row per document and leaked item: key, doc_id, item_id, windows, item_windows, slots."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items, windows = item_windows(benchmark, width)
    sizes = [r["m"] for r in windows.select("m").distinct().collect()]  # at most `width` numbers
    small = _bounded(windows, BROADCAST_WINDOWS)
    keyed = rows.select(_key(rows).alias("key"), "doc_id", "text")
    canon = keyed.select(
        "key", "doc_id", templates(marked_words(F.col("text"))).alias("canon")
    )
    at = F.explode(F.flatten(F.array(*[_windows_of(m) for m in sizes or [width]]))).alias("w")
    exploded = canon.select("key", "doc_id", at).select("key", "doc_id", "w.m", "w.pos_d", "w.h")
    hits = cut(
        exploded.join(small, ["m", "h"]).select(
            "key", "doc_id", "item", "item_id", "m", "pos_i", "item_windows",
            (F.col("pos_d") - F.col("pos_i")).alias("shift"),
        )
    )
    runs = hits.groupBy("key", "doc_id", "item", "item_id", "m", "item_windows", "shift").agg(
        F.collect_set("pos_i").alias("places")  # at most the item's windows
    )
    found = _bounded(hits.select("key").distinct(), BROADCAST_IDS)
    texts = keyed.join(found, "key", "left_semi").dropDuplicates(["key"]).select(
        "key", marked_words(F.col("text")).alias("doc_words")
    )
    aligned = runs.join(items, "item").join(texts, "key")
    judged = (
        aligned.withColumn("pairs", _pairs(F.col("places")))
        .withColumn("bound", F.size(F.array_distinct(F.transform("pairs", lambda z: z["i"]))) == F.size("pairs"))
        .withColumn("at", F.when(~F.col("bound"), _slots_at()))
        .withColumn("kept", F.when(F.col("bound"), F.col("places")).otherwise(_consistent()))
    )
    checked = judged.select(
        "key", "doc_id", "item_id", "item_windows", F.col("kept").alias("places"),
        F.when(F.col("bound"), F.col("pairs")).otherwise(_pairs(F.col("kept"))).alias("pairs"),
    )
    whole = checked.groupBy("key", "doc_id", "item_id", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("windows"),
        F.sum(F.size("pairs")).alias("slots"),
    )
    return whole.filter(
        F.col("windows") >= F.least(F.lit(ENOUGH), F.ceil(F.col("item_windows") / 2))
    ).select("key", "doc_id", "item_id", "windows", "item_windows", "slots")


def without_leaks(docs, benchmark, width=WIDTH):
    """The documents with no leaked item, all columns as they were."""
    keys = cut(leaks(docs, benchmark, width).select("key").distinct())
    name = "_leak"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(
        name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    )
    leaked = _bounded(keys.withColumnRenamed("key", name), BROADCAST_IDS)
    return rows.join(leaked, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
