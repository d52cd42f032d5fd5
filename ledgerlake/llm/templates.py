"""Benchmark decontamination by templates. DataFrame functions only.

A template is a text whose numbers, names and units are replaced by typed placeholders, so a
question whose figures were changed keeps its template. Windows of template words are joined by
hash and counted copy by copy; what stood in the slots of a copy is then compared: wherever the
benchmark repeats a value, the document must repeat its own. Items of one template are looked up
once, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable, held, spare, text_key

WIDTH = 5  # words in a window
PERCENT = 80  # share of a benchmark item's windows that a document must hold
LITERAL = 2  # words that are no placeholders, at least, of a window whose figures may change
MAX_BROADCAST = 1_000_000  # windows of 28 bytes that are sent to every executor, at most

NAME, UNIT, NUMBER = "\u0001", "\u0002", "\u0003"  # placeholders
# Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers "
    "g kg mg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "l ml liter liters litre litres gallon gallons "
    "percent usd eur gbp dollar dollars euro euros cent cents degree degrees mph kph kmh"
)


def words(text: Column) -> Column:
    """Runs of letters and digits, with a decimal point or comma inside a number."""
    return F.regexp_extract_all(text, F.lit(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+"), F.lit(0))


def canonical(text: Column) -> Column:
    """The words of a text with placeholders for numbers, names and units; as many as words()
    gives. A name is a capitalised word that does not begin a sentence; a unit counts as one
    only right after a number. The rest is lower-cased."""
    # Java tries a pattern at every character, so each begins with what is rare.
    clean = F.translate(text, NAME + UNIT + NUMBER, "   ")
    named = F.regexp_replace(
        clean, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})[\p{Ll}\p{M}]++(?![\p{L}\p{M}])", NAME)
    units = "|".join(UNITS.split())
    united = F.regexp_replace(
        named, rf"(\p{{N}}\s*)(?i:{units})(?![\p{{L}}\p{{M}}\p{{N}}])", f"$1{UNIT}")
    numbered = F.regexp_replace(F.lower(united), r"\p{N}+(?:[.,]\p{N}+)*", NUMBER)
    return F.regexp_extract_all(numbered, F.lit(f"[{NAME}{UNIT}{NUMBER}]|[\\p{{L}}\\p{{M}}]+"), F.lit(0))


def _slot(word: Column) -> Column:
    return word.isin(NAME, UNIT, NUMBER)


def _windowed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, size, windows, bare): of each text how many words it has, a hash for each window, and
    whether that window is bare, with too few literal words. A bare window would match any list of
    figures, so its hash is that of the words themselves. A text shorter than a window has one
    window, all of it; one without words has none and is left out."""
    texts = held(rows.select(key, "text"), kinds=canonical(F.col("text"))).filter(F.size("kinds") > 0)
    texts = held(
        texts,
        hashes=F.transform("kinds", lambda w: F.xxhash64(w)),
        slots=F.transform("kinds", lambda w: _slot(w).cast("int")),
    ).drop("kinds")
    filled = lambda i: sum((F.coalesce(F.get("slots", i + k), F.lit(0)) for k in range(1, width)), F.get("slots", i))
    places = F.sequence(F.lit(0), F.greatest(F.size("hashes") - width, F.lit(0)))
    texts = held(texts, bare=F.transform(places, lambda i: filled(i) > width - LITERAL))
    # Few texts have bare windows, and only those are cut into words again.
    texts = held(texts, said=F.when(
        F.array_contains("bare", True), F.transform(words(F.col("text")), lambda w: F.xxhash64(F.lower(w)))))
    window = lambda hashes, i, *seed: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)), *seed)
    windows = F.transform("bare", lambda b, i: F.when(b, window("said", i, F.lit("bare"))).otherwise(window("hashes", i)))
    return texts.select(key, F.size("hashes").alias("size"), windows.alias("windows"), "bare")


def _slots(text: Column) -> Column:
    """(place, value) of each slot of a text, in order; values in small letters."""
    both = F.arrays_zip(canonical(text).alias("kind"), words(text).alias("value"))
    placed = F.transform(both, lambda w, i: F.struct(i.alias("place"), F.lower(w["value"]).alias("value"), _slot(w["kind"]).alias("slot")))
    return F.filter(placed, lambda w: w["slot"])


def shapes(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, shape, template, size, windows, bare, repeats): each item with its template, a
    digest of its windows, and its shape, the template with the pattern of its values: `repeats` lists
    the places of each value that stands in several slots. Items of one shape are found
    alike. Rows without item_id or without words are left out; repeated ones count once."""
    items = durable(benchmark.filter("item_id is not null and text is not null").select(
        "item_id", F.col("text").cast("string").alias("text"), text_key().alias("key")).distinct())
    texts = items.select("key", "text").dropDuplicates(["key"])
    slots = texts.select("key", F.explode(_slots(F.col("text"))).alias("s")).select("key", "s.value", "s.place")
    repeats = (
        slots.groupBy("key", "value").agg(F.sort_array(F.collect_list("place")).alias("places"))
        .filter(F.size("places") > 1)
        .groupBy("key").agg(F.sort_array(F.collect_list("places")).alias("repeats"))
    )
    cut = _windowed(texts, "key", width).join(repeats, "key", "left").withColumn(
        "repeats", F.coalesce("repeats", F.array().cast("array<array<int>>")))
    digest = F.md5(F.array_join(F.col("windows").cast("array<string>"), " "))
    pattern = F.to_json("repeats")
    shaped = cut.select(
        "key", F.unhex(F.md5(F.concat(digest, pattern))).alias("shape"), F.unhex(digest).alias("template"),
        "size", "windows", "bare", "repeats",
    )
    return items.select("item_id", "key").join(shaped, "key").drop("key")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(node, shape, share): texts (by text_key) that hold a copy of a benchmark template whose
    slots fit; see `shapes` for the items of a shape. A copy is a place of the text where windows of
    the template stand as far from each other as in the template, but for words put in or left out: as many as
    100 - percent in a hundred of the template's, one at least (where they come near twice that, it
    depends on the place). `share` is the part of the template's distinct windows that the best
    such copy has, at least percent / 100. Its slots fit if equal slots of the item hold equal values
    of the text. Any copy that fits is enough.

    Bare windows count only for items at least half of whose windows are bare; their figures must be the item's own.
    Null and empty texts, and texts without words, match nothing; repeated rows match alike. An
    item shorter than a window is found only where it is all of a text. Both tables may be empty."""
    known = durable(shapes(benchmark, width))
    templates = known.dropDuplicates(["template"]).select("template", "size", F.arrays_zip("windows", "bare").alias("w"))
    mostly_bare = F.size(F.filter("w", lambda w: w["bare"])) * 2 >= F.size("w")
    templates = templates.withColumn("all", mostly_bare).select("template", "size", "all", F.posexplode("w").alias("item_place", "w"))
    templates = durable(templates.filter(F.col("all") | ~F.col("w.bare")).select(
        "template", "size", "item_place", F.col("w.windows").alias("window")))
    wanted = templates.groupBy("template", "size").agg(F.countDistinct("window").alias("wanted"))
    searched = templates.select("template", "item_place", "window")
    if searched.count() <= MAX_BROADCAST:
        searched = F.broadcast(searched)
    texts = docs.filter("text is not null").select(F.col("text").cast("string").alias("text"))
    keyed = texts.select(text_key().alias("node"), "text")
    placed = _windowed(keyed, "node", width).select("node", F.posexplode("windows").alias("place", "window"))
    hits = durable(placed.join(searched, "window").distinct())
    near, hits = _copies(hits, wanted, percent)
    return _fitting(near, hits, keyed, known, width)


def _copies(hits: DataFrame, wanted: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, template, copy, share) of copies that have enough windows, and the hits of each.
    Windows that say the template begins within one stretch of the text make one copy.
    Stretches overlap by half, so what is no further apart than that half shares one."""
    slack = F.greatest(F.lit(1), F.floor(F.col("size") * (100 - percent) / 100)).cast("int")
    begun = hits.join(wanted, "template").select("*", F.floor((F.col("place") - F.col("item_place")) / slack).alias("part"))
    copies = begun.select(
        "node", "template", "place", "item_place", "window", "wanted",
        F.explode(F.array(F.col("part") - 1, F.col("part"))).alias("copy"),
    )
    found = copies.groupBy("node", "template", "copy", "wanted").agg(F.countDistinct("window").alias("found"))
    near = durable(
        found.filter(F.col("found") * 100 >= F.col("wanted") * percent)
        .select("node", "template", "copy", (F.col("found") / F.col("wanted")).alias("share"))
    )
    return near, copies.join(near, ["node", "template", "copy"]).select("node", "template", "copy", "share", "place", "item_place")


def _fitting(near: DataFrame, hits: DataFrame, keyed: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(node, shape, share) of copies in which equal slots of a shape hold equal values."""
    copy = ["node", "template", "copy"]
    kinds = known.select("shape", "template", "repeats").dropDuplicates(["shape"])
    judged = near.join(kinds, "template")
    # Only values that the item repeats can clash, and only texts near such an item are cut again.
    asked = durable(kinds.select("shape", "template", F.posexplode("repeats").alias("value_no", "places"))
                    .select("shape", "template", "value_no", F.explode("places").alias("item_place")))
    slots = asked.select("template", "item_place").distinct()
    aligned = hits.select(
        *copy, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"), "place", "item_place",
    ).select(*copy, (F.col("place") + F.col("k")).alias("place"), (F.col("item_place") + F.col("k")).alias("item_place"))
    aligned = durable(aligned.join(slots, ["template", "item_place"]).distinct())
    nodes = aligned.select("node").distinct()
    said = keyed.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", F.explode(_slots(F.col("text"))).alias("s"))
    filled = aligned.join(said.select("node", "s.place", "s.value"), ["node", "place"]).join(asked, ["template", "item_place"])
    clashes = (
        filled.groupBy(*copy, "shape", "value_no").agg(F.min("value").alias("least"), F.max("value").alias("most"))
        .filter("least != most").select(*copy, "shape").distinct()
    )
    fits = judged.join(clashes, [*copy, "shape"], "left_anti")
    return fits.groupBy("node", "shape").agg(F.max("share").alias("share"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows whose text is not contaminated, with their columns, whatever their names. Rows
    with null, empty or equal texts are judged one by one like any other; with an empty benchmark
    all rows stay."""
    bad = durable(contaminated(docs, benchmark, width, percent).select("node").distinct())
    columns, made = docs.columns, spare("node", docs)
    keyed = docs.withColumn(made, text_key())
    return keyed.join(bad.withColumnRenamed("node", made), made, "left_anti").select(*(F.col(f"`{c}`") for c in columns))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, shapes (of each shape found its least item_id, sorted, comma-joined; empty when
    clean), n_shapes, n_items (all items of those shapes), share (the largest), contaminated: one
    row per row of docs, repeated ones and those without doc_id or text included. `shapes` gives all
    items of a shape."""
    found = contaminated(docs, benchmark, width, percent)
    of_shape = shapes(benchmark, width).groupBy("shape").agg(
        F.min("item_id").alias("least"), F.countDistinct("item_id").alias("items"))
    per_text = durable(
        found.join(of_shape, "shape").groupBy("node").agg(
            F.array_join(F.array_sort(F.collect_set("least")), ",").alias("shapes"),
            F.count("*").alias("n_shapes"), F.sum("items").alias("n_items"), F.max("share").alias("share"),
        )
    )
    out = docs.select("doc_id", text_key().alias("node")).join(per_text, "node", "left")
    return out.select(
        "doc_id", F.coalesce("shapes", F.lit("")).alias("shapes"), F.coalesce("n_shapes", F.lit(0)).alias("n_shapes"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("share", F.lit(0.0)).alias("share"), F.col("n_items").isNotNull().alias("contaminated"),
    )
