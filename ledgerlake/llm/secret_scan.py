"""Secrets by pattern, and by character Markov models. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable, held, spare

# What the base patterns of the contract match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the whole run has 16 characters at least
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")

RUN = r"[A-Za-z0-9+/_=-]{16,}"  # what the models judge
SAMPLE = 20_000  # labelled strings of each class that the models learn from, on average
THRESHOLD = 12.0  # natural log of the likelihood ratio of a string
PIECE = 256  # characters of a string that are cut into pairs at a time
DROP = 6.0  # fall of the log ratio that ends a stretch inside a run
PER_CHARACTER = 0.5  # and of its characters on average
SMOOTHING = 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
EDGE = 0  # code of the start of a string, and of any character outside the alphabet


@dataclass(frozen=True)
class Models:
    """ln P(next | previous, random) - ln P(next | previous, ordinary), by character codes."""

    ratios: tuple[float, ...]  # at code(previous) * size + code(next)
    size: int = len(ALPHABET) + 1


def _code(character: Column) -> Column:
    return F.instr(F.lit(ALPHABET), character)


def trained(samples: DataFrame) -> Models:
    """Two first-order models from rows (value, random): random strings (true) and ordinary
    identifiers (false). The counts are made by Spark; the driver gets at most
    2 * (alphabet + 1)^2 of them. Null and empty values teach nothing."""
    size = len(ALPHABET) + 1
    # A blank stands for the edge. A long string is cut into pieces, each with the first
    # character of the next, so that no pair of neighbours is lost; pairs are substrings of 2.
    pieces = samples.filter("length(value) > 0").select("random", F.regexp_extract_all(
        F.concat(F.lit(" "), F.col("value")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    lapped = F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.left(F.get("pieces", i + 1), F.lit(1)), F.lit(""))))
    pairs = (
        pieces.select("random", F.explode(lapped).alias("value")).filter("length(value) > 1")
        .select("random", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)),
        )).alias("pair"))
        .groupBy("random", _code(F.substring("pair", 1, 1)).alias("a"), _code(F.substring("pair", 2, 1)).alias("b"))
        .agg(F.count("*").alias("n"))
    )
    counts = np.full((2, size, size), SMOOTHING)
    for row in pairs.collect():
        counts[int(row.random), row.a, row.b] += row.n
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Models(tuple((logs[1] - logs[0]).ravel().tolist()))


def log_ratio(value: Column, models: Models) -> Column:
    """The log-likelihood ratio of a string, random against ordinary."""
    # One literal, folded to an array when the plan is made.
    ratios = F.split(F.lit(" ".join(map(repr, models.ratios))), " ").cast("array<double>")
    start = F.struct(F.lit(EDGE).alias("code"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        F.split(value, ""),
        start,
        lambda at, character: F.struct(
            _code(character).alias("code"),
            (at["sum"] + F.get(ratios, at["code"] * models.size + _code(character))).alias("sum"),
        ),
        lambda at: at["sum"],
    )


def _random(ratio: Column, length: Column) -> Column:
    return ratio >= F.greatest(F.lit(THRESHOLD), length * PER_CHARACTER)


def random_parts(run: Column, models: Models) -> Column:
    """Parts (start, end) of a run that the models call random: the whole, or else each stretch
    whose characters are, up to where the log ratio falls by DROP or to nothing. So a random
    string is found among ordinary words that a joiner ties to it."""
    ratios = F.split(F.lit(" ".join(map(repr, models.ratios))), " ").cast("array<double>")
    before = F.split(F.concat(F.lit(" "), F.substring(run, F.lit(1), F.length(run) - 1)), "")
    gains = F.zip_with(before, F.split(run, ""), lambda a, b: F.get(ratios, _code(a) * models.size + _code(b)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    part = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
    closed = lambda at: F.when(
        _random(at["best"], at["end"] - at["start"]), F.concat(at["found"], part(at["start"], at["end"]))).otherwise(at["found"])

    def state(place, total, start, best, end, found) -> Column:
        names = ("place", "sum", "start", "best", "end", "found")
        return F.struct(*(c.alias(n) for n, c in zip(names, (place, total, start, best, end, found))))

    def step(at: Column, gain: Column) -> Column:
        total, place = at["sum"] + gain, at["place"] + 1
        over = (total <= 0) | (at["best"] - total >= DROP)
        higher = total > at["best"]
        return F.when(over, state(place, F.lit(0.0), place, F.lit(0.0), place, closed(at))).otherwise(state(
            place, total, at["start"], F.greatest(at["best"], total), F.when(higher, place).otherwise(at["end"]), at["found"]))

    zero, nought = F.lit(0), F.lit(0.0)
    stretches = F.aggregate(gains, state(zero, nought, zero, nought, zero, none), step, closed)
    return F.when(_random(log_ratio(run, models), F.length(run)), part(zero, F.length(run))).otherwise(stretches)


def _matches(text: Column, pattern: str, parts, kind: str) -> Column:
    """Spans (start, end, kind) of the `parts` of each match, in order. Between the matches stand the pieces that split() leaves, so lengths give the places."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")
    rank = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))

    def step(at: Column, pair: Column) -> Column:
        start = at["place"] + F.length(pair["piece"])
        end = start + F.length(pair["found"])
        spans = F.transform(parts(pair["found"]), lambda x: F.struct(
            (start + x["start"]).alias("start"), (start + x["end"]).alias("end"), rank.alias("rank"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("place"), F.concat(at["spans"], spans).alias("spans"))

    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found")),
        F.struct(F.lit(0).alias("place"), none.alias("spans")),
        step,
        lambda at: at["spans"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _base(text: Column) -> dict[str, Column]:
    always = lambda m: F.array(F.struct(F.lit(0).alias("start"), F.length(m).alias("end")))
    long_enough = lambda m: F.filter(always(m), lambda x: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    return {
        "assign": _matches(text, ASSIGN, long_enough, "assign"),
        "access": _matches(text, ACCESS, always, "access"),
        "hex": _matches(text, HEX, always, "hex"),
    }


def labelled(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Labelled strings (value, random) from texts: what the base patterns catch is random,
    the other runs of letters, digits and joiners are ordinary. Values are distinct and whole,
    so copies neither thin a class out nor fill it. Of each class a sample, by a hash of the
    string, with `most` members on average if there are more."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    caught = texts.filter(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(
        F.explode(F.concat(
            F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
            F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
            F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
        )).alias("value")
    ).filter("length(value) >= 8")
    plain = texts.filter(~F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("value")
    )
    both = caught.select("value", F.lit(True).alias("random")).union(plain.select("value", F.lit(False).alias("random")))
    # Written once: counting and drawing do not search the texts again.
    both = durable(both.distinct())
    counts = {r["random"]: r["n"] for r in both.groupBy("random").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most / n) for c, n in counts.items()}
    kept = F.when(F.col("random"), share.get(True, 1.0)).otherwise(share.get(False, 1.0))
    draw = F.pmod(F.xxhash64("value"), F.lit(2**31)) / float(2**31)
    return both.filter(draw < kept)


def with_spans(docs: DataFrame, models: Models, into: str) -> DataFrame:
    """All rows and columns, with a column `into`: array of (start, end, rank, kind), by start and
    then by kind; code points, end exclusive. Kinds are those of the base patterns and
    `markov` for parts of runs, outside the base spans, that the models call random. Null and
    empty texts have none, repeated rows the same. A column that is named `into` is replaced,
    all others stay."""
    base_at, free_at = spare("base", docs), spare("free", docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*_base(text).values()))
    staged = held(docs, **{base_at: base})
    # What base spans cover is blanked, so that the rest of a run is judged by itself.
    blanked = F.aggregate(
        base_at,
        F.struct(F.lit(0).alias("place"), F.lit("").alias("out")),
        lambda at, b: F.when(b["end"] <= at["place"], at).otherwise(F.struct(
            b["end"].alias("place"),
            F.concat(at["out"], F.substring(text, at["place"] + 1, b["start"] - at["place"]),
                     F.repeat(F.lit(" "), b["end"] - F.greatest(b["start"], at["place"]))).alias("out"))),
        lambda at: F.concat(at["out"], F.substring(text, at["place"] + 1, F.length(text))),
    )
    staged = held(staged, **{free_at: F.when(F.size(base_at) > 0, blanked).otherwise(text)})
    runs = _matches(F.col(free_at), RUN, lambda m: random_parts(m, models), "markov")
    return held(staged, **{into: F.array_sort(F.concat(base_at, runs))}).drop(base_at, free_at)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans: one row per row."""
    found = with_spans(docs.select("doc_id", "text"), models, "_spans").select("doc_id", "_spans")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["rank"] < len(KINDS))
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("_spans")).alias("spans"), count("markov"),
    )


def redacted(docs: DataFrame, models: Models) -> DataFrame:
    """All rows and columns, with each secret in `text` replaced by <SECRET>; `n_chars`
    follows if there is one. Texts without secrets stay as they are, null included."""
    columns, spans = docs.columns, spare("spans", docs)
    found = with_spans(docs, models, spans)
    text = F.col("text").cast("string")
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("place"), F.lit("").alias("out")),
        lambda at, s: F.when(s["end"] <= at["place"], at).otherwise(F.struct(
            s["end"].alias("place"),
            F.when(s["start"] < at["place"], at["out"]).otherwise(F.concat(
                at["out"], F.substring(text, at["place"] + 1, s["start"] - at["place"]), F.lit("<SECRET>"))).alias("out"),
        )),
        lambda at: F.concat(at["out"], F.substring(text, at["place"] + 1, F.length(text))),
    )
    out = found.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(text))
    if "n_chars" in columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, changed).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in columns))
