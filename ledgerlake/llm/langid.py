"""Language ID by words first, and by ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import durable, small_batches, spare

TRAIN_DOCS = 2_000  # distinct labelled texts sampled per language, on average
MAX_WORDS = 25_000  # entries of the word table for each language
MAX_GRAMS = 50_000  # entries of the n-gram table for each language
LONGEST = 4  # characters in the longest n-gram
EVIDENCE = 20  # words that count as independent evidence, for the score
GROUP = 1_000_000  # characters of text that are worked on at once
CACHED = 50_000  # unseen words whose backed-off score is remembered
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Table:
    """For each entry the languages it was seen in and what each of them gains by it: the log of
    its frequency over that of an entry never seen, which is the same in every language."""

    entries: dict[str, int]  # row; that of k is at bounds[k] : bounds[k + 1]
    bounds: np.ndarray
    langs: np.ndarray
    gains: np.ndarray


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: Table
    commonest: int = 0  # the language with most of the sample, for texts that no table knows


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from. Those without doc_id are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows (lang, entry, n) of all entries that are among the `most` commonest of one
    language at least; among equally common ones a hash decides. How many entries have each
    count tells where a language's table ends, so none is sorted in one place."""
    above = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    room = (
        counts.groupBy("lang", "n").agg(F.count("*").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(above), F.lit(0)))
        .select("lang", "n", ((F.lit(most) - F.col("before")) / F.col("size")).alias("share")).filter("share > 0")
    )
    drawn = F.pmod(F.xxhash64("entry"), F.lit(2**31)) / float(2**31)
    kept = counts.join(durable(room), ["lang", "n"]).filter(drawn < F.col("share")).select("entry").distinct()
    return counts.join(durable(kept), "entry").select("lang", "entry", "n")


def _table(counts: pa.Table, languages: list[str], least: float) -> Table:
    """A row of gains for each entry. An entry never seen in a language has the frequency of
    `least` occurrences in the largest one, so a language known from little is no likelier."""
    entry = pc.dictionary_encode(counts["entry"].combine_chunks())
    at = {language: k for k, language in enumerate(languages)}
    langs = np.array([at[x] for x in counts["lang"].to_pylist()], dtype=np.int32)
    n, rows = counts["n"].to_numpy().astype(float), entry.indices.to_numpy()
    total = np.bincount(langs, n, minlength=len(languages))
    unseen = least / max(total.max(initial=0), 1)
    order = np.argsort(rows, kind="stable")
    bounds = np.searchsorted(rows[order], np.arange(len(entry.dictionary) + 1))
    gains = np.log1p(n / total[langs] / unseen) if len(n) else n
    return Table({w: k for k, w in enumerate(entry.dictionary.to_pylist())}, bounds, langs[order], gains[order])


def trained(labelled: DataFrame, docs_per_language: int = TRAIN_DOCS) -> Model:
    """A model from `text` and `lang` of labelled documents; rows without either are left out.

    It learns from a sample: of each language, the distinct texts whose hash falls below a
    share that makes `docs_per_language` of them on average, and all where there are fewer.
    Counting is a job over the sample; the driver gets the tables of the model."""
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    # Copies count once: their number neither thins out the other texts nor fills the sample.
    distinct = labelled.select("lang", F.xxhash64("text").alias("key")).distinct()
    share = durable(distinct.groupBy("lang").agg((F.lit(float(docs_per_language)) / F.count("*")).alias("share")))
    drawn = F.pmod(F.xxhash64("text"), F.lit(2**31)) / float(2**31)
    sample = labelled.join(share, "lang").filter(drawn < F.col("share")).select("text", "lang").distinct()
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("entry"))
        .groupBy("lang", "entry").agg(F.count("*").alias("n"))
    )
    words = durable(words)
    marked = F.concat(F.lit(" "), F.col("entry"), F.lit(" "))
    grams = None
    for size in range(1, LONGEST + 1):
        pieces = words.select(
            "lang", "n", F.explode(F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(marked) - (size - 1), F.lit(1))),
                lambda i, size=size: F.substring(marked, i, F.lit(size)))).alias("entry"),
        ).filter(F.length("entry") == size)
        grams = pieces if grams is None else grams.union(pieces)
    # A blank alone stands in every language.
    grams = durable(grams.filter("entry != ' '").groupBy("lang", "entry").agg(F.sum("n").alias("n")))
    known = _commonest(words.filter("n > 1"), MAX_WORDS).toArrow()
    shorter = _commonest(grams, MAX_GRAMS).toArrow()
    # A label none of whose texts has a word is no language.
    languages = sorted(set(pc.unique(shorter["lang"]).to_pylist()))
    size = dict.fromkeys(languages, 0)
    for row in words.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        if row["lang"] in size:
            size[row["lang"]] = row["n"]
    commonest = max(range(len(languages)), key=lambda k: size[languages[k]], default=0)
    return Model(languages, _table(known, languages, 0.5), _table(shorter, languages, 0.5), commonest)


def _ranges(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the parts of some rows stand, one row after the other."""
    starts, sizes = bounds[rows], bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Rows(dict):
    """Word -> its row of gains: that of the table, else one made by backing off."""

    def __init__(self, model: Model):
        super().__init__(model.words.entries)
        self.model = model
        self.fixed = len(model.words.entries)
        room = CACHED * min(4, max(1, len(model.languages)))
        self.bounds = np.concatenate([model.words.bounds, np.zeros(CACHED, dtype=np.int64)])
        self.langs = np.concatenate([model.words.langs, np.zeros(room, dtype=np.int32)])
        self.gains = np.concatenate([model.words.gains, np.zeros(room)])

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        langs, gains = self.backed_off(word)
        start = int(self.bounds[row])
        end = start + len(langs)
        if row + 1 >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds[: row // 2 + 1])])
        while end > len(self.langs):
            self.langs = np.concatenate([self.langs, np.zeros(len(self.langs) // 2 + 1, dtype=np.int32)])
            self.gains = np.concatenate([self.gains, np.zeros(len(self.gains) // 2 + 1)])
        self.langs[start:end], self.gains[start:end], self.bounds[row + 1] = langs, gains, end
        return row

    def backed_off(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """At each character the longest known n-gram that starts there; the mean of their gains."""
        grams, marked = self.model.grams, f" {word} "
        found = []
        for start in range(len(marked) - 1):
            for size in range(LONGEST, 0, -1):
                row = grams.entries.get(marked[start : start + size])
                if row is not None:
                    found.append(row)
                    break
        at = _ranges(grams.bounds, np.array(found, dtype=np.int64))
        gains = np.bincount(grams.langs[at], grams.gains[at], minlength=len(self.model.languages))
        langs = np.flatnonzero(gains)
        return langs, gains[langs] / max(len(found), 1)

    def trim(self) -> None:
        """Forget the unseen words, between documents, once there are many."""
        if len(self) > self.fixed + CACHED:
            super().clear()
            super().update(self.model.words.entries)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the gains of each language, summed over its words."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
        text = np.repeat(np.repeat(np.arange(len(texts)), sizes), self.bounds[rows + 1] - self.bounds[rows])
        at, many = _ranges(self.bounds, rows), len(self.model.languages)
        return np.bincount(text * many + self.langs[at], self.gains[at], minlength=len(texts) * many).reshape(len(texts), many)


def predicted(texts: list[str | None], rows: Rows) -> list[tuple[str, float]]:
    """Of each text the likeliest language and its share of the likelihood. Of equally likely
    languages the first by name is named. Where no language knows a piece of any word, that is the
    commonest one, with an even share; `und` without letters."""
    many = len(rows.model.languages)
    words = [WORD.findall(text.lower()) if text and many else [] for text in texts]
    rows.trim()
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    lettered = [k for k, w in enumerate(words) if w]
    if not lettered:
        return found
    scores = rows.of([words[k] for k in lettered])
    sizes = np.array([len(words[k]) for k in lettered])
    best = np.where(scores.any(1), scores.argmax(1), rows.model.commonest)
    scores = scores * (np.minimum(sizes, EVIDENCE) / sizes)[:, None]
    shares = np.exp(scores - scores.max(1, keepdims=True))
    share = shares[np.arange(len(best)), best] / shares.sum(1)
    for k, language, value in zip(lettered, best.tolist(), share.tolist()):
        found[k] = rows.model.languages[language], value
    return found


def predict(text: str | None, rows: Rows) -> tuple[str, float]:
    return predicted([text], rows)[0]


def _in_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that are worked on at once, of about GROUP characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, with `lang_pred` and `score` (0 to 1); columns of these names
    are replaced. A text that is null, empty or without a letter is `und` with score 0, as is
    every text when there was nothing to learn from. Whole texts count; only `text` is read."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def named(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = Rows(shared.value)
        for part in texts:
            found = [x for group in _in_groups(part.to_pylist()) for x in predicted(group, rows)]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["lang_pred", "score"],
            )

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    made = spare("named", docs)
    out = docs.select(*(F.col(f"`{c}`") for c in kept), named(F.col("text").cast("string")).alias(made))
    return out.select(*(F.col(f"`{c}`") for c in kept), f"{made}.lang_pred", f"{made}.score")


def learn_from(docs: DataFrame) -> Model:
    """From `text` and `lang` of the documents that are not held out."""
    return trained(docs.filter(~held_out(F.col("doc_id"))))
