"""Quality rules: plain counts, and how far a text's letters and common words are from its language's.

All of it is DataFrame functions. The references come from the corpus: for each language, the words of few letters that most of
its documents hold, in bands by rank, and the median shares of the bands and of the character classes over all documents
that pass the plain rules (medians, so that a share of junk leaves them as they are). A document is compared
with the reference of its own language by Jensen-Shannon distance (0 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.common import BREAK, keyed_texts, let, saved

#: Characters by class; what belongs to none is "other".
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "space": r"\x20\x09-\x0D",
    "point": r".,;:'()\-",
    "mark": r"!?\"",
}
#: Common words of a language; the longest of them, in characters; documents a language needs for a reference; and the most
#: languages with one (those of most documents). A language without one is judged by the nearest reference's character classes.
BANDS = (5, 15, 40)  # ranks of the last word of each
COMMON_LENGTH, LEAST_DOCS, MOST_LANGUAGES = 6, 20, 256
#: The guards: fewer characters or words than this say too little, and the comparison is left out.
LEAST_CHARS, LEAST_WORDS = 100, 40
#: Distances above these reject.
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.25
#: Shares are counted in steps of one part in so many for their medians.
STEPS = 1000

WINDOW = 8


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[{chars}]+", ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK), "")


def _repeated_words(words: Column) -> Column:
    """Words in windows of eight that the text holds twice or more."""
    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda value, at: F.struct(value.alias("h"), at.alias("at"))))
        repeated = let(marked, lambda rows: F.filter(rows, lambda row, at: (
            ((at > 0) & (F.get(rows, at - 1)["h"] == row["h"]))
            | F.coalesce(F.get(rows, at + 1)["h"] == row["h"], F.lit(False)))))
        places = F.sort_array(F.transform(repeated, lambda row: row["at"]))
        state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, state, lambda acc, at: F.struct(
            at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n")))["n"]

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                         lambda at: F.xxhash64(F.slice(words, at, WINDOW)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, found).otherwise(0)


def text_counts(texts: DataFrame) -> DataFrame:
    """doc_id, lang and text to the plain counts and one count for each character class; `words` stays for further use."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = texts.withColumn("words", _words(F.col("text")))
    classes = {f"c_{name}": F.char_length("text") - _without(F.col("text"), chars)
               for name, chars in CLASSES.items()}
    return counted.select(
        "doc_id", "lang", "words", F.xxhash64("text").alias("text_hash"), F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), r"\x20\x09-\x0D").cast("long").alias("word_chars"),
        (F.char_length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("n_chars"), *[value.alias(name) for name, value in classes.items()])


def common_words(texts: DataFrame) -> dict[str, list[str]]:
    """For each language its commonest short words, by the number of documents. At most MOST_LANGUAGES lists."""
    short = F.array_distinct(F.filter(_words(F.lower("text")), lambda word: F.char_length(word) <= COMMON_LENGTH))
    known = texts.where(F.col("lang").isNotNull())
    counts = (known.select("lang", F.explode(short).alias("word"))
              .where(F.col("word").rlike(r"^\p{L}+$")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= BANDS[-1])
    languages = (known.groupBy("lang").count().where(F.col("count") >= LEAST_DOCS)
                 .orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES))
    found: dict[str, list[str]] = {}
    for row in ranked.join(languages, "lang").orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["word"])
    return found


def _hits(words: Column, bands: list[list[str]]) -> Column:
    """How many of the words are in each band."""
    def within(own: Column, band: list[str]) -> Column:
        return F.size(F.filter(own, lambda word: word.isin(band))).cast("long")

    return let(words, lambda own: F.array(*[within(own, band) for band in bands]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the plain counts, base_failed, kept, the two distances and a hash of the text, for each row of `docs`.

    Null and empty texts have no words and fail the plain rules. Texts that are too short for the guards, or whose
    language has no reference at all, are kept if they pass the plain rules. A null language is compared with the
    nearest reference by character classes alone. Repeated rows are judged alike.
    """
    texts = keyed_texts(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").withColumn(
        "text", F.coalesce("text", F.lit("")))
    common = common_words(texts)
    classes, bands = [f"c_{name}" for name in CLASSES], [f"b_{last}" for last in BANDS]
    hits = F.lit(None).cast("array<long>")
    for lang, words in common.items():
        ranked = [words[first:last] for first, last in zip((0, *BANDS), BANDS, strict=False)]
        hits = F.when(F.col("lang") == lang, _hits(F.transform("words", F.lower), ranked)).otherwise(hits)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = text_counts(texts).withColumns({"hits": hits, "base_failed": failed}).drop("words")
    stats = saved(counted.withColumns({name: F.get("hits", F.lit(at)) for at, name in enumerate(bands)}).drop("hits"))

    medians = _median_shares(stats.where(~F.col("base_failed") & F.col("lang").isin(list(common))),
                             {c: "n_chars" for c in classes} | {b: "n_words" for b in bands}) if common else {}
    class_counts = [F.col(c) for c in classes]
    to_each = {lang: _distance(class_counts, F.col("n_chars"), [found.get(c, 0.0) for c in classes])
               for lang, found in medians.items()}
    class_distance = F.lit(None).cast("double")
    if to_each:
        class_distance = F.array_min(F.array(*to_each.values()))
    word_distance = F.lit(None).cast("double")
    for lang, found in medians.items():
        class_distance = F.when(F.col("lang") == lang, to_each[lang]).otherwise(class_distance)
        word_distance = F.when(F.col("lang") == lang, _distance(
            [F.col(b) for b in bands], F.col("n_words"), [found.get(b, 0.0) for b in bands])).otherwise(word_distance)
    judged = stats.withColumns({
        "class_distance": F.when(F.col("n_chars") >= LEAST_CHARS, class_distance),
        "word_distance": F.when(F.col("n_words") >= LEAST_WORDS, word_distance)})
    far = (F.coalesce(F.col("class_distance") > CLASS_LIMIT, F.lit(False))
           | F.coalesce(F.col("word_distance") > WORD_LIMIT, F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance", "text_hash")


def _median_shares(stats: DataFrame, totals: dict[str, str]) -> dict[str, dict[str, float]]:
    """For each language the median over documents of each count's share of its total, as counted in steps."""
    shares = F.array(*[F.struct(F.lit(name).alias("name"), F.round(F.try_divide(F.col(name) * STEPS, F.col(total))).alias("share"))
                       for name, total in totals.items()])
    counts = (stats.select("lang", F.explode(shares).alias("of")).where(F.col("of.share").isNotNull())
              .groupBy("lang", "of.name", "of.share").agg(F.count(F.lit(1)).alias("n")))
    one = Window.partitionBy("lang", "name")  # STEPS rows at most
    below = F.sum("n").over(one.orderBy("share"))
    found = (counts.withColumns({"below": below, "all": F.sum("n").over(one)}).where(2 * F.col("below") >= F.col("all"))
             .groupBy("lang", "name").agg(F.min("share").alias("share"))).collect()
    medians: dict[str, dict[str, float]] = {}
    for row in found:
        medians.setdefault(row["lang"], {})[row["name"]] = row["share"] / STEPS
    return medians


def _distance(counts: list[Column], total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, between counts and reference shares; what is left of either is a class of its own."""
    def term(share: Column, middle: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / middle)).otherwise(F.lit(0.0))

    def divergence(own: Column, other: float) -> Column:
        return let(own, lambda p: let((p + other) / 2, lambda m: (term(p, m) + term(F.lit(other), m)) / 2))

    left = F.greatest(total - sum(counts[1:], counts[0]), F.lit(0))
    parts = [divergence(F.try_divide(n, total).cast("double"), share)
             for n, share in zip([*counts, left], [*reference, max(0.0, 1 - sum(reference))], strict=True)]
    return F.when(total > 0, F.sqrt(F.greatest(sum(parts[1:], parts[0]), F.lit(0.0))))
