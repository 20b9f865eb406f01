"""Personal data: what is found by pattern, and the terms that give it away by the company they keep.

All of it is DataFrame functions. An entity is the normalised value of an email, ip, card or phone. Its contexts are the words
around its mentions. Of exact copies of a document one counts, on all sides, so that copies change nothing. For a
term t in enough contexts of an entity e, the pointwise mutual information log2(p(e,t) / (p(e) p(t))) is the part of e's
information content -log2 p(e) that t gives away. A term that gives away at least the share GENERALISE is replaced by its
kind wherever it stands in a document that mentions e; from the share REMOVE on it is taken out. Company is kept at two ranges,
of which the greater share counts: the words near a mention, counted in words, and all words of a text that mentions e, however
far from the mention, counted in texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwarden.llm.common import BREAK, WORD, keyed_texts, let, saved

#: Kind to what a mention looks like. The possessive forms match what the plain ones match; that a match starts where its run
#: of characters starts, or where the match before ended, keeps long runs from being tried from each place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no mention of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
#: Words on either side of a mention that are its context; different contexts, or distinct texts, that an entity and a
#: term must have in common: with fewer, each rare word of a text would give away whatever the text mentions.
CONTEXT_WORDS, LEAST_CONTEXTS = 5, 3
GENERALISE, REMOVE = 0.8, 0.999
#: Broadcast a table of this many rows at most.
BROADCAST_ROWS = 20_000

SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, -at, F.lit(1)).cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(value), _luhn)
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, kind: str, valid) -> Column:
    """The valid matches as spans in code points, in order, without overlaps."""
    def collect(parts: Column) -> Column:
        gaps, values = parts["gaps"], parts["values"]

        def step(state: Column, at: Column) -> Column:
            value = F.get(values, at)
            start = state["place"] + F.char_length(F.get(gaps, at))
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"),
                            (start + F.char_length(value)).alias("stop"), value.alias("value"))
            return F.struct((start + F.char_length(value)).alias("place"),
                            F.when(valid(value), F.concat(state["found"], F.array(span)))
                            .otherwise(state["found"]).alias("found"))

        nothing = F.struct(F.lit(0).alias("place"), F.array().cast(SPANS).alias("found"))
        numbers = F.sequence(F.lit(0), F.size(values) - 1)
        return F.when(F.size(values) > 0, F.aggregate(numbers, nothing, step)["found"]).otherwise(
            F.array().cast(SPANS))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), collect)


def base_spans(text: Column, kind: str) -> Column:
    """All mentions of a kind: array of (kind, start, stop, value); empty for a null text."""
    found = _located(text, PATTERNS[kind], kind, lambda value: _valid(kind, value))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPANS))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"])
    return F.concat_ws(":", span["kind"], value.otherwise(_digits(span["value"])))


def _term(word: Column) -> Column:
    """A word without the marks around it, in lower case."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _words(text: Column) -> Column:
    """Every word's term, repeated ones too."""
    return F.array_remove(F.transform(F.split(text, BREAK), _term), "")


def _context(text: Column, span: Column, spans: Column) -> Column:
    """The terms around a mention, without those that are part of a mention themselves."""
    near = 40 * CONTEXT_WORDS  # characters looked at on either side; words longer than 40 shorten the context
    left = F.substring(text, F.greatest(span["start"] - near, F.lit(0)) + 1, F.least(span["start"], F.lit(near)))
    right = F.substring(text, span["stop"] + 1, F.lit(near))
    hidden = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
    words = F.concat(
        let(F.array_remove(F.split(F.regexp_replace(left, hidden, " "), BREAK), ""),
            lambda own: F.slice(own, F.greatest(F.size(own) - (CONTEXT_WORDS - 1), F.lit(1)), CONTEXT_WORDS)),
        F.slice(F.array_remove(F.split(F.regexp_replace(right, hidden, " "), BREAK), ""), 1, CONTEXT_WORDS))
    return F.array_remove(F.array_distinct(F.transform(words, _term)), "")


def _copy(text: Column) -> Column:
    """What exact copies of a text share."""
    return F.md5(text.cast("binary"))


def _near_pairs(mentions: DataFrame) -> DataFrame:
    """(entity, term, n_entity, n_both): mentions in distinct texts, and those with the term in their context."""
    distinct = mentions.dropDuplicates(["copy", "at"])
    joint = (distinct.select("entity", "terms", F.explode("terms").alias("term")).groupBy("entity", "term", "terms")
             .agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term")
             .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS))
    sizes = distinct.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(
        F.col("n_entity") >= LEAST_CONTEXTS)
    return joint.join(sizes, "entity").select("entity", "term", "n_entity", "n_both")


def _text_pairs(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, n_entity, n_both): distinct texts that mention the entity, and those that hold the term as well."""
    once = saved(mentions.select("copy", "entity").distinct())
    sizes = once.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= LEAST_CONTEXTS)
    wanted = saved(once.join(sizes, "entity").groupBy("copy").agg(
        F.collect_list(F.struct("entity", "n_entity")).alias("entities")))
    few = wanted.count() <= BROADCAST_ROWS
    company = found.join(F.broadcast(wanted) if few else wanted, "copy").dropDuplicates(["copy"])
    unmarked = _rewritten(F.col("text"), ["spans"], F.lit(None), lambda span, flagged: F.lit(" "))
    return (company.select("entities", F.explode(F.array_distinct(_words(unmarked))).alias("term"))
            .select("term", F.inline("entities")).groupBy("entity", "term")
            .agg(F.first("n_entity").alias("n_entity"), F.count(F.lit(1)).alias("n_both"))
            .where(F.col("n_both") >= LEAST_CONTEXTS))


def disclosing_terms(texts: DataFrame, mentions: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share): the terms that give away at least GENERALISE of an entity's information.

    All four counts are over distinct texts, so that any number of exact copies of a document changes none of them: near a
    mention they are of words (all of them, the term, mentions, mentions with the term in their context), else of texts.
    """
    pairs = saved(_near_pairs(mentions).withColumn("near", F.lit(True)).union(
        _text_pairs(mentions, found).withColumn("near", F.lit(False))))
    words = _words(F.col("text"))
    held = F.concat(F.transform(words, lambda term: F.struct(term.alias("term"), F.lit(True).alias("near"))),
                    F.transform(F.array_distinct(words), lambda term: F.struct(term.alias("term"), F.lit(False).alias("near"))))
    distinct = texts.where("text is not null").dropDuplicates(["copy"])
    counts = saved(distinct.select(F.inline(held)).groupBy("term", "near").agg(F.count(F.lit(1)).alias("n_term")))
    total = counts.agg(F.sum(F.when(F.col("near"), F.col("n_term"))).alias("n_words")).join(
        texts.where("text is not null").agg(F.count_distinct("copy").alias("n_texts")))
    n = F.when(F.col("near"), F.col("n_words")).otherwise(F.col("n_texts"))
    n_term = F.greatest(F.coalesce("n_term", "n_both"), "n_both")
    content = F.log2(n / F.col("n_entity"))
    revealed = F.log2(F.col("n_both") * n / (F.col("n_entity") * n_term))
    share = F.when(content > 0, revealed / content).otherwise(F.lit(0.0))
    return (pairs.join(counts, ["term", "near"], "left").join(F.broadcast(total))  # one row
            .groupBy("entity", "term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (sanitised; null stays null), the spans of each kind, and `terms`: the spans that the method adds.

    Null and empty texts have no spans. Rows that share an id share the terms found for it. Of the other columns those
    in `keep` come along. Spans count code points of the given text; those that overlap are replaced as one.
    """
    texts = keyed_texts(docs, id_col, text_col, *keep)
    copies = texts.select("doc_id", "text", _copy(F.col("text")).alias("copy"))
    kinds = list(PATTERNS)
    found = copies.where(F.greatest(*[F.col("text").rlike(hint) for hint in HINTS.values()])).withColumn(
        "spans", F.concat(*[base_spans(F.col("text"), kind) for kind in kinds])).where(F.size("spans") > 0)
    mentions = saved(found.select("doc_id", "copy", "text", "spans", F.posexplode("spans").alias("at", "span"))
                     .select("doc_id", "copy", "at", _entity(F.col("span")).alias("entity"),
                             _context(F.col("text"), F.col("span"), F.col("spans")).alias("terms")))
    disclosing = disclosing_terms(copies, mentions, found)
    flagged = saved(mentions.select("doc_id", "entity").distinct().join(disclosing, "entity").groupBy("doc_id", "term")
                    .agg(F.max("share").alias("share")).groupBy("doc_id")
                    .agg(F.collect_set(F.struct("term", "share")).alias("flagged")))
    few = flagged.count() <= BROADCAST_ROWS
    marked = texts.join(F.broadcast(flagged) if few else flagged, "doc_id", "left")
    located = marked.withColumns({kind: base_spans(F.col("text"), kind) for kind in kinds} | {
        "terms": F.when(F.col("flagged").isNotNull(), _located(
            F.col("text"), WORD, "term", lambda word: F.array_contains("flagged.term", _term(word)))
        ).otherwise(F.array().cast(SPANS))})
    return located.select("doc_id", _rewritten(F.col("text"), [*kinds, "terms"], F.col("flagged")).alias("text"),
                          *kinds, "terms", *keep)


def _label(span: Column, flagged: Column) -> Column:
    term = _term(span["value"])
    share = F.element_at(F.filter(flagged, lambda row: row["term"] == term), 1)["share"]
    general = (F.when(share >= REMOVE, "").when(span["value"].rlike("[0-9]"), "[NUMBER]")
               .when(span["value"].rlike(r"^\P{L}*\p{Lu}"), "[NAME]").otherwise("[TERM]"))
    return F.when(span["kind"] == "term", general).otherwise(
        F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))


def _rewritten(text: Column, columns: list[str], flagged: Column, label_of=_label) -> Column:
    every = F.sort_array(F.transform(F.concat(*columns), lambda span: F.struct(
        span["start"].alias("start"), (-span["stop"]).alias("back"), span.alias("span"))))

    def step(state: Column, row: Column) -> Column:
        span = row["span"]
        between = F.substring(text, state["place"] + 1, span["start"] - state["place"])
        label = label_of(span, flagged)
        parts = F.when(span["start"] >= state["place"], F.concat(state["parts"], F.array(between, label)))
        return F.struct(F.greatest(state["place"], span["stop"]).alias("place"),
                        parts.otherwise(state["parts"]).alias("parts"))

    def whole(state: Column) -> Column:
        rest = F.substring(text, state["place"] + 1, F.char_length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    start = F.struct(F.lit(0).alias("place"), F.array().cast("array<string>").alias("parts"))
    return F.when(F.size(F.concat(*columns)) == 0, text).otherwise(let(F.aggregate(every, start, step), whole))


def digest(sanitised: DataFrame) -> DataFrame:
    """Counts of each kind, a hash of the pattern spans, and all spans as text."""
    kinds = list(PATTERNS)
    listed = lambda columns: F.array_join(F.transform(F.concat(*columns), lambda span: F.concat_ws(
        ":", span["kind"], span["start"].cast("string"), span["stop"].cast("string"))), ",")
    return sanitised.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(listed(kinds).cast("binary"), 256).alias("base_sha256"), listed([*kinds, "terms"]).alias("spans"))
