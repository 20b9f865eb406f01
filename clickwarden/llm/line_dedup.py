"""Line dedup: lines that equal an earlier line, or differ from one by few edits, go.

All of it is DataFrame functions. Equal lines are found by 128 bits of hash. For the others a line of length l is cut into
max_edits + 1 segments; a line within max_edits of it holds one of them unchanged, at one of a few places that depend on the
two lengths. So each line enters its own segments under (length, number, text) and looks up its substrings under the lengths
it can be close to. Where many lines meet under one key, the key is refined: of the line's parts beside the matching
segment the one with more different texts is cut in the same way, with the edits left for it, so that no key pairs all lines
that share a beginning, an end or both. Pairs are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwarden.llm.common import keyed_texts, let, saved

#: Edits between near lines, and the shortest line for which near counts: shorter ones must be equal.
MAX_EDITS, LEAST_CHARS = 2, 30
#: Pairs under one key beyond which it is refined, and how often that may happen.
HOT_PAIRS, REFINEMENTS = 1_000, 6
WHITE = " \t\n\x0b\x0c\r"
#: Broadcast a table of this many rows at most.
BROADCAST_ROWS = 200_000

#: An entry may be found (1), looks for others (2), or both (3).
FOUND, LOOKS, BOTH = 1, 2, 3


def _places(budget: int, delta: int) -> list[tuple[int, int]]:
    """(segment from 1, shift) at which a text that is longer by delta can hold a segment unchanged.

    With the first match in mind: fewer than j edits lie before segment j, and the others behind it.
    """
    out = []
    for j in range(1, budget + 2):
        low = max(-(j - 1), delta - (budget + 1 - j))
        high = min(j - 1, delta + (budget + 1 - j))
        out += [(j, shift) for shift in range(low, high + 1)]
    return out


def _placed(rows: DataFrame, places: list[tuple[int, int, int, int]]) -> DataFrame:
    """Each row with each of the places (budget, delta, j, shift) for its own budget and delta, if it has them."""
    placed = rows.withColumn("p", F.explode(F.array(*[
        F.struct(*[F.lit(value).alias(name) for name, value in zip(("budget", "delta", "j", "shift"), place, strict=True)])
        for place in places])))
    own = [F.col(f"p.{name}") == F.col(name) for name in ("budget", "delta") if name in rows.columns]
    for test in own:
        placed = placed.where(test)
    return placed.drop("budget", "delta").select("*", "p.*").drop("p")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (size, budget, delta, j, shift) with the `begin` and `length` of their segment in the part."""
    parts, j, other = F.col("budget") + 1, F.col("j"), F.col("size") - F.col("delta")
    base = F.floor(other / parts).cast("int")
    even = parts - (other - base * parts)  # so many segments come before those with one more
    return rows.withColumns({"length": base + F.when(j > even, 1).otherwise(0),
                             "begin": (j - 1) * base + F.greatest(F.lit(0), j - 1 - even) + F.col("shift")})


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (line, key, role, start, size, and a place) as entries, under the key of their segment.

    The part of `size` characters from `start` (from 0) is cut. Only unshifted segments are found; one that is looked
    for is looked for at all places.
    """
    role = (F.when((F.col("shift") == 0) & (F.col("delta") == 0), F.col("role"))
            .when(F.col("role") == FOUND, 0).otherwise(LOOKS))
    begin, length = F.col("begin"), F.col("length")
    return (_cut(rows).withColumn("role", role).where((begin >= 0) & (begin + length <= F.col("size")) & (F.col("role") > 0))
            .withColumn("key", F.xxhash64("key", "j", F.substring("line", F.col("start") + begin + 1, length))))


def _line_entries(lines: DataFrame, max_edits: int) -> DataFrame:
    """The entries of whole lines (h, g, key, role, delta, j, shift), for each length that a line can be close to."""
    places = [(max_edits, delta, j, shift) for delta in range(max_edits + 1) for j, shift in _places(max_edits, delta)]
    sized = _placed(lines.select("h", "g", "line", F.char_length("line").alias("size")), places)
    return _keyed(sized.withColumns({"key": F.xxhash64(F.col("size") - F.col("delta")), "role": F.lit(BOTH),
                                     "start": F.lit(0)})).select("h", "g", "key", "role", "delta", "j", "shift")


def _sides(entries: DataFrame) -> DataFrame:
    """Entries with their lines to h, g, key, role and what is refined next: start, size, delta, budget, apart, differs, behind.

    Of the two parts beside a segment that is the left one, for the first segment the right one. Some matching segment j has
    j - 1 edits before it, no fewer, so what lies left of segment 2 and up is not equal in the two lines: `apart` says that the
    part is of such a one, and `differs` stands for what cannot be equal. `behind` is the other part, where there is one.
    """
    parts, j, shift, delta = F.col("budget") + 1, F.col("j"), F.col("shift"), F.col("delta")
    start, size, begin, left = F.col("start"), F.col("size"), F.col("begin"), F.col("j") > 1
    end = begin + F.col("length")
    before, after = F.substring("line", start + 1, begin), F.substring("line", start + end + 1, size - end)
    right = {"start": start + end, "size": size - end, "delta": delta - shift, "budget": parts - j}
    return _cut(entries).select(
        "h", "g", "key", "role", *[F.when(left, value).otherwise(right[name]).alias(name)
                                   for name, value in (("start", start), ("size", begin), ("delta", shift), ("budget", j - 1))],
        (left | F.col("apart")).alias("apart"),
        F.when(left, F.xxhash64(before)).when(F.col("apart"), F.xxhash64(after)).otherwise(F.col("h")).alias("differs"),
        F.when(left & (j < parts), F.struct(*[value.alias(name) for name, value in right.items()],
                                            F.xxhash64(after).alias("hash"))).alias("behind"))


def _refined(rows: DataFrame, max_edits: int) -> DataFrame:
    """The entries one level below of rows (h, g, line, and an entry's columns)."""
    return _sides(_keyed(_placed(rows, [(budget, delta, j, shift) for budget in range(max_edits + 1)
                                        for delta in range(-budget, budget + 1) for j, shift in _places(budget, delta)])))


def _turned(entries: DataFrame) -> DataFrame:
    """Entries with `turn`, whether what lies behind the segment is refined next and not what lies before it."""
    turn, names = F.col("turn"), ("start", "size", "delta", "budget")
    return entries.withColumns({**{name: F.when(turn, F.col(f"behind.{name}")).otherwise(F.col(name)) for name in names},
                                "apart": F.col("apart") & ~turn}).drop("turn", "differs", "behind")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), number (from 0), line (without white space around it) and its hashes: the lines with a word."""
    return _hashed(_split(docs))


def _split(docs: DataFrame) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda line: F.trim(line, F.lit(WHITE)))
    return docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("t"), F.posexplode(lines).alias("number", "line")).where("line <> ''")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def edits_at_most(a: Column, b: Column, limit: int) -> Column:
    """Whether the edit distance of two texts is at most `limit`; both must be longer than that.

    The dynamic program keeps, of each column, the 2 * limit + 1 cells around the diagonal, as bits: vp and vn say where the distance
    grows or falls by one from a cell to the next one down. A column takes a handful of integer operations. The distance
    is followed along the lowest diagonal to the last row, and then along that row.
    """
    width = 2 * limit + 1
    full = (1 << width) - 1

    def run(sides: Column) -> Column:
        text, pattern = sides["a"], sides["b"]
        last = F.size(pattern) - limit  # from this column on, the band's lowest cell is below the last row

        def step(state: Column, i: Column) -> Column:
            char = F.get(text, i)
            match = F.lit(0).cast("long")
            for d in range(width):
                match = match.bitwiseOR(F.when(F.get(pattern, i - limit + d) == char, 1 << d).otherwise(0).cast("long"))
            vp, vn = state["vp"], state["vn"]

            def diagonal(x: Column) -> Column:
                return (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def column(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
                return let(F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(vp).alias("hn")), after)

            def after(s: Column) -> Column:
                down = F.shiftright(s["d0"], 1)
                bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(width - 2) - (i - last), F.lit(0)))
                change = F.when(i < last, F.when(s["d0"].bitwiseAND(F.lit(1 << (width - 1))) != 0, 0).otherwise(1)).otherwise(
                    F.when(s["hp"].bitwiseAND(bit) != 0, 1).when(s["hn"].bitwiseAND(bit) != 0, -1).otherwise(0))
                return F.struct(
                    s["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(s["hp"])).bitwiseAND(F.lit(full))).alias("vp"),
                    down.bitwiseAND(s["hp"]).alias("vn"), (state["distance"] + change).alias("distance"))

            return let(let(match, diagonal), column)

        start = F.struct(F.lit((full << limit) & full).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
                         F.lit(limit).alias("distance"))
        return F.aggregate(F.sequence(F.lit(0), F.size(text) - 1), start, step)["distance"] <= limit

    sides = let(_middles(a, b, limit + 1), lambda s: F.struct(F.split(s["a"], "").alias("a"), F.split(s["b"], "").alias("b")))
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > limit, False).otherwise(let(sides, run))


def _shared(a: Column, b: Column, most: Column) -> Column:
    """How many characters two texts have in common at the start, `most` at most: one bit of the number after the other."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(30))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (n + step <= most) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n))


def _middles(a: Column, b: Column, least: int) -> Column:
    """Two texts without what they share at the start and end, but with `least` characters of each: as far apart as before."""
    room = F.least(F.char_length(a), F.char_length(b)) - least

    def cut(n: Column) -> Column:
        rest_a, rest_b = F.substring(a, n + 1, F.char_length(a)), F.substring(b, n + 1, F.char_length(b))
        return let(_shared(F.reverse(rest_a), F.reverse(rest_b), room - n), lambda m: F.struct(
            F.substring(rest_a, F.lit(1), F.char_length(rest_a) - m).alias("a"),
            F.substring(rest_b, F.lit(1), F.char_length(rest_b) - m).alias("b")))

    return let(_shared(a, b, room), cut)


def _signatures(line: Column) -> list[Column]:
    """64 bits each for how often characters, and pairs of neighbours, occur: one bit for odd and even of all with a hash.

    An edit changes two characters and four pairs at most, and so at most as many bits.
    """
    def parity(hashes: Column) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, value: bits.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(value, F.lit(64)).cast("int"))))

    chars = F.split(line, "")
    return [let(chars, lambda c: parity(F.transform(c, lambda x: F.xxhash64(x)))).alias("one"),
            let(chars, lambda c: parity(F.transform(c, lambda x, at: F.xxhash64(x, F.get(c, at + 1))))).alias("two")]


def _small(frame: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it is small."""
    frame = saved(frame)
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _with_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The entries with the columns of their lines. A line is joined once, with all its entries, and not once for each of them.

    A line has some dozens of entries at most at a level, whatever the number of lines.
    """
    own = [name for name in entries.columns if name not in ("h", "g")]
    of_line = entries.groupBy("h", "g").agg(F.collect_list(F.struct(*own)).alias("own"))
    return of_line.join(lines, ["h", "g"]).select(*lines.columns, F.inline("own"))


def near_lines(lines: DataFrame, max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Pairs (h_a, g_a, h_b, g_b) of different lines within max_edits, each pair once."""
    long = lines.where(F.char_length("line") >= max(least_chars, 2 * max_edits + 2))
    entries = _line_entries(long, max_edits)
    keys = (entries.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.bit_or("role").alias("role"))
            .where((F.col("low") != F.col("high")) & (F.col("role") == BOTH)).select("key"))
    state = saved(entries.join(_small(keys), "key", "left_semi").distinct())
    wanted = _small(state.select("h", "g").distinct())
    texts = saved(long.select("h", "g", "line").join(wanted, ["h", "g"], "left_semi").groupBy("h", "g")
                  .agg(F.min("line").alias("line")))
    signed = saved(texts.select("h", "g", *_signatures(F.col("line"))))
    state = saved(_sides(_with_lines(state, texts).withColumns({
        "start": F.lit(0), "size": F.char_length("line"), "budget": F.lit(max_edits), "apart": F.lit(False)})))
    pairs = None
    for again in range(REFINEMENTS + 1):
        found, looks = F.col("role").bitwiseAND(F.lit(FOUND)) > 0, F.col("role").bitwiseAND(F.lit(LOOKS)) > 0
        # Refined is the side with more different texts, as one that the lines have in common tells none apart.
        turn = F.approx_count_distinct("behind.hash", 0.1) > F.approx_count_distinct("differs", 0.1)
        sums = (state.groupBy("key").agg(F.count_if(found).alias("n"), F.count_if(looks).alias("m"), turn.alias("turn"),
                                         F.min("differs").alias("low"), F.max("differs").alias("high"))
                .where("n > 0 and m > 0 and low <> high"))  # no other key pairs lines
        hot = F.col("n") * F.col("m") > (HOT_PAIRS if again < REFINEMENTS else 2**62)
        marked = saved(state.join(sums.select("key", "turn", hot.alias("hot")), "key"))
        cold = saved(_with_lines(marked.where("not hot").select("h", "g", "key", "role").distinct(), signed))
        one, two = (cold.where(side).select("key", *[F.col(name).alias(f"{name}_{letter}") for name in ("h", "g", "one", "two")])
                    for side, letter in ((found, "a"), (looks, "b")))
        a, b = (F.struct(F.col(f"h_{side}").alias("h"), F.col(f"g_{side}").alias("g")) for side in "ab")
        differ = lambda name: F.bit_count(F.col(f"{name}_a").bitwiseXOR(F.col(f"{name}_b")))
        close = (differ("one") <= 2 * max_edits) & (differ("two") <= 4 * max_edits)
        met = one.join(two, "key").where((a != b) & close).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        pairs = met if pairs is None else pairs.union(met)
        if again == REFINEMENTS or (rest := _turned(marked.where("hot").drop("hot"))).isEmpty():
            break
        state = saved(_refined(_with_lines(rest, texts), max_edits).distinct())
    pairs = saved(pairs.distinct().select(F.col("a.h").alias("h_a"), F.col("a.g").alias("g_a"),
                                          F.col("b.h").alias("h_b"), F.col("b.g").alias("g_b")))
    first, second = texts.toDF("h_a", "g_a", "line_a"), texts.toDF("h_b", "g_b", "line_b")
    return saved(pairs.join(first, ["h_a", "g_a"]).join(second, ["h_b", "g_b"])
                 .where(edits_at_most(F.col("line_a"), F.col("line_b"), max_edits))
                 .select("h_a", "g_a", "h_b", "g_b"))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
                text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, t, text without the lines that go, n_lines, n_equal, n_near and dropped (their numbers from 0, in order).

    Lines stand in the order of doc_id and number, and count without the white space around them. A line goes if it equals an
    earlier one or, when both have least_chars characters, is within max_edits of an earlier one. Lines without a word
    stay. Null texts stay null, empty ones empty. Rows with the same id and text count as one and lose the same lines; those with the same id alone
    go by a hash of the text (t). Of the other columns those in `keep` come along.
    """
    texts = keyed_texts(docs, id_col, text_col, *keep)
    lines = _hashed(saved(_split(texts)))  # read five times
    places = F.struct("doc_id", "t", "number")
    firsts = saved(lines.groupBy("h", "g").agg(F.min(places).alias("first"), F.count(F.lit(1)).alias("n")))
    near = near_lines(lines, max_edits, least_chars)
    place = firsts.select("h", "g", "first")
    later = (near.join(place.toDF("h_a", "g_a", "first_a"), ["h_a", "g_a"]).join(
        place.toDF("h_b", "g_b", "first_b"), ["h_b", "g_b"]).select(F.explode(F.array(F.when(
            F.col("first_a") < F.col("first_b"), F.struct(F.col("h_b").alias("h"), F.col("g_b").alias("g"))).otherwise(
            F.struct(F.col("h_a").alias("h"), F.col("g_a").alias("g"))))).alias("l")).select("l.*").distinct())
    repeated = firsts.join(later.withColumn("near", F.lit(True)), ["h", "g"], "left").where("near or n > 1")
    gone = (lines.select("doc_id", "t", "number", "h", "g").join(_small(repeated), ["h", "g"])
            .withColumn("is_first", F.col("first").eqNullSafe(places)).where("near or not is_first")
            .groupBy("doc_id", "t").agg(
                F.array_sort(F.collect_set("number")).alias("dropped"),
                F.count_distinct(F.when(~F.col("is_first"), F.col("number"))).alias("n_equal")))
    gone = _small(gone).withColumnsRenamed({"doc_id": "gone_id", "t": "gone_t"})
    hashed = texts.withColumn("t", F.xxhash64("text"))
    joined = hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["gone_id"]) & (hashed["t"] == gone["gone_t"]), "left")
    parts = F.split("text", "\n")
    kept = let(parts, lambda own: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("dropped")), lambda at: F.get(own, at)), "\n"))
    return joined.select(
        "doc_id", "t", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"),
        F.coalesce(F.size("dropped") - F.col("n_equal"), F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), *keep)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_equal", "n_near",
                          F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
                          F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
