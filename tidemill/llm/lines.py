"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines within EDITS edits of each other are linked, and of each set of linked lines only the first in the corpus (by
document key and place) stays; the others are taken out of their documents. The edit join takes lines of ``least``
code points and more; of shorter lines, down to ``exact`` code points, only equal ones are linked. Empty lines stay. A
document that had text and of which no line is left goes too.

1. A line of length n is cut into EDITS + 1 segments. If two lines are within EDITS edits, one of the shorter line's
   segments is a substring of the longer one, at a place that its length and number bound. Each line gives index keys
   (length, segment number, segment) for itself and probe keys for lines that are up to EDITS shorter.
2. Keys that only one line has are dropped by an aggregate. In the other buckets each line is compared with the bucket's
   smallest and greatest line (stars), so a bucket of k lines costs 2 k comparisons. Counts of characters by class,
   which an edit changes by two in sum at most, come first; a banded bit-parallel edit distance verifies what is left
   of both lines without their common beginning and end.
3. Components of the links. Buckets within one component are done. In the others, lines of different components meet by
   (key, part of the letter counts): of 2 * EDITS + 1 parts one must be equal, so that also large buckets of lines
   that aren't linked fall apart. No bucket is dropped or cut.

Lines are known by a 64-bit hash; two different lines share one with odds of 1 in 2**64. NULL and empty texts stay as
they are. Ids may be NULL or repeated: rows are then told apart by their place in the table. An empty table gives no
rows. All columns are kept, whatever their names. Lines of any length are compared whole. Of equal lines the one with
the smallest (document key, place) stays, so there are no ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, sieve, sifted, stored, within
from tidemill.llm.components import components, joined_components
from tidemill.llm.minhash import keyed

EDITS, LEAST, EXACT = 1, 32, 1
#: Disjoint classes of characters; an edit changes the counts by two in sum at most.
LETTERS = ("e", "a", "n", "t", "i", "o", "r", "s", "cdlu", "hmpw", "gfbvy", " ")


def edit_within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``, by a banded bit-parallel automaton.

    Bit d of the state of level e is set if the first j + d - edits characters of a match the first j of b with e edits or
    fewer; only 2 * edits + 1 diagonals can matter, so a level is one integer, whatever the lengths.
    """
    band = (1 << (2 * edits + 1)) - 1
    long = lambda v: F.lit(v).cast("long")

    def step(p: Column, state: Column, x: Column) -> Column:
        mask = reduce(lambda u, v: u.bitwiseOR(v), [F.when(F.get(p, x["j"] + d - edits) == x["c"], long(1 << d)).otherwise(long(0)) for d in range(2 * edits + 1)])
        new: list[Column] = []
        for e in range(edits + 1):
            r = state[f"r{e}"].bitwiseAND(mask)
            if e:
                low = state[f"r{e - 1}"]
                r = r.bitwiseOR(low).bitwiseOR(F.shiftrightunsigned(low, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
            new.append(r.bitwiseAND(long(band)))
        return F.struct(*[c.alias(f"r{e}") for e, c in enumerate(new)])

    chars = F.transform(F.split(b, ""), lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    start = F.struct(*[long(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)])
    read = F.when(F.length(b) > 0, chars).otherwise(F.slice(chars, 1, 0))
    # a's characters are bound to a variable: as an expression they would be split again for each character of b
    last = F.element_at(F.transform(F.array(F.split(a, "")), lambda p: F.aggregate(read, start, lambda state, x: step(p, state, x))), 1)
    gap = F.length(a) - F.length(b)
    bit = F.call_function("shiftleft", long(1), gap + edits)
    return (F.abs(gap) <= edits) & F.when(F.abs(gap) <= edits, last[f"r{edits}"].bitwiseAND(bit) != 0).otherwise(False)


def stripped(a: Column, b: Column) -> Column:
    """struct<a, b>: the two strings without the beginning and the end that they share; their edit distance stays the same."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

    def common(x: Column, y: Column) -> Column:
        """Length of the common beginning, by doubling from the top."""
        most = F.least(F.length(x), F.length(y))
        longer = lambda n, k: F.when((n + k <= most) & (F.substring(x, F.lit(1), n + k) == F.substring(y, F.lit(1), n + k)), n + k).otherwise(n)
        return F.aggregate(steps, F.lit(0), longer)

    head = F.array(common(a, b))
    tails = F.element_at(F.transform(head, lambda n: F.struct(F.substring(a, n + 1, F.length(a)).alias("a"), F.substring(b, n + 1, F.length(b)).alias("b"))), 1)
    ends = F.transform(F.array(tails), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), common(F.reverse(t["a"]), F.reverse(t["b"])).alias("n")))
    cut = lambda t, c: F.substring(t[c], F.lit(1), F.length(t[c]) - t["n"]).alias(c)
    return F.element_at(F.transform(ends, lambda t: F.struct(cut(t, "a"), cut(t, "b"))), 1)


def join_keys(line: Column, n: Column, edits: int) -> Column:
    """array<struct<sk long, own boolean>>: index keys of the line itself, and probe keys for lines up to ``edits`` shorter.

    Segment i of a line of length m starts after i * m div (edits + 1) characters. A segment of the shorter line stands at
    most ``edits`` places from its own place in the longer one.
    """
    parts = edits + 1
    keys = []
    for less in range(edits + 1):
        m = n - less
        for i in range(parts):
            begin = F.floor(F.lit(i) * m / parts).cast("int")
            size = F.floor(F.lit(i + 1) * m / parts).cast("int") - begin
            for shift in range(-edits, edits + 1):
                # multi-match-aware: edits before the segment are at most i, those after it at most edits - i
                if abs(shift) > i or abs(shift - less) > edits - i:
                    continue
                own = less == 0 and shift == 0
                at = begin + shift
                key = F.xxhash64(m.cast("int"), F.lit(i), F.substring(line, at + 1, size))
                keys.append(F.when((at >= 0) & (at + size <= n), F.struct(key.alias("sk"), F.lit(own).alias("own"))))
    return F.array_compact(F.array(*keys))


def letter_counts(line: Column) -> list[Column]:
    return [(F.length(line) - F.length(F.translate(line, c, ""))).alias(f"c{i}") for i, c in enumerate(LETTERS)]


def _apart(a: str, b: str) -> Column:
    return reduce(lambda u, v: u + v, [F.abs(F.col(f"{a}.c{i}") - F.col(f"{b}.c{i}")) for i in range(len(LETTERS))])


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(key, pos, line, n, id) of the lines of ``least`` code points and more."""
    parts = docs.select("key", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line")).withColumn("n", F.length("line"))
    return parts.filter(F.col("n") >= least).withColumn("id", F.xxhash64("line"))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of line ids within ``edits`` edits; texts: (id, line, c0 ...)."""
    side = lambda x: texts.select(F.col("id").alias(x), F.struct("line", *[f"c{i}" for i in range(len(LETTERS))]).alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_apart("ta", "tb") <= 2 * edits)
    rest = F.array(stripped(F.col("ta.line"), F.col("tb.line")))  # bound likewise, so that it is computed once
    return both.filter(F.element_at(F.transform(rest, lambda t: edit_within(t["a"], t["b"], edits)), 1)).select("a", "b")


def line_links(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(id, component) of the lines of docs(key, text) that are linked to another, different line."""
    keys = _lines(docs, least).select("id", F.explode(join_keys(F.col("line"), F.col("n"), edits)).alias("k")).select("id", "k.sk", "k.own")
    owner = F.when(F.col("own"), F.col("id"))
    hubs = keys.groupBy("sk").agg(F.min(owner).alias("h0"), F.max(owner).alias("h1"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    hubs = stored(hubs.filter("lo <> hi and h0 is not null").select("sk", "h0", "h1"), "line_hubs")
    members = sifted(keys, "sk", sieve(hubs, "sk")).groupBy("sk", "id").agg(F.max("own").alias("own")).join(hubs, "sk")
    members = stored(members, "line_members")
    need = stored(members.select("id").distinct(), "line_ids")
    texts = sifted(_lines(docs, least).select("id", "line"), "id", sieve(need, "id"))
    texts = stored(texts.groupBy("id").agg(F.any_value("line").alias("line")).select("id", "line", *letter_counts(F.col("line"))), "line_texts")
    ends = members.select(F.col("id").alias("x"), F.explode(F.array("h0", "h1")).alias("y")).filter("x <> y")
    pairs = stored(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "line_pairs")
    links = stored(_verified(pairs, texts, edits), "line_links")
    found = stored(components(links), "line_components")

    named = stored(members.join(found, "id", "left").select("sk", "id", "own", F.coalesce("component", "id").alias("label")), "line_named")
    mixed = stored(named.groupBy("sk").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sk"), "line_open")
    if within(mixed, 0):
        return found
    counts = [f"c{i}" for i in range(len(LETTERS))]
    rest = named.join(mixed, "sk", "left_semi").join(texts.drop("line"), "id")
    groups = 2 * edits + 1
    part = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.xxhash64(*[c for i, c in enumerate(counts) if i % groups == g]).alias("h")) for g in range(groups)]))
    cells = rest.withColumn("part", part).select("sk", F.xxhash64("sk", "part.g", "part.h").alias("cell"), "id", "own", "label", F.struct(*counts).alias("c"))
    cells = stored(cells, "line_cells")
    mine = cells.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("cell")
    cells = stored(cells.join(stored(mine, "line_open_cells"), "cell", "left_semi"), "line_open_rows")
    a, b = cells.alias("x"), cells.alias("y")
    test = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.own") | F.col("y.own"))
    test = test & (_apart("x.c", "y.c") <= 2 * edits)
    more = stored(a.join(b, test).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "line_more")
    if within(more, 0):
        return found
    extra = stored(_verified(more, texts, edits), "line_more_links")
    return stored(joined_components(found, extra), "line_components")


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, exact: int = EXACT) -> DataFrame:
    """(key, drop): the places of the lines to take out of each document of docs(key, text) that has any."""
    lines = _lines(docs, min(least, exact))
    seen = stored(lines.select("key", "pos", "id"), "line_places")
    linked = line_links(docs, edits, least)
    per = seen.groupBy("id").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    per = per.join(linked, "id", "left").withColumn("class", F.coalesce("component", "id"))
    per = stored(per.filter("n > 1 or component is not null").select("id", "class", "first"), "line_classes")
    first = per.groupBy("class").agg(F.min("first").alias("first"))
    keep = stored(per.select("id", "class").join(first, "class").select("id", F.col("first.key").alias("fk"), F.col("first.pos").alias("fp")), "line_firsts")
    gone = sifted(seen, "id", sieve(keep, "id")).join(keep, "id").filter("key <> fk or pos <> fp")
    return gone.groupBy("key").agg(F.collect_set("pos").alias("drop"))


def left_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the places ``gone``; NULL if none is left. The lines are bound to a variable, so that a text is split once."""

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.when(F.size(left) > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))

    return F.element_at(F.transform(F.array(F.split(text, "\n")), rest), 1)


def deduplicate_lines(docs: DataFrame, edits: int = EDITS, report: bool = False, least: int = LEAST, exact: int = EXACT) -> DataFrame:
    """docs with the repeated lines taken out of their texts, in all columns; documents that this empties go.

    report: (doc_id, n_lines, n_dropped, text) for every row instead, with the text NULL where the document goes. Only
    documents that may lose lines are shuffled; the others pass as they are.
    """
    key, gone_at, new, n_lines, n_dropped = fresh(docs, "__key", "__drop", "__text", "__n_lines", "__n_dropped")
    rows, _ = keyed(docs, key)
    gone = stored(repeated_lines(rows.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), edits, least, exact), "line_drops")
    bitmap, gone = sieve(gone, "key"), gone.withColumnsRenamed({"key": key, "drop": gone_at})
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    same = sifted(rows, key, bitmap, hit=False).withColumns({new: F.col("text"), n_dropped: F.lit(0).cast("long")})
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(left_lines(F.col("text"), F.col(gone_at)))
    cut = sifted(rows, key, bitmap).join(gone.hint("merge"), key, "left").withColumns({new: text, n_dropped: F.coalesce(F.size(gone_at), F.lit(0)).cast("long")})
    both = same.unionByName(cut.drop(gone_at))
    if report:
        return both.select("doc_id", count.alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.col(new).alias("text"))
    whole = both.filter((F.col(n_dropped) == 0) | F.col(new).isNotNull())
    return whole.select(*[F.col(new).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
