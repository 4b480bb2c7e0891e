"""Fuzzy line deduplication, in DataFrame operations only.

Lines are lower-cased, and runs of anything but letters and digits become one space. Lines of
fewer than ``min_words`` words, and those without a word, are left alone. Equal normalised
lines are one line. Lines so short that the minimal similarity allows no edit need no more.

Each other distinct line is cut into its windows of three words, and each window gets a SimHash:
64 bits, each the majority of its words' bits. These are the blocks of the join, by the pigeonhole
principle: an edit spoils three windows at most, so two similar lines of N words at most have at least N - 2 - 3d
in common, d being the edits they may differ by. For lines so short that this may be none (up to five words at 0.8) windows
of two words, or words, do the same. All windows have one order, so similar lines have ``COMMON`` windows (or all that they
must share, if fewer) in common among the lowest of each, as many as they may lose and ``COMMON`` more (prefix filter). The order
is by how many there are of a window, so those that no other line has come first, and need not travel; windows that repeat in a line are
numbered. No similar pair is lost. SimHashes of whole lines are not the blocks, because they can't be: an edit of a
tenth of the words turns nine bits of 64 on average, beyond any radius that has selective blocks.

Pairs are made of the lines of a window that up to ``most`` have; they are candidates if they share enough windows, those
that more lines have counted as if shared. Lines that may have enough of the latter in common meet by these: all are
held against the first of each; then the lines that have enough windows whose lines are not all connected by what was found so far meet
by their rarest words (of n words an edit spoils one, so two of d + 2 words are shared; in very long lines, one of d + 1), all pairs that are
not connected, in blocks of bounded size. A pair is a candidate there only if the parities of its words' counts, in ``PARITIES`` hashed places,
differ in no more places than its edits can turn, two each. So large groups are split, and what is left of them is compared whole. Candidates
are verified by edit similarity, 1 - (word edits / words of the longer line), of at least ``min_similarity`` (0.8).
Of each connected group of lines the first occurrence, by key and then by line number, stays;
the others go, with their line ends.
In edit distances a word counts as one of 41,984 hashed codes.

A hot line (boilerplate) is one row from the first partial aggregation on. Of texts only the codes of distinct lines travel, two bytes a word.

Rows without a key keep all lines. Null texts stay null and have no lines. Rows that repeat
key and text are one document: what stays in one stays in all. Key columns order as they do in
Spark. Other columns are untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, let, unused
from .graph import components

#: What the registered query and the pipeline ask for.
WHOLE = {"min_words": 1}
#: Bits of the bitmaps that tell which windows, lines or pairs are wanted: 2^18 rows to broadcast.
PIECE_BITS = 1 << 24
#: Windows that similar lines must share, where their length makes them share as many.
COMMON = 4
#: Words of a window.
WIDTH = 3
#: Bits of a window's hash and its width.
KEY_BITS = 40
#: Shares in which windows are counted, and lines take theirs, to take less disk at once.
SHARES = 2
#: Lines of a block where all pairs are compared.
BLOCK = 256
#: Lines of more words meet by one rare word instead of two, which would be too many pairs of words.
PAIRED = 160
#: Places of the parities of a line's words, a multiple of 64.
PARITIES = 256
#: Distinct word codes.
CODES = 41_984


#: What stands between the words of a line.
BREAK = r"[^\p{L}\p{N}]+"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (k, th, line, ws): the words of every line of texts with a key, with a hash of the text."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    # split before lines are exploded: a filter on the lines would copy the work into itself
    lines = F.transform(F.split(text, "\n", -1), words_of)
    return rows.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.posexplode(lines).alias("line", "ws"))


def least_words(min_similarity: float) -> int:
    """The words that a line has at least if an edit, of it or to it, leaves it similar enough."""
    n = 1
    while min_similarity < 1 and int(int(n / min_similarity + 1e-9) * (1 - min_similarity) + 1e-9) < 1:
        n += 1
    return n


def simhash_of(*hashes: Column) -> Column:
    """The SimHash of two or three words, a bit being 1 if over half of theirs are."""
    if len(hashes) == 2:
        return hashes[0].bitwiseAND(hashes[1])
    a, b, c = hashes
    return a.bitwiseXOR(b).bitwiseAND(a.bitwiseXOR(c)).bitwiseXOR(a)


def edits(n, min_similarity: float):
    """The edits that two lines may differ by, the longer of ``n`` words (a number or a column)."""
    most = n * (1 - min_similarity) + 1e-9
    return F.floor(most).cast("int") if isinstance(n, Column) else int(most)


def widths(min_similarity: float) -> list[int]:
    """The widths of windows, the widest first; each word that a line has more must cost it less than it gains."""
    return [w for w in range(WIDTH, 1, -1) if w * (1 - min_similarity) < 1] + [1]


def shared(n, width: int, min_similarity: float):
    """The windows that similar lines share at least, the longer of ``n`` words."""
    return n - width + 1 - width * edits(n, min_similarity)


def width_of(n: int, min_similarity: float) -> int:
    """The width at which lines meet, the longer of ``n`` words."""
    return next((w for w in widths(min_similarity) if shared(n, w, min_similarity) >= 1), 1)


def settled(min_similarity: float) -> int:
    """The number of words from which on lines meet by the widest windows."""
    w = widths(min_similarity)[0]
    n = int((w + 1) / max(1 - w * (1 - min_similarity), 1e-3)) + 1  # beyond, the bound without rounding is over one
    while n > 1 and shared(n - 1, w, min_similarity) >= 1:
        n -= 1
    return n


def lost(n: Column, width: int, min_similarity: float) -> Column:
    """The windows that a line of ``n`` words may not share with a similar one. Of a longer one, each word more is an
    insertion, which spoils a window less; the worst length is within the words that allow an edit more."""
    step = 1 if min_similarity >= 1 else int(1 / (1 - min_similarity)) + 2
    return F.greatest(F.lit(0), *[width * edits(n + k, min_similarity) - k for k in range(step + 1)])


def needed_of(n: int, min_similarity: float) -> int:
    """The windows that candidates must share, the longer of ``n`` words."""
    return min(COMMON, max(shared(n, width_of(n, min_similarity), min_similarity), 1))


def steady(min_similarity: float) -> int:
    """The number of words from which on candidates must share ``COMMON`` windows."""
    w = widths(min_similarity)[0]
    return max(settled(min_similarity), int((COMMON + w) / max(1 - w * (1 - min_similarity), 1e-3)) + 1)


def needed(a: Column, b: Column, min_similarity: float) -> Column:
    """The windows that candidates of two identities must share."""
    n = F.greatest(words_in(a), words_in(b))
    out = F.least(F.lit(COMMON), shared(n, widths(min_similarity)[0], min_similarity))
    for k in range(1, settled(min_similarity)):
        out = F.when(n == k, needed_of(k, min_similarity)).otherwise(out)
    return out


def windows_of(reps: DataFrame, min_similarity: float) -> DataFrame:
    """Rows (id, key): every window of every line that meets others by windows of its width, as a hash of ``KEY_BITS`` bits
    with the width in the lowest two."""
    n, out, first, wide = F.size("code"), None, settled(min_similarity), widths(min_similarity)[0]
    for w in widths(min_similarity):
        if w == wide:
            fits = F.floor(n / min_similarity + 1e-9) >= first
        else:
            sizes = [k for k in range(least_words(min_similarity), first) if any(width_of(m, min_similarity) == w for m in range(k, min(first, int(k / min_similarity + 1e-9) + 1)))]
            if not sizes:
                continue
            fits = n.isin(sizes)
        # compiled as one loop over the codes, unlike functions of arrays
        each = reps.filter(fits).select("id", "code", F.posexplode("code").alias("i", "c")).filter(F.col("i") <= F.size("code") - w)
        words = [F.xxhash64("c"), *[F.xxhash64(F.get("code", F.col("i") + j)) for j in range(1, w)]]
        key = F.xxhash64(F.lit(w), simhash_of(*words) if w > 1 else words[0]).bitwiseAND(F.lit((1 << KEY_BITS) - 4)).bitwiseOR(F.lit(w))
        rows = each.select("id", key.alias("key"))
        out = rows if out is None else out.union(rows)
    return out


def pieces(reps: DataFrame, stage: Stage, min_similarity: float) -> DataFrame:
    """Rows (id, key): the windows by which each line meets all similar ones: its rarest, as many as it may not share and
    ``COMMON`` more, without those that no other has."""
    own = windows_of(reps, min_similarity)
    # one number, by which windows are ordered: how many there are of it, then the hash
    order = F.shiftleft(F.least("m", F.lit((1 << (62 - KEY_BITS)) - 1)), KEY_BITS).bitwiseOR(F.col("key"))
    met = None
    # a share of the hashes at a time, made twice, which takes less disk than to keep them
    for k in range(SHARES):
        part = own.filter(F.pmod(F.shiftright("key", 2), F.lit(SHARES)) == k)
        counts = stage.put(part.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "counts")
        stage.release()
        found = may_hold(part, F.shiftright("key", 2), counts, F.shiftright("key", 2)).join(counts, "key").select("id", F.col("key").bitwiseAND(F.lit(3)).alias("w"), order.alias("x"))
        found = stage.put(found, f"shared-{k}")
        stage.drop("counts")
        stage.release()
        met = found if met is None else met.union(found)
    n, count = words_in(F.col("id")).cast("int"), F.lit(0)
    for w in widths(min_similarity):
        # what is missing are windows that no other line has, the rarest of all
        count = F.when(F.col("w") == w, lost(n, w, min_similarity) + COMMON - (n - w + 1 - F.size("xs"))).otherwise(count)
    # one that repeats is another one each time
    again = lambda xs: F.transform(xs, lambda x, i: F.when((i > 0) & (x == F.get(xs, i - 1)), F.xxhash64(x, i - F.array_position(xs, x))).otherwise(x))
    keys = F.when(F.size(F.array_distinct("xs")) == F.size("xs"), F.col("xs")).otherwise(again(F.col("xs")))
    out = None
    # a share of the lines at a time, which takes less disk at once
    for k in range(SHARES):
        part = met.filter(F.pmod(F.shiftright("id", WORD_BITS), F.lit(SHARES)) == k)
        lines = part.groupBy("id", "w").agg(F.sort_array(F.collect_list("x")).alias("xs")).withColumn("count", count).filter("count > 0").select("id", F.slice("xs", 1, F.col("count")).alias("xs"))
        lines = stage.put(lines.select("id", F.explode(keys).alias("key")), f"pieces-{k}")
        stage.release()
        out = lines if out is None else out.union(lines)
    for k in range(SHARES):
        stage.drop(f"shared-{k}")
    return out


#: The bits of a line's identity that hold its number of words, as far as they go.
WORD_BITS = 16


def hashed(lines: DataFrame) -> DataFrame:
    """Rows (k, th, line, k1, k2, id, code): two hashes of each line, its identity, its words' codes.

    The identity is the upper bits of the first hash with the number of words below.
    """
    # hashes chain their arguments: what comes first makes the second hash another one
    n, k1 = F.size("ws"), F.xxhash64("ws")
    number = F.least(n, F.lit((1 << WORD_BITS) - 1)).cast("long")
    code = F.transform("ws", lambda w: (F.pmod(F.xxhash64(w), F.lit(CODES)) - CODES // 2).cast("short"))
    return lines.select("k", "th", "line", "ws", k1.alias("k1")).select(
        "k", "th", "line", "k1", F.xxhash64(F.lit("again"), "ws").alias("k2"), F.shiftleft(F.shiftright("k1", WORD_BITS), WORD_BITS).bitwiseOR(number).alias("id"), code.alias("code")
    )


def may_hold(rows: DataFrame, place: Column, wanted: DataFrame, wanted_place: Column, bits: int = PIECE_BITS) -> DataFrame:
    """The rows whose ``place`` (a hash) may be one of the wanted: a filter by a broadcast bitmap
    of ``bits`` bits, which lets every wanted row pass."""
    at = F.pmod(wanted_place, F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    mine = F.pmod(place, F.lit(bits))
    hit = F.call_function("shiftrightunsigned", F.col("__bits"), mine.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bitmap), (F.shiftright(mine, 6) == F.col("__word")) & hit).select(rows.columns)


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), BREAK, -1), lambda w: w != "")


def as_text(code: Column) -> Column:
    """A coded line with each word as one character of the basic plane, always four hexadecimal digits."""
    return F.decode(F.unhex(F.array_join(F.transform(code, lambda c: F.hex(c.cast("long") + (CODES // 2 + 0x3400))), "")), "UTF-16BE")


def words_in(identity: Column) -> Column:
    """The number of words that an identity tells."""
    return identity.bitwiseAND(F.lit((1 << WORD_BITS) - 1))


def alike(a: Column, b: Column, min_similarity: float) -> Column:
    """Whether lines of two identities can be similar, by their numbers of words."""
    n, m = words_in(a), words_in(b)
    return F.abs(n - m) <= F.floor(F.greatest(n, m) * (1 - min_similarity) + 1e-9)


def close(a: Column, b: Column, min_similarity: float) -> Column:
    """Whether two lines as texts are similar."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * (1 - min_similarity) + 1e-9).cast("int")
    # the distance is followed only as far as it may go; beyond, it is -1
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def verify(pairs: DataFrame, reps: DataFrame, min_similarity: float) -> DataFrame:
    """Of pairs (a, b) of lines, those whose edit similarity reaches the minimum, with their places."""
    own = may_hold(reps, F.col("id"), pairs.select(F.explode(F.array("a", "b")).alias("id")), F.col("id"))
    side = lambda x: own.select(F.col("id").alias(x), F.col("at").alias(f"at_{x}"), as_text(F.col("code")).alias(f"c{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.filter(close(F.col("ca"), F.col("cb"), min_similarity)).select("a", "b", "at_a", "at_b")


def parities(code: Column) -> list[Column]:
    """Bits of ``PARITIES`` hashed places: whether an odd number of a line's words fall there. An edit turns two at most."""
    place = lambda c: F.pmod(F.xxhash64(F.lit("parity"), c), F.lit(PARITIES))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    own = lambda k: lambda s, c: s.bitwiseXOR(F.when(F.shiftright(place(c), 6) == k, bit(c)).otherwise(F.lit(0).cast("long")))
    return [F.aggregate(code, F.lit(0).cast("long"), own(k)).alias(f"s{k}") for k in range(PARITIES // 64)]


def may_match(a: Column, b: Column, sa: Column, sb: Column, min_similarity: float) -> Column:
    """Whether lines of two identities can be similar, by their parities: an inserted or deleted word turns one bit alone."""
    n, m = words_in(a), words_in(b)
    turned = sum((F.bit_count(sa[k].bitwiseXOR(sb[k])) for k in range(1, PARITIES // 64)), F.bit_count(sa[0].bitwiseXOR(sb[0])))
    return turned <= 2 * edits(F.greatest(n, m), min_similarity) - F.abs(n - m)


def rare_words(own: DataFrame, min_similarity: float) -> DataFrame:
    """Rows (id, part, key, s0, ...): the pairs of its rarest words by which a line of ``own`` meets every similar one, and its
    parities; lines that are, or may be similar to, ones of over ``PAIRED`` words meet by single words as well."""
    each = own.select("id", "at", F.size("code").alias("n"), F.explode("code").alias("c"))
    # of the codes there are few
    counts = each.groupBy("c").agg(F.count("*").alias("of"))
    # a word that repeats is another one each time
    each = each.groupBy("id", "at", "n", "c").agg(F.count("*").cast("int").alias("times")).join(F.broadcast(counts), "c")
    each = each.select("id", "at", "n", F.explode(F.transform(F.sequence(F.lit(1), "times"), lambda i: F.struct("of", "c", i.alias("i")))).alias("w"))
    # of the words of a line as many as it may lose, and two more
    rare = each.groupBy("id", "at", "n").agg(F.sort_array(F.collect_list("w")).alias("ws")).withColumn("most", lost(F.col("n"), 1, min_similarity) + 2)
    rare = rare.select("id", "at", "n", "most", F.transform(F.slice("ws", 1, F.col("most")), lambda w: F.xxhash64(w["c"], w["i"])).alias("ws"))
    rows = own.select("id", "at", "part", *parities(F.col("code"))).join(rare, ["id", "at"])
    # the fewest words of the longer line that make similar ones share two
    two = next((n for n in range(2, PAIRED) if n - edits(n, min_similarity) >= 2), PAIRED + 1)
    longest, signs = F.floor(F.col("n") / min_similarity + 1e-9), [f"s{k}" for k in range(PARITIES // 64)]
    paired = rows.filter((longest >= two) & (F.col("n") <= PAIRED)).select("id", "part", *signs, "ws", F.posexplode("ws").alias("i", "x"))
    paired = paired.select("id", "part", *signs, "x", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("y")).select("id", "part", F.xxhash64("x", "y").alias("key"), *signs)
    single = rows.filter((F.col("n") < two) | (longest > PAIRED)).select("id", "part", F.explode(F.slice("ws", 1, F.col("most") - 1)).alias("x"), *signs)
    return paired.union(single.select("id", "part", F.xxhash64(F.lit("one"), "x").alias("key"), *signs))


def crowded_lines(large: DataFrame, links: DataFrame, reps: DataFrame, stage: Stage, min_similarity: float) -> DataFrame:
    """Links between lines that only meet by windows of many lines, given as rows (key, id, m, g)."""
    # held against the first of each window
    lead = large.groupBy("key").agg(F.min("id").alias("lead"))
    star = large.join(lead, "key").filter((F.col("id") != F.col("lead")) & alike(F.col("id"), F.col("lead"), min_similarity)).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    star = stage.put(star.join(links.select("a", "b"), ["a", "b"], "left_anti"), "star")
    links = links.union(stage.put(verify(star, reps, min_similarity), "links-star"))
    stage.release()
    # what is connected by now needs no more; neither do windows whose lines all are
    parts = components(links.select("a", "b"), stage, "part").select(F.col("node").alias("id"), F.col("component").alias("part"))
    told = stage.put(large.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "told")
    open_keys = told.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("key")
    rows = told.join(open_keys, "key")
    # two lines that are not connected share COMMON of these windows, or all that they must
    fewest = needed(F.col("id"), F.col("id"), min_similarity)
    for k in range(1, steady(min_similarity)):
        fewest = F.when(words_in(F.col("id")) == k, min(needed_of(m, min_similarity) for m in range(k, int(k / min_similarity + 1e-9) + 1))).otherwise(fewest)
    rows = stage.put(rows.groupBy("id", "part").agg(F.count("*").alias("g")).filter(F.col("g") >= fewest).select("id", "part"), "open")
    own = stage.put(may_hold(reps, F.col("id"), rows, F.col("id")).join(rows, "id").select("id", "at", "part", "code"), "crowd")
    stage.release()
    met = stage.put(rare_words(own, min_similarity), "met-words")
    groups = met.groupBy("key").agg(F.count("*").alias("m"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    signs = [f"s{i}" for i in range(PARITIES // 64)]
    mine = stage.put(met.join(groups.select("key", blocks.alias("blocks")), "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "blocks")
    stage.release()
    # a pair of blocks is a key: the lower block's rows are the one side, the upper one's the other
    meet = mine.select("id", "part", "key", "mine", F.array(*signs).alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    x = meet.filter("mine <= other").select("key", F.col("mine").alias("p"), F.col("other").alias("q"), F.col("id").alias("a"), F.col("part").alias("pa"), F.col("s").alias("sa"))
    y = meet.filter("mine >= other").select("key", F.col("other").alias("p"), F.col("mine").alias("q"), F.col("id").alias("b"), F.col("part").alias("pb"), F.col("s").alias("sb"))
    apart = (F.col("pa") != F.col("pb")) & (F.col("a") != F.col("b")) & alike(F.col("a"), F.col("b"), min_similarity)
    pairs = x.join(y, ["key", "p", "q"]).filter(apart & may_match(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), min_similarity))
    pairs = stage.put(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs-words")
    links = links.union(stage.put(verify(pairs, own, min_similarity), "links-words"))
    for done in ("star", "told", "open", "crowd", "met-words", "blocks", "pairs-words"):
        stage.drop(done)
    stage.release()
    return links


def similar_lines(reps: DataFrame, stage: Stage, min_similarity: float, most: int) -> DataFrame:
    """Links (a, b) between the places of similar lines; ``reps`` has (id, at, code).

    Links join what is similar, not all that is: lines that are connected need no link.
    """
    own = pieces(reps, stage, min_similarity)
    groups = own.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    met = stage.put(own.join(groups, "key"), "met")
    for k in range(SHARES):
        stage.drop(f"pieces-{k}")
    stage.release()
    few = met.filter(F.col("m") <= most)
    crowd = stage.put(met.filter(F.col("m") > most).groupBy("id").agg(F.count("*").alias("g")), "crowds")
    x, y = few.select("key", F.col("id").alias("a")), few.select("key", F.col("id").alias("b"))
    pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & alike(F.col("a"), F.col("b"), min_similarity)).groupBy("a", "b").agg(F.count("*").alias("c")).withColumn("want", needed(F.col("a"), F.col("b"), min_similarity))
    pairs = stage.put(pairs.filter("c >= want").select("a", "b").union(_maybe(pairs.filter("c < want"), crowd)), "pairs")
    stage.release()
    links = stage.put(verify(pairs, reps, min_similarity), "links")
    stage.drop("pairs")
    stage.release()
    # lines that may share enough windows of many lines
    least = min(needed_of(n, min_similarity) for n in range(1, steady(min_similarity) + 1))
    large = stage.put(met.filter(F.col("m") > most).join(crowd.filter(F.col("g") >= least), "id"), "large")
    stage.drop("met")
    if not large.isEmpty():
        links = crowded_lines(large, links, reps, stage, min_similarity)
    return links.select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))


def _maybe(pairs: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs (a, b, c, want) that share enough windows if they share all that many lines have."""
    side = lambda x: crowd.select(F.col("id").alias(x), F.col("g").alias(f"g{x}"))
    for x in ("a", "b"):
        pairs = may_hold(pairs, F.col(x), crowd, F.col("id"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("c") + F.least("ga", "gb") >= F.col("want")).select("a", "b")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5, min_similarity: float = 0.8, most: int = 16) -> DataFrame:
    """Rows (k, th, line, kept): each line that goes, and the occurrence (k, th, line) that stays for it."""
    stage = Stage(docs.sparkSession, "linededup")
    own = docs.select(key, text)
    lines = stage.put(hashed(lines_of(own, key, text).filter(F.size("ws") >= max(min_words, 1))), "lines")
    at = F.struct("k", "th", "line")
    reps = stage.put(lines.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.first("id").alias("id"), F.first("code").alias("code"), F.count("*").alias("times")), "reps")
    # from here on the codes of distinct lines are enough
    places = stage.put(lines.drop("id", "code"), "places")
    stage.drop("lines")
    stage.release()
    known = reps.filter(F.size("code") >= least_words(min_similarity)).select("id", "at", "code")
    found = components(similar_lines(known, stage, min_similarity, most), stage)
    kept = reps.join(found, reps["at"] == found["node"], "left").select("k1", "k2", F.coalesce("component", "at").alias("kept"), ((F.col("times") > 1) | (F.col("component") < F.col("at"))).alias("any"))
    kept = stage.put(kept.filter(F.coalesce("any", F.lit(False))).drop("any"), "kept")
    # both sides come from files, so a hot line's partition can be split
    gone = places.join(kept, ["k1", "k2"]).filter(at != F.col("kept")).select("k", "th", "line", "kept").distinct()
    out = Stage(docs.sparkSession, "linesgone").put(gone, "gone")
    stage.drop()
    return out


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_emptied: bool = True, **options) -> DataFrame:
    """The documents without the lines that go; other columns as they are.

    Documents of which no line with a word is left, and that had lost one, go as well, unless
    ``drop_emptied`` is off. Texts are shuffled once, to meet the lists of their lines that go.
    """
    gone = dropped_lines(docs, key, text, **options)
    stage = Stage(docs.sparkSession, "linedrop")
    k, th, at, new = unused(docs, 4)
    lists = stage.put(gone.groupBy("k", "th").agg(F.sort_array(F.collect_list("line")).alias(at)).select(F.col("k").alias(k), F.col("th").alias(th), at), "lists")
    join = (F.col(key) == F.col(k)) & (F.xxhash64(text) == F.col(th))
    keep = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(at), i))
    left = docs.join(lists, join, "left")
    cut = F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    out = left.select(*[c for c in docs.columns if c != text], F.struct(cut.alias("t"), F.col(at).isNotNull().alias("cut")).alias(new))
    if drop_emptied:
        out = out.filter(~F.col(f"{new}.cut") | F.col(f"{new}.t").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.select(*[F.col(f"{new}.t").alias(text) if c == text else F.col(c) for c in docs.columns])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per row with a key: lines, lines that go, and the documents that keep lines for it."""
    gone = dropped_lines(docs, key, text, **options)
    lost = gone.groupBy("k", "th").agg(F.count("*").alias("lost"), F.array_sort(F.collect_list("line")).alias("at"), F.array_sort(F.collect_set("kept.k")).alias("by"))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("n"))
    return rows.join(lost, ["k", "th"], "left").select(
        F.col("k").alias(key),
        F.col("n").cast("long").alias("n_lines"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("at", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped_lines"),
        F.coalesce(F.array_join(F.transform("by", lambda x: x.cast("string")), ","), F.lit("")).alias("kept_in"),
    )
