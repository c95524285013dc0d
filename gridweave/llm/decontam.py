"""Benchmark decontamination by SimHash windows, in DataFrame functions alone.

Words are runs of letters and digits, lower-cased; shingles are five words. A window has as many words as
the item it is compared with, or fewer where the document begins or ends within it.

1. Of all windows of a document the best for an item begins with a shared shingle or, cut by the
   document's begin, ends with one: a window that doesn't gets no worse when it moves or shrinks. Within a
   run of shared shingles the longer reach is as good, unless the shingle that it adds is in the window
   already. So windows are laid where such a run begins, where one ends near the document's begin, and at
   each place where shingles repeat; the best one of all starts is among them.
2. Each different window and each item gets a 64-bit SimHash of its words.
3. Fingerprints are cut into four blocks of 16 bits. If two differ in at most 11 bits, one block differs in
   at most two (pigeonhole). Items are entered under each block with up to two bits turned, windows look up
   each block as it is, both beside the number of words, so all such pairs meet.
4. Pairs beyond that radius meet by shingles: a match holds at least 0.75 of an item's shingles, so it
   holds one of any choice of more than 0.25 of them. Windows look up the rarest such choice.
5. Pairs that met either way are compared exactly: shingles weighted by how often they occur, the sum
   of the lesser weights over the sum of the greater, 0.75 or more.

Items of fewer than five words have no shingle and match nothing; null and empty texts match nothing.
Rows of the documents without doc_id count as one document without id. Repeated rows give the result
of one. Of windows of equal similarity the first is reported, of those the longest. A text of any length
is searched whole, in blocks of words that overlap by an item's length. Columns beside doc_id and text,
item_id and text are not read, whatever their names. Either table may be empty: then there are no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import fresh, stored

WIDTH = 5
BLOCKS, BLOCK_BITS = 4, 16
TURNED = 2
RADIUS = BLOCKS * (TURNED + 1) - 1
LANES, LANE_BITS = 3, 21
#: Places of a document that are looked at as one row.
STEP = 1024
#: A benchmark of at most so many bytes of text is broadcast, as shingle hashes; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def positions(words: str, width: int = WIDTH) -> Column:
    """0 to the last place where a shingle begins; none in too few words."""
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def shingle_hash(words: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(WIDTH)])


def shingle_text(words: str) -> Column:
    """The shingles themselves."""
    return F.transform(positions(words), lambda i: F.array_join(F.slice(F.col(words), i + 1, WIDTH), " "))


def turned(bits: int) -> list[int]:
    """All masks of a block with up to so many bits set."""
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)]


def fingerprint(texts: DataFrame, key: str, words: str) -> DataFrame:
    """(key, fp): a bit is set where more than half of the words' hashes have it. Counts of three bits lie side by side in one sum."""
    h = F.xxhash64("word")
    groups = [range(g, min(g + LANES, 64)) for g in range(0, 64, LANES)]
    packed = []
    for bits in groups:
        lane = F.lit(0).cast("long")
        for k, b in enumerate(bits):
            lane = lane.bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")), LANE_BITS * k))
        packed.append(F.sum(lane).alias(f"s{bits[0]}"))
    sums = texts.select(key, F.explode(words).alias("word")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *packed)
    fp = F.lit(0).cast("long")
    for bits in groups:
        for k, b in enumerate(bits):
            count = F.shiftright(F.col(f"s{bits[0]}"), LANE_BITS * k).bitwiseAND(F.lit((1 << LANE_BITS) - 1).cast("long"))
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(key, fp.alias("fp"))


def entries(prints: DataFrame, key: str, bits: int) -> DataFrame:
    """(key, fp, entry): each block of the fingerprint with up to so many bits turned, beside the block's number."""
    blocks = [F.lit(k << BLOCK_BITS).bitwiseOR(F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")) for k in range(BLOCKS)]
    each = prints.select(key, "fp", F.explode(F.array(*blocks)).alias("block"))
    return each.select(key, "fp", F.explode(F.transform(F.array(*map(F.lit, turned(bits))), lambda m: F.col("block").bitwiseXOR(m))).alias("entry"))


def rarest(texts: DataFrame, percent: int) -> DataFrame:
    """(shingle, item_hash): of each item the shingles in fewest items, just so many that no match is without all of them."""
    n = F.size("words") - (WIDTH - 1)
    each = texts.select("item", n.alias("n"), F.explode(F.transform(positions("words"), lambda i: shingle_hash("words", i))).alias("shingle"))
    each = each.groupBy("item", "n", "shingle").agg(F.count(F.lit(1)).alias("times"))
    each = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_items")), "shingle")
    before = F.sum("times").over(Window.partitionBy("item").orderBy("n_items", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    chosen = each.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    return chosen.select("shingle", F.xxhash64("item").alias("item_hash"))


def blocks_of(documents: DataFrame, longest: int) -> DataFrame:
    """(doc_id, text_hash, first, begin, w): the words of STEP places from ``begin`` on, and so many before and after as an item may reach."""
    words = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("w")).where(F.size("w") >= WIDTH)
    each = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("w") - WIDTH) / STEP).cast("int")),
        lambda b: F.struct(
            F.greatest(b * STEP - longest, F.lit(0)).alias("first"),
            (b * STEP).alias("begin"),
            F.slice("w", F.greatest(b * STEP - longest, F.lit(0)) + 1, b * STEP + STEP + longest + WIDTH - F.greatest(b * STEP - longest, F.lit(0))).alias("w"),
        ),
    )
    return words.select("doc_id", "text_hash", F.explode(each).alias("block")).select("doc_id", "text_hash", "block.*")


def hits(documents: DataFrame, seeds: DataFrame, longest: int, small: bool) -> DataFrame:
    """Places i of a block's words w where a document and an item share a shingle, with the seed's columns."""
    blocks = blocks_of(documents, longest)
    place = F.sequence(F.col("begin") - F.col("first"), F.least(F.col("begin") - F.col("first") + STEP - 1, F.size("w") - WIDTH))
    if small:
        return blocks.select("doc_id", "first", "w", F.explode(place).alias("i")).withColumn("shingle", shingle_hash("w", F.col("i"))).join(F.broadcast(seeds), "shingle")
    # only hashes are shuffled; the words join again where there is a hit
    key = ["doc_id", "text_hash", "begin"]
    hashes = F.transform(place, lambda i: F.struct(i.alias("i"), shingle_hash("w", i).alias("shingle")))
    found = blocks.select(*key, F.explode(hashes).alias("p")).select(*key, "p.*").join(seeds, "shingle").distinct()
    found = found.withColumnsRenamed({k: f"hit_{k}" for k in key})
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc_id")) & (F.col("text_hash") == F.col("hit_text_hash")) & (F.col("begin") == F.col("hit_begin"))
    return blocks.join(found, same)


def lay(hit: DataFrame, percent: int) -> DataFrame:
    """(doc_id, start_word, n_words, win): the windows at these places; n_words is the item's length."""
    i, head, n = F.col("i"), F.col("i") + WIDTH, F.col("n_words")
    starts_run = F.col("before").isNull() | (i == 0) | (shingle_hash("w", i - 1) != F.col("before"))
    ends_run = F.col("after").isNull() | (i == F.size("w") - WIDTH) | (shingle_hash("w", i + 1) != F.col("after"))
    text = lambda at, size: F.array_join(F.slice("w", at + 1, size), " ")
    # whether the window holds the shingle that would make it longer
    holds = lambda at, size, j: F.contains(F.concat(F.lit(" "), text(at, size), F.lit(" ")), F.concat(F.lit(" "), text(j, F.lit(WIDTH)), F.lit(" ")))
    # a shorter window can't match the item
    reaches = lambda size: (size - (WIDTH - 1)) * 100 >= (n - (WIDTH - 1)) * percent
    from_run = reaches(F.least(n, F.size("w") - i)) & (starts_run | holds(i, n, i - 1))
    to_run = (F.col("first") == 0) & (head < n) & reaches(head) & (ends_run | holds(F.lit(0), head, i + 1))
    window = lambda at, size: F.struct((F.col("first") + at).alias("start_word"), n.alias("n_words"), text(at, size).alias("win"))
    laid = F.array_compact(F.array(F.when(from_run, window(i, n)), F.when(to_run, window(F.lit(0), head))))
    return hit.select("doc_id", F.explode(laid).alias("laid")).select("doc_id", "laid.*").distinct()


def met(different: DataFrame, texts: DataFrame, percent: int, small: bool) -> DataFrame:
    """(win, item) of windows (win, n_words, words) and items (item, n_words, words): all pairs within the radius, and those beyond that share a rare shingle."""
    sized = lambda df, key, bits: entries(fingerprint(df, key, "words"), key, bits).join(df.select(key, "n_words"), key)
    near = sized(different, "win", 0).join(sized(texts, "item", TURNED).withColumnRenamed("fp", "item_fp"), ["entry", "n_words"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("win", "item")
    rare = rarest(texts, percent)
    rare = F.broadcast(rare) if small else rare
    in_win = different.select("win", "n_words", F.explode(F.transform(positions("words"), lambda i: shingle_hash("words", i))).alias("shingle"))
    far = in_win.join(rare, "shingle").select("win", "n_words", "item_hash").distinct()
    far = far.join(texts.select("item", "n_words", F.xxhash64("item").alias("item_hash")), ["item_hash", "n_words"]).select("win", "item")
    return near.union(far).distinct()


def matches(documents: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each document and item that match."""
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") >= WIDTH)
    items = items.dropDuplicates(["item_id", "words"]).withColumn("item", F.array_join("words", " "))
    texts = items.select("item", "words", F.size("words").alias("n_words")).dropDuplicates(["item"])
    (size, longest) = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.size(words_of("text"))), F.lit(0))).first()
    small = size <= BROADCAST_BYTES

    placed = texts.select("words", "n_words", F.explode(positions("words")).alias("offset"))
    seeds = placed.select(
        shingle_hash("words", F.col("offset")).alias("shingle"),
        F.when(F.col("offset") > 0, shingle_hash("words", F.col("offset") - 1)).alias("before"),
        F.when(F.col("offset") < F.size("words") - WIDTH, shingle_hash("words", F.col("offset") + 1)).alias("after"),
        "n_words",
    ).distinct()
    windows = stored(lay(hits(documents, seeds, longest, small), percent), "windows")
    different = windows.select("win", "n_words").distinct().withColumn("words", F.split("win", " "))
    pairs = met(different, texts, percent, small)

    weigh = lambda df, key, weight: df.select(key, F.explode(shingle_text("words")).alias("shingle")).groupBy(key, "shingle").agg(F.count(F.lit(1)).alias(weight))
    in_win = weigh(different.select("win", "words").dropDuplicates(["win"]), "win", "in_win")
    both = pairs.join(in_win, "win").join(weigh(texts, "item", "in_item"), ["item", "shingle"])
    shared = both.groupBy("win", "item").agg(F.sum(F.least("in_win", "in_item")).alias("shared"))
    total = F.size(F.split("win", " ")) + F.size(F.split("item", " ")) - 2 * (WIDTH - 1) - F.col("shared")
    good = shared.withColumn("total", total).where(F.col("shared") * 100 >= F.col("total") * percent)
    similarity = F.round(F.col("shared") / F.col("total"), 6).alias("similarity")
    good = good.join(items.select("item", "item_id", F.size("words").alias("n_words")), "item").select("win", "n_words", "item_id", similarity, F.size(F.split("win", " ")).alias("length"))

    best = F.max(F.struct("similarity", -F.col("start_word"), "length")).alias("b")
    found = windows.join(good, ["win", "n_words"]).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.col2")).alias("start_word"), F.col("b.length").alias("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that match no item, with all their columns; rows without doc_id stay unless one of them matches."""
    own = fresh(documents, "leak")
    found = matches(documents, benchmark, percent).select(F.col("doc_id").alias(own)).distinct()
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
