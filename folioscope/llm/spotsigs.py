"""SpotSigs fingerprints, with built-in functions only.

A signature is a common word (anchor) and the chain of the next two content words after it; up to
three further common words on the way are passed over. The start of a text is an anchor as well, and
the end stands for missing content words. Anchors are the words that most documents of the corpus
hold. A text with few of them for its length, such as a word list or a text in a rare language, takes
every word after two content words as an anchor too (stretches), so it is covered to its end. The
fingerprint of a text is the sorted set of 64-bit hashes of its signatures; a null text has none.
Fingerprints fall into classes by set length; sets whose classes are not neighbours are too unlike to
be compared, all others are compared by their Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut

ANCHORS = sorted(set(  # where no corpus is given, or an empty one
    "the of and to in is a that it for on with as was be by are this have from or at an not but "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne "
    "el y los se del las por con no una su para al lo como".split()
))
MOST_ANCHORS = 150  # words of a corpus that are anchors
SPARSE = 8  # words for each anchored signature from which on a text takes stretches
CHAIN = 2
SKIP = 3
LEAST = 0.2  # likeness that sets of classes further apart cannot reach
BLOCK_BITS = 10  # 2 ** BLOCK_BITS ids share a block when the next document is sought


def _any(words: Sequence[str]) -> str:
    """Pattern of the words, grouped by their first letter."""
    groups = [f"{k}(?:{'|'.join(w[1:] for w in ws)})" for k, ws in groupby(sorted(words), key=lambda w: w[0])]
    return f"(?:{'|'.join(groups)})"


def _words(text: Column | str) -> Column:
    """Lower-case words with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def common_words(docs: DataFrame, most: int = MOST_ANCHORS) -> list[str]:
    """The words that most rows of ``docs`` hold, ties by word; ``ANCHORS`` if there are no words.

    Counts are over whole texts of all rows; only the chosen words reach the driver.
    """
    held = docs.select(F.explode(F.array_distinct(F.split(_words("text"), " "))).alias("word")).where("word <> ''")
    top = held.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in top.collect()] or list(ANCHORS)


def signatures(text: Column | str, anchors: Sequence[str] = ANCHORS) -> Column:
    """Sorted distinct hashes of the signatures of a text; empty for a text without a word, null for a null one."""
    common = _any(anchors)
    passed = f"(?:{common} ){{0,{SKIP}}}+"
    chain = f"(?:{passed}[^ ]+ ){{{CHAIN}}}"
    # A space is consumed and the rest looked at, so chains may overlap.
    anchored = f" (?=((?:\\^|{common}) {chain}))"
    # Two content words are looked over, and what follows them starts a signature.
    content = f"(?!(?:\\^|\\$|{common}) )[^ ]+ "
    stretch = f" (?={content}{content}({content}{chain}))"

    def found(marked: Column) -> Column:
        own = F.regexp_extract_all(marked, F.lit(anchored), F.lit(1))
        spaces = F.length(marked) - F.length(F.replace(marked, F.lit(" "), F.lit("")))

        def all_of(own: Column) -> Column:
            few = F.size(own) < (spaces - 2 - CHAIN) / SPARSE
            return F.when(few, F.concat(own, F.regexp_extract_all(marked, F.lit(stretch), F.lit(1)))).otherwise(own)

        return F.element_at(F.transform(F.array(own), all_of), 1)

    marked = F.concat(F.lit(" ^ "), _words(text), F.lit(" $" * CHAIN + " "))
    # The text is worked out once, however often it is looked at.
    both = F.element_at(F.transform(F.array(marked), found), 1)
    between = f" (?:{common} )+"
    return F.array_sort(F.array_distinct(F.transform(both, lambda s: F.xxhash64(F.regexp_replace(s, between, " ")))))


def fingerprint(signatures: Column | str) -> Column:
    """The set as a string of hexadecimal numbers."""
    found = F.col(signatures) if isinstance(signatures, str) else signatures
    return F.array_join(F.transform(found, lambda h: F.hex(h)), " ")


def length_class(signatures: Column | str, least: float = LEAST) -> Column:
    """Class of a set by its length; sets with a similarity of ``least`` lie in the same or neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / -math.log(least)).cast("int")


def likeness(a: str, b: str, least: float = LEAST) -> Column:
    """Jaccard similarity of two sets; 0 if their lengths rule out ``least``, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    jaccard = both / (F.size(a) + F.size(b) - both).cast("double")
    apart = F.abs(length_class(a, least) - length_class(b, least)) > 1
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, 1.0).when(apart | (F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard)


def _before(blocks: DataFrame, levels: int) -> DataFrame:
    """(block, prev): the largest id in the blocks before each one; no row where there is none.

    Blocks are grouped like the ids were, level by level, so no window sees more than 2 ** (BLOCK_BITS + 1) rows.
    """
    grouped = blocks.withColumn("up", F.shiftright("block", BLOCK_BITS))
    # On the last level all rows share a group, or two if there are ids below and above zero.
    group = F.lit(0) if levels == 0 else F.col("up")
    inside = grouped.withColumn("own", F.lag("hi").over(Window.partitionBy(group).orderBy("block")))
    if levels == 0:
        return inside.select("block", F.col("own").alias("prev")).where("prev is not null")
    above = grouped.groupBy("up").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    above = _before(above.withColumnRenamed("up", "block"), levels - 1).withColumnRenamed("block", "up")
    return inside.join(above, "up", "left").select("block", F.coalesce("own", "prev").alias("prev")).where("prev is not null")


def with_next(docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(doc_id, text, the values, and each of them as next_...) for the next document by descending doc_id.

    The last is followed by the first. Each block of ids is one window; the document that comes
    before a block is added to it as a guest, so texts are shuffled once. Rows with a null id have
    no next document (nulls). Of rows that share an id, the one with the smaller text comes later.
    """
    block = F.shiftright(F.col("doc_id").cast("long"), BLOCK_BITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = cut(
        rows.where("doc_id is not null").groupBy(block.alias("block")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")),
        "blocks",
    )
    ends = blocks.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    levels = 0
    if ends["lo"] is not None:
        low, high = ends["lo"] >> 2 * BLOCK_BITS, ends["hi"] >> 2 * BLOCK_BITS
        while low != high and (low < -1 or high > 0):  # shifted on, they end as -1 and 0
            low, high, levels = low >> BLOCK_BITS, high >> BLOCK_BITS, levels + 1
    first = blocks.where(F.col("lo") == F.lit(ends["lo"])).select("block", F.lit(ends["hi"]).cast("long").alias("prev"))
    guests = cut(_before(blocks, levels).unionByName(first), "guests").withColumnRenamed("prev", "doc_id")
    guests = rows.join(guests, "doc_id").select("block", F.lit(0).alias("_own"), "doc_id", "text")
    # Without an id a row is alone in its block.
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    placed = rows.select(block.alias("block"), F.lit(1).alias("_own"), "doc_id", "text")
    placed = placed.unionByName(guests).withColumn("_alone", alone).withColumns(values)
    window = Window.partitionBy("block", "_alone").orderBy("_own", "doc_id", "text")
    names = ["text", *values]
    out = placed.withColumns({f"next_{c}": F.lag(c).over(window) for c in names})
    return out.where("_own = 1").select("doc_id", *names, *[f"next_{c}" for c in names])


def edited(text: Column | str, following: Column | str) -> Column:
    """``text`` with its last half (floor) replaced by the first as many characters of ``following``."""
    text = F.col(text) if isinstance(text, str) else text
    following = F.col(following) if isinstance(following, str) else following
    half = F.floor(F.length(text) / 2).cast("int")
    kept = text.substr(F.lit(1), F.length(text) - half)
    return F.concat(kept, F.coalesce(following.substr(F.lit(1), half), F.lit("")))
