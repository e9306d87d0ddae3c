"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A mask lays fixed positions over a window of words and ignores the others, so that a substituted word breaks only the
windows in which it falls on a position that counts. Windows of the benchmark and of the documents meet under the
hashes of their masked words. Each hit fixes a diagonal (a shift between document and item); on it the words of the item
are compared with the document's one by one, and an overlap around hits decides.

Where the benchmark is small enough to broadcast, hits are verified where they arise, while the words of the document
are at hand: documents are read and split once, and only what was verified is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts; 0: it is ignored. Six of ten words, for items of ten words or more.
MASKS = ("1101001011", "1011010011")
#: Four of six words, besides, for items of ten words up to SHORT, which hold few windows. Items of fewer than ten words
#: are sought whole.
SHORT_MASKS, SHORT = ("110101", "101101", "111001"), 24
#: Seeds (24 bytes each) and characters of items up to which the benchmark's side is broadcast; above, the joins shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 64 << 20
#: Diagonals of an item whose shifts differ by less than half of this count together: words were put in or left out.
DRIFT = 32


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hash(mask: str, words: Column, at: Column) -> Column:
    """Of the words under the mask from word number `at` on; null where it does not fit."""
    seed = F.lit(int("1" + mask, 2))
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(seed, *(F.get(words, at + k) for k, x in enumerate(mask) if x == "1")))


def _seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...], words: str, name: str) -> DataFrame:
    """keep, name (word number of a window) and h, for each window and mask. One generator gives the places, another the
    hashes at a place: both stay in compiled code, where the array of words is not copied."""
    every = [*dict.fromkeys([*keep, words])]
    places = rows.select(*every, F.explode(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))).alias(name))
    hashes = F.array(*(_hash(m, F.col(words), F.col(name)) for m in masks))
    return places.select(*keep, name, F.explode(hashes).alias("h")).filter("h IS NOT NULL")


def _verified(near: DataFrame, run_words: int, run_equal: int) -> DataFrame:
    """id, content, item, item_content, item_words, drift, at (place of an equal word), run (whether so many words in a row
    hold so many equal ones) for diagonals with words and item_list."""
    equal = F.filter(F.sequence(F.lit(0), F.size("item_list") - 1), lambda i: F.get("words", i + F.col("shift")) == F.get("item_list", i))
    keys = ["id", "content", "item", "item_content", F.size("item_list").alias("item_words")]
    rows = near.select(*keys, "shift", equal.alias("equal"))
    last = F.size("equal") - run_equal
    run = F.when(last >= 0, F.exists(F.sequence(F.lit(0), last), lambda k: F.get("equal", k + run_equal - 1) - F.get("equal", k) < run_words)).otherwise(False)
    # every two shifts that differ by less than half of DRIFT share one of the two
    drift = F.array(F.floor(F.col("shift") / DRIFT) * 2, F.floor((F.col("shift") + DRIFT // 2) / DRIFT) * 2 + 1)
    return rows.select("id", "content", "item", "item_content", "item_words", F.explode(drift).alias("drift"), "equal", run.alias("run")).select("id", "content", "item", "item_content", "item_words", "drift", "run", F.explode("equal").alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", least_share: float = 0.5, least_words: int = 8, run_words: int = 13, run_equal: int = 11, shortest: int = 1) -> DataFrame:
    """id_column, item_column, matched (words of the item found together), item_words, for each document and item of
    which enough stands in the document, in the item's order, around hits: at least least_words words (all of a shorter
    item) and least_share of the item's; or run_equal words of run_words in a row, however long the item.

    Words are runs of letters and digits in lower case. Items of fewer than ten words are found where all their words
    stand in a row; those of fewer than `shortest` words, and of none, are left out. Null texts hold no words. A null id
    or item is a value like another; different texts under one id, or one item id, are judged each; repeated rows give
    one result row. A very long text costs time in proportion to its words, in one task. Empty tables give an empty
    result; other columns are left out.
    """
    span = len(MASKS[0])
    items = benchmark.select(F.col(item_column).alias("item"), normal_words(F.col(item_text)).alias("item_list")).filter(F.size("item_list") >= max(1, shortest))
    items = items.withColumn("item_content", F.xxhash64("item_list")).dropDuplicates(["item", "item_content"])
    n = F.size("item_list")
    # at most nine lengths, and one row of sums
    whole = sorted(r["n"] for r in items.filter(n < span).select(n.alias("n")).distinct().collect())
    size = items.agg(F.sum(n).alias("words"), F.sum(F.length(F.concat_ws(" ", "item_list"))).alias("chars"), F.max(F.when((n >= span) & (n <= SHORT), 1)).alias("short")).first()
    exact = tuple("1" * k for k in whole)
    masks = MASKS + (SHORT_MASKS if size["short"] else ()) + exact
    keep = ["item", "item_content"]
    seeds = _seeds(items.filter(n >= span), keep, MASKS, "item_list", "item_at")
    if size["short"]:
        seeds = seeds.union(_seeds(items.filter((n >= span) & (n <= SHORT)), keep, SHORT_MASKS, "item_list", "item_at"))
    for k, mask in zip(whole, exact, strict=True):
        seeds = seeds.union(items.filter(n == k).select(*keep, F.lit(0).alias("item_at"), _hash(mask, F.col("item_list"), F.lit(0)).alias("h")))
    seeds = seeds.distinct()
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("content"), normal_words(F.col(text_column)).alias("words"))
    few = (size["words"] or 0) * 5 <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS
    shift = (F.col("doc_at") - F.col("item_at")).alias("shift")
    lists = items.select(F.col("item").alias("own_item"), F.col("item_content").alias("own_content"), "item_list")
    same_item = F.col("item").eqNullSafe(F.col("own_item")) & (F.col("item_content") == F.col("own_content"))
    if few:
        hits = _seeds(rows, ["id", "content", "words"], masks, "words", "doc_at").join(F.broadcast(seeds), "h")
        near = hits.select("id", "content", "words", "item", "item_content", shift).join(F.broadcast(lists), same_item)
    else:
        hits = _seeds(rows, ["id", "content"], masks, "words", "doc_at").join(seeds, "h")
        hits = hits.select(F.col("id").alias("hit_id"), F.col("content").alias("hit_content"), "item", "item_content", shift).distinct()
        same = rows["id"].eqNullSafe(hits["hit_id"]) & (rows["content"] == hits["hit_content"])
        near = rows.join(hits, same, "left_semi").dropDuplicates(["id", "content"]).join(hits, same).join(lists, same_item)
    met = _verified(near, run_words, run_equal)
    keys = ["id", "content", "item", "item_content", "item_words"]
    met = met.groupBy(*keys, "drift", "at").agg(F.max("run").alias("run")).groupBy(*keys, "drift").agg(F.count("*").alias("matched"), F.max("run").alias("run"))
    met = met.groupBy(*keys).agg(F.max("matched").alias("matched"), F.max("run").alias("run"))
    enough = (F.col("matched") >= F.least(F.lit(least_words), F.col("item_words"))) & (F.col("matched") >= least_share * F.col("item_words"))
    return met.filter(enough | F.col("run")).select(F.col("id").alias(id_column), F.col("item").alias(item_column), "matched", F.col("item_words").cast("long").alias("item_words"), "content")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark, id_column, text_column, **limits).select(F.col(id_column).alias("bad_id"), F.col("content").alias("bad_content")).distinct()
    own = F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit("")))
    return docs.join(bad, docs[id_column].eqNullSafe(bad["bad_id"]) & (own == bad["bad_content"]), "left_anti")
