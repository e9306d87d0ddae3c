"""Quality rules on whole texts, with lines that many documents of a host share; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

#: What parts words: 0x20 and 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Min-hashes of 5-word windows by which near copies are known: a pair that shares one of SKETCH / 2 bands of two meets,
#: and is near if ALIKE agree. At a similarity of 0.8 a pair is missed with a chance of under 1 %; links go on from copy to copy.
SKETCH, ALIKE = 32, 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows found twice or more, by sorting (hash, place) of all windows and looking next door."""
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        near = lambda k: F.coalesce(F.when(k > 0, h(k - 1)) == h(k), F.lit(False)) | F.coalesce(h(k + 1) == h(k), F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), near)
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(a["end"], p)).cast("long")).alias("n"), (p + 3).alias("end"))
    covered = lambda s: F.aggregate(places(s), start, step, lambda a: a["n"])
    some = lambda t: F.size(F.array_distinct(F.transform(t, lambda x: x["h"]))) < F.size(t)
    return F.coalesce(_let(hashes, lambda t: F.when(some(t), _let(F.sort_array(t), covered)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))


def measures(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """id, host, content (hash of the text) and the counts of each text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(host_column).alias("host"), text.alias("text"))
    # the words are bound once inside the expression: a filter on these counts that the optimizer moves below them would
    # otherwise split the text again for every word
    counts = _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w, F.size(w)).alias("repeated")))
    rows = rows.select("id", "host", "text", F.xxhash64("text").alias("content"), counts.alias("counts"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    return rows.select(
        "id",
        "host",
        "content",
        F.col("counts")["n"].alias("n_words"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("counts")["repeated"].alias("n_repeat_words"),
    )


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def lines_of(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """id, host, content, at, line (hash of the normalised line), n (its words), for each line with a word."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(host_column).alias("host"), F.xxhash64(text).alias("content"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    normal = normal_line(F.col("line"))
    rows = rows.select("id", "host", "content", "at", normal.alias("line")).filter(F.length("line") > 0)
    return rows.select("id", "host", "content", "at", F.xxhash64("line").alias("line"), F.size(words_of(F.col("line"))).cast("long").alias("n"))


def common_lines(lines: DataFrame, least_documents: int, share: float) -> DataFrame:
    """(host, line) that more than least_documents and more than that share of the host's different documents hold."""
    once = lines.select("host", "line", "content").distinct()
    held = once.groupBy("host", "line").agg(F.count("*").alias("held"))
    hosts = lines.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    held = held.filter(F.col("held") > least_documents)
    same = held["host"].eqNullSafe(hosts["host"])
    return held.join(hosts, same).filter((F.col("held") > least_documents) & (F.col("held") > share * F.col("documents"))).select(held["host"], "line")


def near_classes(docs: DataFrame, contents: DataFrame, text_column: str) -> DataFrame:
    """(content, class) for the texts among contents that have near copies there: class is the same for all of them."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # equal texts go once from each task, and once in all
    texts = docs.select(F.xxhash64(text).alias("content"), text.alias("text")).dropDuplicates(["content"]).join(contents, "content", "left_semi")
    grams = lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))))
    hashes = texts.select("content", F.explode(_let(words_of(F.col("text")), grams)).alias("h"))
    least = hashes.groupBy("content").agg(*(F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(SKETCH)))
    bands = F.array(*(F.xxhash64(F.lit(k), f"m{k}", f"m{k + 1}") for k in range(0, SKETCH, 2)))
    short = F.array(*(F.col(f"m{k}").bitwiseAND(0xFFFF).cast("int") for k in range(SKETCH)))
    sketches = written(least.select("content", bands.alias("bands"), short.alias("sketch")), "sketches")
    spread = sketches.select("content", "sketch", F.explode("bands").alias("band"))
    first = spread.groupBy("band").agg(F.min(F.struct("content", "sketch")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("band", "first")
    agree = F.size(F.filter(F.zip_with("sketch", F.col("first")["sketch"], lambda a, b: a == b), lambda x: x))
    edges = spread.join(first, "band").filter(F.col("content") != F.col("first")["content"]).filter(agree >= ALIKE)
    found = components(edges.select(F.col("content").alias("a"), F.col("first")["content"].alias("b")))
    return found.select(F.col("node").alias("content"), F.col("root").alias("class"))


def once_a_class(docs: DataFrame, lines: DataFrame, text_column: str, least_documents: int) -> DataFrame:
    """host, line, content of lines, with the class of near copies in place of content. Classes are sought among the
    texts that hold a line which over least_documents texts of a host hold; larger groups of copies are all there."""
    once = lines.select("host", "line", "content").distinct()
    often = once.groupBy("host", "line").agg(F.count("*").alias("held")).filter(F.col("held") > least_documents)
    contents = once.join(often, once["host"].eqNullSafe(often["host"]) & (once["line"] == often["line"]), "left_semi").select("content").distinct()
    classes = written(near_classes(docs, contents, text_column), "classes")
    return once.join(classes, "content", "left").select("host", "line", F.coalesce("class", "content").alias("content"))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", least_documents: int = 20, share: float = 0.02, least_words: int = 50, least_left: float = 0.3) -> DataFrame:
    """Counts and verdict for every row: id_column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_common_words (words in lines that many documents of the host hold), kept.

    A document is kept unless base_failed (fewer than least_words words, or over half of them in repeated 3-word
    windows) or depleted: without its common lines, under least_left of its words are left. Documents with equal texts
    count as one where lines are counted, so that copies, which a later step removes, do not make their own lines
    common. Null text: empty, so it fails. A null host is a host. Repeated rows come back as often, with equal values;
    ids may be null; a very long text takes time in proportion to its words, in one task; an empty table gives an empty
    result; other columns are left out.
    """
    rows = measures(docs, id_column, text_column, host_column)
    lines = lines_of(docs, id_column, text_column, host_column)
    lost = lost_lines(lines, common_lines(lines, least_documents, share))
    return _verdicts(rows, lost, least_words, least_left, id_column).drop("gone")


def lost_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """lost_id, lost_content, lost (words in common lines) and gone (places of these lines, in order)."""
    met = lines.join(common, lines["host"].eqNullSafe(common["host"]) & (lines["line"] == common["line"]), "left_semi")
    # equal rows (id and text) have equal lines: each line counts once
    lost = met.groupBy("id", "content", "at").agg(F.first("n").alias("n")).groupBy("id", "content").agg(F.sum("n").alias("lost"), F.sort_array(F.collect_list("at")).alias("gone"))
    return lost.select(F.col("id").alias("lost_id"), F.col("content").alias("lost_content"), "lost", "gone")


def _verdicts(rows: DataFrame, lost: DataFrame, least_words: int, least_left: float, id_column: str) -> DataFrame:
    """The columns of quality(), and gone."""
    out = rows.join(lost, rows["id"].eqNullSafe(lost["lost_id"]) & (rows["content"] == lost["lost_content"]), "left")
    out = out.withColumn("n_common_words", F.coalesce("lost", F.lit(0).cast("long")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("n_common_words") >= least_left * F.col("n_words"))
    return out.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_common_words", kept.alias("kept"), "content", "gone")


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines at the places in gone, which are in order: what lies between them is joined again."""
    ends = lambda lines: F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    between = lambda lines, e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(lines, F.get(e, k - 1) + 2, F.get(e, k) - F.get(e, k - 1) - 1))
    left = _let(F.split(text, "\n"), lambda lines: _let(ends(lines), lambda e: F.array_join(F.flatten(between(lines, e)), "\n")))
    return F.when(F.size(gone) > 0, left).otherwise(text)


def keep_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", chars_column: str = "n_chars", least_documents: int = 20, share: float = 0.02, least_words: int = 50, least_left: float = 0.3) -> DataFrame:
    """The rows of docs whose document the rules of quality() keep, with all their columns, and their texts without the common lines
    of their host; chars_column, where there is one, follows the text. The verdicts are written first, so that each text
    is measured once. Unlike in quality(), which counts as its SQL does, a class of near copies counts once where lines
    and documents are counted: near copies, of which a later step keeps one, do not make their own lines common."""
    rows = measures(docs, id_column, text_column, host_column)
    lines = written(lines_of(docs, id_column, text_column, host_column), "lines")
    lost = lost_lines(lines, common_lines(once_a_class(docs, lines, text_column, least_documents), least_documents, share))
    out = _verdicts(rows, lost, least_words, least_left, id_column)
    verdicts = written(out.select(F.col(id_column).alias("good_id"), F.col("content").alias("good_content"), "kept", "gone"), "verdicts")
    good = verdicts.filter("kept").dropDuplicates(["good_id", "good_content"]).withColumnRenamed("gone", "good_gone").drop("kept")
    own = F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit("")))
    met = docs.join(good, docs[id_column].eqNullSafe(good["good_id"]) & (own == good["good_content"]))
    left = without_lines(docs[text_column], good["good_gone"])
    chars = {chars_column: F.length(left).cast(docs.schema[chars_column].dataType)} if chars_column in docs.columns else {}
    new = {text_column: left} | chars
    return met.select(*(new.get(c, docs[c]).alias(c) for c in docs.columns))


#: DuckDB SQL for quality() with its defaults.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS content FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
tri AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, source, content, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
held AS (SELECT source, norm, count(DISTINCT content) AS n FROM lines GROUP BY source, norm),
hosts AS (SELECT source, count(DISTINCT content) AS n FROM lines GROUP BY source),
common AS (SELECT held.source, norm FROM held JOIN hosts USING (source) WHERE held.n > 20 AND held.n > 0.02 * hosts.n),
lost AS (SELECT doc_id, sum(len(list_filter(string_split(norm, ' '), lambda x: x <> ''))) AS n FROM lines JOIN common USING (source, norm) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_common_words >= 0.3 * n_words AS kept FROM f
"""
