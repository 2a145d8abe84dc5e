"""Quality rules (native): cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents of a line are counted; lines above the limit are
removed and documents that lose too much are rejected. Base rules on words and repetition come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is above the limit in a host if so many distinct documents have it, and so many hundredths of the host's distinct documents.
MIN_DOCS, MIN_PERCENT = 20, 2
#: A document is depleted if fewer than so many hundredths of its words are left.
LEFT_PERCENT = 50


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised_line(line: Column) -> Column:
    """Lower-cased, white space as single spaces, none at the ends; empty for a line without a word."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    Windows are hashed and sorted with their places; those equal to a neighbour repeat. In place order, each of them adds
    the words that the next one doesn't cover.
    """

    def places(a: Column) -> Column:
        n = F.size(a)
        hashed = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at(a, i), F.element_at(a, i + 1), F.element_at(a, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(hashed), repeated)

    def repeated(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == h(k - 1), F.lit(False)) | F.coalesce(x["h"] == h(k + 1), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(places(w))


def base_metrics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    held = lines(text)
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(held, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def line_hashes(text: Column) -> Column:
    """The distinct hashes of a text's normalised lines: 16 hexadecimal digits of their MD5."""
    cleaned = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalised_line)
    return F.array_distinct(F.transform(F.filter(cleaned, lambda x: x != ""), digest))


def digest(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 16)


def line_hash(x: Column) -> Column:
    return digest(normalised_line(x))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """docs(text, source) -> source, frequent (array of line hashes): the lines above the limit, for each host that has any.

    Distinct documents of a host are told apart by a hash of all their distinct line hashes, so documents of the same
    lines count once and a copied document isn't taken for boilerplate; any other line makes another document. Counting
    is by (host, line, whole), then by (host, line), both combined before the shuffle: a line or a host that most rows
    have doesn't fall to one task. A line above the limit is held by a fixed share of its host's documents, so there are few.
    """
    hashes = docs.select("source", line_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    held = written(hashes.withColumn("whole", F.unhex(F.md5(F.array_join(F.array_sort("h"), "")))), "line-hashes")  # texts are read once for both counts
    hosts = held.select("source", "whole").distinct().groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_docs"))
    each = held.select("source", "whole", F.explode("h").alias("line")).distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
    above = each.where(F.col("n") >= min_docs).join(hosts, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("n") * 100 >= F.col("_docs") * min_percent)
    return above.groupBy("source").agg(F.sort_array(F.collect_set("line")).alias("frequent"))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """docs(doc_id, text, source, ...) -> all its columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    removed_words, kept_text (the text without the lines above the limit), kept.

    A null text has no words and fails the base rules; null sources are one host; repeated rows are judged alike and
    count once; an empty table gives an empty one. Columns of the result's names that docs has are replaced.
    """
    frequent = written(frequent_lines(docs, min_docs, min_percent), "frequent-lines").select(F.col("source").alias("__orrery_host"), F.col("frequent").alias("__orrery_lines"))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept_text", "kept"]
    out = docs.drop(*new).join(frequent, F.col("source").eqNullSafe(F.col("__orrery_host")), "left").withColumn("__orrery_m", base_metrics(F.col("text")))
    m, text = F.col("__orrery_m"), F.coalesce(F.col("text"), F.lit(""))
    over = lambda x: F.array_contains(F.col("__orrery_lines"), line_hash(x))
    gone = F.when(F.col("__orrery_lines").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(lines(text), F.lit(0).cast("long"), lambda a, x: a + F.when(over(x), F.size(words(x))).otherwise(0)))
    left = F.when(F.col("__orrery_lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~(F.rlike(x, F.lit(WORD)) & over(x))), "\n"))
    out = out.withColumns({"n_words": m["w"]["n_words"], "word_chars": m["w"]["word_chars"], "n_symbols": m["n_symbols"], "n_dup_lines": m["n_dup_lines"], "n_repeat_words": m["w"]["n_repeat_words"], "removed_words": gone, "kept_text": left})
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    out = out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("removed_words")) * 100 >= F.col("n_words") * left_percent))
    return out.drop("__orrery_host", "__orrery_lines", "__orrery_m")
