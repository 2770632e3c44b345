"""Quality rules with cross-document line frequency: lines that a host repeats are removed, depleted documents rejected.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_hash, line_key, stored, text_of

GAPS = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAPS, -1), lambda w: w != "")


def _head(a: Column, n: Column) -> Column:
    return F.slice(a, 1, n)


def window_hashes(words: Column) -> Column:
    """A hash of every three words in a row."""
    def of(h: Column) -> Column:
        n = F.size(h) - 2
        pairs = F.zip_with(_head(h, n), F.slice(h, 2, n), lambda x, y: F.xxhash64(x, y))
        return F.when(n < 1, F.array().cast("array<long>")).otherwise(F.zip_with(pairs, F.slice(h, 3, n), lambda p, z: F.xxhash64(p, z)))
    return bind(F.transform(words, lambda w: F.xxhash64(w)), of)


def _has_repeat(windows: Column) -> Column:
    return F.size(F.array_distinct(windows)) < F.size(windows)


def _covered(windows: Column) -> Column:
    """Words inside windows found twice or more: sort (hash, place), compare with both neighbours, unite three places each."""
    def marked(t: Column) -> Column:
        m, none = F.size(t) - 1, F.lit(None).cast("struct<v:bigint,i:int>")
        before = F.concat(F.array(none), _head(t, m))
        after = F.concat(F.slice(t, 2, m), F.array(none))
        left = F.zip_with(t, before, lambda x, p: F.struct(x["v"].alias("v"), x["i"].alias("i"), F.coalesce(x["v"] == p["v"], F.lit(False)).alias("e")))
        places = F.filter(F.zip_with(left, after, lambda x, q: F.when(x["e"] | (x["v"] == q["v"]), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))
    return bind(F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), marked)


def repeat_words(words: Column) -> Column:
    return bind(window_hashes(words), lambda w: F.when(_has_repeat(w), _covered(w)).otherwise(F.lit(0)))


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """The base figures of a text; ``words`` is a column that holds its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORDY))
    long = lambda c: c.cast("long")
    return {"n_words": long(F.size(words)), "word_chars": long(F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w))),
            "n_symbols": long(F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))),
            "n_dup_lines": long(bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))), "n_repeat_words": long(repeat_words(words))}


def judge(docs: DataFrame, max_share: float = 0.1, min_docs: int = 10, min_left: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept) of every row.

    A line is removed if it is in at least ``min_docs`` documents of its host and in more than ``max_share`` of them. A
    document is rejected if fewer than ``min_left`` of its words are left, or if the base rules fail it: fewer than 50 words, or more than half
    of them in repeated windows.

    Defined cases: null and empty texts have no words and fail; rows without host form one host of their own;
    rows that repeat an id are one document when documents are counted and judged each by its own text; rows without
    id count for no line; an empty table gives an empty one; other columns are not read.

    Scale: lines are counted by (host, line, id) and then by (host, line), so neither a host nor a line with a third
    of all rows meets in one task; texts are never shuffled, only hashes and figures are. A host's size is one number.
    """
    text = text_of(text_col)
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), host.alias("host"), text.alias("text"))
    lines = rows.select("id", "row", "host", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.col("line").rlike(WORDY))
    hashed = stored(lines.select("id", "row", "host", F.size(words_of(F.col("line"))).alias("n"), *key_hash(line_key(F.col("line")))), "host-lines")
    counts = hashed.groupBy("host", "h1", "h2").agg(F.count_distinct("id").alias("docs")).filter(F.col("docs") >= min_docs)
    hosts = rows.groupBy("host").agg(F.count_distinct("id").alias("all"))
    common = stored(counts.join(hosts, "host").filter(F.col("docs") > F.col("all") * max_share).select("host", "h1", "h2"), "common-lines")
    removed = hashed.join(common, ["host", "h1", "h2"]).groupBy("id", "row", "host").agg(F.sum("n").alias("gone"))
    # one row of figures for each text; rows that repeat id, host and text get the same sum of all their lines
    times = hashed.groupBy("id", "row", "host").agg(F.sum("n").alias("all_words"))
    counted = rows.select("id", "row", "host", "text", words_of(F.col("text")).alias("words"))
    figures = counted.select("id", "row", "host", *(v.alias(k) for k, v in base_counts(F.col("text"), F.col("words")).items()))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = removed.alias("r").join(times.alias("t"), (F.col("r.id").eqNullSafe(F.col("t.id"))) & (F.col("r.row") == F.col("t.row")) & (F.col("r.host") == F.col("t.host"))).select(
        "t.id", "t.row", "t.host", (F.col("gone") / F.col("all_words")).alias("lost"))
    f, s = figures.alias("f"), share.alias("s")
    judged = f.join(s, F.col("f.id").eqNullSafe(F.col("s.id")) & (F.col("f.row") == F.col("s.row")) & (F.col("f.host") == F.col("s.host")), "left")
    lost = F.coalesce("lost", F.lit(0.0))
    return judged.select(F.col("f.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                         F.round(lost * F.col("n_words")).cast("long").alias("n_removed_words"), (~base_failed & (1 - lost >= min_left)).alias("kept"))
