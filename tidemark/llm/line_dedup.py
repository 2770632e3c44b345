"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

DataFrame functions only. A line's key is the line stripped of ASCII white space with A-Z lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_hash, line_key, stored, text_of


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keep_positions(lines: Column, dropped: Column) -> Column:
    """The lines whose positions are not in ``dropped``. Linear: a set difference, then one pass."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    # the one-element array binds the split lines to a name, so that they are not split again for each position
    return F.element_at(F.transform(F.array(lines), lambda held: F.transform(kept, lambda i: held[i])), 1)


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
                      counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Documents with the lines dropped that many documents share; the largest id holding a key keeps its lines.

    A key of at least ``min_chars`` code points in at least ``min_docs`` different ids loses all its lines
    except in the largest of these ids. Returns the columns of ``docs`` with the new text, and ``counts``: its
    lines before dropping, and those dropped. Extra columns of these two names are replaced.

    Defined cases: a null or empty text is one empty line. Rows that repeat an id are one document when
    documents are counted, and each keeps its own row. A row without an id counts for no key and loses
    every line whose key qualifies. An empty table gives an empty table.

    Scale: the hashed lines (36 bytes each) are stored once. Counting is a two-step distinct aggregate, first by
    (key, id), so a line found in a third of all documents is spread over tasks before its ids meet as
    one partial count per task. The join back on the key is left to the skew join; texts move once, by id.
    """
    docs = docs.select(*(c for c in docs.columns if c not in counts))
    text = text_of(text_col)
    row = F.xxhash64(text)  # tells rows of one id apart
    lines = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.posexplode(split_lines(text)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    hashed = stored(keyed.select("id", "row", "pos", *key_hash(F.col("key"))), "line-hashes")
    # stored, so that both sides of the next join are plain exchanges, which the skew join can split
    shared = stored(hashed.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
                    .filter(F.col("n") >= min_docs).select("h1", "h2", "last"), "shared-lines")
    drops = (hashed.join(shared, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
             .groupBy("id", "row").agg(F.collect_set("pos").alias("gone")))
    d, g = docs.alias("d"), drops.alias("g")
    joined = d.join(g, F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.xxhash64(text_of(f"d.{text_col}")) == F.col("g.row")), "left")
    own = text_of(f"d.{text_col}")
    kept = F.when(F.col("g.gone").isNull(), own).otherwise(F.array_join(keep_positions(split_lines(own), F.col("g.gone")), "\n"))
    return joined.select(*(kept.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns),
                         F.size(split_lines(own)).cast("long").alias(counts[0]),
                         F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias(counts[1]))
