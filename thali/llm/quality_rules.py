"""Operator 10: quality rules with cross-document line frequency.

One pass over the texts yields per document its word statistics and the hashes of its
normalised lines (lower-cased A-Z, white space collapsed; the first 8 bytes of the MD5).
Lines are counted per host in distinct documents; a line above both limits is boilerplate
and is removed. A document that keeps too few of its words is rejected, as is one that
fails the base rules.

A document is its set of normalised lines: exact copies (in whatever order of lines) are one
document, so copying a text does not make boilerplate of it; documents that differ in any line count
each. A line is boilerplate in more than ``MIN_DOCS`` documents of a host that are also more than
``MIN_SHARE`` percent of them, or in more than ``MAX_DOCS``, however large the host. Near copies of one
text are pages of one template in this sense: a host with many of them loses their common lines.

Scale: the texts themselves are not shuffled for the verdict, only (host, hash) rows; all
counts are partial aggregates, and the join back is many lines to one count, which the
skew join splits for a line that a third of the documents hold. The per-document result
of the pass (hashes, numbers) is written once to the shared checkpoint folder.

Defined results: a null or empty text has no words and fails the base rules; a null host
is a host of its own; repeated rows are one document in the counts and each get the same
verdict; an empty table gives no rows; very long texts are read whole; extra columns, whatever their
names, are ignored by ``verdicts`` and kept by ``clean_documents``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, prepare

#: A line is boilerplate in more documents of a host than this number and than this share (percent) of them,
#: and in more than ``MAX_DOCS`` documents of any host.
MIN_DOCS, MIN_SHARE, MAX_DOCS = 20, 2, 10_000
#: A document is depleted when boilerplate lines hold more than this share (percent) of its words.
MAX_REMOVED = 70
MIN_WORDS, MAX_REPEATED = 50, 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[ \t-\r]")


def normalised_lines(text: str) -> list[tuple[bytes, int]]:
    """(normalised line, words) for each line that holds a word."""
    out = []
    for line in text.encode().lower().split(b"\n"):
        words = line.split()
        if words:
            out.append((b" ".join(words), len(words)))
    return out


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big")


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per document the number of words within 3-word windows that occur twice or more in it."""
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros(len(words), dtype=np.int64)
    if n.sum() < 3:
        return out
    ids = pd.factorize(np.array([w for d in words for w in d], dtype=object))[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), n)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(inside):
        return out
    distinct = int(ids.max()) + 1
    pair = pd.factorize(ids[inside] * distinct + ids[inside + 1])[0]
    triple = pd.factorize(pair * distinct + ids[inside + 2])[0]
    code = pd.factorize(triple * len(words) + doc[inside])[0]
    at = inside[np.bincount(code)[code] >= 2]
    hit = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        hit[at + k] = True
    return np.bincount(doc[hit], minlength=len(words)).astype(np.int64)


def document_lines(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """(doc_id, key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_set,
    lines array<struct<h, words>>): one row per row of ``docs``; key is a hash of the text, line_set one of
    the distinct normalised lines."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                       F.xxhash64(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(3).to_pylist()
                words = [t.encode().split() for t in texts]
                stats: tuple[list, ...] = ([], [], [], [])
                line_set, lines = [], []
                for t, w in zip(texts, words):
                    seen, repeats = set(), 0
                    for line in t.split("\n"):
                        if line in seen:
                            repeats += 1
                        elif _SPACE.sub("", line):
                            seen.add(line)
                    own: dict[int, int] = {}
                    for line, k in normalised_lines(t):
                        h = line_hash(line)
                        own[h] = own.get(h, 0) + k
                    for column, x in zip(stats, (len(w), len(t) - len(_SPACE.findall(t)),
                                                 len(_SYMBOLS.findall(t)), repeats)):
                        column.append(x)
                    held = np.sort(np.fromiter(own, dtype=np.uint64, count=len(own)))
                    line_set.append(line_hash(held.tobytes()) - (1 << 63))
                    lines.append([{"h": h - (1 << 63), "words": k} for h, k in own.items()])
                yield pa.record_batch(
                    [part.column(0), part.column(2), part.column(1), *(pa.array(x, pa.int64()) for x in stats),
                     pa.array(repeated_words(words)), pa.array(line_set, pa.int64()),
                     pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())])))],
                    names=["doc_id", "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "line_set", "lines"])

    return rows.mapInArrow(run, (
        "doc_id long, key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, line_set long, lines array<struct<h: long, words: long>>"))


def boilerplate(found: DataFrame, min_docs: int = MIN_DOCS, min_share: int = MIN_SHARE,
                max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h): lines in too many distinct documents of their host."""
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))     # null is a host of its own
    # exact copies are one row before their lines are counted
    docs = found.select(host.alias("host"), "line_set", "lines").groupBy("host", "line_set").agg(F.first("lines.h").alias("hs"))
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = docs.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    return counts.join(hosts, "host").filter(
        (100 * F.col("n") > min_share * F.col("docs")) | (F.col("n") > max_docs)).select("host", "h")


def verdicts(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, min_share: int = MIN_SHARE,
             max_removed: int = MAX_REMOVED, max_docs: int = MAX_DOCS) -> DataFrame:
    """Statistics and verdict per row: the base rules, then ``removed`` (hashes of boilerplate lines),
    ``removed_words``, ``depleted`` and ``kept``."""
    found = cut_lineage(document_lines(docs, host_col))
    common = boilerplate(found, min_docs, min_share, max_docs)
    lines = found.dropDuplicates(["doc_id", "key", "host"]).select(
        "doc_id", "key", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host"),
        F.explode("lines").alias("line")).select("doc_id", "key", "host", F.col("line.h").alias("h"), "line.words")
    hit = lines.join(common, ["host", "h"]).groupBy("doc_id", "key", "host").agg(
        F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("h")).alias("removed"))
    hit = hit.select(*(F.col(c).alias("_" + c) for c in hit.columns))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    same_host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")) == F.col("_host")
    joined = found.drop("lines", "line_set").join(
        hit, (F.col("doc_id").eqNullSafe(F.col("_doc_id"))) & (F.col("key") == F.col("_key")) & same_host, "left")
    words = F.coalesce("_removed_words", F.lit(0))
    return joined.select(
        "doc_id", "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), words.alias("removed_words"), F.col("_removed").alias("removed"),
        (100 * words > max_removed * F.col("n_words")).alias("depleted")).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_lines(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines whose hashes are listed; null stays null."""
    out = []
    for text, hashes in zip(texts, removed):
        if text is None:
            out.append(None)
            continue
        drop = set(hashes)
        keep = []
        for line in text.split("\n"):
            words = line.encode().lower().split()
            if not words or line_hash(b" ".join(words)) - (1 << 63) not in drop:
                keep.append(line)
        out.append("\n".join(keep))
    return pd.Series(out, dtype=object)


def clean_documents(docs: DataFrame, host_col: str = "source", **limits: int) -> DataFrame:
    """Documents that are kept, without their boilerplate lines; all columns of ``docs`` stay, and
    ``n_chars``, where there is one, follows the text."""
    found = verdicts(docs, host_col, **limits)
    # only rejected documents and those that lose lines are joined back
    acts = found.filter(~F.col("kept") | F.col("removed").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("host").alias("_host"),
        F.col("kept").alias("_kept"), F.col("removed").alias("_removed")).dropDuplicates(["_id", "_key", "_host"])
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.withColumn("_text_key", key).join(
        acts, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
        & F.col(host_col).cast("string").eqNullSafe(F.col("_host")), "left").filter(
        F.coalesce("_kept", F.lit(True)))
    # texts that lose no line are not sent to Python
    less = F.pandas_udf(without_lines, "string")(F.when(F.col("_removed").isNotNull(), F.col("text")), F.col("_removed"))
    out = joined.withColumn("_less", less).withColumn("text", F.coalesce("_less", F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_less").isNotNull(), F.char_length("_less")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle_sql(min_docs: int = MIN_DOCS, min_share: int = MIN_SHARE, max_removed: int = MAX_REMOVED,
               max_docs: int = MAX_DOCS) -> str:
    """The query over these verdicts in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, text FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
grams AS (SELECT doc_id, p, ws[p:p + 2] AS g FROM win),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) >= 2),
hit AS (SELECT DISTINCT doc_id, p + k AS p FROM grams JOIN twice USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM raw
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY 1),
norm AS (SELECT doc_id, host, regexp_extract_all(translate(line, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM raw),
lines AS (SELECT doc_id, host, left(md5(array_to_string(ws, ' ')), 16) AS h, sum(len(ws)) AS words
          FROM norm WHERE len(ws) > 0 GROUP BY ALL),
sets AS (SELECT doc_id, string_agg(h, ',' ORDER BY h) AS line_set FROM lines GROUP BY 1),
ids AS (SELECT d.doc_id, host, coalesce(line_set, '') AS line_set FROM d LEFT JOIN sets USING (doc_id)),
hosts AS (SELECT host, count(DISTINCT line_set) AS docs FROM ids GROUP BY 1),
common AS (SELECT l.host, l.h FROM lines l JOIN ids ON ids.doc_id = l.doc_id JOIN hosts ON hosts.host IS NOT DISTINCT FROM l.host
           GROUP BY l.host, l.h, docs
           HAVING count(DISTINCT line_set) > {min_docs} AND (100 * count(DISTINCT line_set) > {min_share} * docs
                  OR count(DISTINCT line_set) > {max_docs})),
lost AS (SELECT l.doc_id, sum(words) AS n FROM lines l JOIN common c ON c.host IS NOT DISTINCT FROM l.host AND c.h = l.h GROUP BY 1),
s AS (SELECT w.doc_id, len(ws) AS n_words,
             length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(removed_words AS BIGINT) AS removed_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND NOT 100 * removed_words > {max_removed} * n_words AS kept
FROM s"""
