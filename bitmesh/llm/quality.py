r"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself, failing lines go, and a document that loses too
much text thereby is rejected. Words are ``[^\x20\x09-\x0D]+``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitmesh.llm.frames import once

BLANK = r"\x20\x09-\x0D"
#: Marks that end a sentence, and quotes and brackets that may follow (fixed values).
ENDS, CLOSERS = r".!?…:;。！？", r"\"'”»’)\]"
#: Marks between the entries of a menu (fixed values).
MENU = r"|»›•·"
SYMBOLS = r"#*$%&|<>"
#: Phrases of page furniture and licence lines (fixed values).
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "enable javascript", "lorem ipsum", "click here", "sign up", "log in", "subscribe", "skip to content",
    "licensed under", "released under", "powered by",
]
#: A line of up to so many characters that has such a phrase is boilerplate.
BOILERPLATE_CHARS = 200
#: Of a document's word characters, the failing lines may hold so many hundredths.
MAX_LOST = 50


def _length_of(x: Column, other_than: str) -> Column:
    return F.length(F.regexp_replace(x, f"[^{other_than}]++", ""))


def line_fails(x: Column) -> Column:
    """Whether a line with words breaks a rule; a line without words breaks none."""
    bare = F.rtrim(F.regexp_replace(x, f"[{BLANK}]", " "))
    three_words = x.rlike(rf"\A[{BLANK}]*+[^{BLANK}]++[{BLANK}]++[^{BLANK}]++[{BLANK}]++[^{BLANK}]")
    ended = bare.rlike(rf"[{ENDS}][{CLOSERS}]{{0,3}}\z")
    unfinished = ~ended & (~three_words | ~x.rlike(f"[{ENDS}]"))
    marks = _length_of(x, MENU)
    words = F.size(F.split(F.trim(bare), " +"))
    menu = F.when(marks > 0, 4 * marks >= words).otherwise(False)
    noisy = 10 * _length_of(x, SYMBOLS) > F.length(x)
    furniture = (F.length(x) <= BOILERPLATE_CHARS) & F.lower(x).rlike("|".join(BOILERPLATE))
    return x.rlike(f"[^{BLANK}]") & (unfinished | menu | noisy | furniture)


def judge(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_bad_lines, cleaned, kept``.

    ``cleaned`` is the text without its failing lines. A document is kept
    unless it fails the base rules (under 50 words, or over half of the words
    repeated) or its failing lines hold more than ``max_lost`` hundredths of
    its word characters.

    A null text counts as empty, has no words and is not kept. Every row is
    judged by itself: repeated rows get the same result, an empty table stays
    empty, other columns pass through, and columns named like new ones are
    replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "cleaned", "kept"]
    old = [c for c in docs.columns if c not in own]
    df = docs.select(*[F.col(f"`{c}`") for c in old], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    df = once(df, __words=F.array_remove(F.split("__t", f"[{BLANK}]+"), ""), __lines=F.split("__t", "\n"))
    w = F.col("__words")
    windows = F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", F.size(w).cast("long").alias("n_words"))
    df = once(df, __hash=windows)
    df = once(df, __order=F.when(F.size(F.array_distinct("__hash")) < F.size("__hash"), F.sort_array(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = once(df, __good=F.filter("__lines", lambda x: ~line_fails(x)))
    order = F.col("__order")
    near = F.filter(
        F.transform(order, lambda s, j: F.when((F.get(order, j - 1)["h"] == s["h"]) | (F.get(order, j + 1)["h"] == s["h"]), s["i"])),
        lambda i: i.isNotNull(),
    )
    repeats = F.size(F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(i, i + 1, i + 2)))))
    worded = F.filter("__lines", lambda x: x.rlike(f"[^{BLANK}]"))
    chars = lambda c: F.length(F.regexp_replace(c, f"[{BLANK}]++", "")).cast("long")
    df = once(df, __counts=F.struct(
        chars(F.col("__t")).alias("word_chars"),
        _length_of(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.when(order.isNotNull(), repeats).otherwise(0).cast("long").alias("n_repeat_words"),
        (F.size("__lines") - F.size("__good")).cast("long").alias("n_bad_lines"),
        F.array_join("__good", "\n").alias("cleaned"),
    ))
    df = df.select(*old, "n_words", "__counts.*")
    lost = F.when(F.col("n_bad_lines") > 0, F.col("word_chars") - chars(F.col("cleaned"))).otherwise(0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * lost <= max_lost * F.col("word_chars")))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), a AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, string_split(x, chr(10)) AS l,
         list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lw FROM t
), b AS (
  SELECT *, list_transform(lw, lambda s: struct_pack(
      s := s,
      ended := regexp_matches(s, '[.!?…:;。！？]["''”»’)\]]{0,3}[\x20\x09-\x0D]*$'),
      marked := regexp_matches(s, '[.!?…:;。！？]'),
      words := len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')),
      menu := length(regexp_replace(s, '[^|»›•·]', '', 'g')),
      syms := length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')),
      furniture := length(s) <= 200 AND regexp_matches(lower(s), 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|accept cookies|enable javascript|lorem ipsum|click here|sign up|log in|subscribe|skip to content|licensed under|released under|powered by'))) AS r
  FROM a
), c AS (
  SELECT doc_id, x, w, lw, list_filter(r, lambda q:
      (NOT q.ended AND (q.words < 3 OR NOT q.marked)) OR (q.menu > 0 AND 4 * q.menu >= q.words) OR 10 * q.syms > length(q.s) OR q.furniture) AS bad
  FROM b
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), e AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id
), f AS (
  SELECT c.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lw) - len(list_distinct(lw)) AS n_dup_lines,
         coalesce(e.n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(array_to_string(list_transform(bad, lambda q: q.s), ''), '[\x20\x09-\x0D]', '', 'g')) AS lost
  FROM c LEFT JOIN e ON e.doc_id = c.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept
FROM f
"""


def digest(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return judge(slim).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
