"""Line-first cleaning: lines are judged one by one, then documents by what is left of them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from codeq.llm.common import chunks, through_arrow, whole_text

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
ENDINGS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "…", "”", "»")
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "we use cookies", "terms of use",
    "terms of service", "terms and conditions", "enable javascript", "click here", "skip to content",
    "add to cart", "sign up for our", "subscribe to our", "lorem ipsum", "licensed under the",
    "permission is hereby granted",
)
MOST_LOST = 30  # percent of the words
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
SPACES = " \t\n\x0b\x0c\r"


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line with words is no prose.

    Punctuation: fewer than 5 words without an end mark, or more than one symbol to two words.
    Navigation: two separators or more, one to five words at least. Boilerplate: a stock phrase.
    """
    if sum(map(line.count, SYMBOLS)) * 2 > n_words:
        return True
    if n_words < 5 and not line.rstrip(SPACES).endswith(ENDINGS):
        return True
    separators = sum(map(line.count, SEPARATORS))
    return (separators > 1 and 5 * separators >= n_words) or bool(_BOILERPLATE.search(line.lower()))


def repeated_words(words: list, width: int = 3) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) < width:
        return 0
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    count, windows = len(words) - width + 1, codes[:len(words) - width + 1]
    for i in range(1, width):
        # Renumbered at each step, so that products stay below 2^63 for any text.
        _, windows = np.unique(windows * len(known) + codes[i:i + count], return_inverse=True)
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i:i + count] |= again
    return int(covered.sum())


def judge(text: str, most_lost: int = MOST_LOST) -> dict:
    """Base figures and verdict of one text, and the text without failed lines."""
    words, seen, kept_lines = [], set(), []
    dup_lines = lost = bad_lines = 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            kept_lines.append(line)
            continue
        words += own
        dup_lines += line in seen
        seen.add(line)
        if line_fails(line, len(own)):
            bad_lines += 1
            lost += len(own)
        else:
            kept_lines.append(line)
    n_words, repeats = len(words), repeated_words(words)
    failed = n_words < 50 or 100 * repeats > 50 * n_words
    return {
        "n_words": n_words, "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup_lines,
        "n_repeat_words": repeats, "base_failed": failed,
        "kept": not failed and 100 * lost <= most_lost * n_words,
        "n_bad_lines": bad_lines, "n_lost_words": lost, "clean_text": "\n".join(kept_lines),
    }


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, "
          "n_lost_words long, clean_text string")


def clean_lines(docs: DataFrame, most_lost: int = MOST_LOST, with_text: bool = True) -> DataFrame:
    """One row per document with its figures, verdict and cleaned text (null unless wanted).

    Null text has no words and fails; null and repeated doc_ids are kept row by row.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(batches):
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            found = [judge(t, most_lost) for t in texts]
            if not with_text:
                for x in found:
                    x["clean_text"] = None
            yield {"doc_id": doc_ids} | {n: [x[n] for x in found] for n in names[1:]}
    return through_arrow(docs.select("doc_id", whole_text()), rows, SCHEMA)


SQL = r"""
WITH lines AS (
    SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
           length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
           length(regexp_replace(line, '[^|»›•]', '', 'g')) AS separators
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), by_line AS (
    SELECT doc_id, sum(n) AS n_words, count(*) FILTER (again AND n > 0) AS n_dup_lines,
           coalesce(sum(n) FILTER (fails), 0) AS n_lost_words, count(*) FILTER (fails) AS n_bad_lines
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
                 n > 0 AND (symbols * 2 > n
                   OR n < 5 AND NOT regexp_matches(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                                   '[.!?:;,"'')\]…”»]$')
                   OR separators > 1 AND 5 * separators >= n
                   OR regexp_matches(lower(line), '{boilerplate}')) AS fails
          FROM lines)
    GROUP BY doc_id
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
), triples AS (
    SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS triple
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), repeats AS (
    SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, triple) AS times
          FROM triples WHERE triple IS NOT NULL), range(3) AS t(d)
    WHERE times > 1 GROUP BY doc_id
), base AS (
    SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
           coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
           coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
    FROM documents d LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * n_lost_words <= {most_lost} * n_words AS kept
FROM base
""".replace("{boilerplate}", "|".join(BOILERPLATE)).replace("{most_lost}", str(MOST_LOST))
