"""The pattern scan for packs of very many rules.

The scan of the catalogue writes each rule into the plan. Here the rules are a table: an automaton over
all needles reads a text once and names the rules it may match, and only those pairs of text and rule
run a pattern; rules that begin with plain letters are tried right where these are. The plan is the same for ten rules and for ten thousand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeq.functions.text import java_pattern
from codeq.operators.scan import MARK, scan_input
from codeq.rules.catalogue import PatternRule

MOST_CHARS = 16 << 20  # of patterns, ids and needles: what is broadcast and sent to each task


# A pattern of plain ASCII letters and what repeats of letters and classes may follow them; Python and Java read these alike.
_LED = re.compile(r"(?:(?:[0-9A-Za-z_ ]|\[[0-9A-Za-z_ -]+\])(?:(?:[+*?]|\{\d+(?:,\d*)?\})\??(?![+?]))?)+")


def lead(pattern: str) -> str:
    """The plain letters that every match of such a pattern begins with, lower-case; empty for other patterns."""
    begins = re.match(r"[0-9A-Za-z_ ]+", pattern)
    if not begins or not _LED.fullmatch(pattern):
        return ""
    known = begins[0][:-1] if re.match(r"[*?{]", pattern[begins.end():]) else begins[0]
    return known.lower() if len(known) > 1 else ""


def _tried(rules: Sequence[PatternRule]) -> Callable:
    """Column function: (number, lines) of the rules that a text may match, from the clean and the folded text.

    ``lines`` has the line of each match of a rule with a lead, which can begin only where the lead is;
    it is null for other rules, whose patterns are still to be run.
    """
    leads = {i: word for i, r in enumerate(rules) if (word := lead(r.pattern))}
    always = [i for i, r in enumerate(rules) if i not in leads and not r.must_hold]
    owners: dict[str, tuple[list[int], list[int]]] = {}  # rules whose needle it is, and whose lead
    for i, r in enumerate(rules):
        for needle in [leads[i]] if i in leads else r.must_hold:
            owners.setdefault(needle, ([], []))[i in leads].append(i)
    patterns = {i: rules[i].pattern for i in leads}

    @F.pandas_udf("array<struct<number:int,lines:array<int>>>")
    def tried(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for needle, (need, led) in owners.items():
            automaton.add_word(needle, (len(needle) - 1, need, led))
        automaton.make_automaton()
        match = {i: re.compile(p, re.IGNORECASE | re.MULTILINE).match for i, p in patterns.items()}

        def of(clean: str | None, folded: str | None) -> list[tuple[int, list[int] | None]]:
            may, found, ends = set(always), {}, {}
            line, at = 1, 0
            for end, (back, need, led) in automaton.iter(folded) if folded and owners else ():
                may.update(need)
                for i in led:
                    start = end - back
                    if start >= ends.get(i, 0) and (hit := match[i](clean, start)):
                        ends[i] = hit.end()
                        # Leads end in order; of several that end here the longest begins first.
                        if start < at:
                            own = line - clean.count("\n", start, at)
                        else:
                            own = line = line + clean.count("\n", at, start)
                            at = start
                        found.setdefault(i, []).append(own)
            return [(i, None) for i in sorted(may)] + list(found.items())
        for cleans, foldeds in columns:
            yield pd.Series([of(c, f) for c, f in zip(cleans, foldeds, strict=True)], dtype=object)
    return tried


def pack_frame(spark: SparkSession, rules: Sequence[PatternRule]) -> DataFrame:
    """The rules as a table: number, rule_id, pattern. More than ``MOST_CHARS`` characters are refused."""
    chars = sum(len(r.rule_id) + len(r.pattern) + sum(map(len, r.needles)) for r in rules)
    if chars > MOST_CHARS:
        raise ValueError(f"rules of {chars} characters; at most {MOST_CHARS} go to every task")
    return spark.createDataFrame(pa.table({
        "number": pa.array(range(len(rules)), pa.int32()),
        "rule_id": pa.array([r.rule_id for r in rules], pa.string()),
        "pattern": pa.array([java_pattern(r.pattern) for r in rules], pa.string()),
    }))


def _pairs(files: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """A row per file and rule that it may match, with the pattern and, where known, the lines of the matches."""
    read = scan_input(files).select("review_id", "file_id", "clean", _tried(rules)("clean", "folded").alias("tried"))
    return read.select("review_id", "file_id", "clean", F.explode("tried").alias("x")).select(
        "review_id", "file_id", F.when(F.col("x.lines").isNull(), F.col("clean")).alias("clean"), "x.*").join(
        F.broadcast(pack_frame(files.sparkSession, rules)), "number")


def scan_pack(files: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """One row per match: review_id, file_id, rule_id, line_start, as ``scan_rules`` gives them.

    No shuffle: the text goes once through the automaton. Rules led by plain letters are held to the text
    where these are; for each other rule that may match the text is repeated and its pattern run. Rules of
    which no needle is known are tried on every text. Null content has no matches; two rules of one id are
    two rules.
    """
    mark = F.lit(MARK)
    marked = F.transform(F.split(F.regexp_replace("clean", F.col("pattern"), F.lit(MARK + "$0")), "\n"),
                         lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    lines = F.flatten(F.transform(F.filter(marked, lambda x: F.contains(x.text, mark)), lambda x: F.array_repeat(
        x.line, F.length(x.text) - F.length(F.replace(x.text, mark, F.lit(""))))))
    return _pairs(files, rules).select("review_id", "file_id", "rule_id", F.explode(
        F.coalesce("lines", lines)).alias("line_start"))


def count_pack(files: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """rule_id and n_matches over all files, for rules that match at all; counted without their lines."""
    counted = F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(F.regexp_count("clean", F.col("pattern")))
    return _pairs(files, rules).groupBy("rule_id").agg(F.sum(counted.cast("long")).alias("n_matches")).filter("n_matches > 0")
