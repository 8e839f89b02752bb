"""Text entries: tokenizing, trimming, and the match predicates, all as native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import strings


@dataclass(frozen=True)
class Match:
    """How entries are matched; each flag is one of the extraction's options."""

    pattern: str = ""
    ignore_case: bool = False
    whole_word: bool = False
    regex: bool = False
    extract: bool = False
    keep_white: bool = False
    tokenize: bool = False
    clip: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if self.regex and (self.whole_word or self.extract):
            raise ValueError("a regex pattern excludes whole words and substrings")
        if self.extract and not self.pattern:
            raise NotImplementedError("a substring needs a pattern")


def lines(df: DataFrame, text: str = "text", out: str = "ln", number: str | None = None) -> DataFrame:
    """A row for each line, numbered from 1 if asked."""
    split = F.split(F.col(text), "\n")
    if number is None:
        return df.withColumn(out, F.explode(split))
    return df.select("*", F.posexplode(split).alias("_pos", out)).withColumn(number, (F.col("_pos") + 1).cast("long")).drop("_pos")


def tokens(df: DataFrame, text: str = "text", out: str = "tok") -> DataFrame:
    """A row for each word, blank ones dropped."""
    return df.withColumn(out, F.explode(strings.words(F.col(text))))


def folded_pattern(how: Match) -> str:
    """The pattern as it is looked for: case is ignored for ASCII only, as it is in the text."""
    return how.pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if how.ignore_case else how.pattern


def matches(text: Column, how: Match) -> Column:
    """Whether an entry's text meets the pattern."""
    if not how.pattern:
        return F.lit(True)
    if how.regex:
        return text.rlike(f"(?i){how.pattern}" if how.ignore_case else how.pattern)
    pattern = how.pattern
    if how.ignore_case:
        text, pattern = strings.ascii_lower(text), folded_pattern(how)
    if how.whole_word:
        return strings.whole_word_first(text, pattern) if how.extract else text == pattern
    return F.contains(text, F.lit(pattern))


def search(entries: DataFrame, how: Match) -> DataFrame:
    """Entries (text, x, y, length) in the extraction's order: words, trim, drop blank, clip, match, substring."""
    found = entries
    if how.tokenize:
        found = tokens(found, "text", "text")
    elif not how.keep_white:
        found = found.withColumn("text", strings.trim_blank(F.col("text")))
    found = found.where(~strings.is_blank(F.col("text")))
    if how.clip:
        from leafmill.functions.values import within

        found = found.where(within(F.col("x"), F.col("y"), *how.clip))
    found = found.where(matches(F.col("text"), how))
    if how.extract:
        text = strings.ascii_lower(F.col("text")) if how.ignore_case else F.col("text")
        pattern = folded_pattern(how)
        found = found.withColumn("pos", F.locate(pattern, text).cast("long")).withColumn("text", F.substring("text", F.col("pos").cast("int"), F.lit(len(pattern))))
    return found
