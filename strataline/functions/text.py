"""Text, date and hashing expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The space separators (category Zs), which SQL's trim strips, and with the controls all white space.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029" + SPACES


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def normalise_title(title: Column) -> Column:
    """URL-decoded, underscores as spaces, white space collapsed; a plus stays, a bad escape leaves the text."""
    decoded = F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title)
    return squeeze(F.replace(decoded, F.lit("_"), F.lit(" ")))


def _fold(texts: pd.Series) -> pd.Series:
    link = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]")
    return texts.map(lambda t: None if t is None else " ".join(link.sub(r"\1", unicodedata.normalize("NFKC", t)).split()).casefold())


def fold(text: Column | str) -> Column:
    """NFKC, link markup without brackets, white space collapsed, full case folding."""
    return F.pandas_udf(_fold, "string")(text)


def fold_ascii(text: Column) -> Column:
    """The same for texts of plain ASCII, without leaving the JVM."""
    return F.lower(squeeze(F.regexp_replace(text, "\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]", "$1")))


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD that exists, else null."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def time_literal(text: Column) -> Column:
    """The day of a literal like +2024-01-05T00:00:00Z; month or day 00 is null."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, "^\\+(\\d{4}-\\d{2}-\\d{2})T", 1), F.lit("")), "yyyy-MM-dd")


def qualifier_date(dates: Column, one_only: bool) -> Column:
    """The greatest date, or with one_only the only distinct one."""
    return F.when(F.size(F.array_distinct(dates)) == 1, F.array_max(dates)) if one_only else F.array_max(dates)


def excerpt(text: Column, limit: int) -> Column:
    short = squeeze(text)
    return F.when(F.length(short) <= limit, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, limit - 1)), F.lit("…")))


def blocks(text: Column, least: int = 20, white: str = WHITE) -> Column:
    """Stripped blocks between blank lines, without those shorter than `least`; a line of `white` characters alone is blank."""
    # a bare F.trim would take the place in the array as the characters to strip
    stripped = F.transform(F.split(text, f"\\n[\\n{white}]*\\n"), lambda b: F.trim(b, F.lit(white)))
    return F.filter(stripped, lambda b: F.length(b) >= least)


def quoted(text: Column) -> Column:
    """The text as a literal part of a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def mentions(text: Column, alias: Column) -> Column:
    """The alias as a whole word, without regard to case."""
    return F.regexp_like(text, F.concat(F.lit("(?iU)(?<!\\w)"), quoted(alias), F.lit("(?!\\w)")))


def answers_directly(text: Column, alias: Column) -> Column:
    """The text is the alias alone or in one of three affirmative phrases; a longer sentence that mentions it is none."""
    own, mark = quoted(squeeze(alias)), "[\"']?"
    forms = [
        F.concat(own, F.lit("[.!]?")),
        F.concat(F.lit(rf"(?:the\s+)?answer\s*(?:is|was|:)\s*{mark}"), own, F.lit(rf"{mark}[.!]?")),
        F.concat(F.lit(rf"(?:it|this|that)\s+(?:is|was)\s+{mark}"), own, F.lit(rf"{mark}[.!]?")),
        F.concat(F.lit(rf"my\s+(?:final\s+)?answer\s*(?:is|:)\s*{mark}"), own, F.lit(rf"{mark}[.!]?")),
    ]
    whole = F.concat(F.lit("(?iu)^(?:"), F.concat_ws("|", *forms), F.lit(")$"))
    return (F.length(squeeze(alias)) > 0) & F.regexp_like(squeeze(text), whole)


def claim_errors(evidence: Column, page: Column, answer: Column, cited: Column, owned: Column, most_words: int = 8) -> Column:
    """What is wrong with a claim: its evidence does not stand in the page, its answer has no word or too many, or it cites what is not its own."""
    quote, words = fold_ascii(evidence), F.size(F.filter(F.split(squeeze(answer), " "), lambda w: w != ""))
    return F.array_compact(F.array(
        F.when((quote == "") | ~F.contains(fold_ascii(page), quote), F.lit("evidence")), F.when(~words.between(1, most_words), F.lit("answer_length")), F.when(F.size(F.array_except(cited, owned)) > 0, F.lit("citation")),
    ))


def evidence_window(text: Column, alias: Column, before: int, after: int) -> Column:
    """The text around the first mention of the alias, else null."""
    at = F.instr(F.lower(text), F.lower(alias))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before)) + F.length(alias) + after))


def canonical_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of compact JSON with sorted keys and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def precedes(a: Column, b: Column) -> Column:
    """As timestamps where both parse, else as texts; false for a missing one."""
    return F.coalesce(F.try_to_timestamp(a) < F.try_to_timestamp(b), a < b, F.lit(False))


def lenient_json(text: Column, schema: str) -> Column:
    """The object in a raw, fenced or surrounded JSON text."""
    inner = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    return F.from_json(F.when(inner != "", inner), schema)
