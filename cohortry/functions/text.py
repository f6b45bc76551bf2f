"""Text helpers: trimming, question keys and figure tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.rounding import with_two_decimals
from cohortry.spec import WHITE_SPACE

# A month label, or a number with an optional sign, decimals and unit. The lookahead
# changes nothing but lets ordinary characters be skipped at once.
FIGURE_PATTERN = r"(?iU)(?=[-\d])(?:\d{4}-\d{2}|-?\d[\d,]*(?:\.\d+)?\s*(?:%|pp|bp|x)?)"

# A numeric code in front of a segment name, as in "01 - TOP".
SEGMENT_CODE_PATTERN = r"(?U)^\s*\d+\s*-\s*"


def strip(text: Column, characters: str = WHITE_SPACE) -> Column:
    """Trim a set of characters; blanks alone take Spark's much faster plain trim."""
    return F.trim(text) if characters == " " else F.btrim(text, F.lit(characters))


def plain_token(token: Column) -> Column:
    """Lower case, without blanks and thousands separators."""
    return F.translate(F.lower(token), " ,", "")


def figure_tokens(text: Column) -> Column:
    """All figures of a text in reading order, in plain form."""
    return F.transform(F.regexp_extract_all(text, F.lit(FIGURE_PATTERN), F.lit(0)), plain_token)


SHOWN = ("shown_value", "shown_prior", "shown_delta", "shown_size")


def with_display_text(findings: DataFrame) -> DataFrame:
    """Adds the figures of a finding as the tokens in which they may be stated."""
    hundred = {
        "shown_value": "value * 100",
        "shown_prior": "prior_value * 100",
        "shown_delta": "delta * 100",
        "shown_size": "abs(delta) * 100",
    }
    units = dict(zip(SHOWN, ("%", "%", "pp", "pp"), strict=True))
    return with_two_decimals(findings, hundred).withColumns(
        {name: F.concat(name, F.lit(unit)) for name, unit in units.items()}
    )


def segment_name(segment: Column) -> Column:
    """Segment label without its leading numeric code."""
    return strip(F.regexp_replace(segment, SEGMENT_CODE_PATTERN, ""))


def question_key(text: Column) -> Column:
    """Lower case, outer space removed, inner runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
