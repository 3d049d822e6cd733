"""Numbers, directions and metric names in prose, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number of a text, with its thousands separators.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
#: Words that say which way something went (fixed values).
UP_WORDS = (
    "rise rises rose risen rising climb climbs climbed climbing grew grow grows growing growth increase increases increased increasing "
    "gain gains gained jump jumps jumped jumping surge surges surged surging rally rallies rallied soar soars soared soaring "
    "accelerate accelerates accelerated accelerating upward"
)
DOWN_WORDS = (
    "fall falls fell fallen falling drop drops dropped dropping decline declines declined declining decrease decreases decreased decreasing "
    "shrink shrinks shrinking shrank shrunk plunge plunges plunged plunging slid slide slides sliding sank sink sinks sinking "
    "slump slumps slumped slumping downward lost losing loss deteriorate deteriorates deteriorated deteriorating"
)
#: How two things move together: whole words, and beginnings of words (fixed values).
TOGETHER_WORDS, AGAINST_BEGINNINGS = "positive positively lockstep", "inverse negative opposite anti-correlat anticorrelat"


def _any_of(words: str, ends: str = r"\b", more: str = "") -> str:
    return rf"(?i)\b({'|'.join(words.split())}{more}){ends}"


UP, DOWN = _any_of(UP_WORDS), _any_of(DOWN_WORDS)
TOGETHER, AGAINST = _any_of(TOGETHER_WORDS, more=r"|in\s+tandem"), _any_of(AGAINST_BEGINNINGS, "")
#: How far a number may lie from one that is allowed: absolutely, or in proportion (fixed values).
NEAR, NEAR_SHARE = 0.05, 0.015


def numbers_in(text: Column) -> Column:
    """The numbers of a text without their signs, as array<double>."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.abs(F.replace(x, F.lit(","), F.lit("")).try_cast("double")))


def forms_of(x: Column) -> Column:
    """What prose may make of a number: itself, rounded, and from 1e3, 1e6 and 1e9 on in thousands, millions and
    billions."""
    half = lambda v, k: F.floor(v * k + 0.5) / k
    own = [F.abs(x), F.abs(half(x, 1.0)), F.abs(half(x, 10.0))]
    scaled = [F.when(F.abs(x) >= s, half(F.abs(x) / s, k)) for s in (1e3, 1e6, 1e9) for k in (10.0, 100.0)]
    return F.array_compact(F.array(*own, *scaled))


def is_near(number: Column, allowed: Column) -> Column:
    off = F.abs(number - F.abs(allowed))
    return (off <= NEAR) | (F.try_divide(off, F.abs(allowed)) <= NEAR_SHARE)


def mentions(text: Column, name: str) -> Column:
    """Whether a text has a metric's name as a whole word, in any case; names of one character never count."""
    if len(name) < 2:
        return F.lit(False)
    return text.rlike(f"(?i)(?<![\\w]){re.escape(name)}(?![\\w])")


def direction_of(text: Column) -> Column:
    """up, down, both or null: which way the words of a text point."""
    up, down = text.rlike(UP), text.rlike(DOWN)
    return F.when(up & down, "both").when(up, "up").when(down, "down")
