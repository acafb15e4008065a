"""What answers and questions look like: word lists and patterns, and predicates from them as Spark columns and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers that aren't substantive, in lower case.
SPECIAL = [
    "don't know", "dont know", "do not know", "do not know / no answer", "don't know/haven't heard", "don't know/haven't heard enough", "don't know him",
    "hard to say", "difficult to say", "can't say", "can't choose", "uncertain", "not sure", "haven't thought about it", "haven't thought much about it",
    "do not understand", "refused", "refused to answer", "refuse to answer", "decline to answer", "prefer not to say", "prefer not to answer", "refusal",
    "missing", "not applicable", "not asked", "not asked in survey", "not asked in this country", "not available", "no data", "no answer", "no response",
    "na", "n/a", "inapplicable", "does not apply", "does not apply at all", "skipped", "not stated", "other", "others", "other (specify)",
    "other (please specify)", "other - specify", "other- specify", "other (please name)", "others (please specify)", "extra-regio nuts 1",
    "extra-regio nuts 2", "extra-regio nuts 3",
]
# Options that no variation is made of (parties, groups, faiths, languages), matched in lower case.
OPTION_PATTERNS = [
    r"^[A-Z]{2,3}:\s+", r"\bparty\s*\(", r"\([A-Z]{2,6}\)$", r"\bparty\s+of\s+\w+", r"\bdemocratic\s+party\b", r"\brepublican\s+party\b", r"\blabour\s+party\b",
    r"\bliberal\s+party\b", r"\bconservative\s+party\b", r"\bsocialist\s+party\b", r"\bcommunist\s+party\b", r"\bgreen\s+party\b", r"\bpeople'?s\s+party\b",
    r"\bnational\s+front\b", r"\bmovement\s+for\b", r"\balliance\s+for\b", r"\bcoalition\s+of\b", r"\bcongress\s+party\b", r"\btribe\b", r"\btribal\b",
    r"\bethnic\s+group\b", r"igna$", r"\bcluster\b", r"\bcatholic\b", r"\bprotestant\b", r"\borthodox\b", r"\bsunni\b", r"\bshia\b", r"\bhindu\b",
    r"\bbuddhist\b", r"\bmuslim\b", r"\bchristian\b", r"\bpentecostal\b", r"\bevangelical\b", r"\bdenomination\b", r"^arabic$", r"^english$", r"^french$",
    r"^spanish$", r"^portuguese$", r"^swahili$", r"^mandarin$", r"^cantonese$",
]
# Questions of which no variation is made, matched in lower case.
QUESTION_PATTERNS = [
    r"which\s+party", r"vote\s+for\s+which", r"party\s+did\s+you", r"ethnic\s+group", r"ethnicity", r"your\s+tribe", r"religious\s+denomination",
    r"what\s+religion", r"language.*speak", r"mother\s+tongue", r"native\s+language",
]
# Options that stand on a scale, in any case.
SCALE_PATTERNS = [
    r"^strongly\s+(agree|disagree)", r"^(agree|disagree)\s+strongly", r"^(completely|totally)\s+(agree|disagree)", r"^(somewhat|slightly)\s+(agree|disagree)",
    r"^neither\s+agree\s+nor\s+disagree", r"^(agree|disagree)$", r"^(very|quite|fairly|rather)\s+(often|frequently|rarely|seldom)",
    r"^(always|usually|sometimes|rarely|never)$", r"^(every\s+day|several\s+times|once\s+a\s+week)", r"^(very|quite|fairly|somewhat|a\s+little|not\s+at\s+all)",
    r"^(a\s+great\s+deal|a\s+lot|some|a\s+little|none)", r"^(extremely|very|moderately|slightly|not\s+at\s+all)",
    r"^(very|fairly|not\s+very|not\s+at\s+all)\s+(satisfied|dissatisfied)", r"^(completely|mostly|somewhat)\s+(satisfied|dissatisfied)",
    r"^(very|fairly|not\s+very|not\s+at\s+all)\s+important", r"^(essential|very\s+important|fairly\s+important|not\s+important)",
    r"^(a\s+great\s+deal|quite\s+a\s+lot|not\s+very\s+much|none\s+at\s+all)", r"^(complete|a\s+lot\s+of|some|little|no)\s+(trust|confidence)",
    r"^(very|fairly|not\s+very|not\s+at\s+all)\s+likely", r"^(definitely|probably|probably\s+not|definitely\s+not)", r"^(excellent|good|fair|poor|very\s+poor)$",
    r"^(much\s+better|somewhat\s+better|about\s+the\s+same|somewhat\s+worse|much\s+worse)", r"^(first|second|third|fourth|fifth)\s+", r"^(1st|2nd|3rd|4th|5th)\s+",
]

SPECIAL_RE = "|".join(re.escape(s) for s in SPECIAL)
SPECIAL_TEXT = "\n".join(SPECIAL)
SCALE_RE, OPTION_RE, QUESTION_RE = "|".join(SCALE_PATTERNS), "|".join(OPTION_PATTERNS), "|".join(QUESTION_PATTERNS)


def is_special(option: Column) -> Column:
    """Exactly one of the special answers, trimmed and in any case."""
    return F.lower(F.trim(option)).isin(SPECIAL)


def is_substantive(option: Column) -> Column:
    """Not empty, holding no special answer and held by none: one pattern and one search, whatever the list's length."""
    o = F.lower(F.trim(option))
    return (o != "") & ~o.rlike(SPECIAL_RE) & (F.instr(F.lit(SPECIAL_TEXT), o) == 0)


def is_scale_option(option: Column) -> Column:
    return F.lower(F.trim(option)).rlike(SCALE_RE)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def substantive_sql(o: str) -> str:
    parts = " OR ".join(f"contains(lower({o}), {quoted(s)}) OR contains({quoted(s)}, lower({o}))" for s in SPECIAL)
    return f"({o} <> '' AND NOT ({parts}))"
