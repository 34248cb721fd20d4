"""What stands before a match in its sentence, and whether that negates the match.

Offsets within a sentence decide, which no built-in expression tells, so these serve Arrow UDFs.
"""

from __future__ import annotations

import re
from bisect import bisect_right

STOPS = re.compile(r"[.!?;\n]")

#: What denies an observation, at once or from further off, and what ends such a denial.
DENIED_HERE = re.compile(r"\b(?:no|not|without|denies|denied|negative for|reports no)\s+(?:any\s+|active\s+|current(?:ly)?\s+|reported\s+)?$")
DENIAL = re.compile(r"\b(?:denies|denied|negative for)\b")
CONTRAST = re.compile(r"\b(?:but|however|except|except for|now|currently)\b")

#: What forbids an act, the acts, and the words of a bare list of prohibitions.
FORBIDS_HERE = re.compile(r"\b(?:(?:do not|don't|never|must not|cannot|does not|not)|not\s+an?)\s+$")
FORBIDS = re.compile(r"\b(?:do not|don't|never|must not|cannot|does not)\s+")
ACT = re.compile(
    r"\b(?:diagnos(?:e|is|ed)|prescrib(?:e|ing|ed)|administer|inject|dispense|start|give|dose|dosing|override|downgrade|ignore|skip|discharge|send home)\b"
    r"|\b(?:provide|offer|make|assign|state|use|treat as)\b[^.!?\n;]{0,80}\b(?:diagnos(?:e|is|ed)|prescription|medication order|condition label)\b"
)
LIST_WORDS = re.compile(
    r"\b(?:diagnos(?:e|is|ed)|prescrib(?:e|ing|ed)|administer|inject|dispense|dose|dosing|override|downgrade|ignore|skip|discharge|send|clear|rule|ruled|out|treat(?:ment)?|condition|label|drug|"
    r"medication|order|start|antibiotic|antibiotics|opioid|insulin|aspirin|oxygen|escalation|protocol|red|flag|home|or|and)\b|[,/()\s-]+"
)
#: Fixed value: any negation up to a hundred characters before.
NEGATED_NEAR = re.compile(r"\b(?:do not|don't|never|must not|cannot|does not|not|no)\b[^.!?\n;]{0,100}$")


class Sentences:
    """A text whose sentences are found once; `before` gives, in lower case, what leads up to a place in its sentence."""

    def __init__(self, text: str) -> None:
        self.text, self.starts = text, [0, *(m.end() for m in STOPS.finditer(text))]

    def before(self, place: int) -> str:
        return self.text[self.starts[bisect_right(self.starts, place) - 1] : place].lower()


def denied(before: str) -> bool:
    """An observation is denied right here, or by the last denial of the sentence if no contrast has followed it."""
    since_denial = DENIAL.split(before)
    return DENIED_HERE.search(before) is not None or (len(since_denial) > 1 and CONTRAST.search(since_denial[-1]) is None)


def prohibited(before: str) -> bool:
    """An act is forbidden right here, or stands in a clause of forbidden acts, or in a bare list that something forbids."""
    clause = FORBIDS.split(before, maxsplit=1)[1:]
    return FORBIDS_HERE.search(before) is not None or any(ACT.search(c) or not LIST_WORDS.sub("", c) for c in clause)


def ruled_out(before: str) -> bool:
    """The wider test of behaviour: prohibited, or any negation near before."""
    return NEGATED_NEAR.search(before) is not None or prohibited(before)


def first_standing(pattern: re.Pattern[str], sentences: Sentences, negated) -> str | None:
    """The first match that its sentence does not negate."""
    return next((m[0] for m in pattern.finditer(sentences.text) if not negated(sentences.before(m.start()))), None)
