"""The dictionaries of the registered queries: rules, phrases, gates, checks. They are data; the operators take any others."""

from __future__ import annotations

from sievework.operators.audit import Gate
from sievework.operators.screening import Rule, whole_word

RULES = (
    Rule("ABUSE-STRONG", "emergency", "ABUSE-CARD", (whole_word("scum"), whole_word("worthless"), whole_word("disgusting")), label="Strong abuse"),
    Rule("ABUSE", "urgent", "ABUSE-CARD", (whole_word("idiot", "moron"), whole_word("stupid")), label="Abuse"),
    Rule("ABUSE-MILD", "monitor", "TONE-CARD", (whole_word("clown"), whole_word("loser"), whole_word("trash", "pathetic")), label="Mild abuse"),
    Rule("CREDENTIAL", "urgent", "SECRET-CARD", ("((?:token|password|secret|api_key) *[=:] *\"?[a-z0-9+/_.-]+)", "(akia[a-z0-9]+)"), label="Credential"),
    Rule("CONTACT", "monitor", "PRIVACY-CARD", ("([a-z0-9._%+-]+@[a-z0-9.-]+)", r"(\+1 \([0-9]+\) [0-9]+-[0-9]+)"), label="Contact details"),
    Rule("LICENCE", "monitor", "RIGHTS-CARD", (whole_word("licensed under", "all rights reserved"),), gate="general public|license", label="Licence line"),
)
FORBIDDEN = tuple(whole_word(w) for w in ("idiot", "trash", "scum", "moron", "token", "licensed"))
CUES = ("idiot", "clown", "trash", "stupid")
MARKERS = ("the", "of", "that", "is")
AGE_UNITS = ("months", "years", "weeks", "mo", "yrs", "", "d", "adult", "y", "Days")
ERRORS = ("idiot", "licensed", "akia", "timeout", "$$$", "token")
SLOTS = (("a", 5), ("b", 3), ("c", 2), ("d", 1))
GATES = (
    Gate("licence", "licensed under|all rights", "version 2"),
    Gate("credential", "token *=|akia"),
    Gate("abuse", "idiot|scum|moron", "not an idiot"),
    Gate("contact", "@mail|call now"),
)
PROVEN = ("contact",)
EXTRA_QUERIES = ((-1, "zzqqx"), (-2, "ntio"), (-3, ""))
SPLIT_SEED, SPLIT_FRACTION, SPLIT_GROUP = "round-1", 0.1, 4
QUOTAS = (("Brand#1", 5), ("Brand#2", 200), ("Brand#3", 0), ("Brand#4", 12), ("Brand#17", 60))
INTAKES = (
    (1, "8 months", "", "fever"),
    (2, "40 years", "pregnant", "temp 39.1 c"),
    (3, "17 y", "not_pregnant", "pregnant aunt"),
    (4, "", "", "a toddler, not pregnant"),
    (5, "240 mo", "postpartum week 2", "temperature of 101 f"),
    (6, "9", "unsure", "denies pregnancy"),
    (7, "3 wks", "unsure", "she is pregnant"),
    (8, "99", "n/a", "temp 37.0 c"),
)
OBSERVATION_CUES = ("idiots of trash", "token", "released under license", "the clown", "is it stupid")
