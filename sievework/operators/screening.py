"""Rule screening: dictionaries of patterns over text, first evidence in pattern order, severity floors, negation scope.

Patterns are literals unrolled into one projection, so a rule set of any size is one scan without a join.
"""

from __future__ import annotations

import operator
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import severity
from sievework.functions.negation import Sentences, denied, first_standing
from sievework.functions.sets import compact_issues


@dataclass(frozen=True)
class Rule:
    """Patterns are tried in their order; gate, if given, must match as well."""

    rule_id: str
    severity: str
    card_id: str
    patterns: tuple[str, ...]
    gate: str | None = None
    label: str = ""


def whole_word(*alternatives: str) -> str:
    """A pattern with the match in group 1, bounded by ASCII non-word characters or the ends: equal in every regex dialect."""
    return f"(?:^|[^a-z0-9])({'|'.join(alternatives)})(?:[^a-z0-9]|$)"


def record_text(*columns: str) -> Column:
    """Columns in order, one a line, lower-cased; nulls are skipped, empty strings stay."""
    return F.lower(F.concat_ws("\n", *columns))


def needed_texts(nodes: Iterable) -> list[str]:
    """Texts of which every match of a parsed expression holds at least one; none if it tells of none. The longest are chosen."""
    found, run = [], ""
    for kind, value in [*nodes, (None, None)]:
        if kind is sre.LITERAL:
            run += chr(value)
            continue
        found.append([run] if run else [])
        run = ""
        if kind is sre.SUBPATTERN:
            found.append(needed_texts(value[-1]))
        elif kind is sre.BRANCH:
            arms = [needed_texts(x) for x in value[1]]
            found.append([t for x in arms for t in x] if all(arms) else [])
        elif kind is sre.MAX_REPEAT and value[0] > 0:
            found.append(needed_texts(value[2]))
    return max(found, key=lambda x: min(map(len, x), default=0))


def extracted(text: Column, pattern: str) -> Column:
    """The stripped match of a pattern; null if there is none. A search for plain text that it needs comes first, as most texts lack that."""
    compiled = re.compile(pattern)
    found = F.nullif(F.trim(F.regexp_extract(text, pattern, 1 if compiled.groups else 0)), F.lit(""))
    needed = [] if compiled.flags & re.IGNORECASE else needed_texts(sre_parser.parse(pattern))
    if not needed:
        return found
    return F.when(reduce(operator.or_, (F.contains(text, F.lit(t)) for t in dict.fromkeys(needed))), found)


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The stripped match of the first pattern in list order that matches; null if none does."""
    return F.coalesce(*(extracted(text, p) for p in patterns))


def fired(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Array of structs of the rules that fire, in their order."""

    def one(rule: Rule, ordinal: int) -> Column:
        evidence = first_match(text, rule.patterns)
        good = evidence.isNotNull() if rule.gate is None else evidence.isNotNull() & text.rlike(rule.gate)
        row = F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.label).alias("label"),
            F.lit(rule.severity).alias("severity"),
            evidence.alias("evidence"),
            F.lit(rule.card_id).alias("card_id"),
            F.lit(ordinal).alias("check_ordinal"),
        )
        return F.when(good, row)

    return compact_issues(*(one(r, i) for i, r in enumerate(rules)))


def screen(df: DataFrame, text: Column, rules: tuple[Rule, ...], confirmed: Column | None = None, into: str = "fired") -> DataFrame:
    """df with the fired rules; a row that is not confirmed gets none."""
    found = fired(text, rules)
    if confirmed is not None:
        found = F.when(confirmed, found).otherwise(F.slice(found, 1, 0))
    return df.withColumn(into, found)


def rule_rows(screened: DataFrame, *keys: str, column: str = "fired") -> DataFrame:
    """One row for each fired rule. (An outer explode: of a plain one the optimizer would compute all rules twice.)"""
    return screened.select(*keys, F.inline_outer(column)).where("rule_id IS NOT NULL")


def floor(fired_rules: Column, base: Column | None = None) -> Column:
    """The highest severity among the fired rules and the base floor."""
    levels = F.transform(fired_rules, lambda r: r["severity"])
    return severity.highest(levels if base is None else F.concat(levels, F.array(base)))


def clauses(text: Column) -> Column:
    """Text cut at clause ends."""
    return F.filter(F.split(F.lower(text), r"[.;!?\n]", -1), lambda c: F.trim(c) != "")


def negated_clause(clause: Column, cue: str, markers: tuple[str, ...]) -> Column:
    """Whether a marker stands before the cue's first place in the clause."""
    before = F.substring_index(clause, cue, 1)
    return before.rlike(f"(?:^|[^a-z0-9])(?:{'|'.join(markers)})(?:[^a-z0-9]|$)")


def first_unnegated(patterns: tuple[str, ...]):
    """An Arrow UDF: the first match, in pattern order and then text order, that its clause does not negate. Offsets decide, so this one is not a Column."""
    compiled = [re.compile(p, re.I) for p in patterns]

    @F.pandas_udf(T.StringType())
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            sentences = Sentences(text or "")
            found = (first_standing(p, sentences, denied) for p in compiled)
            return next((x.strip() for x in found if x is not None), None)

        for batch in texts:
            yield batch.map(one).astype(object)

    return find
