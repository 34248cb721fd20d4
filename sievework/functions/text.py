"""Text as Columns: tokenizers, normalizers, counting, snippets, ages. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"

#: Words left out of grounding tokens, and the aliases of cue tokens.
GROUNDING_STOPWORDS = (
    "and", "the", "for", "with", "from", "that", "this", "only", "protocol", "local", "cited", "review", "request",
    "escalate", "escalation", "observed", "reported", "vitals", "setting", "field", "clinic", "case", "synthetic",
)
CUE_ALIASES = {
    "vitals": "vital", "signs": "sign", "meds": "medication", "medications": "medication", "breaths": "breathing",
    "respirations": "respiration", "respiratory": "respiration",
}
#: Words left out of the tokens of a cue.
CUE_STOPWORDS = (
    "a", "an", "and", "or", "the", "to", "of", "for", "if", "by", "with", "used", "use", "local", "protocol", "protocols",
    "observation", "observations", "report", "reported", "confirmation", "confirm", "known", "available", "complete",
    "current", "relevant", "specific", "source", "card", "cards", "id", "ids", "detail", "details",
)
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90,
}


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def words(value: Column) -> Column:
    """Lower-case runs of letters and digits, with repeats; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(WORD), F.lit(0))


def normalize(value: Column) -> Column:
    """Words joined by one space: the key for comparing phrases."""
    return F.array_join(words(value), " ")


def squeeze(value: Column) -> Column:
    """Lower case, dashes and underscores as spaces, white space collapsed; punctuation stays."""
    flat = F.translate(F.lower(value), "-_", "  ")
    return F.trim(F.regexp_replace(flat, r"[ \t\n\x0B\f\r]+", " "))


def query_terms(value: Column) -> Column:
    """Search terms: words of two characters or more, repeats kept."""
    return F.filter(words(value), lambda w: F.length(w) > 1)


def grounding_tokens(value: Column) -> Column:
    """Distinct tokens of three characters or more; stop words go before the plural ending does."""

    def singular(w: Column) -> Column:
        ies = F.concat(F.expr("''"), F.regexp_replace(w, "ies$", "y"))
        return F.when(w.endswith("ies") & (F.length(w) > 4), ies).when(w.endswith("s") & (F.length(w) > 4), F.regexp_replace(w, "s$", "")).otherwise(w)

    kept = F.filter(words(value), lambda w: (F.length(w) >= 3) & ~w.isin(*GROUNDING_STOPWORDS))
    return F.array_distinct(F.transform(kept, singular))


def cue_tokens(value: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct cue tokens: aliases, then the plural s of words longer than three characters."""
    aliases = F.create_map(*(F.lit(x) for pair in CUE_ALIASES.items() for x in pair))

    def token(w: Column) -> Column:
        cut = F.when(w.endswith("s") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
        return F.coalesce(F.try_element_at(aliases, w), cut)

    made = F.transform(words(value), token)
    return F.array_distinct(F.filter(made, lambda w: ~w.isin(*stopwords)) if stopwords else made)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs as a substring, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def snippet(text: Column, term: str, around: int = 40, default: int = 120) -> Column:
    """The term's first place with some characters on both sides, or the text's beginning."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - F.lit(around), F.lit(1))
    near = F.substring(text, start, at - start + F.lit(len(term) + around))
    return F.trim(F.when(at > 0, near).otherwise(F.substring(text, 1, default)))


def compact(text: Column, most: int = 180) -> Column:
    """One table cell: white space collapsed, cut with an ellipsis, pipes escaped."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    cut = F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)
    return F.replace(cut, F.lit("|"), F.lit("\\|"))


def slug(text: Column, most: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), 1, most)


def age_in_years(age: Column) -> Column:
    """Years told by an age text: months, weeks or days, years, or a bare one- or two-digit number; null if none."""
    low = F.trim(F.lower(F.coalesce(age, F.lit(""))))
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("int")
    months = number(r"(?:^|[^a-z0-9])([0-9]{1,3}) ?(?:months|month|mos|mo)(?:[^a-z0-9]|$)")
    short = number(r"(?:^|[^a-z0-9])([0-9]{1,3}) ?(?:days|day|d|weeks|week|wks|wk|w)(?:[^a-z0-9]|$)")
    years = number(r"(?:^|[^a-z0-9])([0-9]{1,3}) ?(?:years|year|yrs|yr|y)(?:[^a-z0-9]|$)")
    bare = number(r"^([0-9]{1,2})$")
    return F.coalesce(F.floor(months / 12).cast("int"), F.when(short.isNotNull(), F.lit(0)), years, bare)


def is_minor(age: Column) -> Column:
    return F.coalesce(age_in_years(age) < 18, F.lit(False))


def spoken_number(value: Column) -> Column:
    """Number words added up ("twenty three"); an unknown word makes it null."""
    table = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    parts = F.transform(words(value), lambda w: F.try_element_at(table, w))
    total = F.aggregate(parts, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x.isNotNull()), total)
