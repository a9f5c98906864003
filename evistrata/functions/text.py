"""Text normalisation as Column expressions. Patterns use (?U) so that classes are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters folded one to one.
FOLD = {
    "‒": "-", "–": "-", "—": "-", "¯": "-",
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a",
    "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e",
    "í": "i", "î": "i", "ï": "i", "ñ": "n",
    "ò": "o", "ó": "o", "ô": "o", "ö": "o", "ø": "o", "×": "x",
    "ú": "u", "ü": "u", "č": "c", "ğ": "g", "ł": "l",
    "ń": "n", "ş": "s", "ŭ": "u", "і": "i", "ј": "j",
    "а": "a", "в": "b", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "ӧ": "o", "⁰": "0", "⁴": "4", "⁵": "5", "⁶": "6",
    "⁷": "7", "⁸": "8", "⁹": "9", "₀": "0", "₁": "1", "₂": "2",
    "₃": "3", "₅": "5", "₇": "7", "₉": "9",
}
# Substrings removed one after the other, in this order.
UNITS = (
    "/μm", "/mol", "°c", "≥", "≤", "<", ">", "±", "%", "/mumol", "day", "month", "year", "·", "week", "days", "weeks", "years",
    "/µl", "μg", "u/mg", "mg/m", "g/m", "mumol/kg", "/week", "/day", "m²", "/kg", "®", "ﬀ", "ﬃ", "ﬁ", "ﬂ", "£", "¥", "©", "«", "¬",
    "°", "±", "²", "³", "´", "·", "¹", "»", "½", "¿", "‘", "’", "“", "”", "•", "˂", "˙", "˚", "˜", "…", "‰", "′", "″", "‴", "€", "™",
    "↑", "→", "↓", "∗", "∙", "∝", "∞", "∼", "≈", "≠", "≤", "≥", "≦", "≫", "⊘", "⊣", "⊿", "⋅", "═", "■", "▵", "⟶", "⩽", "⩾", "、",
    "气", "益", "粒", "肾", "补", "颗", "\ue2f6", "\ue2fa", "\uf020", "\uf02c", "，",
)
# Spellings of the disease name, and the token that replaces them.
SYNONYMS = (
    "amyotrophic[- ]lateral[- ]sclerosis", "lou[- ]gehrig[’'`s]?[- ]disease", "lou[- ]gehrig[- ]disease",
    "motor[- ]neuron[- ]disease", "charcot[- ]disease",
)
ENTITY = "als_disease_token"
# Words that mark unwanted publication types.
EXCLUDED = ("foreword", "prelude", "commentary", "workshop", "conference", "symposium", "comment", "comments", "retract", "correction", "erratum", "memorial")
# Fixed values: (pattern, replacement) after folding, lower-casing, citations, units and synonyms, in order.
CLEANING = (
    (r"http\S+|www\.\S+", " "), (r"\b-+\s*", ""), (r"\s*-+\b", ""), (r"-{2,}", "-"), (r"\s*-\s*", "-"),
    (r"[^a-z0-9_\-\s]", " "), (r"\b\d+\b", " "), (r"\bh4\b", " "), (r"\b[a-zA-Z0-9]\b", " "), (r"\s+", " "),
)
MIN_CHARS, MIN_TOKENS = 10, 20
TOKEN = r"[A-Za-z0-9_]+"


def squeeze(text: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    return F.translate(text, "".join(FOLD), "".join(FOLD.values()))


def normalize(text: Column, ascii_words: bool = False) -> Column:
    """The whole cleaning chain. Intra-word hyphens vanish and fuse their words; the chain isn't idempotent.

    With ascii_words, "et al" and "als" end at any character but ASCII letters, digits and "_", as SQL's \\b has it.
    """
    alone = (lambda w: rf"(?U)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])") if ascii_words else (lambda w: rf"(?U)\b{w}\b")
    out = F.regexp_replace(F.lower(fold(text)), alone(r"et\s+al"), " ")
    for i, u in enumerate(UNITS):
        if len(u) > 1 and not any(e in u for e in UNITS[:i]):  # else nothing is left of it by then
            out = F.replace(out, F.lit(u), F.lit(" "))
    single = "".join(dict.fromkeys(u for u in UNITS if len(u) == 1))  # each comes after the longer ones that hold it
    out = F.translate(out, single, " " * len(single))
    out = F.regexp_replace(out, "(?iU)(" + "|".join(SYNONYMS) + ")", f" {ENTITY} ")
    out = F.regexp_replace(out, alone("als"), f" {ENTITY} ")
    for pattern, by in CLEANING:
        ascii_only = pattern in (r"\b\d+\b", r"\bh4\b", r"\b[a-zA-Z0-9]\b", r"-{2,}")
        out = F.regexp_replace(out, pattern if ascii_only else f"(?U){pattern}", by)
    return F.trim(out)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that filters and projections above can't have computed again."""
    return df.withColumn(name, F.explode(F.array(value)))


def long_enough(text: Column) -> Column:
    return (F.char_length(text) > MIN_CHARS) & (F.size(F.split(text, " ")) > MIN_TOKENS)


def is_excluded(text: Column) -> Column:
    return text.rlike(r"(?i)\b(" + "|".join(EXCLUDED) + r")\b")


def tokens(text: Column, lower: bool = True) -> Column:
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def is_upper_mention(token: Column) -> Column:
    """At least one letter, and no letter that isn't upper case."""
    return token.rlike(r"\p{L}") & (token == F.upper(token))


def slug(text: Column, most: int = 150) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", "")
    return F.substr(F.regexp_replace(F.trim(kept), r"\s+", "_"), F.lit(1), F.lit(most))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(most - 3))), F.lit("..."))).otherwise(text)


def highlight(text: Column, term: str) -> Column:
    return F.regexp_replace(text, rf"(?i)\b({term})\b", "**$1**")


def mentions(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def distinct_flat(lists: Column) -> Column:
    """Elements of an array of arrays, each once, in order of first appearance."""
    return F.array_distinct(F.flatten(lists))


def themes(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Labels of which any keyword occurs in the lower-cased text."""
    low = F.lower(text)
    hit = lambda words: F.greatest(F.lit(False), *[F.contains(low, F.lit(w)) for w in words])
    return F.array_compact(F.array(*[F.when(hit(w), F.lit(k)) for k, w in keywords.items()]))
