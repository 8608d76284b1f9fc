"""Normal forms of notice texts, all as column expressions: nothing leaves the JVM.

Java's classes are ASCII-only without (?U), so every pattern carries it, and punctuation is told by explicit Unicode classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of a normal form, in the order in which they apply, and the tokens that replace them.
SPACES = r"[ \t]+"
NEWLINES = r"\n{2,}"
LABELLED_REFERENCE = r"(reference number|ref\.? no\.?|tender (?:reference|id|no\.?)|nit no\.?|bid number)\s*[:\-]?\s*\S+"
REFERENCE_SHAPE = r"\b(?:[a-z]{2,6}[-/][0-9]{2,4}(?:[-/][0-9a-z]{1,6}){1,3}|[a-z]{2,6}[-/][0-9]{4,}|[0-9]{2,4}[-/][0-9]{2,6}[-/][0-9]{2,6})\b"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
DATE = rf"\b(?:\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-\s]?(?:{MONTHS})[a-z]*[-,\s]+\d{{2,4}}|(?:{MONTHS})[a-z]*[-\s]+\d{{1,2}}\s*,?\s*\d{{2,4}})\b"
MONEY = [
    (r"(?:rs\.?|inr|rupees)?\s*([\d,]+(?:\.\d+)?)\s*(?:cr\.?|crore[s]?)\b", 1e7),
    (r"(?:rs\.?|inr|rupees)?\s*([\d,]+(?:\.\d+)?)\s*(?:lakh[s]?|lac[s]?)\b", 1e5),
    (r"\b(?:rs\.?|inr|rupees)\s*([\d,]+(?:\.\d+)?)\s*(?:/-|only)?", 1.0),
]
NUMBER = r"\b\d[\d,]*(?:\.\d+)?\b"
PUNCTUATION = r"[^\p{L}\p{N}_<>\p{Z}\x09-\x0d\x1c-\x1f\x85]+"
REFERENCE_TOKEN, DATE_TOKEN, NUMBER_TOKEN = " <ref> ", " <date> ", " <num> "
VARIANTS = ("raw", "mask", "canon")

#: Anything that separates words.
WHITE = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]+"
#: Marks both ends of a match while it is rewritten; taken out of the text before.
_MARK = "\x01"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once for a row: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _flagged(pattern: str) -> str:
    return f"(?iU){pattern}"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}|{WHITE}$", "")


def money_token(amount: Column) -> Column:
    """Three significant digits and a power of ten of an amount; what is no amount, or none above 0, is <money>."""
    power = F.floor(F.log10(amount)).cast("int")
    digits = F.rint(amount / F.pow(F.lit(10.0), (power - 2).cast("double"))).cast("bigint")
    large = F.concat(F.lit("<money_"), digits.cast("string"), F.lit("e"), (power - 2).cast("string"), F.lit(">"))
    small = F.concat(F.lit("<money_"), F.rint(amount).cast("bigint").cast("string"), F.lit(">"))
    return F.when(amount.isNull() | (amount <= 0) | (amount > 1e300), "<money>").when(amount >= 100, large).otherwise(small)


def rewritten(text: Column, pattern: str, token: Callable[[Column], Column]) -> Column:
    """The text with every match replaced by what `token` makes of its first group: matches are marked, and every second part is one."""
    parts = F.split(F.regexp_replace(text, _flagged(pattern), f"{_MARK}$1{_MARK}"), _MARK)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.concat(F.lit(" "), token(part), F.lit(" "))).otherwise(part)), "")


def canonical_money(text: Column) -> Column:
    """Amounts of rupees in any notation as tokens of their value, so the same sum written differently is the same word."""
    text = F.translate(text, _MARK, " ")
    for pattern, unit in MONEY:
        text = rewritten(text, pattern, lambda part, unit=unit: bound(F.translate(part, ",", "").try_cast("double") * unit, money_token))
    return text


def line_key(line: Column) -> Column:
    """What makes two lines the same boilerplate: case and punctuation don't count, digits do."""
    return _strip(F.regexp_replace(F.regexp_replace(F.lower(line), PUNCTUATION, " "), SPACES, " "))


def without_lines(text: Column, keys: Column) -> Column:
    """The text without the lines whose keys are in the array."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(keys, line_key(line))), "\n")


def normalised(text: Column, variant: str = "canon", boilerplate: Column | None = None) -> Column:
    """Lower case, boilerplate lines gone, references, dates, money and numbers as tokens, punctuation as spaces.

    raw keeps numbers and boilerplate, mask replaces all numbers, canon keeps the value of money.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {VARIANTS}")
    text = F.lower(F.coalesce(text, F.lit("")))
    if variant != "raw":
        if boilerplate is not None:
            text = F.when(boilerplate.isNull() | (F.size(boilerplate) == 0), text).otherwise(without_lines(text, F.coalesce(boilerplate, F.array().cast("array<string>"))))
        text = F.regexp_replace(text, _flagged(LABELLED_REFERENCE), REFERENCE_TOKEN)
        text = F.regexp_replace(text, _flagged(DATE), DATE_TOKEN)
        if variant == "canon":
            text = canonical_money(text)
        text = F.regexp_replace(text, _flagged(REFERENCE_SHAPE), REFERENCE_TOKEN)
        text = F.regexp_replace(text, _flagged(NUMBER), NUMBER_TOKEN)
    text = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), SPACES, " ")
    return _strip(F.regexp_replace(text, NEWLINES, "\n"))


def words(text: Column) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def portable_hash(gram: Column) -> Column:
    """60 bits of an MD5, which any engine can repeat."""
    return F.conv(F.substring(F.md5(gram), 1, 15), 16, 10).cast("bigint")


def word_grams(text: Column, k: int, hashed: Callable[[Column], Column] | None = None) -> Column:
    """The set of hashes of all k successive words. A shorter text is padded, so even an empty one has one."""
    hashed = hashed or F.xxhash64
    padded = bound(words(text), lambda w: F.when(F.size(w) < k, F.concat(w, F.array_repeat(F.lit("<pad>"), k - F.size(w)))).otherwise(w))
    return F.array_distinct(bound(padded, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: hashed(F.array_join(F.slice(w, i + 1, k), " ")))))


def byte_grams(text: Column, k: int, hashed: Callable[[Column], Column] | None = None) -> Column:
    """The set of hashes of all k successive bytes of the UTF-8 text; none of a shorter text."""
    hashed = hashed or F.xxhash64
    none = F.array().cast("array<bigint>")
    grams = lambda data: F.transform(F.sequence(F.lit(0), F.octet_length(data) - k), lambda i: hashed(F.substring(data, i + 1, F.lit(k))))
    return F.array_distinct(bound(F.encode(text, "UTF-8"), lambda data: F.when(F.octet_length(data) >= k, grams(data)).otherwise(none)))


def shingles(text: Column, scheme: str = "w5", hashed: Callable[[Column], Column] | None = None) -> Column:
    """The shingle set by a scheme: w and a number of words, or c and a number of bytes."""
    k = int(scheme[1:])
    if scheme[0] not in "wc" or k < 1:
        raise ValueError("a scheme is w or c and a number")
    return word_grams(text, k, hashed) if scheme[0] == "w" else byte_grams(text, k, hashed)
