"""Text functions on columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.dims import DIGIT_ZEROS

#: White space as ECMAScript has it: Java's own class lacks the no-break space and the byte-order mark.
WHITE = r"[\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
ZERO_WIDTH = r"[\u200B\u200C\u200D\uFEFF]"
# What counts as a marker, as attributes behind a bar, and as a number or reference.
ANY_MARKER = r"(?i)\\[a-z0-9]+\*?"
NAMED_MARKER = r"\\[A-Za-z][A-Za-z0-9]*\*?"
ATTRIBUTES = r"\|[^\\]+(?=\\|$)"
NUMBER = r"[0-9]+/[0-9]+|[0-9]+(?::[0-9]+)?(?:-[0-9]+(?::[0-9]+)?)?"


#: Only texts with one of these characters can differ from their NFC: all below U+0300, CJK ideographs,
#: kana without sound marks and Hangul syllables stand as they are.
MAY_CHANGE = r"[\u0300-\u33FF\uA000-\uABFF\uD7B0-\uD7FF\uF900-\uFFFF\x{10000}-\x{10FFFF}]"


def nfc(c: Column) -> Column:
    """Unicode NFC by the library that Spark's own collations use; only texts that may change are handed to it.

    Spark takes a call by reflection for nondeterministic: it may stand in a projection or filter, not
    inside an aggregate function or a join's condition (project it first).
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(MAY_CHANGE), composed).otherwise(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    return trim(F.coalesce(c, F.lit(""))) == ""


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), f"{WHITE}+", " "))


def normalize(c: Column) -> Column:
    """NFC, no zero-width characters, single spaces, trimmed."""
    return collapse(nfc(F.coalesce(c, F.lit(""))))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize(c), 256)


def unescape_xml(c: Column) -> Column:
    """The five entities; the ampersand before the quotes, so these may be decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_xml(c: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def strip_markers(c: Column) -> Column:
    """Visible text: markers become spaces; attributes from a bar to the end go with them."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), ANY_MARKER, " ")
    return normalize(F.regexp_replace(bare, ATTRIBUTES, " "))


def strip_notes(c: Column) -> Column:
    """Visible text without footnotes (f) and cross-references (x): first the closed ones of each, then to the end."""
    c = F.coalesce(c, F.lit(""))
    for end in ("\\\\{0}\\*", "$"):
        for marker in "fx":
            c = F.regexp_replace(c, rf"(?i)\\{marker}(?=\s)[\s\S]*?" + end.format(marker), " ")
    return strip_markers(c)


def ascii_digits(c: Column) -> Column:
    native = "".join(chr(zero + d) for zero in DIGIT_ZEROS for d in range(10))
    return F.translate(c, native, "0123456789" * len(DIGIT_ZEROS))


def numeric_form(c: Column) -> Column:
    """Native digits to ASCII, dashes to hyphens, no space around separators."""
    dashes = F.regexp_replace(ascii_digits(F.coalesce(c, F.lit(""))), "[\u2010\u2011\u2012\u2013\u2014\u2212]", "-")
    return F.regexp_replace(dashes, f"{WHITE}*([:/\\-]){WHITE}*", "$1")


def numbers(c: Column) -> Column:
    """Fractions, chapter-and-verse references and plain numbers, in order."""
    return F.regexp_extract_all(numeric_form(c), F.lit(NUMBER), F.lit(0))


def marker_sequence(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NAMED_MARKER), F.lit(0))
    return F.transform(found, lambda m: F.lower(F.substring(m, 2, 1_000)))


def marker_starts(c: Column, marker: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(rf"\\{marker}(?={WHITE}|\+|$)"), F.lit(0)))


def marker_ends(c: Column, marker: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(rf"\\{marker}\*"), F.lit(0)))


def code_points(c: Column, characters: str) -> Column:
    """U+XXXX of every character of the class, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(characters), F.lit(0)), lambda x: F.concat(F.lit("U+"), F.hex(F.ascii(x))))


def words(c: Column) -> Column:
    """Runs of letters and marks, case kept, after NFC and without markers."""
    bare = F.regexp_replace(nfc(c), r"\\[A-Za-z0-9]+\*?", " ")
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def whole_number(c: Column) -> Column:
    return F.when(c.rlike("^-?[0-9]+$"), c.try_cast("int"))


def new_id(prefix: str) -> Column:
    """A fresh identifier for every row."""
    return F.concat(F.lit(f"{prefix}_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def iso_now() -> Column:
    """The query's start as an ISO 8601 time in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def clean_cell(c: Column) -> Column:
    """Table cell: NFC, spaces collapsed, line feeds kept, NA and N/A empty."""
    s = F.regexp_replace(F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), ZERO_WIDTH, ""), r"[ \r]+", " ")
    s = trim(F.regexp_replace(s, r" *\n *", "\n"))
    return F.when(s.rlike("(?i)^(NA|N/A)$"), F.lit("")).otherwise(s)
