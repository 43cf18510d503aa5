"""Text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the page-text normaliser drops (vowel and reading marks, stretching), and what it keeps.
DIACRITICS = "".join(map(chr, [*range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE), 0x640]))
HARAKAT = "".join(map(chr, [*range(0x64B, 0x653), 0x640]))
NOT_KEPT = r"[^0-9\u0600-\u06FFa-zA-Z\-/._:]+"
ALEF_FORMS, ALEF_PLAIN = "\u0625\u0623\u0622\u0649\u0629", "\u0627\u0627\u0627\u064A\u0647"
EASTERN_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
#: White space as Python has it (Java's \s is ASCII only).
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLANK = f"[{BLANKS}]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(as_col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(as_col(c), f"{BLANK}+", " "))


def _rare_folds() -> tuple[dict[str, str], dict[str, str]]:
    """What lower case leaves to be folded, but for sharp s and final sigma: (one letter to one, one to several)."""
    rest = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() != c.casefold() or c.lower().casefold() != c.lower()}
    rest = {low: f for c, f in rest.items() for low in (c, c.lower()) if len(low) == 1 and low.casefold() != low and low not in "ßς"}
    return {c: f for c, f in rest.items() if len(f) == 1}, {c: f for c, f in rest.items() if len(f) > 1}


_one, _many = _rare_folds()


def _class(letters: str) -> str:
    """A character class of ranges; Java tries the parts of a class one by one."""
    points = set(map(ord, letters))
    first = sorted(p for p in points if p - 1 not in points)
    last = sorted(p for p in points if p + 1 not in points)
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(first, last)) + "]"


#: Where a rare letter may be: whatever is no plain Latin letter, with or without common accents. Other text passes fast.
_BEYOND = "[^" + _class("".join(chr(p) for p in range(min(ord(c) for c in [*_one, *_many] if ord(c) > 0xFF)) if chr(p) not in _one))[1:]
_SEVERAL = _class("".join(_many))


def fold(c: Column | str) -> Column:
    """Full case folding: lower case, and what Unicode folds beyond it (sharp s, final sigma, ligatures, Greek, Armenian, Cherokee)."""
    low = F.replace(F.replace(F.lower(as_col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    ones = F.translate(low, "".join(_one), "".join(_one.values()))
    table = F.create_map(*[F.lit(x) for pair in _many.items() for x in pair])
    several = F.array_join(F.transform(F.split(ones, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    plain = (F.length(low) == F.octet_length(low)) | ~F.rlike(low, F.lit(_BEYOND))  # ASCII, or nearly
    return F.when(plain, low).when(F.rlike(ones, F.lit(_SEVERAL)), several).otherwise(ones)


def fold_text(s: str) -> str:
    return s.casefold()


def normalize_arabic(c: Column | str) -> Column:
    """Search form of page text; null becomes ''."""
    # marks are deleted, letters and digits replaced, in one pass; runs of blanks and of what isn't kept are one space
    s = F.translate(F.coalesce(as_col(c).cast("string"), F.lit("")), ALEF_FORMS + EASTERN_DIGITS + DIACRITICS, ALEF_PLAIN + WESTERN_DIGITS)
    return F.trim(F.regexp_replace(fold(s), NOT_KEPT, " "))


def undiacritize(c: Column | str) -> Column:
    """Without short vowels and stretching marks, white space squeezed."""
    return squeeze(F.translate(F.coalesce(as_col(c), F.lit("")), HARAKAT, ""))


def strip_leading_number(c: Column | str) -> Column:
    """`12. Topic` and `3 - Topic` without their number."""
    return strip(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"^\s*\d{1,3}\s*[.\-]\s*", ""))


def safe_filename_part(c: Column | str, fallback: str = "export") -> Column:
    """Word characters, Arabic, hyphens and underscores for spaces; at most 80; fallback if nothing is left."""
    s = F.regexp_replace(strip(F.coalesce(as_col(c), F.lit(""))), r"[^\p{L}\p{N}_\u0600-\u06FF\s\-]+", "")
    s = F.regexp_replace(F.regexp_replace(s, f"{BLANK}+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 80), F.lit("")), F.lit(fallback))


def sanitize_filename(c: Column | str) -> Column:
    """Characters that file systems reserve as _, white space squeezed, no dots or spaces at the end."""
    s = F.regexp_replace(strip(F.coalesce(as_col(c), F.lit(""))), r'[<>:"/\\|?*\x00-\x1F]+', "_")
    return F.regexp_replace(squeeze(s), r"[. ]+$", "")


def split_list(c: Column | str) -> Column:
    """A delimited string as a list of trimmed items; only the first delimiter present, in this order, counts."""
    s = as_col(c)
    parts = None
    for mark in reversed([";", ",", "|", "،", "\n", "\t"]):
        cut = F.split(s, "\\Q" + mark + "\\E")
        parts = F.when(F.contains(s, F.lit(mark)), cut).otherwise(F.array(s) if parts is None else parts)
    return F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(parts, strip), lambda x: x != ""))


def clean_items(c: Column | str) -> Column:
    """A list of strings trimmed, without nulls and blanks; null becomes an empty list."""
    return F.coalesce(F.filter(F.transform(as_col(c), strip), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def page_number(c: Column | str) -> Column:
    """The page as an integer where it reads as one, else null; keep the raw text beside it."""
    return strip(as_col(c).cast("string")).try_cast("int")


def page_order(c: Column | str) -> Column:
    """Sort key that puts numeric pages first, by number, then the rest by text."""
    n = page_number(c)
    return F.struct(n.isNull().alias("other"), F.coalesce(n, F.lit(0)).alias("number"), F.when(n.isNull(), F.coalesce(as_col(c).cast("string"), F.lit(""))).otherwise("").alias("text"))


def lenient_timestamp(c: Column | str) -> Column:
    """ISO date or date-time (a zone-less one is UTC), else the first ten characters as a date, else null."""
    s = strip(c)
    head = F.substring(s, 1, 10)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), s.try_cast("timestamp"))
    return F.coalesce(iso, F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("timestamp")))


def relative_path(path: Column | str, filename: Column | str) -> Column:
    """The path, or the file name where there is none, with / and without leading /."""
    chosen = F.coalesce(F.nullif(strip(path), F.lit("")), F.nullif(strip(filename), F.lit("")), F.lit(""))
    return F.regexp_replace(F.translate(chosen, "\\", "/"), "^/+", "")


def digest(c: Column | str) -> Column:
    return F.sha2(as_col(c), 256)


def join_broken_lines(c: Column | str) -> Column:
    """Lines merged with the one before unless that ends a sentence (`.` or `:`); `=== Page` lines stand alone.

    State of the fold: the finished text, the line being built, and what came before it.
    """
    lines = F.split(as_col(c), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("before"))

    def step(state: Column, line: Column) -> Column:
        page = F.startswith(line, F.lit("=== Page"))
        before, done = state["before"], state["done"]
        last = F.try_element_at(done, F.lit(-1))
        ends = F.regexp_like(before, F.lit(r"[.:]\s*$"))
        blank_after_page = F.startswith(before, F.lit("=== Page")) & (F.trim(line) == "")
        opens = before.isNull() | page | F.startswith(before, F.lit("=== Page")) | ends | F.coalesce(last == "", F.lit(True))
        glued = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.regexp_replace(last, r"\s+$", ""), F.lit(" "), F.regexp_replace(line, r"^\s+", ""))))
        alone = F.concat(done, F.when(blank_after_page, F.array(F.lit(""), line)).otherwise(F.array(line)))
        return F.struct(F.when(opens, alone).otherwise(glued).alias("done"), line.alias("before"))

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["done"]), "\n")
