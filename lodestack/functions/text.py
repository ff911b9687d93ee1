"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which organisation a name denotes.
COMPANY_WORDS = ["company", "co", "corp", "corporation", "inc", "llc", "ltd", "limited", "the"]
# Parts of keys whose values are secret.
SECRET_KEYS = ["password", "token", "secret", "key", "api_key"]

HAN = r"[\x{4e00}-\x{9fff}]"


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits a hyphen, none at the ends; ``default`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "default").otherwise(s)


def semantic_key(c: Column) -> Column:
    """The distinct meaning words of a name, ascending; names of other scripts have none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " ")), " +")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(COMPANY_WORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two key arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def language_by_share(c: Column) -> Column:
    """zh if more than 30 % of all characters are Han, else en."""
    return F.when(F.regexp_count(c, F.lit(HAN)) > 0.3 * F.length(c), "zh").otherwise("en")


def language_by_evidence(c: Column) -> Column:
    """zh from 4 Han characters, en from 3 Latin words with 12 letters, else null; formulas and tags do not count."""
    t = F.regexp_replace(F.regexp_replace(c, r"\$[^$]*\$", " "), "<[^>]*>", " ")
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return F.when(F.regexp_count(t, F.lit(HAN)) >= 4, "zh").when((F.regexp_count(t, F.lit("[A-Za-z]+")) >= 3) & (letters >= 12), "en")


def html_text(c: Column) -> Column:
    """Visible text: no script, style and noscript blocks, no comments and tags, white space collapsed."""
    t = c
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", " "), "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


#: Whole lines that go with their break: numbers of pages between dashes, standard numbers with their year, and single letters
#: of formulas; and lines with an address. Written for a whole text, so that lines need not be looked at one by one.
PLAIN_NOISE = r"[ —–-]*[0-9]{1,4}[ —–-]*|[A-Z/ ]{1,10}[0-9.]+ ?[—–-] ?(?:19|20)[0-9]{2} *| *[Ttpση=] *"
LINKED_NOISE = r".*(?i:https?:|www[.]).*"
NOISE_LINE = f"(?:{PLAIN_NOISE}|{LINKED_NOISE})"
# What goes from within a line, brackets around nothing and page numbers between dashes.
INLINE = [r"\[\s*\]", r"[—-]\s*\d{1,4}\s*[—-]"]
#: The same on a text of many lines, in which white space does not reach over a line's end.
NOISE_WITHIN = "|".join(INLINE).replace(r"\s", r"[^\S\n]")


def clean_lines(text: Column) -> Column:
    """Noise lines and noise within lines dropped, runs of spaces one space, three or more line breaks two, none at the ends.

    Only texts that hold an address at all are searched for lines with one, as that search tries every place.
    """
    low = F.lower(text)
    linked = F.contains(low, F.lit("http")) | F.contains(low, F.lit("www."))
    lines = F.when(linked, F.regexp_replace(text, f"(?md)^{NOISE_LINE}$\\n?", "")).otherwise(F.regexp_replace(text, f"(?md)^(?:{PLAIN_NOISE})$\\n?", ""))
    kept = F.regexp_replace(lines, NOISE_WITHIN, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, " {2,}", " "), "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def masked(c: Column) -> Column:
    """Empty stays empty, up to 8 characters become ***, longer ones keep 4 at each end."""
    return F.when(c == "", "").when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("***"), F.right(c, F.lit(4))))


def is_secret_key(key: Column) -> Column:
    """Any key that contains one of the secret words; so does monkey."""
    return F.exists(F.array(*[F.lit(k) for k in SECRET_KEYS]), lambda k: F.contains(F.lower(key), k))


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the trimmed parts, joined by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), 256)


def prefixed_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each behind its length."""
    each = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return F.sha2(F.concat(*each), 256)


def fixed_chunks(text: Column, size: int) -> Column:
    """Trimmed pieces of ``size`` characters; blank ones are left out."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i, F.lit(size)))), lambda c: c != "")


def overlapping_chunks(text: Column, size: int, overlap: int) -> Column:
    """The whole text if it fits, else windows every ``size - overlap`` characters; the last may lie within the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
