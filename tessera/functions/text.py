"""Text functions as Spark columns: casing, folding, tokens, cleaning.

White space is what Python's str.split takes for it: Unicode white space and
U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed
from tessera.params import DEFAULTS, Params

WS = r"[\s\x1c-\x1f]"
U = "(?U)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tr_lower(c: Column) -> Column:
    """Lower case by Turkish rules."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "ıi", "Iİ"))


def fold_diacritics(c: Column) -> Column:
    """A lossy ASCII key for matching; never shown."""
    return F.translate(c, fixed.FOLD_FROM, fixed.FOLD_TO)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{U}\A{WS}+|{WS}+\z", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{U}{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokenize(c: Column) -> Column:
    """Folded lower-case runs of letters and digits, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(fold_diacritics(c)), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*sorted(fixed.STOP_WORDS)))


def folded_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(fold_diacritics(c)), F.lit("[a-z0-9]+"), 0)


def estimate_tokens(c: Column, params: Params = DEFAULTS) -> Column:
    return F.floor(word_count(c) * F.lit(params.tokens_per_word)).cast("int")


def count_tokens(c: Column, params: Params = DEFAULTS) -> Column:
    """Estimated tokens, rounded up: what a prompt is budgeted with."""
    return (F.floor(word_count(c) * F.lit(params.measured_tokens_per_word)) + 1).cast("int")


def fix_hyphenation(c: Column) -> Column:
    """Rejoins words split over a line break; a capital or a blank line keeps the hyphen."""
    return F.regexp_replace(c, r"(?<=\p{L})-[ \t\r]*\n[ \t\r]*(?=[\p{Ll}\p{Lo}\p{Lm}])", "")


def nfc(c: Column) -> Column:
    """Unicode composition; Spark has no function for it."""

    def run(column):
        import unicodedata

        import pyarrow as pa

        return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(c)


def ascii_only(c: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII then."""

    def run(column):
        import unicodedata

        import pyarrow as pa

        return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(c)


def tidy_lines(c: Column) -> Column:
    """Line ends, blanks at line ends and runs of blank lines; the part of normalisation that needs no composition."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    c = fix_hyphenation(c)
    c = F.regexp_replace(c, rf"{U}[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(c)


def normalize_text(c: Column) -> Column:
    return tidy_lines(nfc(c))


def looks_like_page_number(line: Column) -> Column:
    core = F.regexp_replace(strip(line), r"\A[-–—.\[\]() ]+|[-–—.\[\]() ]+\z", "")
    plain = core.rlike(rf"{U}\A\d+\z")
    page = tr_lower(core).rlike(rf"{U}(?s)\Asayfa.*\d")
    ratio = core.rlike(rf"{U}\A{WS}*\d+{WS}*/{WS}*\d+{WS}*\z")
    return (core != "") & (F.length(core) <= 12) & (plain | page | ratio)


def longest_run(c: Column) -> Column:
    """Length of the longest run without white space."""
    return F.coalesce(F.array_max(F.transform(F.split(c, f"{U}{WS}+"), F.length)), F.lit(0))


def occurrences(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strip_thinking(c: Column) -> Column:
    """Drops reasoning blocks; of an unclosed one, keeps the answer after an empty block or else what stood before."""
    closed = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")

    def judged(t: Column) -> Column:
        at = F.locate("<think>", t)
        before, after = F.substring(t, F.lit(1), at - 1), F.substring(t, at + 7, F.length(t))
        gap = rf"{U}\A{WS}*\n{WS}*\n"
        return F.when(at == 0, strip(t)).when((strip(before) == "") & after.rlike(gap), strip(F.regexp_replace(after, gap, ""))).otherwise(strip(before))

    return let(closed, judged)


def strip_leading_heading(c: Column) -> Column:
    """Drops a first line that is only a heading, if text follows."""

    def judged(t: Column) -> Column:
        first = strip(F.substring_index(t, "\n", 1))
        rest = F.substring(t, F.locate("\n", t) + 1, F.length(t))
        marked = first.startswith("#") | (first.startswith("**") & first.endswith("**") & (F.length(first) > 4))
        empty = first.rlike(fixed.HEADING_LINE) & ~F.contains(first, F.lit(fixed.LABEL_WORD))
        return F.when(F.contains(t, F.lit("\n")) & marked & empty, strip(rest)).otherwise(strip(t))

    return let(c, judged)


def slugify(c: Column, most: int = 100) -> Column:
    """ASCII letters and digits, hyphens between; its first ``most`` characters.  A text is read in parts, and only as far as they go."""

    def run(column):
        import re
        import unicodedata

        import pyarrow as pa

        other, gap, space = re.compile(r"[^A-Za-z0-9_ \t\n\x0b\x0c\r-]"), re.compile(r"[- \t\n\x0b\x0c\r]+"), " \t\n\x0b\x0c\r"
        part = 4 * most

        def slug(text: str) -> str:
            out = ""
            for at in range(0, len(text), part):
                # A decomposition only reorders marks, which aren't ASCII, so that parts can be decomposed alone.
                piece = other.sub("", unicodedata.normalize("NFKD", text[at : at + part]).encode("ascii", "ignore").decode())
                out = gap.sub("-", (out + piece) if out else piece.lstrip(space))
                if len(out) > most:
                    return out[:most].lower().strip("-")
            return gap.sub("-", out.rstrip(space)).lower()[:most].strip("-")

        return pa.array((None if not t.is_valid else slug(t.as_py()) for t in column), pa.string())

    return F.coalesce(F.nullif(F.arrow_udf(run, "string")(c), F.lit("")), F.lit("belge"))


def category_slug(href: Column, categories: tuple[str, ...]) -> Column:
    """The last part of a link's path if it is one of the categories; null otherwise."""
    last = F.element_at(F.split(F.regexp_replace(href, "/+$", ""), "/"), -1)
    return F.when(last.isin(*categories), last)


def classify_version(label: Column) -> Column:
    """Kind of a version label: son_versiyon, degisiklik, eski_versiyon or diger."""
    low = F.lower(F.regexp_replace(fold_diacritics(label), r"[^\x00-\x7f]", ""))
    newest = F.contains(low, F.lit("son")) & (F.contains(low, F.lit("versiyon")) | F.contains(low, F.lit("hali")))
    return F.when(newest, "son_versiyon").when(F.contains(low, F.lit("degisiklik")), "degisiklik").when(F.contains(low, F.lit("eski")), "eski_versiyon").otherwise("diger")


def parse_dotted_date(c: Column) -> Column:
    """dd.mm.yyyy at the start as ISO text; null otherwise."""
    pattern = r"\A(\d{1,2})\.(\d{1,2})\.(\d{4})"
    t = strip(c)
    day, month, year = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    return F.when(t.rlike(pattern), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def stem(token: Column) -> Column:
    """Strips at most two suffixes and leaves four characters at least (for evaluation only)."""
    pattern = "^(.{4,}?)(?:" + "|".join(fixed.SUFFIXES) + ")$"

    def once(t: Column) -> Column:
        # The first suffix of the list that fits, not the longest.
        fits = [F.when(t.endswith(s) & (F.length(t) >= len(s) + 4), F.substring(t, F.lit(1), F.length(t) - len(s))) for s in fixed.SUFFIXES]
        return F.when(t.rlike(pattern), F.coalesce(*fits, t)).otherwise(t)

    return let(let(token, once), once)


def stem_word(token: str) -> str:
    """What ``stem`` gives, for one token in Python."""
    for _ in range(2):
        token = next((token[: -len(s)] for s in fixed.SUFFIXES if token.endswith(s) and len(token) >= len(s) + 4), token)
    return token


APART = "".join(map(chr, range(0xFDD0, 0xFDF0)))  # code points that never stand for a character


def guard(c: Column, chars: str) -> Column:
    """The text with each of these characters (32 at most) as one that no rule knows; ``unguard`` turns it back."""
    return F.translate(c, chars, APART[: len(chars)])


def unguard(c: Column, chars: str) -> Column:
    return F.translate(c, APART[: len(chars)], chars)


def strip_labels(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, fixed.LABEL_MENTION, ""), rf"{U}{WS}{{2,}}", " "))


def clean_rewrite(c: Column) -> Column:
    """The first line with text, without a leading name and quotes."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    first = strip(F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), fixed.LEADING_NAME, ""))
    return strip(F.regexp_replace(first, "\\A[\"'“”‘’ ]+|[\"'“”‘’ ]+\\z", ""))
