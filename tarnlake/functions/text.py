"""Text columns: names, titles, tokens, context strings (TX-15 to TX-24, TX-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def blank_to_null(x: Column) -> Column:
    """NULL, empty and blanks all mean: none."""
    return F.when(F.trim(x) != "", x)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """:func:`tokens` as one string, with a space between them and perhaps one at each end."""
    return F.regexp_replace(F.lower(text), TOKEN.replace("[", "[^", 1), " ")


def stable_filename(identifier: Column, title: Column, suffix: str = ".md", longest: int = 120) -> Column:
    """TX-16: cleaned identifier (40 characters at most), sixteen hex digits of the identifier's hash, and the cleaned title in what is left."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    longest = max(longest, 40)
    fixed = 16 + 4 + len(suffix)
    name = F.coalesce(F.nullif(F.substring(clean(identifier), 1, min(40, longest - fixed - len("untitled"))), F.lit("")), F.lit("document"))
    room = F.greatest(F.lit(longest - fixed) - F.length(name), F.lit(0))
    told = F.coalesce(F.nullif(F.substr(clean(title), F.lit(1), room), F.lit("")), F.lit("untitled"))
    return F.concat(name, F.lit("__"), F.substring(F.sha2(F.coalesce(identifier.cast("string"), F.lit("")), 256), 1, 16), F.lit("__"), told, F.lit(suffix))


def document_filename(identifier: Column) -> Column:
    """TX-17."""
    return F.concat(F.lit("enterprise__"), F.regexp_replace(identifier, r"[^A-Za-z0-9._-]+", "_"), F.lit(".md"))


def fts_query(question: Column) -> Column:
    """TX-18: all distinct tokens in order of first use, in their own case, quoted and joined by OR; the original takes the first 64."""
    words = F.array_distinct(F.regexp_extract_all(question, F.lit(TOKEN), F.lit(0)))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def chunk_prefix(chunk_id: Column) -> Column:
    """TX-20: what stands before the running number of a leaf id, empty if it is no leaf id."""
    return F.regexp_extract(chunk_id, r"^(.+::p\d+::l3::)\d+$", 1)


def chunk_number(chunk_id: Column) -> Column:
    return F.regexp_extract(chunk_id, r"^.+::p\d+::l3::(\d+)$", 1).try_cast("int")


def without_run_prefix(filename: Column) -> Column:
    """TX-21: the stored document's own name at the end of a run's file name; other names stay."""
    own = F.regexp_extract(F.coalesce(filename, F.lit("")), r"(enterprise__dsid_[0-9a-f]+\.md)$", 1)
    return F.when(own != "", own).otherwise(F.coalesce(filename, F.lit("")))


#: SRC-04, fixed values.
FILE_TYPES = {"PDF": (".pdf",), "Word": (".docx",), "PowerPoint": (".pptx",), "Excel": (".xlsx",), "Image": (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif"), "HTML": (".html", ".htm"), "Markdown": (".md",), "Text": (".txt",)}


def file_type(filename: Column) -> Column:
    """SRC-04: type by suffix."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    out = F.lit("Unsupported")
    for kind, endings in FILE_TYPES.items():
        for ending in endings:
            out = F.when(F.endswith(name, F.lit(ending)), kind).otherwise(out)
    return out


def needs_converter(filename: Column) -> Column:
    """SRC-04: types that hold no text of their own."""
    return file_type(filename).isin("PDF", "Word", "PowerPoint", "Excel", "Image")


def valid_upload_name(name: Column) -> Column:
    """TX-22: a plain file name of a supported type: no path, quote or control characters."""
    ok = (F.trim(name) != "") & ~name.rlike(r"[/\\\x00-\x1f\x7f'\"]") & ~name.isin(".", "..") & (file_type(name) != "Unsupported")
    return F.coalesce(ok, F.lit(False))


#: White space as Unicode has it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def session_title(text: Column, longest: int = 16, default: str = "新会话") -> Column:
    """TX-23: words with one blank between them, closing punctuation off either end, cut, never empty."""
    flat = F.btrim(F.regexp_replace(text, f"{SPACE}+", " "), F.lit(" 。！？!?，,；;：:"))
    return F.coalesce(F.nullif(F.substring(flat, 1, longest), F.lit("")), F.lit(default))


def context_entry(position: Column, filename: Column, page: Column, text: Column) -> Column:
    """TX-24: ``[i] file (Page p):`` and the text below."""
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), F.coalesce(blank_to_null(filename), F.lit("Unknown")), F.lit(" (Page "), F.coalesce(page.cast("string"), F.lit("N/A")), F.lit("):\n"), F.coalesce(text, F.lit("")))


CONTEXT_JOINT = "\n\n---\n\n"


# TX-26: fixed values. Quantities, units that count as one, and what a translation must keep letter by letter. A run of digits,
# points and commas is taken whole and cut afterwards, as Java's patterns go down a level with each repetition of a group. As in
# the twin, a Latin unit ends where a word of ASCII letters, digits and underscores begins or ends, the character before a quantity belongs to no other,
# and where case doesn't count the long s is an s and the Kelvin sign a k.
BLANKS = r"[\t\n\f\r ]"
RUN = r"(?=[0-9])(?<![A-Za-z0-9%s])(?:\A|(?!\G))([0-9][0-9.,]*+)"
S, K = "[s\u017f]", "[k\u212a]"
UNIT_END = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TIME_UNITS = {
    "millisecond": ("millisecond", "milliseconds", "ms", "毫秒"),
    "second": ("second", "seconds", "sec", "secs", "秒"),
    "minute": ("minute", "minutes", "min", "mins", "分钟", "分"),
    "hour": ("hour", "hours", "hr", "hrs", "h", "小时"),
    "day": ("day", "days", "d", "天"),
}
TIME = rf"(?:(?<=[0-9]){BLANKS}*(?:(?:milli{S}econd{S}?|m{S}|{S}econd{S}?|{S}ec{S}?|minute{S}?|min{S}?|hour{S}?|hr{S}?|h|day{S}?|d){UNIT_END}|毫秒|秒|分钟|分|小时|天))?"
TECHNICAL = rf"(?:(?<=[0-9]){BLANKS}*(?:(?:{K}iB|MiB|GiB|{K}B|MB|GB|m{S}|u{S}){UNIT_END}|[μΜµ]{S}|%))?"
LITERAL = r"`[^`\n]+`|https?://[^\t\n\f\r )]+"
CLOSING = ".,;:!?，。！？；："


def _quantities(text: Column, unit: str) -> Column:
    """Quantities with a unit; of a run that holds several numbers the last has it."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){RUN[:-1]}{unit})".replace("%s", "\u017f\u212a", 1)), F.lit(1))
    return F.transform(F.filter(found, lambda x: x.rlike("[^0-9.,]$")), lambda x: F.regexp_replace(x, r"^[0-9.,]*[.,]{2}(?=[0-9])", ""))


def time_tokens(text: Column) -> Column:
    """TX-26: times as ``<value><unit>``, a unit's names being one."""
    found = _quantities(text, TIME)

    def told(x: Column) -> Column:
        value, unit = F.regexp_extract(x, r"^([0-9.,]*[0-9])", 1), F.lower(F.regexp_extract(x, rf"^[0-9.,]*[0-9]{BLANKS}*(.*)$", 1))
        out = unit
        for name, aliases in TIME_UNITS.items():
            out = F.when(unit.isin(*aliases), name).otherwise(out)
        return F.concat(F.lit("time:"), value, out)

    return F.transform(found, told)


def number_tokens(text: Column) -> Column:
    """TX-26."""
    runs = F.regexp_extract_all(text, F.lit(RUN % ""), F.lit(1))
    numbers = F.flatten(F.transform(runs, lambda x: F.split(F.rtrim(x, F.lit(".,")), r"[.,]{2,}")))
    return F.transform(numbers, lambda x: F.concat(F.lit("number:"), x))


def literal_tokens(text: Column) -> Column:
    """TX-26: code and addresses as they stand, technical units without blanks in lower case."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)), lambda x: F.when(x.startswith("http"), F.rtrim(x, F.lit(CLOSING))).otherwise(x))
    units = F.transform(_quantities(text, TECHNICAL), lambda x: F.lower(F.regexp_replace(x, BLANKS, "")))
    return F.transform(F.concat(whole, units), lambda x: F.concat(F.lit("literal:"), x))


def fact_tokens(text: Column) -> Column:
    """TX-26: everything that a translation must hold as often as its source."""
    x = F.coalesce(text, F.lit(""))
    return F.concat(time_tokens(x), number_tokens(x), literal_tokens(x))
