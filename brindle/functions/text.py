"""Text, JSON, date and rounding functions as columns; all run in the JVM.

Null in gives null out unless a docstring says otherwise. Lengths count code points where not stated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Java counts it; blocks counted as one token a character; types by extension and MIME type.
WHITE = r"[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{2EFF}\x{3000}-\x{30FF}\x{3130}-\x{318F}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
EXTENSIONS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "doc": "doc", "docx": "docx"}
MIMES = {
    "application/pdf": "pdf",
    "application/x-pdf": "pdf",
    "text/markdown": "markdown",
    "text/x-markdown": "markdown",
    "application/msword": "doc",
    "application/vnd.ms-word": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
}


def others(class_: str) -> str:
    """The complement of a character class."""
    return "[^" + class_[1:]


def round1(x: Column) -> Column:
    """One decimal, halves upwards (towards positive infinity)."""
    return F.floor(x.cast("double") * 10 + 0.5) / 10


def round_half_up(x: Column) -> Column:
    """To a whole number, halves upwards."""
    return F.floor(x.cast("double") + 0.5).cast("bigint")


def trim_control(x: Column) -> Column:
    """Without outer characters up to U+0020."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(x: Column) -> Column:
    """True for null and for white space alone."""
    return F.coalesce(F.regexp_replace(x, WHITE + "+", "") == "", F.lit(True))


def cleanup(x: Column) -> Column:
    """No byte order marks, no blanks before line ends, at most one empty line in a row, trimmed."""
    text = F.regexp_replace(x, r"\x{FEFF}", "")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return trim_control(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def prompt_cleanup(x: Column) -> Column:
    return trim_control(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def utf16_length(x: Column) -> Column:
    return F.length(x) + F.length(F.regexp_replace(x, r"[\x00-\x{FFFF}]+", ""))


def token_count(x: Column) -> Column:
    """An estimate: a token for 4 ASCII characters, 1 ideograph, kana or Hangul, or 2 others (UTF-16 units); null counts 0."""
    solid = F.regexp_replace(F.coalesce(x, F.lit("")), WHITE + "+", "")

    def counted(s: Column) -> Column:
        ascii_ = F.length(F.regexp_replace(s, r"[^\x00-\x7F]+", ""))
        return F.struct(ascii_.alias("ascii"), F.length(F.regexp_replace(s, others(CJK) + "+", "")).alias("cjk"), utf16_length(s).alias("all"))

    # lambdas, so that each expression is computed once
    total = lambda n: F.floor((n["ascii"] + 3) / 4) + n["cjk"] + F.floor((n["all"] - n["ascii"] - n["cjk"] + 1) / 2)
    counts = F.transform(F.transform(F.array(solid), counted), lambda n: F.when(n["all"] == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(total(n), F.lit(1).cast("bigint"))))
    return counts[0].cast("bigint")


def split_questions(x: Column) -> Column:
    """Parts between question marks, full stops, semicolons and line ends, each ending with a question mark; the whole text if
    there is no part."""
    parts = F.filter(F.transform(F.split(x, "[?？。；;\n]+"), trim_control), lambda p: p != "")
    asked = F.transform(parts, lambda p: F.when(p.rlike("[?？]$"), p).otherwise(F.concat(p, F.lit("？"))))
    return F.when(F.size(parts) > 0, asked).otherwise(F.array(x))


def map_term(x: Column, source: str, target: str) -> Column:
    """Replaces a term, but not where the target stands already (which matters if the target begins with the source)."""
    if not source:
        return x
    if target.startswith(source):
        return F.regexp_replace(x, f"{re.escape(target)}|{re.escape(source)}", target.replace("\\", "\\\\").replace("$", "\\$"))
    return F.replace(x, F.lit(source), F.lit(target))


def map_terms(x: Column, rules: list[dict]) -> Column:
    """Enabled exact rules in order: larger priority first (none before any), then longer source."""
    chosen = [r for r in rules if r.get("enabled", 1) == 1 and r.get("match_type", 1) in (None, 1) and r.get("source") and r.get("target")]
    chosen.sort(key=lambda r: (r.get("priority") is not None, -(r.get("priority") or 0), -len(r["source"])))
    for rule in chosen:
        x = map_term(x, rule["source"], rule["target"])
    return x


def normalize_name(x: Column) -> Column:
    """Lower case without ASCII punctuation and white space."""
    return F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]+|" + WHITE + "+", "")


def strip_fence(x: Column) -> Column:
    """Without a code fence around the text."""
    text = trim_control(x)
    return trim_control(F.regexp_replace(F.regexp_replace(text, r"^```[A-Za-z0-9_-]*[ \t]*\n?", ""), r"\n?```[ \t]*$", ""))


def json_span(x: Column) -> Column:
    """The widest {...} or [...] of a text, whichever begins first; null if there is none."""
    found = F.regexp_extract(x, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """{key} and {{key}} replaced; null values become empty."""
    text = F.lit(template)
    for key, value in values.items():
        for mark in ("{{" + key + "}}", "{" + key + "}"):
            text = F.replace(text, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return text


def extension(name: Column) -> Column:
    base = F.regexp_replace(trim_control(F.coalesce(name, F.lit(""))), r"^.*[/\\](?=.)", "")
    return F.lower(trim_control(F.regexp_extract(base, r"\.([^.]+)$", 1)))


def file_type(name: Column, mime: Column) -> Column:
    """By extension, then MIME type, then the extension or MIME type as it is; '' without either."""
    ext = extension(name)
    kind = F.trim(F.split_part(F.lower(trim_control(mime)), F.lit(";"), F.lit(1)))
    by_ext, by_mime = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        by_ext = F.when(ext == k, v).otherwise(by_ext)
    for k, v in MIMES.items():
        by_mime = F.when(kind == k, v).otherwise(by_mime)
    return F.coalesce(by_ext, by_mime, F.when(ext != "", ext), mime, F.lit(""))


def file_name(disposition: Column, url: Column) -> Column:
    """From a disposition header, else the last part of the path of a URL; null if neither names one."""
    given = F.regexp_replace(F.regexp_extract(disposition, r"(?i)filename\s*=\s*\"?([^\";]+)", 1), r"^\s+|\s+$", "")
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", ""), "/"), -1)
    return F.coalesce(F.when(given != "", F.url_decode(given)), F.when(last != "", F.url_decode(last)))


def rechunk(x: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` code points."""
    return F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def truncate(x: Column, most: int, note: str = "") -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(note))).otherwise(x)


def week_of_month(day: Column) -> Column:
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")


def window_hours(text: str | None, default: int = 24) -> int:
    """Hours of '24h' or '7d'; the default for anything else."""
    found = re.fullmatch(r"\s*(\d+)\s*([hHdD])\s*", text or "")
    hours = int(found[1]) * (24 if found[2] in "dD" else 1) if found else 0
    return hours or default


def granularity(text: str | None, hours: int) -> str:
    """As named, else by hour for windows of up to 48 hours and by day beyond."""
    name = (text or "").strip().lower()
    return name if name in ("hour", "day") else "hour" if hours <= 48 else "day"
