"""Text normalisation, parsing and extraction as column expressions.

Everything here is JVM-side but ``unescape_html`` and the table parser, which
need an HTML parser and run as Arrow-batched pandas UDFs. White space is the
Unicode class, as (?U)\\s.
"""

from __future__ import annotations

import html
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[a-z0-9]+(?:[-'][a-z0-9]+)?"
SPACE = r"(?U)\s"

# Words that text recognition joins, and their spelling.
JOINED_WORDS = {
    "crosssectional": "cross-sectional",
    "firstline": "first-line",
    "secondline": "second-line",
    "highrisk": "high-risk",
    "lowrisk": "low-risk",
    "videoassisted": "video-assisted",
    "singlestage": "single-stage",
    "gallstonerelated": "gallstone-related",
}
# Words that open a question in a table cell.
QUESTION_WORDS = ("Which", "Are", "Is", "How", "When", "Should", "Can", "What")


def tokenize(text: Column) -> Column:
    """Lower-cased words and numbers, with one inner hyphen or apostrophe: array<string>."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """A stand-in for a model's token count: the number of tokens."""
    return F.size(tokenize(F.coalesce(text, F.lit(""))))


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _unescaped(text: Column) -> Column:
    """unescape_html, which only texts with an ampersand need: the others do not pass through Python."""
    return F.coalesce(unescape_html(F.when(F.contains(text, F.lit("&")), text)), text)


def clean_text(text: Column, unescape: bool = True) -> Column:
    """Repairs recognised text: entities, line breaks, hyphenated breaks, space around punctuation, joined words. The order matters."""
    c = F.coalesce(text, F.lit(""))
    if unescape:
        c = _unescaped(c)
    c = F.translate(c, "\r\n", "  ")
    c = F.regexp_replace(c, r"(?U)(?<=[A-Za-z])-\s+(?=[a-z])", "")
    c = F.regexp_replace(c, r"(?U)\s+([,.;:)\]])", "$1")
    c = F.regexp_replace(c, r"(?U)([(\[])\s+", "$1")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    for joined, fixed in JOINED_WORDS.items():
        c = F.replace(c, F.lit(joined), F.lit(fixed))
    return F.trim(c)


def normalize_topic(text: Column, unescape: bool = True) -> Column:
    """Cleaned text without a leading number and full stop."""
    return F.trim(F.regexp_replace(clean_text(text, unescape), r"(?U)^\d+\.\s*", ""))


def split_numbered(text: Column, unescape: bool = True) -> Column:
    """Items of the cleaned text that begin with a number, a full stop and a capital; text before the first is dropped; without any, the whole text."""
    text = clean_text(text, unescape)
    parts = F.transform(F.split(text, r"(?:^|\s)(?=\d+\.\s+[A-Z])"), lambda x: F.trim(x))
    items = F.filter(parts, lambda x: x.rlike(r"^\d+\.\s+[A-Z]"))
    return F.when(F.size(items) > 0, items).when(F.trim(text) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))


def split_questions(text: Column, unescape: bool = True) -> Column:
    """Parts that begin at a question word, cleaned, that end with a question mark. Entities are repaired in the whole text before it is split."""
    text = _unescaped(F.coalesce(text, F.lit(""))) if unescape else text
    parts = F.split(text, rf"(?=(?:{'|'.join(QUESTION_WORDS)})\b)")
    return F.filter(F.transform(parts, lambda x: clean_text(x, unescape=False)), lambda x: x.endswith("?"))


def dedupe(values: Column) -> Column:
    """Cleaned, non-blank values at their first occurrence. Entities stay: no Python function runs inside an array, so unescape before."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: clean_text(x, unescape=False)), lambda x: x != ""))


def json_object(text: Column) -> Column:
    """The JSON object in a model's reply, fenced or not, as a string; null where there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def tagged(text: Column, tag: str) -> Column:
    """The contents of every <tag>…</tag>."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def tagged_lines(text: Column, tag: str) -> Column:
    """The non-empty lines of every <tag>…</tag>."""
    lines = F.flatten(F.transform(tagged(text, tag), lambda x: F.split(x, "\n")))
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def option(text: Column, options: Sequence[str], tag: str = "option") -> Column:
    """The trimmed content of the first <tag>, null unless it is one of the options."""
    found = F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))
    return F.when(found.isin(list(options)), found)


def pico_line(text: Column, letter: str) -> Column:
    """The values of lines like ``P - adults``."""
    got = F.regexp_extract_all(text, F.lit(rf"(?m)^{letter}\s*[–-]?\s*(.*)$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x != ""))


def render_pico(letter: str, values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit(f"{letter} - "), x)), "\n")


def normalize_spaces(text: Column) -> Column:
    """Lower-cased, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def has_cjk(text: Column) -> Column:
    """Whether a character from U+3400 to U+9FFF occurs."""
    return text.rlike("[㐀-鿿]")


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s*\n\s*", "\n")


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` characters with a marker; 0 or less leaves text alone."""
    if most <= 0:
        return text
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+\z", ""), F.lit("...[truncated]"))).otherwise(text)


def match_name(text: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, collapsed: for comparing names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[_-]", " "), r"\s+", " "))


# --- cleaning bricks, by name -------------------------------------------------------------------------------------

BULLETS = "•‣⁃◦●○■□▪–*"


def _unicode_quotes(c: Column) -> Column:
    return F.translate(c, "‘’‚‛“”„‟", "''''\"\"\"\"")


BRICKS = {
    "clean_extra_whitespace": lambda c: F.trim(F.regexp_replace(F.translate(c, " \n", "  "), " {2,}", " ")),
    "clean_bullets": lambda c: F.regexp_replace(c, rf"^[{BULLETS}-]+\s*", ""),
    "clean_ordered_bullets": lambda c: F.regexp_replace(c, r"^(?:[0-9A-Za-z]{1,2}\.)+(?:[0-9A-Za-z]{1,2}\.?)?\s+", ""),
    "clean_dashes": lambda c: F.trim(F.regexp_replace(c, "[-–]", " ")),
    "clean_trailing_punctuation": lambda c: F.regexp_replace(F.rtrim(c), r"[.,:;]+$", ""),
    "clean_non_ascii_chars": lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", ""),
    "group_broken_paragraphs": lambda c: F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " "),
    "remove_punctuation": lambda c: F.regexp_replace(c, r"(?U)\p{Punct}", ""),
    "replace_unicode_quotes": _unicode_quotes,
    "bytes_string_to_string": lambda c: F.regexp_replace(F.regexp_replace(c, r"^b(['\"])(.*)\1$", "$2"), r"\\n", "\n"),
}
#: Bricks with a pattern argument.
PATTERN_BRICKS = {
    "clean_prefix": lambda c, pattern: F.ltrim(F.regexp_replace(c, rf"^(?:{pattern})[\p{{Punct}}]*", "")),
    "clean_postfix": lambda c, pattern: F.rtrim(F.regexp_replace(c, rf"(?:{pattern})$", "")),
}
DEFAULT_BRICKS = (("replace_unicode_quotes", {}), ("clean_non_ascii_chars", {}), ("group_broken_paragraphs", {}), ("clean_extra_whitespace", {}))


def apply_bricks(text: Column, bricks: Sequence[tuple[str, dict[str, str]]] = DEFAULT_BRICKS) -> Column:
    """The named cleaners in order; an unknown name raises ValueError."""
    for name, options in bricks:
        if name in BRICKS:
            text = BRICKS[name](text)
        elif name in PATTERN_BRICKS:
            text = PATTERN_BRICKS[name](text, **options)
        else:
            raise ValueError(f"no cleaner is named {name}")
    return text


# --- extractors -------------------------------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9\._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
US_PHONE = r"(?:\+?1[-. ]?)?\(?[2-9][0-9]{2}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}"
DATETIME = r"[A-Z][a-z]{2},\s[0-9]{1,2}\s[A-Z][a-z]{2}\s[0-9]{4}\s[0-9]{2}:[0-9]{2}:[0-9]{2}\s[+-][0-9]{4}"
IPV6 = r"[0-9A-Za-z]{1,4}(?:::?[0-9A-Za-z]{1,4}){3,7}(?:%[0-9A-Za-z]+)?"
IP_NAME = r"[A-Za-z0-9-]+\.[A-Za-z]+\.[A-Za-z][A-Za-z0-9-]*"
MAPI_ID = r"[0-9]+(?:\.[0-9]+){3}(?=;)"
EXTRACTORS = {"email": EMAIL, "ip_address": IPV4, "ipv6_address": IPV6, "ip_address_name": IP_NAME, "mapi_id": MAPI_ID, "us_phone": US_PHONE, "datetime": DATETIME}


def extract_all(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(EXTRACTORS[kind]), F.lit(0))


def text_before(text: Column, mark: str) -> Column:
    return F.when(F.instr(text, mark) > 0, F.rtrim(F.split_part(text, F.lit(mark), F.lit(1))))


def text_after(text: Column, mark: str) -> Column:
    return F.when(F.instr(text, mark) > 0, F.ltrim(F.substr(text, F.locate(mark, text) + len(mark))))


def ordered_bullet(text: Column) -> Column:
    """Up to three parts of a leading ``1.2.b`` as an array."""
    return F.filter(F.split(F.regexp_extract(text, r"^([0-9A-Za-z]{1,2}(?:\.[0-9A-Za-z]{1,2}){0,2})\.?\s", 1), r"\."), lambda x: x != "")


class _Tables(HTMLParser):
    """The cells of the first table, row by row."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.depth = self.done = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
        if self.depth and not self.done:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join(" ".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(text: pd.Series) -> pd.Series:
    """The cells of the first HTML table of a text; empty without one."""

    def rows(t: str) -> list[list[str]]:
        p = _Tables()
        p.feed(t or "")
        return [r for r in p.rows if r]

    return text.map(rows)
