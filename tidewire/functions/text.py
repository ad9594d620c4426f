"""Text functions, Column to Column, evaluated in the JVM.

Accents are handled for Latin letters (U+00C0 to U+017F), from a table made by rule from the Unicode data. Text with
other compatibility characters (ligatures, fractions, full-width forms, other scripts' composed letters) needs full
NFKD: ``exact=True`` sends just those values, and nothing else, through an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Small Latin letters that are a base letter and one mark.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if chr(c).islower() and len(unicodedata.normalize("NFKD", chr(c))) == 2 and unicodedata.combining(unicodedata.normalize("NFKD", chr(c))[1]))
BASES = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)
#: The same letters as a class that a pattern engine tests by range, letters in the range that have no mark taken out.
_SPAN = f"{min(ACCENTED)}-{max(ACCENTED)}"
_BARE = "".join(chr(c) for c in range(ord(min(ACCENTED)), ord(max(ACCENTED))) if chr(c) not in ACCENTED and chr(c) == chr(c).lower())
ACCENTED_CLASS = f"[{_SPAN}&&[^{_BARE}]]"
#: Characters that the native forms treat as full NFKD would.
_PLAIN = "".join(chr(c) for c in range(0xA1, 0x180) if unicodedata.normalize("NFKD", chr(c)) == chr(c))
NATIVE = f"^[\\x00-\\x7F{ACCENTED}{ACCENTED.upper()}{re.escape(_PLAIN)}‐–—‘’“”•€]*$".replace("İ", "")

WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


@F.pandas_udf(StringType())
def _clean_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", t).lower()).split()))


@F.pandas_udf(StringType())
def _fold_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.lower()).encode("ascii", "ignore").decode())


def _with_exact(text: Column, native: Column, udf) -> Column:
    rest = F.when(~text.rlike(NATIVE), text)  # null for nearly all rows, which costs the UDF nothing
    return F.coalesce(udf(rest), native)


def fold_ascii(c: Column | str, exact: bool = False) -> Column:
    """Lower case, accents dropped, then all that isn't ASCII dropped. Null gives ''."""
    text = _text(c)
    native = F.regexp_replace(F.translate(F.lower(text), ACCENTED, BASES), "[^\\x00-\\x7F]", "")
    return _with_exact(text, native, _fold_exact) if exact else native


def clean_text(c: Column | str, compat: bool = True, exact: bool = False) -> Column:
    """Lower case, words of letters, digits and underscore joined by single spaces. Null gives ''.

    With ``compat`` an accent ends its letter's word, as decomposition leaves a mark that is no letter; without, accents
    are folded first."""
    text = _text(c)
    low = F.lower(text)
    marked = F.translate(F.regexp_replace(low, f"({ACCENTED_CLASS})", "$1 "), ACCENTED, BASES) if compat else F.translate(low, ACCENTED, BASES)
    native = F.trim(F.regexp_replace(marked, "[^\\p{L}\\p{N}_]+", " "))  # white space is no word character either
    return _with_exact(text, native, _clean_exact) if exact and compat else native


def preview(c: Column | str, size: int = 200) -> Column:
    """The first ``size`` characters and '...', or all of a shorter text. Null gives ''."""
    text = _text(c)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def normalize_term(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_text(c)), f"^{WHITE}|{WHITE}$", "")


def query_words(c: Column | str) -> Column:
    """Lower-case words of a query; none of a blank one."""
    words = F.split(normalize_term(c), WHITE)
    return F.filter(words, lambda w: w != "")


def strip_title(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), "^[ \\t\\n\\x0B\\f\\r\\x{A0}]+|[ \\t\\n\\x0B\\f\\r\\x{A0}]+$", "")


#: The references that the native form of strip_html decodes, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}
NODES = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?/a-z][^>]*>"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= bool(self.skip and tag in ("script", "style"))

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def _strip(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(StringType())
def _strip_exact(s: pd.Series) -> pd.Series:
    return s.map(_strip)


def strip_html(c: Column | str, exact: bool = True) -> Column:
    """The text between tags: each piece stripped, empty ones dropped, joined by one space; comments, scripts and
    styles have none. Null gives ''. Pages that have references other than the common ones, and no others, are sent through
    a parser that knows all, those without a semicolon too; ``exact=False`` leaves such references as they are."""
    text = _text(c)
    native = F.regexp_replace(F.regexp_replace(text, NODES, "\u0001"), "[ \\t\\n\\x0B\\f\\r]*\u0001[ \\t\\n\\x0B\\f\\r\u0001]*", " ")
    native = F.regexp_replace(native, f"^{WHITE}|{WHITE}$", "")
    for name, char in ENTITIES.items():
        native = F.replace(native, F.lit(name), F.lit(char))
    if not exact:
        return native
    odd = F.when(F.regexp_replace(text, "|".join(ENTITIES), "").rlike("&[#a-zA-Z]"), text)
    return F.coalesce(_strip_exact(odd), native)


def parse_pubdate(c: Column | str) -> Column:
    """RFC 2822 date to a timestamp, null if it is none. The weekday is dropped, names of UTC become +0000."""
    text = F.regexp_replace(F.regexp_replace(F.trim(_text(c)), "^[A-Za-z]{3},? +", ""), " (GMT|UTC|UT|Z)$", " +0000")
    with_seconds = F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(with_seconds, F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")))


def pubdate_offset(c: Column | str) -> Column:
    """Minutes east of UTC that the source wrote, null if none."""
    text = F.regexp_replace(F.trim(_text(c)), " (GMT|UTC|UT|Z)$", " +0000")
    sign, hours, minutes = (F.regexp_extract(text, r"([+-])(\d{2})(\d{2})$", g) for g in (1, 2, 3))
    return F.when(sign != "", F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 60 + minutes.try_cast("int")))


def iso_date(c: Column | str) -> Column:
    """ISO 8601 in the source's own offset; the present time, without an offset, where there is no valid date."""
    at, offset = parse_pubdate(c), pubdate_offset(c)
    local = F.timestamp_seconds(F.unix_timestamp(at) + offset * 60)
    wall = F.date_format(F.to_utc_timestamp(local, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    size = F.abs(offset)
    zone = F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.concat(wall, zone), now)

