"""Text normalisation as Column expressions.

White space means what Unicode and the ASCII separators 0x1C-0x1F make of it, so
U+00A0, U+0085 and U+3000 count.  None of these functions returns null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space, for use inside a regex class.
SPACE = r"\t-\r\x1C-\x1F\x85\p{Z}"

#: Texts that stand for a missing value in cleaned sheets, and the wider set of the document builders.
SHEET_PLACEHOLDERS = ("", "-", "--", "---", "—", "——", "———", "暂无", "无", "未填写", "未标注")
DOCUMENT_PLACEHOLDERS = ("", "-", "--", "---", "—", "——", "暂无", "无", "未填写", "未标注", "nan", "None")
#: Signs that sheet headers and product names are compared without.
HEADER_SIGNS = r"，,：:；;（()）【】\[\]/\\|·•、\-—_"
NAME_SIGNS = r"·•（）()\[\]【】《》<>:：,，。;；/\\"
#: Texts that mean yes.
TRUE_WORDS = ("true", "1", "yes", "是")


def safe_text(c: Column) -> Column:
    """The value as text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(safe_text(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_space(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(safe_text(c), rf"[{SPACE}]+", " "))


def first_nonblank(*cs: Column, placeholders: Sequence[str] = ()) -> Column:
    """The first value, stripped, that isn't blank or a placeholder; else empty."""
    options = []
    for c in cs:
        s = strip(c)
        options.append(F.when((s != "") & ~s.isin(*placeholders), s) if placeholders else F.when(s != "", s))
    return F.coalesce(*options, F.lit(""))


def normalize_text(c: Column, wide_spaces: bool = False) -> Column:
    """Line feeds only, single blanks, no blanks around line feeds, at most one empty line."""
    s = F.regexp_replace(safe_text(c), r"\r\n?", "\n")
    if wide_spaces:
        s = F.replace(s, F.lit("　"), F.lit(" "))
    s = F.regexp_replace(s, r"[ \t\f\x0B]+", " ")
    s = F.regexp_replace(s, r" *\n *", "\n")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def header_key(c: Column) -> Column:
    """A column header without white space and signs."""
    return F.regexp_replace(safe_text(c), rf"[{SPACE}{HEADER_SIGNS}]+", "")


def without_signs(c: Column) -> Column:
    """A name without white space and signs; letter case stays."""
    return F.regexp_replace(safe_text(c), rf"[{SPACE}\-_{NAME_SIGNS}]+", "")


def plain_key(c: Column) -> Column:
    """A name in lower case without white space and signs; what stands in brackets stays."""
    return F.lower(without_signs(c))


def spaced_words(c: Column) -> Column:
    """A name with signs (not hyphens) as single blanks."""
    return normalize_space(F.regexp_replace(safe_text(c), rf"[{NAME_SIGNS}]+", " "))


def match_key(c: Column) -> Column:
    """Lower case, without bracketed parts, digits, a-z and CJK ideographs only."""
    bare = F.regexp_replace(F.lower(safe_text(c)), r"\([^)]*\)|（[^）]*）", "")
    return F.regexp_replace(bare, r"[^0-9a-z一-鿿]+", "")


def name_key(c: Column) -> Column:
    """Lower case, without middle dots and white space."""
    return F.regexp_replace(F.lower(safe_text(c)), rf"[·•{SPACE}]+", "")


def truncate(c: Column, limit: int) -> Column:
    """Line feeds as spaces, stripped, at most `limit` characters of which the last three are dots if it was cut."""
    s = strip(F.replace(safe_text(c), F.lit("\n"), F.lit(" ")))
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, max(limit - 3, 0)), F.lit("..."))).otherwise(s)


def shorten(c: Column, limit: int) -> Column:
    """The first `limit` characters, followed by dots if it was cut."""
    s = strip(c)
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def preview(c: Column, limit: int = 420) -> Column:
    return truncate(normalize_space(c), limit)


def slug(c: Column, limit: int = 64, other: str = "_") -> Column:
    """Letters, digits, dot, hyphen and underscore; anything else as `other`; at most `limit` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{N}_.\-]+", other), rf"^{other}+|{other}+$", ""), 1, limit)


def joined(items: Column, separator: str = "、") -> Column:
    """Non-empty items of an array, white space collapsed, joined."""
    return F.array_join(F.filter(F.transform(items, normalize_space), lambda x: x != ""), separator)


def distinct_lines(c: Column, pattern: str = r"\n", limit: int | None = None) -> Column:
    """Parts of a text in order, stripped, blanks and repeats dropped, at most `limit`."""
    out = F.array_distinct(F.filter(F.transform(F.split(safe_text(c), pattern), strip), lambda x: x != ""))
    return F.slice(out, 1, limit) if limit else out


def tags(c: Column, limit: int | None = None) -> Column:
    """A tag list from text with any of the usual separators."""
    return distinct_lines(c, r"[,\n，、;；]+", limit)


def clean_cell(c: Column) -> Column:
    """A sheet cell: stripped; placeholders are null; whole numbers written as floats lose their fraction."""
    s = strip(c)
    return F.when(~s.isin(*SHEET_PLACEHOLDERS), F.regexp_replace(s, r"^(-?\d+)\.0+$", "$1"))


def truthy(c: Column) -> Column:
    return F.lower(strip(c)).isin(*TRUE_WORDS)


def escape_query(field: str, c: Column) -> Column:
    """`field:'text'` with backslashes and quotes escaped."""
    quoted = F.replace(F.replace(safe_text(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit(f"{field}:'"), quoted, F.lit("'"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value evaluated a single time, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; CJK runs also give their character pairs."""
    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))

    def with_pairs(words: Column) -> Column:
        return F.concat(words, F.flatten(F.transform(F.filter(words, lambda w: w.rlike(r"[一-鿿]{2}")), pairs)))

    low = F.lower(safe_text(c))
    return once(low, lambda t: once(F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda words: F.when(t.rlike(r"[一-鿿]{2}"), with_pairs(words)).otherwise(words)))


def labelled(parts: Sequence[tuple[str, Column, int]]) -> Column:
    """Lines `label：text` of the non-blank texts, each text once (case aside), truncated."""
    rows = F.array(*(F.struct(F.lit(label).alias("label"), normalize_space(c).alias("text"), F.lit(limit).alias("limit")) for label, c, limit in parts))
    keys = F.transform(rows, lambda r: F.lower(r["text"]))
    first = F.filter(rows, lambda r, i: (r["text"] != "") & (F.array_position(keys, F.lower(r["text"])) == i + 1))
    cut = F.transform(first, lambda r: F.concat(r["label"], F.lit("："), F.when(
        F.char_length(r["text"]) > r["limit"], F.concat(F.substring(r["text"], F.lit(1), r["limit"] - 3), F.lit("..."))).otherwise(r["text"])))
    return F.array_join(cut, "\n")
