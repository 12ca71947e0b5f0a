"""Fields, clues and judgements read out of free text, as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import SPACE, first_nonblank, normalize_space, normalize_text, plain_key, safe_text, spaced_words, strip, truncate, without_signs

#: How product texts label these fields.
LABELS = {
    "product_name": r"(?:产品名称|商品名称|酒名|名称|品名)[:：]\s*([^。；;\n，,]{2,80})",
    "brand": r"(?:品牌)[:：]\s*([^。；;\n，,]{2,60})",
    "spec": r"(?:规格型号|规格|净含量)[:：]\s*([^。；;\n，,]{2,80})",
}
#: Keys under which a field may be given directly.
DIRECT_KEYS = {
    "product_id": ("product_id", "canonical_product_id"),
    "product_name": ("product_name", "name", "产品名称", "商品名称", "品名"),
    "brand": ("brand", "品牌"),
    "spec": ("spec", "specification", "规格", "规格型号"),
}
#: Words that make a product a gift.
GIFT_WORDS = ("礼赠", "送礼", "收藏", "品鉴", "宴请", "聚会", "非卖品", "纪念", "节庆")
#: Longest brand that is read out of a name, in characters.
BRAND_MOST = 20
#: What marks a version in a product name, after its bracketed parts.
VERSION_PATTERNS = (
    r"\b[VA]\d{1,2}\b",
    r"精品\s*\d+\s*[号號]",
    r"藏\s*\d+",
    r"天字号\s*[VA]\d{1,2}",
    r"师藏年鉴[^\s，,。；;]*",
    r"[甲乙丙丁戊己庚辛壬癸]?[子丑寅卯辰巳午未申酉戌亥]?[鼠牛虎兔龙蛇马羊猴鸡狗猪]年",
    r"端午纪念",
)
#: Other forms under which a brand begins a product's name.
BRAND_FORMS = {"大民族": ("大民族酒", "大民族"), "石荣霄": ("石荣霄酒", "百年石荣霄酒", "石荣霄")}
#: Spellings that stand for each other.
SPELLINGS = (("陈任远", "陈仁远"), ("陈仁远", "陈任远"))


def label(text: Column, field: str) -> Column:
    """The labelled value of a field, white space collapsed; else empty."""
    return normalize_space(F.regexp_extract(safe_text(text), LABELS[field], 1))


def product_name(text: Column) -> Column:
    """Labelled name, else labelled brand, else the first line cut to 60 characters."""
    line = F.split(strip(text), r"\r\n|\n|\r")[0]
    return first_nonblank(F.regexp_extract(safe_text(text), LABELS["product_name"], 1), F.regexp_extract(safe_text(text), LABELS["brand"], 1), truncate(line, 60))


def field_of(field: str, metadata: Column, text: Column, direct: dict[str, Column] | None = None) -> Column:
    """A bundle field: given directly, else in the metadata map, else labelled in the text."""
    options = []
    for key in DIRECT_KEYS[field]:
        if direct and key in direct:
            options.append(direct[key])
        options.append(metadata[key])
    if field in LABELS:
        options.append(label(text, field))
    return normalize_space(first_nonblank(*options))


def json_map(c: Column) -> Column:
    """Metadata given as JSON text, as a map of strings; invalid or other JSON is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.when(strip(c).startswith("{"), safe_text(c)), "map<string,string>", {"mode": "PERMISSIVE"}), empty)


def json_in_prose(c: Column) -> Column:
    """The JSON object in a text: the whole text, else from the first { to the last }; null if neither parses."""
    s = strip(c)
    inner = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x) for x in (s, inner)))


def text_quality(c: Column, characters: int = 200, ideographs: int = 40) -> Column:
    """Whether a page's text is good enough to go without OCR."""
    s = safe_text(c)
    return (F.char_length(F.regexp_replace(s, rf"[{SPACE}]", "")) >= characters) & (F.regexp_count(s, F.lit("[一-鿿]")) >= ideographs)


#: What an OCR line of at most three characters must not be.
SHORT_NOISE = r"^([^\p{L}\p{N}]+|\d{1,4}|[A-Za-z]{1,2}|[A-Za-z0-9]{1,3})$"


def ocr_noise(line: Column) -> Column:
    """Whether a line, white space collapsed, is noise: blank, up to three characters that are signs, digits or Latin only, or a single other sign."""
    n = F.char_length(line)
    return (n == 0) | ((n <= 3) & line.rlike(SHORT_NOISE)) | ((n == 1) & ~line.rlike(r"[一-鿿A-Za-z0-9]"))


def clean_ocr(c: Column, limit: int = 1500) -> Column:
    """Normalised OCR lines without noise and repeats, cut to `limit`."""
    lines = F.filter(F.array_distinct(F.transform(F.split(normalize_text(c), r"\n"), normalize_space)), lambda x: ~ocr_noise(x))
    s = F.array_join(lines, "\n")
    return F.when(F.char_length(s) > limit, F.concat(F.regexp_replace(F.substring(s, 1, limit), rf"[{SPACE}]+$", ""), F.lit("..."))).otherwise(s)


def brand_and_series(name: Column) -> Column:
    """(brand, series): the name before its first middle dot, else before its first wide bracket, of at most BRAND_MOST characters; and after the dot."""
    n = safe_text(name)
    dot, bracket = F.instr(n, "·"), F.instr(n, "（")
    head = F.when(dot > 0, F.substring(n, F.lit(1), dot - 1)).when(bracket > 0, F.substring(n, F.lit(1), bracket - 1)).otherwise("")
    brand = strip(F.regexp_replace(head, r"^[（( ]+|[（( ]+$", ""))
    series = F.when(dot > 0, strip(F.regexp_replace(F.substring(n, dot + 1, F.lit(1 << 30)), r"^[）) ]+|[）) ]+$", ""))).otherwise("")
    return F.struct(F.when(F.char_length(brand) <= BRAND_MOST, brand).otherwise("").alias("brand"), series.alias("series"))


def gift_attributes(text: Column) -> Column:
    """The gift words a text has, joined."""
    words = F.array(*map(F.lit, GIFT_WORDS))
    return F.array_join(F.filter(words, lambda w: F.contains(safe_text(text), w)), "、")


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items with a key of their own, in order; of equal keys the first."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: (key(x) != "") & (F.array_position(keys, key(x)) == i + 1))


def version_signals(c: Column) -> Column:
    """Bracketed parts and version marks of a name, in this order, each once by its plain key."""
    s = normalize_space(c)
    found = [F.regexp_extract_all(s, F.lit(r"[（(]([^）)]+)[）)]"), 1), *(F.regexp_extract_all(s, F.lit(f"(?iuU){p}"), 0) for p in VERSION_PATTERNS)]
    return first_by(F.transform(F.concat(*found), normalize_space), plain_key)


def without_brand(name: Column, brand: Column) -> Column:
    """A name without the brand, in any of its forms, at its beginning; the longest form counts."""
    n, b = normalize_space(name), safe_text(brand)
    known = F.create_map(*(x for k, forms in BRAND_FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(forms, key=len, reverse=True))))))
    forms = F.coalesce(known[b], F.array(b))
    begun = F.get(F.filter(forms, lambda f: F.startswith(n, f)), F.lit(0))
    return F.when(begun.isNotNull(), strip(F.regexp_replace(F.substring(n, F.char_length(begun) + 1, F.lit(1 << 30)), "^[·• ]", ""))).otherwise(n)


def search_terms(name: Column, brand: Column) -> Column:
    """Search terms of a product: the name; without its brand; that without signs; brand and rest in words; each version
    signal, also behind the bare name if that lacks it; and all of them in their other spellings.  Each once, letter case aside."""
    full = normalize_space(name)
    core = without_brand(name, brand)
    bare = without_signs(core)
    marks = F.flatten(F.transform(version_signals(name), lambda s: F.when(
        (bare != "") & ~F.contains(plain_key(bare), plain_key(s)), F.array(s, F.concat(bare, without_signs(s)))).otherwise(F.array(s))))
    terms = F.concat(F.array(full, core, bare, spaced_words(F.concat(safe_text(brand), F.lit(" "), core))), marks)
    other = F.flatten(F.transform(terms, lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(a)), F.replace(t, F.lit(a), F.lit(b))) for a, b in SPELLINGS)))))
    return first_by(F.transform(F.concat(terms, other), normalize_space), F.lower)


#: What OCR text says after these labels.
OCR_CLUES = (
    ("酒精度", r"(?i)酒精度[:：]?\s*([0-9]{1,2}(?:\.\d+)?\s*% ?vol)"),
    ("净含量", r"(?i)净含量[:：]?\s*([0-9]+(?:\.[0-9]+)?\s*(?:ml|l)(?:x[0-9]+)?)"),
    ("规格", r"规格[:：]?\s*([^\n，,；;]{1,40})"),
    ("香型", r"(?m)(?:^|[\n\s])香型[:：]?\s*([^\n]{1,24}?白酒)"),
)
#: Labels at which a clue's value ends.
CLUE_END = r"(?s)(?:净含量|规格|酒精度|执行标准|生产企业|配料表|食品名称|贮存方式|温馨提示).*$"


def ocr_clues(ocr: Column, known: dict[str, Column], most: int = 4) -> Column:
    """`label：value` clues from OCR text, without those that the product's own field already holds."""
    found = []
    for name, pattern in OCR_CLUES:
        v = F.regexp_replace(F.regexp_replace(F.regexp_extract(safe_text(ocr), pattern, 1), CLUE_END, ""), r"(?s)[【\[(（].*$", "")
        v = normalize_space(F.regexp_replace(v, r"^[ ：:;；，,】)\]）]+|[ ：:;；，,】)\]）]+$", ""))
        held = F.contains(normalize_space(known[name]), v) if name in known else F.lit(False)
        found.append(F.when((v != "") & ~held, F.concat(F.lit(f"{name}："), v)))
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def ocr_summary(ocr: Column, known: dict[str, Column]) -> Column:
    """The clues, else the first three lines of two characters or more, cut to 160."""
    clues = ocr_clues(ocr, known)
    lines = F.slice(F.filter(F.transform(F.split(safe_text(ocr), r"\r\n|\n|\r"), normalize_space), lambda x: F.char_length(x) >= 2), 1, 3)
    text = F.array_join(lines, "；")
    return F.when(F.size(clues) > 0, F.array_join(clues, "；")).otherwise(F.when(F.char_length(text) > 160, F.concat(F.substring(text, 1, 160), F.lit("..."))).otherwise(text))


def image_section(title: str, caption: Column, tags: Column, ocr: Column, limit: int, labels: tuple[str, str, str]) -> Column:
    """A titled section from the caption, tags and OCR summary of a product's main image; empty if there is nothing."""
    cut = F.when(F.char_length(strip(caption)) > limit, F.concat(F.substring(strip(caption), 1, limit), F.lit("..."))).otherwise(strip(caption))
    shown = F.array_join(tags, "、")
    lines = F.array_compact(F.array(*(F.when(v != "", F.concat(F.lit(f"{name}："), v)) for name, v in zip(labels, (cut, shown, safe_text(ocr)), strict=True))))
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n"))).otherwise("")


def gift_tags(tags: Column, most: int = 6) -> Column:
    """Tags that speak of gifts or occasions."""
    words = F.array(*map(F.lit, ("礼", "商务", "节庆", "高端", "喜庆", "纪念", "收藏", "国风")))
    return F.slice(F.filter(tags, lambda t: F.exists(words, lambda w: F.contains(t, w))), 1, most)


@pandas_udf(StringType())
def balanced_json(s: pd.Series) -> pd.Series:
    """The first brace-balanced object in each text, braces inside strings aside; null if there is none."""
    decoder = json.JSONDecoder(strict=False)

    def first(text: str | None) -> str | None:
        at = (text or "").find("{")
        if at < 0:
            return None
        try:
            return text[at:decoder.raw_decode(text, at)[1]]
        except ValueError:
            pass
        depth, quoted, i = 0, False, at
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[at:i + 1]
            i += 1
        return None

    return s.map(first)
