"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges that tell scripts apart.
HAN = r"[\x{4e00}-\x{9fff}]"
KANA = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"
HANGUL = r"[\x{ac00}-\x{d7af}]"
LATIN = r"[a-zA-Z]"
# What begins a list item.
BULLET = r"(?m)^\s*([-*+]\s+|\d+[.)]\s+|[一二三四五六七八九十]+[、.]\s+)"

TOKEN = r"\p{IsHan}+|[A-Za-z0-9_]+"


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_language(text: Column, policy: str = "most") -> Column:
    """A language code by script.

    ``most``: the script with the most characters, on a tie the first of zh,
    ja, ko, en. ``first``: ja, else zh, else en. ``first_han``: zh, else ja,
    else en. ``first_regional``: as ``first`` with zh_cn. ``first_korean``: ja, ko, zh, en.
    ``ratio``: by shares of the Han, kana and hangul characters. Blank texts are en.
    """
    if policy == "most":
        zh, ja, ko, en = (count_matches(text, p) for p in (HAN, KANA, HANGUL, LATIN))
        code = F.when((zh > 0) & (zh >= F.greatest(ja, ko, en)), "zh").when((ja > 0) & (ja >= F.greatest(ko, en)), "ja").when((ko > 0) & (ko >= en), "ko").otherwise("en")
    elif policy == "ratio":
        zh, ja, ko = (count_matches(text, p) for p in (HAN, KANA, HANGUL))
        third = 0.3 * (zh + ja + ko)
        code = F.when(zh + ja + ko == 0, "en").when((ja >= third) & (ja > zh) & (ja > ko), "ja").when((ko >= third) & (ko > zh), "ko").otherwise("zh")
    else:
        orders = {
            "first": ((KANA, "ja"), (HAN, "zh")),
            "first_han": ((HAN, "zh"), (KANA, "ja")),
            "first_regional": ((KANA, "ja"), (HAN, "zh_cn")),
            "first_korean": ((KANA, "ja"), (HANGUL, "ko"), (HAN, "zh")),
        }
        code = F.lit("en")
        for pattern, name in reversed(orders[policy]):
            code = F.when(text.rlike(pattern), name).otherwise(code)
    return F.when(is_blank(text), "en").otherwise(code)


def tokenize(text: Column) -> Column:
    """Lower-case words of Latin letters, digits and underscores, and runs of Han with all their pairs of characters."""

    def parts(chunk: Column) -> Column:
        size = F.char_length(chunk)
        pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr(chunk, i, F.lit(2)))
        return F.when(~chunk.rlike(r"\p{IsHan}"), F.array(F.lower(chunk))).when(size <= 2, F.array(chunk)).otherwise(F.concat(F.array(chunk), pairs))

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, parts))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, the other characters, and the words."""
    text = F.coalesce(text, F.lit(""))
    ascii_ = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    words = count_matches(text, "[A-Za-z0-9_]+")
    return (F.ceil(ascii_ * 0.25) + (F.char_length(text) - ascii_) + words).cast("long")


def clean_tag_name(name: Column) -> Column:
    """Trimmed; without Han, anything but word characters, white space and hyphens becomes a space. Blank names are null."""
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(trimmed, r"[^\w\s\-]", " "), r"\s+", " "))
    return F.when(is_blank(name), F.lit(None).cast("string")).when(trimmed.rlike(r"\p{IsHan}"), trimmed).otherwise(plain)


def preview(text: Column, size: int = 100) -> Column:
    """The first characters, with dots where the text goes on."""
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def truncate(text: Column, size: int = 4000, marker: str = "... (truncated)") -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit(marker))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.when(is_blank(text), F.lit(0)).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def html_title(html: Column) -> Column:
    """The title element, else the first h1."""
    title, heading = (F.regexp_extract(html, rf"(?is)<{tag}>(.*?)</{tag}>", 1) for tag in ("title", "h1"))
    has = html.rlike("(?is)<title>.*?</title>")
    return F.nullif(F.trim(F.when(has, title).otherwise(heading)), F.lit(""))


def html_attribute(inside: Column, name: str) -> Column:
    """The value of an attribute in what stands inside a tag: quoted either way or bare; empty where it isn't there."""
    key = rf"(?is)(?:^|[\s\"'/]){name}\s*=\s*"
    forms = [F.regexp_extract(inside, key + form, 1) for form in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>=]+)")]
    return F.concat(*forms)  # one of them matches at most


def html_meta(html: Column, name: str) -> Column:
    """The content of a named meta element, its attributes in any order; null where there is none, of several the last."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"), F.lit(1))
    own = F.filter(tags, lambda t: F.lower(html_attribute(t, "name")) == name)
    values = F.filter(F.transform(own, lambda t: html_attribute(t, "content")), lambda v: v != "")
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def html_keywords(html: Column) -> Column:
    return F.transform(F.split(html_meta(html, "keywords"), ","), lambda k: F.trim(k))


def html_body(html: Column) -> Column:
    """Text of the body without scripts and styles; of the whole page where it has no body."""
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    opened = F.regexp_extract(shown, r"(?is)<body\b(?:\s[^>]*)?>(.*)", 1)
    inner = F.when(shown.rlike(r"(?i)<body\b"), F.regexp_replace(opened, r"(?is)</body\s*>.*", "")).otherwise(shown)
    return F.trim(F.regexp_replace(inner, r"(?:<[^>]+>|\s)+", " "))


def section_text(title: Column, number: Column, content: Column) -> Column:
    """The text that is embedded for a section."""
    named = F.when(~is_blank(title), F.concat(F.lit("Title: "), title))
    return F.concat_ws("\n\n", named, F.concat(F.lit("Section: "), number.cast("string")), content)


def prompt_text(title: Column, number: Column, content: Column) -> Column:
    """The text that a tag prompt quotes for a section."""
    head = F.when(number.isNotNull() & title.isNotNull(), F.concat(F.lit("Section "), number.cast("string"), F.lit(": "), title)).otherwise(title)
    return F.concat_ws("\n\n", head, content)


def explanation(combined: Column, vector: Column, text: Column) -> Column:
    four = lambda c: F.round(c, 4).cast("string")
    return F.concat(F.lit("Combined: "), four(combined), F.lit(" (vector: "), four(vector), F.lit(", text: "), four(text), F.lit(")"))


def config_name(language: Column, configs: dict[str, str]) -> Column:
    """The text search configuration of a language: exact, else of what stands before the underscore, else the default, else the simple one."""
    table = F.create_map(*(F.lit(x) for pair in configs.items() for x in pair)) if configs else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, language), F.try_element_at(table, F.substring_index(language, "_", 1)), F.try_element_at(table, F.lit("default")), F.lit("pg_catalog.simple"))


def index_languages(text: Column, language: Column, share: float = 0.2) -> Column:
    """The section's language, and each of zh, ja and ko that has ``share`` of its Han, kana and hangul characters."""
    counts = {"zh": count_matches(text, HAN), "ja": count_matches(text, KANA), "ko": count_matches(text, HANGUL)}
    total = counts["zh"] + counts["ja"] + counts["ko"]
    return F.array_distinct(F.array_compact(F.array(language, *(F.when((total > 0) & (n >= share * total), F.lit(code)) for code, n in counts.items()))))
