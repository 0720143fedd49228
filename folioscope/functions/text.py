"""Column functions on text and numbers; each is one expression inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.params import BULLET_GLYPHS, INLINE_GLYPHS, PASS_FROM, WARN_FROM, WS, WS_CHARS

AS_IS = "(?<![A-Za-z0-9_])"  # ASCII word edges; \b is Unicode-aware in Java
NO_MORE = "(?![A-Za-z0-9_])"
NOT_SPACE = f"[{WS}&&[^ ]]"


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up, as floor(x * 10^d + 0.5) / 10^d in doubles."""
    f = float(10**digits)
    value = F.floor(x * F.lit(f) + F.lit(0.5))
    return value.cast("int") if digits == 0 else value.cast("double") / F.lit(f)


def once(value, name: str):
    """As a generator's output a value is computed once, and not again for each mention of it in later filters and columns."""
    return F.explode(F.array(value)).alias(name)


def trimmed(x: Column) -> Column:
    """Without white space at either end; no pattern is matched against the text between."""
    return F.btrim(x, F.lit(WS_CHARS))


def collapse_ws(x: Column) -> Column:
    """Every stretch of white space as one space; a lone space, the most of them, is not touched."""
    return trimmed(F.regexp_replace(x, f" {WS}+|{NOT_SPACE}{WS}*", " "))


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"{WS}+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.when(trimmed(x) == "", 0).otherwise(F.size(F.split(trimmed(x), f"{WS}+")))


def seen_chars(x: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), f"{WS}+", ""))


def clean_run_text(x: Column) -> Column:
    """White-space controls become spaces; other control, zero-width, soft-hyphen and bidi characters go."""
    plain = F.regexp_replace(x, r"[\t\n\r\x{B}\f]", " ")
    # most runs have no such character: all of theirs lie in one range, or in a few
    return F.when(x.rlike(r"^[ -~]*+\z") | x.rlike(r"^[ -~\x{A0}-\x{AC}\x{AE}-\x{200A}]*+\z"), x).otherwise(F.regexp_replace(plain, r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]", ""))


def neutralize_markers(x: Column) -> Column:
    return F.translate(x, "[]", "()")


def strip_ignored(x: Column) -> Column:
    out = F.regexp_replace(x, r"(?s)\[IGNORED\].*?\[/IGNORED\]", "")
    out = F.regexp_replace(out, "[ \t]{2,}", " ")
    return F.regexp_replace(out, "(?m)[ \t]+$", "")


def relative_luminance(color: Column) -> Column:
    def channel(at: int) -> Column:
        c = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return channel(2) * 0.2126 + channel(4) * 0.7152 + channel(6) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    la, lb = relative_luminance(a), relative_luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def parse_font_name(x: Column) -> Column:
    """struct(family, bold, italic) of a PostScript font name."""
    name = trimmed(F.regexp_replace(x, r"^[A-Z]{6}\+", ""))
    family_part = F.split(name, "[-,]", 2)[0]
    family = trimmed(F.regexp_replace(F.regexp_replace(family_part, "(PSMT|MT|PS)$", ""), "([a-z])([A-Z])", "$1 $2"))
    named = name != ""
    return F.struct(
        F.when(~named, F.lit("Unknown")).when(family == "", name).otherwise(family).alias("family"),
        (named & name.rlike("(?i)bold|black|heavy")).alias("bold"),
        (named & name.rlike("(?i)italic|oblique")).alias("italic"),
    )


def normalize_heading(x: Column) -> Column:
    plain = F.ltrim(trimmed(x), F.lit("#"))
    for mark in "*_":
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    return F.lower(trimmed(F.rtrim(trimmed(plain), F.lit(":"))))


def is_bullet(line: Column) -> Column:
    glyphs = BULLET_GLYPHS.replace("-", r"\-").replace("*", r"\*")
    return line.rlike(rf"^[{glyphs}\x{{F000}}-\x{{F0FF}}]") | line.rlike(rf"^[0-9]+[.)]{WS}+") | line.rlike(rf"[\x{{2000}}-\x{{2FFF}}&&[{INLINE_GLYPHS}]]")


def bullet_text(line: Column) -> Column:
    glyphs = BULLET_GLYPHS.replace("-", r"\-").replace("*", r"\*")
    return F.regexp_replace(F.regexp_replace(line, rf"^[{glyphs}\x{{F000}}-\x{{F0FF}}]{WS}*", ""), rf"^[0-9]+[.)]{WS}+", "")


def count_skill_items(x: Column) -> Column:
    # of the marks before an item only the asterisk does not part items
    items = F.transform(F.transform(F.split(x, r"[,\n|•·-]"), trimmed), lambda i: F.when(i.startswith("*"), F.ltrim(F.substring(i, 2, 2**31 - 1), F.lit(WS_CHARS))).otherwise(i))
    return F.size(F.filter(items, lambda i: F.length(i) >= 2))


def posting_tokens(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9][a-z0-9+.#-]*"), F.lit(0)), lambda t: F.regexp_replace(t, "[.]+$", ""))


def contains_word(text: Column, word: Column) -> Column:
    """``word`` occurs in ``text`` without an ASCII word character on either side."""
    quoted = F.concat(F.lit(AS_IS + r"\Q"), word, F.lit(r"\E" + NO_MORE))
    return F.contains(text, word) & F.regexp_like(text, quoted)  # a pattern is made only for what is there


def has_email(x: Column) -> Column:
    return x.contains("@") & x.rlike(r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}")


# fixed values: results must agree on what is a range of years and no phone number
YEAR_RANGE = rf"(?i){AS_IS}(?:19|20)[0-9]{{2}}{WS}*[-/\x{{2013}}\x{{2014}}]{WS}*(?:(?:19|20)[0-9]{{2}}|sekarang|saat ini|present|now){NO_MORE}"


def has_phone(x: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(x, YEAR_RANGE, " "), F.lit(rf"\+?[0-9](?:[0-9().-]|{WS}){{7,}}[0-9]"), F.lit(0))
    phone = F.exists(found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 9)
    return F.when(x.rlike(r"(?:[0-9][^0-9]*+){9}"), phone).when(x.isNotNull(), False)  # no number without nine digits


def pipes(line: Column) -> Column:
    return F.when(line.contains("|"), F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))).when(line.isNotNull(), 0)


def status_band(score: Column) -> Column:
    return F.when(score >= PASS_FROM, "pass").when(score >= WARN_FROM, "warn").otherwise("fail")


def escape_data_tags(x: Column) -> Column:
    """Tags that frame data blocks of a prompt lose their angle brackets."""
    return F.regexp_replace(x, rf"(?i)<{WS}*(/?){WS}*(cv|posting|job|title|output)(?:{WS}[^<>]*)?>", "[$1$2]")


def to_score(x: Column) -> Column:
    """A number or numeric string as an int from 0 to 100; else null."""
    value = trimmed(x.cast("string")).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))))


def clip(x: Column, n: int) -> Column:
    return trimmed(F.substring(trimmed(x), 1, n))


LABELS = {  # fixed values: label, sentence start, inline form, words that already introduce
    "en": (r"(?:for\s+)?examples?", "For example, ", "for example, ", "such as|like|including"),
    "id": ("contoh", "Misalnya, ", "misalnya, ", "seperti|misalnya|yaitu|termasuk"),
}


def without_emphasis(x: Column) -> Column:
    """Without marks of bold text; an em dash becomes a comma."""
    out = F.regexp_replace(x, r"(\*\*|__)(.+?)\1", "$2")
    out = F.regexp_replace(out, r"\*\*|__", "")
    return F.regexp_replace(out, rf"{WS}*\x{{2014}}{WS}*", ", ")


def clean_prose(x: Column, language: str = "en") -> Column:
    """Removes emphasis and em dashes, and rewrites or drops "Example:" labels."""
    # most texts have nothing to clean: no mark of emphasis, dash, label or wide gap
    return F.when(x.rlike(r"\*\*|__|[\x{2014}:]|[ \t]{2}"), rewritten_prose(x, language)).otherwise(trimmed(x))


def rewritten_prose(x: Column, language: str) -> Column:
    label, start, inline, introduced = LABELS[language]
    mark = rf"(?i:{AS_IS}{label}\s*:\s*)"
    out = without_emphasis(x)
    out = F.regexp_replace(out, rf"{mark}(?=\p{{Lu}})", "")
    out = F.regexp_replace(out, rf"((?i:{AS_IS}(?:{introduced})){WS}*){mark}", "$1")
    out = F.regexp_replace(out, rf"(^{WS}*|[.!?:]{WS}*){mark}", f"$1{start}")
    out = F.regexp_replace(out, mark, inline)
    return trimmed(F.regexp_replace(out, "[ \t]{2,}", " "))


def word_set(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of lower-cased word sets; 1 for two empty sets."""
    x, y = word_set(a), word_set(b)
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / either)


