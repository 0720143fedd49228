"""Messages in several languages: templates with typed slots, compiled to one column expression.

A slot is ``{name}`` (text), ``{name:number}`` or ``{name:list}``. Numbers have at most two decimals
and the language's separators; lists are cut after ``limit`` items with "and N more". Templates are
parameters, so they become literals of the plan: no join, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import rounded

SLOT = re.compile(r"(\{\w+(?::\w+)?\})")


@dataclass(frozen=True)
class Locale:
    group: str = ","
    decimal: str = "."
    more: str = "{0}, and {1} more"  # shown items and how many are left out


@dataclass(frozen=True)
class Messages:
    """language -> key -> template, with each language's way to write numbers and lists."""

    templates: dict[str, dict[str, str]]
    locales: dict[str, Locale] = field(default_factory=lambda: {"en": Locale(), "id": Locale(".", ",", "{0}, dan {1} lainnya")})
    limit: int = 15


def number_text(value: Column, locale: Locale = Locale(), digits: int = 2) -> Column:
    """Grouped by thousands, half up at ``digits`` decimals, without trailing zeros."""
    plain = F.format_number(rounded(value.cast("double"), digits) if digits else F.floor(value + 0.5), digits)
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), ",", locale.group.replace("$", r"\$"))
    part = F.regexp_replace(F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(""), "0+$", "")
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit(locale.decimal), part))


def list_text(items: Column, locale: Locale = Locale(), limit: int = 15) -> Column:
    shown, extra = F.array_join(F.slice(items, 1, limit), ", "), (F.size(items) - limit).cast("string")
    parts = [shown if p == "{0}" else extra if p == "{1}" else F.lit(p) for p in re.split(r"(\{[01]\})", locale.more)]
    return F.when(F.size(items) <= limit, F.array_join(items, ", ")).otherwise(F.concat(*parts))


def compiled(template: str, locale: Locale, limit: int, texts: Column, numbers: Column, lists: Column) -> Column:
    """One template as a column. A slot without a value stays as it is written."""
    parts = []
    for part in SLOT.split(template):
        if not SLOT.fullmatch(part):
            parts.append(F.lit(part))
            continue
        name, _, kind = part[1:-1].partition(":")
        if kind == "number":
            value = number_text(F.try_element_at(numbers, F.lit(name)), locale)
        elif kind == "list":
            value = list_text(F.try_element_at(lists, F.lit(name)), locale, limit)
        elif kind == "":
            value = F.try_element_at(texts, F.lit(name))
        else:
            raise ValueError(f"slot of unknown kind: {part}")
        parts.append(F.coalesce(value, F.lit(part)))
    return F.concat(*parts)


def message(messages: Messages, key: Column, language: Column, texts: Column, numbers: Column, lists: Column) -> Column:
    """The message of ``key`` in ``language``; null where there is no template.

    ``texts`` is a map<string,string>, ``numbers`` a map<string,double>, ``lists`` a map<string,array<string>>.
    """
    out = F.lit(None).cast("string")
    for lang, by_key in messages.templates.items():
        locale = messages.locales.get(lang, Locale())
        for name, template in by_key.items():
            out = F.when((key == name) & (language == lang), compiled(template, locale, messages.limit, texts, numbers, lists)).otherwise(out)
    return out
