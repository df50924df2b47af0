"""Prompt texts as columns: concatenation, removal, filling in, and the hierarchy in their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = ("system", "human", "user", "source")


def concat(*prompts: Column) -> Column:
    return F.concat_ws("\n", *prompts)


def subtract(prompt: Column, part: Column) -> Column:
    """All occurrences taken out; an empty part takes nothing."""
    return F.when(part == "", prompt).otherwise(F.replace(prompt, part, F.lit("")))


def fill(prompt: Column, **values: Column) -> Column:
    """{name} replaced for each name given; doubled braces become single. Names that aren't given stay."""
    held = F.replace(F.replace(prompt, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in values.items():
        held = F.replace(held, F.lit(f"{{{name}}}"), value.cast("string"))
    return F.replace(F.replace(held, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def path(name: Column) -> Column:
    """PROMPT_A_B_ROLE as [A, B, role]; null for other names. Only a last part that is a role is put in lower case."""
    parts = F.split(F.regexp_replace(name, "^PROMPT_", ""), "_")
    last = F.element_at(parts, -1)
    low = F.when(F.lower(last).isin(*ROLES), F.lower(last)).otherwise(last)
    return F.when(name.startswith("PROMPT_"), F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(low)))


def constant_name(section: Column, field: Column) -> Column:
    camel = F.array_join(F.transform(F.split(section, "_"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1_000)))), "")
    return F.concat(F.lit("PROMPT_"), camel, F.lit("_"), F.upper(field))
