"""String functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often it stands in body. Expressions inside an array lambda are
    evaluated again for each element, so what does not depend on the element is bound outside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(strip(c)) > 0, c)


def text_or_null(c: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def non_empty(c: Column, kind: str) -> Column:
    """Whether a scalar has more than blanks, or a list an element; never null."""
    held = F.size(c) > 0 if kind in ("array", "map") else F.length(strip(c)) > 0
    return F.coalesce(held, F.lit(False))


def found(c: Column, pattern: str) -> Column:
    """Case-blind search, false for null."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, f"(?i){pattern}", group), F.lit(""))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """table[c], or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def one_of(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def key(c: Column) -> Column:
    """A column or field name as it is compared."""
    return F.translate(strip(F.lower(c)), " -", "__")


def plain_key(name: str) -> str:
    """The same for a name known when the plan is built."""
    return name.lower().strip().replace(" ", "_").replace("-", "_")


ALIASES = {plain_key(a): canonical for canonical, names in V.FIELD_ALIASES.items() for a in names}


def resolve_field(c: Column) -> Column:
    """The canonical field of a spelling, or null."""
    return lookup(key(c), ALIASES)


def known_fields(fields: Column) -> Column:
    """Map of canonical field to value from an array of (key, value) structs; the first spelling wins, blank or not."""
    named = F.filter(F.transform(fields, lambda f: F.struct(resolve_field(f["key"]).alias("key"), f["value"].alias("value"))), lambda f: f["key"].isNotNull())
    return F.map_from_entries(first_by(named, lambda f: f["key"]))


def first_by(items: Column, by) -> Column:
    """Elements whose key has not stood before; keys are computed once."""
    # items are bound as well: what stands inside a lambda can't hold an Arrow function
    return let(items, lambda xs: let(F.transform(xs, by), lambda keys: F.filter(xs, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def cell_list(c: Column) -> Column:
    """Items of a cell: a JSON array, or text cut at , ; | and line breaks."""

    def items(text: Column) -> Column:
        parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
        return F.filter(F.transform(F.coalesce(parsed, F.split(text, r"[,;|\n]+")), strip), lambda x: F.length(x) > 0)

    return F.coalesce(let(strip(c), items), F.array().cast("array<string>"))


# Contacts


def email(c: Column) -> Column:
    return first_match(c, V.EMAIL)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def phone(c: Column) -> Column:
    """The first run that looks like a number and has 7 to 15 digits."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"({V.PHONE})"), 1), strip)
    return F.get(F.filter(runs, lambda x: F.length(digits(x)).between(7, 15)), F.lit(0))


def person_name(header: Column) -> Column:
    """The first line of two to six words of letters that is no contact detail."""
    lines = F.filter(F.transform(F.split(header, r"\r\n|\n|\r"), strip), lambda x: F.length(x) > 0)

    def fits(line: Column) -> Column:
        words = F.split(line, r"(?U)\s+")
        return ~found(line, V.NAME_SKIP) & F.size(words).between(2, 6) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z'\-.]+$"))

    return F.get(F.filter(lines, fits), F.lit(0))


# Links


def url_key(c: Column) -> Column:
    """What two spellings of a URL share."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^https?://", ""), r"^www\.", ""), r"/+$", "")


def site(c: Column) -> Column:
    """Label of a URL's site, Website for others."""
    out = F.lit("Website")
    for label, host in reversed(V.LINK_SITES.items()):
        out = F.when(found(c, rf"(?:^|//|\.){host}\.com"), label).otherwise(out)
    return out


def with_scheme(c: Column) -> Column:
    text = strip(c)
    return F.when(found(text, "^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def link(url: Column, label: Column) -> Column:
    return F.struct(url.alias("url"), label.cast("string").alias("label"))



def no_links() -> Column:
    return F.array().cast("array<struct<url:string,label:string>>")


def _labelled(label: str):
    return lambda u: link(with_scheme(u), F.lit(label))


def text_links(c: Column) -> Column:
    """Links to known sites, site by site, then other URLs of what is left."""

    def rest_of(rest: Column, sites: list[tuple[str, str]]) -> Column:
        if not sites:
            other = F.transform(F.regexp_extract_all(rest, F.lit(f"((?i){V.GENERIC_URL})"), 1), lambda u: F.regexp_replace(u, r"[.,;:)]+$", ""))
            return F.transform(F.filter(other, lambda u: ~u.contains("\u0000")), lambda u: link(u, site(u)))
        label, host = sites[0]
        own = rf"(?i)(?:https?://)?(?:www\.)?{host}\.com/[\w\-_%/{'@' if label == 'Medium' else ''}]+"
        here = F.transform(F.regexp_extract_all(rest, F.lit(f"({own})"), 1), _labelled(label))
        # what a site's link takes can't be part of another one
        left = F.regexp_replace(rest, f"(?:(?i)https?://[^\\s()<>\"']*?)?{own}", "\u0000")
        after = let(left, lambda r: rest_of(r, sites[1:]))
        return F.concat(here, after)

    # few texts hold a link at all
    return F.when(c.rlike(r"(?i)https?://|\.com/"), rest_of(c, list(V.LINK_SITES.items()))).otherwise(no_links())


def merge_links(links: Column) -> Column:
    """Links in order without those whose URL, or telling label, has been kept before."""
    empty = F.struct(F.array().cast("array<string>").alias("urls"), F.array().cast("array<string>").alias("labels"), no_links().alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        url, label = url_key(x["url"]), F.lower(strip(F.coalesce(x["label"], F.lit(""))))
        telling = ~label.isin(*V.GENERIC_LABELS)
        seen = F.array_contains(acc["urls"], url) | (telling & F.array_contains(acc["labels"], label))
        return F.when(seen, acc).otherwise(
            F.struct(
                F.concat(acc["urls"], F.array(url)).alias("urls"),
                F.when(telling, F.concat(acc["labels"], F.array(label))).otherwise(acc["labels"]).alias("labels"),
                F.concat(acc["kept"], F.array(x)).alias("kept"),
            )
        )

    return F.aggregate(links, empty, step, lambda acc: acc["kept"])


# Skills


def heading(c: Column) -> Column:
    """A line as headings are compared."""
    return F.lower(squeeze(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)[\s:\-|•]+$", ""), r"(?U)^[\s:\-|•]+", "")))


def skill(c: Column) -> Column:
    """Cleaned skill, by its usual name where it has one."""
    return let(F.regexp_replace(squeeze(c), r"^[.,;:|•\-]+|[.,;:|•\-]+$", ""), lambda clean: F.coalesce(lookup(F.lower(clean), V.SKILL_ALIASES), clean))


def distinct_nocase(items: Column) -> Column:
    """Without later repeats that differ in case only."""
    return first_by(items, lambda x: F.lower(x))


def tidy_skills(items: Column) -> Column:
    return distinct_nocase(F.filter(F.transform(items, skill), lambda x: F.length(x) > 0))


def term_pattern(term: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9+#.])"


def tech_terms(c: Column, terms=tuple(V.TECH_TERMS)) -> Column:
    """Known terms that stand in the text as whole words, in the list's order."""
    return let(c, lambda text: F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(term_pattern(t)), F.lit(False)), F.lit(t)) for t in terms])))


def with_scanned(skills: Column, text: Column, least: int = 5) -> Column:
    """Skills, and terms found in the text if there are few."""
    return let(skills, lambda own: F.when(F.size(own) < least, distinct_nocase(F.concat(own, tech_terms(F.coalesce(text, F.lit("")))))).otherwise(own))
