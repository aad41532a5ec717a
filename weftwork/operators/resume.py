"""Plain-text resumes to fields, as array expressions over the lines of a text; no Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..schema import DURATION, EDUCATION, EXPERIENCE

_EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(c: Column) -> Column:
    """Lines without a last empty one."""
    return F.split(F.regexp_replace(c, rf"(?:{_EOL})\z", ""), _EOL)


def joined(rows: Column) -> Column:
    return X.strip(F.array_join(rows, "\n"))


def section_of(line: Column) -> Column:
    """Name of the section that a heading line starts, or null."""

    def name_of(head: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(V.SECTIONS.items()):
            out = F.when(head.rlike(rf"^(?:{pattern})$"), name).otherwise(out)
        return out

    return X.let(X.strip(line), lambda text: F.when(F.length(text).between(1, 60), X.let(X.heading(text), name_of)))


def sections(c: Column) -> Column:
    """Array of (name, content) in order; _header holds what stands before the first heading."""

    def of(rows: Column) -> Column:
        marks = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("at"), section_of(x).alias("name"))), lambda m: m["name"].isNotNull())
        return X.let(marks, lambda marks: cut(rows, marks))

    def cut(rows: Column, marks: Column) -> Column:
        def content(m: Column, i: Column) -> Column:
            end = F.coalesce(F.get(marks, i + 1)["at"], F.size(rows))
            return F.struct(m["name"].alias("name"), joined(F.slice(rows, m["at"] + 2, F.greatest(end - m["at"] - 1, F.lit(0)))).alias("content"))

        top = F.when(F.size(marks) > 0, joined(F.slice(rows, 1, F.get(marks, F.lit(0))["at"]))).otherwise(X.strip(c))
        return F.concat(F.array(F.struct(F.lit("_header").alias("name"), top.alias("content"))), F.transform(marks, content))

    return X.let(lines(c), of)


def section(all_sections: Column, name: str) -> Column:
    """Content of the last section of a name, empty without one."""
    own = F.filter(all_sections, lambda s: s["name"] == name)
    return F.coalesce(F.get(F.reverse(own), F.lit(0))["content"], F.lit(""))


def any_heading(line: Column) -> Column:
    text = X.strip(line)
    compact = F.replace(text, F.lit(" "), F.lit(""))
    letters = F.length(F.regexp_replace(compact, r"\P{L}", ""))
    return F.length(text).between(1, 60) & (letters >= 0.7 * F.length(compact)) & X.heading(line).isin(*dict.fromkeys(V.SKILL_HEADINGS + V.OTHER_HEADINGS))


def _choice(words: list[str]) -> str:
    return "|".join(sorted((re.escape(w) for w in words), key=len, reverse=True))


_INLINE = rf"(?i)^\s*(?:{_choice(V.SKILL_HEADINGS)})\s*[:\-|•]\s*(\S.*)$"
_LABEL = rf"(?i)^\s*(?:{_choice(V.NOISE_LABELS)})\s*[:\-|•]\s*"


def loose_skills_section(c: Column) -> Column:
    """From the first skills heading, or label with values, to the next heading."""

    def of(rows: Column) -> Column:
        starts = F.filter(
            F.transform(rows, lambda x, i: F.struct(i.alias("at"), X.heading(x).isin(*V.SKILL_HEADINGS).alias("heading"), F.regexp_extract(X.strip(x), _INLINE, 1).alias("values"))),
            lambda m: m["heading"] | (F.length(m["values"]) > 0),
        )
        return X.let(F.get(starts, F.lit(0)), lambda first: F.when(first.isNull(), "").otherwise(X.let(after(rows, first), lambda rest: F.when(first["heading"], rest).otherwise(X.strip(F.concat(first["values"], F.lit("\n"), rest))))))

    def after(rows: Column, first: Column) -> Column:
        ends = F.filter(F.transform(rows, lambda x, i: F.when((i > first["at"]) & any_heading(x), i)), lambda i: i.isNotNull())
        end = F.coalesce(F.get(ends, F.lit(0)), F.size(rows))
        return joined(F.slice(rows, first["at"] + 2, F.greatest(end - first["at"] - 1, F.lit(0))))

    return X.let(lines(c), of)


def skill_tokens(c: Column) -> Column:
    """Raw skills of a section: lines without labels and markers, cut at , ; | and /."""

    def of_line(row: Column) -> Column:
        line = F.regexp_replace(X.strip(row), _LABEL, "")
        noise = X.heading(line).isin(*V.NOISE_LABELS)
        parts = F.transform(F.split(F.regexp_replace(line, rf"(?U){V.MARKER}", ""), r"[,;|/]+"), X.strip)
        return F.when(noise, F.array().cast("array<string>")).otherwise(F.filter(parts, lambda p: (F.length(p) > 1) & ~X.heading(p).isin(*V.NOISE_LABELS)))

    return F.flatten(F.transform(lines(c), of_line))


def skills(section_text: Column, full_text: Column) -> Column:
    block = X.let(section_text, lambda own: F.when(F.length(own) > 0, own).otherwise(loose_skills_section(full_text)))
    return X.with_scanned(X.tidy_skills(skill_tokens(block)), full_text)


def date_line(line: Column) -> Column:
    """Whether a line is hardly more than a date or a range of dates."""

    def of(text: Column) -> Column:
        rest = F.substr(text, F.length(F.regexp_extract(text, rf"(?i)^(?s:(.*?))({V.DATE})", 1)) + F.length(X.first_match(text, V.DATE)) + 1)
        return F.when(X.found(rest, V.DATE_TAIL), True).otherwise(F.length(X.first_match(text, V.DATE)) >= 0.75 * F.length(text))

    return X.let(F.regexp_replace(X.strip(line), rf"(?U){V.MARKER}", ""), lambda text: F.when(X.found(text, V.DATE), of(text)).otherwise(False))


def _blocks(c: Column) -> Column:
    """Paragraphs as arrays of stripped lines, with their text."""
    parts = F.transform(F.split(c, r"\n{2,}"), lambda b: F.struct(X.strip(b).alias("text"), F.filter(F.transform(lines(X.strip(b)), X.strip), lambda x: F.length(x) > 0).alias("rows")))
    return F.filter(parts, lambda b: F.size(b["rows"]) > 0)


def _unlabelled(c: Column) -> Column:
    return F.coalesce(X.text_or_null(F.regexp_replace(c, rf"(?i){V.EXPERIENCE_LABEL}", "")), c)


def experience(c: Column) -> Column:
    """One entry for each paragraph: title, company, then description; dates from the first date found."""

    def dates(raw: Column) -> Column:
        parts = F.split(raw, r"\s*[-–—]\s*", 2)
        start, tail = X.strip(F.get(parts, F.lit(0))), X.strip(F.get(parts, F.lit(1)))
        now = F.when(tail.isNull(), True).otherwise(X.found(tail, f"^(?:{V.PRESENT})"))
        return F.when(F.length(start) > 0, F.struct(start.alias("start"), F.when(~now, tail).alias("end"), now.alias("is_current")).cast(DURATION))

    def entry(b: Column) -> Column:
        content = F.filter(b["rows"], lambda x: ~date_line(x))
        return X.let(content, lambda kept: X.let(F.when(F.size(kept) > 0, kept).otherwise(b["rows"]), lambda rows: of_rows(rows, b["text"])))

    def of_rows(rows: Column, block: Column) -> Column:
        text = F.when(F.size(rows) > 2, F.array_join(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))), " "))
        heads = F.struct(_unlabelled(F.get(rows, F.lit(0))).alias("one"), _unlabelled(F.get(rows, F.lit(1))).alias("two"))

        def named(h: Column) -> Column:
            swapped = h["two"].isNotNull() & ~X.found(h["one"], V.JOB_TITLE) & X.found(h["two"], V.JOB_TITLE)
            return F.struct(
                F.when(swapped, h["one"]).otherwise(h["two"]).alias("company"), F.when(swapped, h["two"]).otherwise(h["one"]).alias("title"),
                X.let(X.first_match(block, V.DATE), dates).alias("duration"), text.alias("description"), F.lit(None).cast("string").alias("location"),
            ).cast(EXPERIENCE)

        return X.let(heads, named)

    return F.when(F.length(c) > 0, F.transform(_blocks(c), entry)).otherwise(F.array().cast(f"array<{EXPERIENCE}>"))


def education(c: Column) -> Column:
    """One entry for each paragraph; a paragraph with a degree only and its neighbour with an institution only are one.

    A paragraph without a range of years starts in the year of its first date line that has one, else in the first year
    anywhere: the number of "Uni 1999" is no date beside a line "2018".
    """

    def part(b: Column) -> Column:
        range_start, range_end = X.first_match(b["text"], V.YEAR_RANGE, 1), X.first_match(b["text"], V.YEAR_RANGE, 2)
        marked = F.transform(b["rows"], lambda x, i: F.struct(i.alias("i"), x.alias("x"), X.found(x, V.DEGREE_LINE).alias("d"), X.found(x, V.GPA_LINE).alias("g"), date_line(x).alias("t")))

        def start(rows: Column) -> Column:
            dated = F.filter(F.transform(F.filter(rows, lambda r: r["t"]), lambda r: X.first_match(r["x"], V.ONE_YEAR, 1)), lambda y: y.isNotNull())
            return F.coalesce(range_start, F.get(dated, F.lit(0)), X.first_match(b["text"], V.ONE_YEAR, 1))

        return X.let(marked, lambda rows: X.let(F.get(F.filter(rows, lambda r: r["d"]), F.lit(0)), lambda degree_at: of_rows(rows, degree_at, start(rows), range_end)))

    def of_rows(rows: Column, degree_at: Column, start: Column, range_end: Column) -> Column:
        other = F.filter(rows, lambda r: ~r["i"].eqNullSafe(degree_at["i"]))
        marks = F.filter(F.transform(F.filter(other, lambda r: r["g"]), lambda r: F.regexp_extract(r["x"], r"\d+\.?\d*", 0)), lambda x: F.length(x) > 0)
        place = F.get(F.filter(other, lambda r: ~r["g"] & ~r["t"]), F.lit(0))
        return F.struct(
            place["x"].alias("institution"), degree_at["x"].alias("degree"), start.alias("start"),
            F.when(~X.found(range_end, f"^(?:{V.PRESENT})"), range_end).alias("end"),
            F.get(F.reverse(marks), F.lit(0)).try_cast("double").alias("gpa"),
        )

    parts = F.transform(_blocks(c), part)
    kind = "struct<institution:string,degree:string,start:string,end:string,gpa:double>"
    # (finished entries, open one): an open entry closes or takes its complement
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))

    def halves(a: Column, b: Column) -> Column:
        one = lambda x, y: x.isNotNull() & y.isNull()
        return (one(a["degree"], a["institution"]) & one(b["institution"], b["degree"])) | (one(a["institution"], a["degree"]) & one(b["degree"], b["institution"]))

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        whole = F.struct(*[F.coalesce(a[f], b[f]).alias(f) for f in ("institution", "degree", "start", "end", "gpa")]).cast(kind)
        return (
            F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.cast(kind).alias("open")))
            .when(halves(a, b), F.struct(F.concat(acc["done"], F.array(whole)).alias("done"), F.lit(None).cast(kind).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(a)).alias("done"), b.cast(kind).alias("open")))
        )

    merged = F.aggregate(parts, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))

    def entry(m: Column) -> Column:
        duration = F.when(F.length(m["start"]) > 0, F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(False).alias("is_current")).cast(DURATION))
        return F.struct(m["institution"].alias("institution"), m["degree"].alias("degree"), F.lit(None).cast("string").alias("field_of_study"), duration.alias("duration"), m["gpa"].alias("gpa")).cast(EDUCATION)

    kept = F.filter(merged, lambda m: m["institution"].isNotNull() | m["degree"].isNotNull())
    return F.when(F.length(c) > 0, F.transform(kept, entry)).otherwise(F.array().cast(f"array<{EDUCATION}>"))


def parsed(c: Column, parts: Column, extra_links: Column | None = None) -> dict[str, Column]:
    """All fields of a resume text, parts being its sections; links found elsewhere (such as in a PDF's annotations) come first."""
    links = X.text_links(c) if extra_links is None else F.concat(F.coalesce(extra_links, X.no_links()), X.text_links(c))
    none = F.lit(None).cast("string")
    return {
        "name": X.person_name(section(parts, "_header")), "email": X.email(c), "phone": X.phone(c), "location": none,
        "summary": X.text_or_null(section(parts, "summary")), "skills": skills(section(parts, "skills"), c),
        "experience": X.let(section(parts, "experience"), experience), "education": X.let(section(parts, "education"), education), "links": X.merge_links(links),
    }
