"""Checkboxes, radio buttons and dropdowns in recognized text, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, marks that count as set, words of dropdown labels.
CHECKBOXES = (r"\[([\sxX])\]", r"\(([\sxX])\)", r"(☐|☑|✓)", r"(□|■)")
RADIOS = (r"(○|●)", r"\(([\s•])\)", r"\[([\s•])\]")
CHECKED, SELECTED = frozenset("x✓☑■•"), frozenset("•●")
DROPDOWN = (r"([A-Za-z\s]+):\s*([A-Za-z0-9\s]+)", r"([A-Za-z\s]+)\s*[-–]\s*([A-Za-z0-9\s]+)")
KEYWORDS = ("select", "choose", "option", "category", "type", "gender", "status", "priority", "level", "grade", "class")


def marks(text: str | None, patterns: tuple[re.Pattern[str], ...], on: frozenset[str], context_lines: int) -> Iterator[tuple[bool, str, int, int]]:
    """checked, label, line from 1 and position of each mark; a mark at a line's end is labelled by a line that follows."""
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        for p in patterns:
            for m in p.finditer(line):
                below = (x.strip() for x in lines[i + 1 : i + 1 + context_lines])
                label = line[m.end() :].strip() or next(filter(None, below), "")
                if label:
                    yield m[1].lower() in on, label, i + 1, m.start()


_COMPILED = {"checkbox": (tuple(map(re.compile, CHECKBOXES)), CHECKED), "radio": (tuple(map(re.compile, RADIOS)), SELECTED)}
_DROPDOWN = tuple(map(re.compile, DROPDOWN))


def choices(text: str | None) -> Iterator[tuple[str, str, int, int]]:
    """label, value, line from 1 and position of each dropdown."""
    for i, line in enumerate((text or "").split("\n")):
        for p in _DROPDOWN:
            for m in p.finditer(line):
                if any(k in m[1].strip().lower() for k in KEYWORDS):
                    yield m[1].strip(), m[2].strip(), i + 1, m.start()


def elements_of(text: str | None, kinds: tuple[str, ...], context_lines: int = 2) -> Iterator[tuple]:
    """type, checked, label, value, line, position of the elements of these kinds."""
    for kind in kinds:
        if kind == "dropdown":
            yield from ((kind, None, label, value, line, at) for label, value, line, at in choices(text))
        else:
            yield from ((kind, on, label, None, line, at) for on, label, line, at in marks(text, *_COMPILED[kind], context_lines))


#: White space as Python's str has it, in Java's patterns.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = "".join(filter(str.isspace, map(chr, range(1 << 16))))


def _java(pattern: str) -> str:
    return "(?U)" + pattern.replace(r"\s", _SPACE)


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def lines_of(df: DataFrame, context_lines: int) -> DataFrame:
    """doc_id, line from 1, its text, and below: the first of the next lines that says something, stripped."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stripped = F.transform(lines, _strip)
    # each later line beside its line by shifted copies, so that a text of many lines is read once
    shifted = [F.slice(stripped, k + 1, F.lit(1 << 30)).alias(f"b{k}") for k in range(1, context_lines + 1)]
    rows = df.select("doc_id", F.posexplode(F.arrays_zip(lines.alias("t"), *shifted)).alias("n", "row"))
    return rows.select("doc_id", (F.col("n") + 1).alias("line"), F.col("row.t").alias("text"), F.coalesce(*[F.nullif(f"row.b{k}", F.lit("")) for k in range(1, context_lines + 1)], F.lit("")).alias("below"))


def _matches(kind: str, pattern: str) -> Column:
    """The elements that one pattern finds on a line, left to right; a match's place is the length of all before it."""
    own, line = F.lit(_java(pattern)), F.col("text")
    found = F.regexp_extract_all(line, own, F.lit(0))
    between = F.zip_with(F.split(line, _java(pattern), -1), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    places = F.aggregate(F.filter(between, lambda x: x["size"].isNotNull()), none, lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(s["places"], s["at"] + x["gap"]).alias("places")))["places"]
    parts = F.arrays_zip(found.alias("m"), F.regexp_extract_all(line, own, F.lit(1)).alias("first"), (F.regexp_extract_all(line, own, F.lit(2)) if kind == "dropdown" else found).alias("second"), places.alias("at"))

    def element(x: Column) -> Column:
        if kind == "dropdown":
            checked, label, value = F.lit(None).cast("boolean"), _strip(x["first"]), _strip(x["second"])
        else:
            checked, value = F.lower(x["first"]).isin(*sorted(CHECKED if kind == "checkbox" else SELECTED)), F.lit(None).cast("string")
            label = F.coalesce(F.nullif(_strip(F.substring(line, x["at"] + F.char_length(x["m"]) + 1, F.lit(1 << 30))), F.lit("")), F.col("below"))
        return F.struct(F.lit(kind).alias("type"), checked.alias("checked"), label.alias("label"), value.alias("value"), F.col("line"), x["at"].alias("position"))

    said = (lambda e: F.lower(e["label"]).rlike("|".join(KEYWORDS))) if kind == "dropdown" else (lambda e: e["label"] != "")
    return F.when(line.rlike(_java(pattern)), F.filter(F.transform(parts, element), said))


def marked(df: DataFrame, kinds: tuple[str, ...], context_lines: int) -> DataFrame:
    """Elements of every line, with their places, by column expressions over a table of lines. Rows: doc_id and text.

    A null text has none, as an empty one; repeated rows give their elements each; other columns are left out. A line of
    very many matches copies their places once for each.
    """
    patterns = [(kind, p) for kind in kinds for p in {"checkbox": CHECKBOXES, "radio": RADIOS, "dropdown": DROPDOWN}[kind]]
    lines = lines_of(df, context_lines).filter(F.col("text").rlike("|".join(sorted({_STARTS[kind] for kind in kinds}))))
    return lines.select("doc_id", F.inline(F.flatten(F.array_compact(F.array(*[_matches(*p) for p in patterns])))))


# A sign that every match of a kind holds; lines without it are passed over.
_STARTS = {"checkbox": r"[\[(☐☑✓□■]", "radio": r"[\[(○●]", "dropdown": "[:\\-–]"}


def detect_checkboxes(df: DataFrame, context_lines: int = 2) -> DataFrame:
    return marked(df, ("checkbox",), context_lines)


def detect_radios(df: DataFrame, context_lines: int = 2) -> DataFrame:
    return marked(df, ("radio",), context_lines)


def detect_dropdowns(df: DataFrame) -> DataFrame:
    return marked(df, ("dropdown",), 0)


def detect_elements(df: DataFrame, context_lines: int = 2) -> DataFrame:
    return marked(df, ("checkbox", "radio", "dropdown"), context_lines)


def element_counts(elements: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("type") == k).alias(f"{k}_count")
    return elements.groupBy("doc_id").agg(kind("checkbox"), kind("radio"), kind("dropdown"), F.count("*").alias("total_elements"))


@F.udtf(returnType=T.StructType().add("type", "string").add("checked", "boolean").add("label", "string").add("value", "string").add("line", "integer").add("position", "integer"))
class FormElements:
    """The elements of one text, for LATERAL use in SQL after spark.udtf.register."""

    def eval(self, text: str):
        yield from elements_of(text, ("checkbox", "radio", "dropdown"))
