"""Field extraction from recognized text: tables of patterns, turned into native column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldSpec:
    """Patterns in the order they are tried, a cleaner and a check by name."""

    name: str
    clean: str
    check: str
    patterns: tuple[str, ...]


# Field, cleaner, check, patterns. Matching ignores case; ^ and $ match at lines.
SPECS = (
    FieldSpec("student_name", "name", "name", (
        r"(?:name|student\s+name|applicant\s+name|full\s+name|name\s+of\s+student|name\s+of\s+applicant)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+?)(?:\s+[Dd][Oo][Bb]|\n|phone|email|address|gender|$)",
        r"(?:name|student\s+name|applicant\s+name)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+?)(?:\s+[Dd][Oo][Bb]|\n|phone|email|address|gender|$)",
        r"(?:name|student\s+name)[:\s]+([^\n]{3,50}?)(?:\s+[Dd][Oo][Bb]|\n|phone|email|gender|$)",
        r"^([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*$",
    )),
    FieldSpec("date_of_birth", "date", "date", (r"(?:dob|date\s+of\s+birth|birth\s+date|born|date\s+of\s+birth)[:\s]+(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})", r"(?:dob|date\s+of\s+birth)[:\s]+(\d{2}[\/\-]\d{2}[\/\-]\d{4})", r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})")),
    FieldSpec("gender", "upper", "any", (r"(?:gender|sex)[:\s]+(male|female|other|m|f)", r"(?:gender|sex)[:\s]+([MF])")),
    FieldSpec("category", "upper", "any", (r"(?:category|caste)[:\s]+(general|obc|sc|st|other|gen|scheduled\s+caste|scheduled\s+tribe)", r"(?:category|caste)[:\s]+([A-Z]{3,})")),
    FieldSpec("nationality", "name", "any", (r"(?:nationality|country)[:\s]+([A-Za-z\s]+)", r"(?:nationality)[:\s]+([A-Z][a-z]+)")),
    FieldSpec("religion", "name", "any", (r"(?:religion)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("aadhar_number", "id", "digits12", (r"(?:aadhar|aadhaar|uid|aadhar\s+no|aadhaar\s+no|aadhar\s+number)[:\s]+(\d{4}[\s\-]?\d{4}[\s\-]?\d{4})", r"(\d{4}[\s\-]?\d{4}[\s\-]?\d{4})")),
    FieldSpec("blood_group", "upper", "any", (r"(?:blood\s+group|blood\s+type)[:\s]+([ABO][\+\-]?|AB[\+\-]?)", r"(?:blood\s+group)[:\s]+([A-Z]{1,3})")),
    FieldSpec("permanent_address", "address", "address", (r"(?:permanent\s+address|permanent\s+addr)[:\s]+([^\n]+(?:\n[^\n]+){0,4})", r"(?:permanent\s+address)[:\s]+([A-Za-z0-9\s,.-]+(?:\n[A-Za-z0-9\s,.-]+){0,3})")),
    FieldSpec("correspondence_address", "address", "address", (r"(?:correspondence\s+address|correspondence\s+addr|mailing\s+address)[:\s]+([^\n]+(?:\n[^\n]+){0,4})", r"(?:correspondence\s+address)[:\s]+([A-Za-z0-9\s,.-]+(?:\n[A-Za-z0-9\s,.-]+){0,3})")),
    FieldSpec("pincode", "id", "digits6", (r"(?:pincode|pin\s+code|pin)[:\s]+(\d{6})", r"(\d{6})")),
    FieldSpec("city", "name", "name", (r"(?:city)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("state", "name", "name", (r"(?:state)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("phone_number", "phone", "phone", (r"(?:phone|mobile|contact|tel|phone\s+no|mobile\s+no|student\s+phone)[:\s]+([+\d\s\-()]{10,15})", r"(?:phone|mobile)[:\s]+(\d{10,15})", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3,4}\)?[-.\s]?\d{3}[-.\s]?\d{4}")),
    FieldSpec("alternate_phone", "phone", "phone", (r"(?:alternate\s+phone|alt\s+phone|alternate\s+mobile|secondary\s+phone)[:\s]+([+\d\s\-()]{10,15})", r"(?:alternate|alt)[:\s]+(\d{10,15})")),
    FieldSpec("email", "lower", "email", (r"(?:email|e-mail|email\s+id|email\s+address)[:\s]+([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})")),
    FieldSpec("emergency_contact_name", "name", "name", (r"(?:emergency\s+contact|emergency\s+contact\s+name)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",)),
    FieldSpec("emergency_contact_phone", "phone", "phone", (r"(?:emergency\s+contact\s+phone|emergency\s+phone)[:\s]+([+\d\s\-()]{10,15})",)),
    FieldSpec("father_name", "name", "name", (r"(?:father|father'?s\s+name|father\s+name)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"(?:father)[:\s]+([^\n]{3,50})")),
    FieldSpec("father_occupation", "base", "any", (r"(?:father'?s\s+occupation|father\s+occupation)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("father_phone", "phone", "phone", (r"(?:father'?s\s+phone|father\s+phone|father\s+contact)[:\s]+([+\d\s\-()]{10,15})",)),
    FieldSpec("mother_name", "name", "name", (r"(?:mother|mother'?s\s+name|mother\s+name)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"(?:mother)[:\s]+([^\n]{3,50})")),
    FieldSpec("mother_occupation", "base", "any", (r"(?:mother'?s\s+occupation|mother\s+occupation)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("mother_phone", "phone", "phone", (r"(?:mother'?s\s+phone|mother\s+phone|mother\s+contact)[:\s]+([+\d\s\-()]{10,15})",)),
    FieldSpec("guardian_name", "name", "name", (r"(?:guardian|guardian'?s\s+name|guardian\s+name)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"(?:guardian)[:\s]+([^\n]{3,50})")),
    FieldSpec("guardian_relation", "base", "any", (r"(?:guardian\s+relation|guardian\s+relationship|relation)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("guardian_phone", "phone", "phone", (r"(?:guardian'?s\s+phone|guardian\s+phone|guardian\s+contact)[:\s]+([+\d\s\-()]{10,15})",)),
    FieldSpec("annual_income", "number", "any", (r"(?:annual\s+income|income|family\s+income)[:\s]+([\d,\.]+)", r"(?:annual\s+income)[:\s]+([\d]+)")),
    FieldSpec("tenth_board", "base", "any", (r"(?:10th\s+board|10\s+board|tenth\s+board|ssc\s+board)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("tenth_year", "base", "any", (r"(?:10th\s+year|10\s+year|tenth\s+year|ssc\s+year)[:\s]+(\d{4})",)),
    FieldSpec("tenth_percentage", "number", "percent", (r"(?:10th\s+percentage|10\s+percentage|tenth\s+percentage|ssc\s+percentage|10th\s+%)[:\s]+([\d\.]+)",)),
    FieldSpec("tenth_school", "address", "short", (r"(?:10th\s+school|10\s+school|tenth\s+school|ssc\s+school)[:\s]+([^\n]{3,100})",)),
    FieldSpec("twelfth_board", "base", "any", (r"(?:12th\s+board|12\s+board|twelfth\s+board|hsc\s+board|intermediate\s+board)[:\s]+([A-Za-z\s]+)",)),
    FieldSpec("twelfth_year", "base", "any", (r"(?:12th\s+year|12\s+year|twelfth\s+year|hsc\s+year|intermediate\s+year)[:\s]+(\d{4})",)),
    FieldSpec("twelfth_percentage", "number", "percent", (r"(?:12th\s+percentage|12\s+percentage|twelfth\s+percentage|hsc\s+percentage|12th\s+%)[:\s]+([\d\.]+)",)),
    FieldSpec("twelfth_school", "address", "short", (r"(?:12th\s+school|12\s+school|twelfth\s+school|hsc\s+school|intermediate\s+school)[:\s]+([^\n]{3,100})",)),
    FieldSpec("previous_qualification", "address", "short", (r"(?:qualification|education|degree|diploma|previous\s+qualification|educational\s+qualification)[:\s]+([^\n]{3,100})", r"(?:qualification|education)[:\s]+([A-Za-z\s&.,]+)")),
    FieldSpec("graduation_details", "address", "any", (r"(?:graduation|degree\s+details|bachelor)[:\s]+([^\n]{3,200})",)),
    FieldSpec("course_applied", "base", "short", (r"(?:course|program|subject|stream|course\s+applied|program\s+applied|course\s+of\s+study)[:\s]+([^\n]{3,100})", r"(?:course|program)[:\s]+([A-Za-z\s&]+)")),
    FieldSpec("application_number", "id", "any", (r"(?:application\s+no|application\s+number|app\s+no|app\s+number)[:\s]+([A-Z0-9\-]+)",)),
    FieldSpec("enrollment_number", "base", "any", (r"(?:enrollment\s+no|enrollment\s+number|enrol\s+no|enrolment\s+number|roll\s+no|roll\s+number)[:\s]+([A-Z0-9\-\/]+)", r"(?:enrollment|enrolment|roll)[:\s]+([A-Z0-9\-\/]+)")),
    FieldSpec("admission_date", "date", "date", (r"(?:admission\s+date|date\s+of\s+admission)[:\s]+(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})",)),
)


def gate(pattern: str, spaced: bool = False) -> tuple[str, ...]:
    """Words with one of which, in lower case, any match of the pattern begins; none for patterns without labels. ("@",): a
    match holds an @ somewhere. spaced: white space in the text is single spaces, so that labels of several words are whole."""
    m = re.match(r"\(\?:([^)]*)\)", pattern)
    if not m:
        return ("@",) if "@" in pattern else ()
    words = [re.match(r"([a-z0-9-]*)(?![?*{])", a) for a in m[1].split("|")]
    if not all(w and w[1] for w in words):
        return ()
    if spaced:
        words = [re.match(r"([a-z0-9% -]*)(?![?*{])", a.replace(r"\s+", " ")) for a in m[1].split("|")]
    own = {w[1] for w in words}
    return tuple(sorted(w for w in own if not spaced or not any(w != v and w.startswith(v) for v in own)))


def led(pattern: str, words: tuple[str, ...]) -> str:
    """The pattern, tried only where the first letters, each by itself, are ones that some word begins with."""
    heads = ["".join(sorted({w[i] for w in words})) for i in range(min(4, *map(len, words)))]
    return "(?=" + "".join(f"[{re.escape(h)}]" for h in heads) + ")" + pattern


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean(value: Column, how: str) -> Column:
    kept = {"phone": r"[^\d+]", "date": r"[^\d/\-.]", "id": r"[^\d\-]", "number": r"[^\d.]"}
    if how in kept:  # what these keep, the steps below would keep, too
        return F.regexp_replace(value, kept[how], "")
    v = F.trim(F.regexp_replace(F.regexp_replace(value, r"(?U)[^\w\s@.,\-+()/]", ""), r"(?U)\s+", " "))
    return {"base": lambda: v, "name": lambda: F.initcap(v), "lower": lambda: F.lower(v), "address": lambda: F.trim(F.btrim(v, F.lit(","))), "upper": lambda: F.upper(v)}[how]()


def is_valid(v: Column, check: str) -> Column:
    n = F.char_length(v)
    digits = lambda: F.char_length(F.regexp_replace(v, r"\D", ""))
    own = {
        "any": lambda: n >= 2,
        "name": lambda: n.between(2, 50) & v.rlike("[a-zA-Z]"),
        "email": lambda: (n >= 5) & F.coalesce(F.try_element_at(F.split(v, "@"), F.lit(2)).contains("."), F.lit(False)),
        "phone": lambda: (n >= 2) & digits().between(10, 15),
        "date": lambda: n.between(8, 12),
        "address": lambda: n >= 10,
        "digits12": lambda: (n >= 2) & (digits() == 12),
        "digits6": lambda: (n >= 2) & (digits() == 6),
        "short": lambda: n.between(3, 100),
        "percent": lambda: (n >= 2) & F.coalesce(v.try_cast("double").between(0, 100), F.lit(False)),
    }
    return own[check]()


def extract_fields(df: DataFrame, text: str = "raw_text", specs: tuple[FieldSpec, ...] = SPECS, mode: str = "collapsed", form_type: Column | None = None, only: dict[str, Column] | None = None) -> DataFrame:
    """Adds one column for each spec: the first pattern's value that is valid once cleaned, else NULL.

    mode: "collapsed" matches on the text with all white space made single spaces, "lines" on the text as it is.
    form_type: a boolean column; rows where it isn't true get NULL; only: likewise for single fields. Each pattern runs only on texts with its label, from
    the first of them on, and where no pattern before it gave a valid value.
    """
    whole = collapse(F.col(text)) if mode == "collapsed" else F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_text": whole}).withColumns({"_low": F.lower("_text")})
    # lowering a letter may give two, and a place counts letters beyond 16 bits as two; places are told where neither happens
    df = df.withColumns({"_ascii": F.octet_length("_text") == F.char_length("_text"), "_bytes": F.col("_text").cast("binary")})
    df = df.withColumns({"_even": F.col("_ascii") | ((F.char_length("_low") == F.char_length("_text")) & ~F.col("_text").rlike(r"[\x{10000}-\x{10FFFF}]"))})
    texts, low, rest = F.col("_text"), F.col("_low"), F.lit(1 << 30)
    places: dict[tuple[str, ...], Column] = {}

    def value(s: FieldSpec, pattern: str) -> Column:
        words, own, on = gate(pattern, mode == "collapsed"), texts, None
        if words == ("@",):
            on = low.contains("@")
        elif words:
            if words not in places:  # a literal of four letters is found in leaps; locate would compare at each letter
                at = F.array_min(F.array_remove(F.array(*[F.regexp_instr(low, F.lit(w)) if len(w) > 3 else F.when(low.contains(w), F.regexp_instr(low, F.lit(w))) for w in words]), 0))
                # ASCII is cut by bytes: no letters need be counted
                places[words] = F.when(F.col("_ascii"), F.substring(F.col("_bytes"), at, rest).cast("string")).when(F.col("_even"), F.substring(texts, at, rest)).when(at.isNotNull(), texts)
            own = places[words]
        elif r"\d" in pattern:
            on = low.rlike(r"\d")
        for wanted in (form_type, (only or {}).get(s.name)):
            on = wanted if on is None else on if wanted is None else wanted & on
        found = clean(F.regexp_extract(own if on is None else F.when(on, own), "(?im)" + (pattern if own is texts else led(pattern, words)), 1), s.clean)
        return F.get(F.filter(F.array(found), lambda v: is_valid(v, s.check)), F.lit(0))

    # the filters by a function also keep Spark from compiling all patterns into one method, which the JVM would only interpret
    out = {s.name: F.coalesce(*[value(s, p) for p in s.patterns]) for s in specs}
    return df.withColumns(out).drop("_text", "_low", "_ascii", "_even", "_bytes")


def extract_by_type(df: DataFrame, form_type: str, profiles: dict[str, tuple[FieldSpec, ...]], text: str = "raw_text", mode: str = "collapsed", default: str | None = None) -> DataFrame:
    """Adds the fields of all profiles; a row gets those of the profile that the column form_type names, the others are NULL.

    A row of another type, or none, gets the default profile's, or NULL. Profiles may hold one field by different patterns;
    a spec that several share is matched once, and a row runs its own profile's patterns only. In a profile that names a field twice the first valid value counts.
    """
    if default is not None and default not in profiles:
        raise ValueError(f"no profile {default}")
    kind = F.when(F.col(form_type).isin(*profiles), F.col(form_type)).otherwise(F.lit(default))
    users: dict[FieldSpec, list[str]] = {}
    for name, specs in profiles.items():
        for s in specs:
            users.setdefault(s, []).append(name)
    own = tuple(replace(s, name=f"_own_{i}") for i, s in enumerate(users))
    out = extract_fields(df, text, own, mode, only={o.name: kind.isin(*types) for o, types in zip(own, users.values())})
    fields: dict[str, list[Column]] = {}
    for o, s in zip(own, users):
        fields.setdefault(s.name, []).append(F.col(o.name))
    return out.withColumns({name: F.coalesce(*found) for name, found in fields.items()}).drop(*[o.name for o in own])


def validation_report(forms: DataFrame, key: str = "id", specs: tuple[FieldSpec, ...] = SPECS) -> DataFrame:
    """key, field and value of every filled field that fails its check as it stands."""
    own = [s for s in specs if s.name in forms.columns]
    bad = lambda s: F.nullif(F.trim(s.name), F.lit("")).isNotNull() & ~F.coalesce(is_valid(F.col(s.name), s.check), F.lit(False))
    found = F.array_compact(F.array(*[F.when(bad(s), F.struct(F.lit(s.name).alias("field"), F.col(s.name).alias("value"))) for s in own]))
    return forms.select(key, F.explode(found).alias("f")).select(key, "f.field", "f.value")


def to_structured(names: list[str]) -> Column:
    """The fields found, as a map."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])), lambda k, v: v.isNotNull())


# The patterns of the nine-field profile; group 1 is taken, or the whole where it is empty.
LITE = {
    "student_name": (r"(?i)(?:name|student\s+name|applicant\s+name|full\s+name)[:\s]+([a-z\s]+?)(?:\n|phone|dob|email|address|$)", r"(?m)^([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*$"),
    "name_check": (r"(?i)^[a-z\s'-]+$",),
    "email": (r"(?i)([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",),
    "phone_number": (r"(?i)(?:phone|mobile|contact|tel)[:\s]+([+\d\s\-()]{10,15})", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\d{10,15}"),
    "date_of_birth": (r"(?i)(?:dob|date\s+of\s+birth|birth\s+date|born)[:\s]+(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})", r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})"),
    "address": (r"(?i)(?:address|residence|location)[:\s]+([^\n]+(?:\n[^\n]+){0,3})",),
    "guardian_name": (r"(?i)(?:guardian|parent|father|mother)[:\s]+([a-z\s]+?)(?:\n|phone|email|$)",),
    "guardian_phone": (r"(?i)(?:guardian|parent)[\s\w]*phone[:\s]+([+\d\s\-()]{10,15})",),
    "course_applied": (r"(?i)(?:course|program|subject|stream)[:\s]+([^\n]+)",),
    "previous_qualification": (r"(?i)(?:qualification|education|degree|diploma)[:\s]+([^\n]+)",),
}


def extract_fields_lite(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Nine fields by line-aware patterns."""
    t = F.coalesce(F.col(text), F.lit(""))
    get = lambda p, group=1: F.trim(F.regexp_extract(t, p, group))
    digits = lambda c: F.regexp_replace(c, r"[^\d+]", "")
    between = lambda c, lo, hi: F.when((F.char_length(c) > lo) & (F.char_length(c) < hi), c)
    tidy = lambda c: F.initcap(F.regexp_replace(c, r"\s+", " "))
    labelled, plain, bare = LITE["phone_number"]
    phones = [digits(get(labelled)), digits(F.coalesce(F.nullif(get(plain), F.lit("")), get(plain, 0))), get(bare, 0)]
    lines = F.filter(F.transform(F.split(get(LITE["address"][0]), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    address, guardian_phone = F.array_join(lines, ", "), digits(get(LITE["guardian_phone"][0]))
    return df.withColumns({
        "student_name": F.coalesce(*[F.when(get(p).rlike(LITE["name_check"][0]), tidy(between(get(p), 2, 50))) for p in LITE["student_name"]]),
        "email": F.nullif(F.lower(get(LITE["email"][0])), F.lit("")),
        "phone_number": F.coalesce(*[between(p, 9, 16) for p in phones]),
        "date_of_birth": F.coalesce(*[between(get(p), 7, 13) for p in LITE["date_of_birth"]]),
        "address": F.when(F.char_length(address) > 10, address),
        "guardian_name": tidy(between(get(LITE["guardian_name"][0]), 2, 50)),
        "guardian_phone": F.when(F.char_length(guardian_phone) >= 10, guardian_phone),
        "course_applied": between(get(LITE["course_applied"][0]), 3, 100),
        "previous_qualification": between(get(LITE["previous_qualification"][0]), 3, 100),
    })
