"""Text tests and extractions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that belong in a printed dimension, and the limits of one.
DIMENSION_WORDS = r"(?i)(?<!{c})(road|wide|widening|setback|set\s*-?back|plot|site|building|width|depth|length|clear|ht|height|dia|mtr|mts|metre|meter|feet|foot|inch|sq|smt|mm|cm|m|ft|in)(?!{c})"
DIMENSION_MARKS = r"[0-9\s.,;:/()\[\]{}<>~=+*&%@#$^_|\\'\"×xX-]"
MAX_CHARS, MAX_LETTERS = 32, 3
#: How feet with inches and numbers with a unit are printed, spellings of units, the largest bare number.
FEET_INCHES = r"(\d+(?:\.\d+)?)\s*'\s*-?\s*(\d+(?:\.\d+)?)\s*\"?"
NUMBER_UNIT = r"(?i)(\d*\.\d+|\d+)\s*(mm|cm|m|ft|feet|in|inch|inches|sq\.?\s?ft|sqft|sq\.?\s?m|sqm|sq\.?\s?mt|'|\")?"
UNIT_SPELLINGS = {"feet": "ft", "inch": "in", "inches": "in", "'": "ft", '"': "in", "sqft": "sq_ft", "sq.ft": "sq_ft", "sqm": "sq_m", "sq.m": "sq_m", "sq.mt": "sq_m"}
MOST_BARE = 1000.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once however often it is used; inside a lambda, once for each of its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9, dot and hyphen; all else separates."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9\s.\-]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def looks_like_dimension(text: Column, ascii_words: bool = False) -> Column:
    """Short, no numbered clause, and few letters besides a dimension's own words.

    Words are bounded by characters that are no letter, digit or underscore; with
    ascii_words only those of ASCII count as such, so that "è" ends a word.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    words = DIMENSION_WORDS.replace("{c}", "[A-Za-z0-9_]" if ascii_words else r"[\p{L}\p{N}_]")
    left = F.regexp_replace(F.regexp_replace(t, words, " "), DIMENSION_MARKS, "")
    return (t != "") & (F.length(t) <= MAX_CHARS) & ~t.rlike(r"^\s*[0-9]+\s*[.)]\s*[A-Za-z]") & (F.length(left) <= MAX_LETTERS)


def unit_token(raw: Column) -> Column:
    """The usual name of a printed unit, itself if it has no other; null for none."""
    key = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit(""))
    table = F.create_map(*[F.lit(v) for kv in UNIT_SPELLINGS.items() for v in kv])
    return F.when(key != "", F.coalesce(F.element_at(table, key), key))


def candidate_confidence(unit: Column, feet_inches: Column, ocr: Column | None = None) -> Column:
    """0.85 for feet with inches, 0.75 with a unit, else 0.55; the mean with the confidence of the reading, where it was read by OCR."""
    base = F.when(feet_inches, 0.85).when(unit.isNotNull(), 0.75).otherwise(0.55)
    blended = base if ocr is None else F.coalesce((base + ocr) / 2.0, base)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), blended)), 3)


def dimension_candidate(text: Column, ocr: Column | None = None) -> Column:
    """struct(value, unit, confidence) of a text that is a printed dimension, else null.

    Feet with inches below 12 come first, in decimal feet and the unit ft_in; else
    the first number with the unit behind it. A bare number over MOST_BARE is none.
    """
    t = F.trim(text)
    feet, inches, number = (F.regexp_extract(t, p, g).try_cast("double") for p, g in ((FEET_INCHES, 1), (FEET_INCHES, 2), (NUMBER_UNIT, 1)))
    unit = unit_token(F.regexp_extract(t, NUMBER_UNIT, 2))
    mixed = F.coalesce((inches >= 0) & (inches < 12), F.lit(False))
    made = F.struct(
        F.when(mixed, feet + inches / 12.0).otherwise(number).alias("value"), F.when(mixed, "ft_in").otherwise(unit).alias("unit"), candidate_confidence(unit, mixed, ocr).alias("confidence")
    )
    fits = mixed | (number.isNotNull() & (unit.isNotNull() | (number <= MOST_BARE)))
    return F.when(looks_like_dimension(text) & fits, made)


#: A drawing scale as printed, contexts in which such a ratio is none, and its denominators.
SCALE_NOTE = r"(?i)(\bscale\b\s*[:\-]?\s*)?\b1\s*[:=]\s*(\d{1,4})\b(?!\s*[:=]\s*\d)"
NO_SCALE = r"(?i)\b(far|f\.a\.r|ratio|floor\s+area|coverage|date|version|ward|no\.?\s*of)\b"
MIXTURE = r"(?i)\b(c\.?m|c\.?c|p\.?c\.?c|r\.?c\.?c|r\.?r|mix|mortar|cement|concrete|brick|block\s*work|plaster|screed|grout|proportion)\b"
DENOMINATORS = (10, 5000)


def scale_notes(text: Column) -> Column:
    """array of struct(denominator, keyword): the scales ``1:N`` of a text, and whether each says so; none in other contexts."""
    words, numbers = (F.regexp_extract_all(text, F.lit(SCALE_NOTE), F.lit(i)) for i in (1, 2))
    notes = F.zip_with(numbers, words, lambda n, w: F.struct(n.cast("int").alias("denominator"), (w != "").alias("keyword")))
    kept = F.filter(notes, lambda s: s["denominator"].between(*DENOMINATORS))
    return F.when(text.rlike(NO_SCALE) | text.rlike(MIXTURE), F.slice(kept, 1, 0)).otherwise(kept)


def points_per_metre(denominator: Column) -> Column:
    return F.lit(72000.0) / (F.lit(25.4) * denominator)


#: Fixed value: a reference to rows of a table.
ROW_FORMULA = r"\(\s*\d+(?:\.\d+)?(?:\s*[-+*/x×]\s*\d+(?:\.\d+)?)+\s*\)"


def without_row_formula(text: Column) -> Column:
    """With a blank instead of references such as ``(1-2)`` to table rows."""
    return F.regexp_replace(text, ROW_FORMULA, " ")


#: Fixed value: ways to print a number of floors.
FLOOR_COUNT = r"(?i)\b(?:g(?:round|f)?\s*\+\s*(\d+)|no\.?\s*of\s*floors?\s*[:\-]?\s*(\d+)|(\d+)\s*(?:storey|story|floors?)\b(?!\s*plans?\b))"


def floor_count(text: Column) -> Column:
    """Floors from the leftmost G+N (one more), `no. of floors: N` or `N storey` that is no caption of a plan; null without."""
    plus, named, storeys = (F.regexp_extract(text, FLOOR_COUNT, i).try_cast("int") for i in (1, 2, 3))
    return F.coalesce(plus + 1, named, storeys)


def development_area(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, r"(?i)\bdevelopment\s+area\b[^A-Za-z0-9]{0,10}([ABC])\b", 1), F.lit("")))


def labelled_areas(text: Column) -> Column:
    """All labelled areas: array of struct(label, value, unit)."""
    pattern = r"(?i)\b(carpet|built[\s-]*up|plinth|floor)\s+area\b[^0-9]{0,12}([0-9]+(?:\.[0-9]+)?)\s*(sq\.?\s*m|m2|sq\.?\s*ft|ft2)"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "lvu", strict=True)]), lambda s: F.struct(F.lower(s["l"]).alias("label"), s["v"].cast("double").alias("value"), F.when(F.lower(s["u"]).contains("ft"), "ft2").otherwise("m2").alias("unit")))


#: Uses of a building, and other spellings of them.
USES = ("residential", "commercial", "public_semi_public", "traffic_transportation", "public_utility", "hospital", "health_centre_nursing_home", "nursery_primary_school", "secondary_school", "college")
USE_ALIASES = {
    "residential building": "residential",
    "house": "residential",
    "commercial building": "commercial",
    "public and semi public": "public_semi_public",
    "public & semi public": "public_semi_public",
    "public semi public": "public_semi_public",
    "traffic and transportation": "traffic_transportation",
    "traffic transportation": "traffic_transportation",
    "public utility": "public_utility",
    "health centre": "health_centre_nursing_home",
    "health center": "health_centre_nursing_home",
    "nursing home": "health_centre_nursing_home",
    "health centre/nursing home": "health_centre_nursing_home",
    "nursery school": "nursery_primary_school",
    "primary school": "nursery_primary_school",
    "nursery/primary school": "nursery_primary_school",
    "secondary school": "secondary_school",
}


def building_use(raw: Column) -> Column:
    """The use that a text names, null if it names none."""
    name = F.trim(F.regexp_replace(F.replace(F.lower(raw), F.lit("-"), F.lit(" ")), r"\s+", " "))
    table = {u: u for u in USES} | USE_ALIASES
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), name)


def first_keyword(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The value of the first keyword of an ordered table that a text contains."""
    low = F.lower(text)
    return reduce(lambda rest, kv: F.when(low.contains(kv[0]), kv[1]).otherwise(rest), reversed(table), F.lit(default))


def json_answer(text: Column) -> Column:
    """The JSON of a model's answer: without reasoning and fences at its ends if that can be parsed, else from the first brace
    to the last; null if neither can."""
    ends = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    clean = ends(F.regexp_replace(ends(text), r"(?is)<think>.*?</think>", ""))
    clean = F.when(clean.startswith("```"), F.regexp_replace(F.regexp_replace(clean, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(clean)
    begin, end = F.instr(clean, "{"), F.length(clean) - F.instr(F.reverse(clean), "}") + 1
    inner = F.when((begin > 0) & (end > begin), F.substr(clean, begin, end - begin + 1))
    return F.when(F.try_parse_json(clean).isNotNull(), clean).when(F.try_parse_json(inner).isNotNull(), inner)


def _fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, as format_string prints it; decimals are quicker where the number is small enough."""
    kind = f"decimal(18,{digits})"
    # Numbers below 0, and -0, keep their sign even where they round to 0.
    plain = (value > 0) & (value < 1e7)
    return F.when(plain, F.round(value, digits).cast(kind).cast("string")).otherwise(F.format_string(f"%.{digits}f", value))


def _short(value: Column) -> Column:
    """Six significant digits without trailing zeros, null where that takes an exponent."""
    shown = lambda digits: reduce(lambda rest, d: F.when(digits == d, _fixed(value, d)).otherwise(rest), range(10), F.lit(None).cast("string"))
    ends = lambda t: F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(t)
    text = once(once(5 - F.floor(F.log10(F.abs(value))), shown), ends)
    return F.when(value == 0, "0").when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e6), text)


def value_forms(value: Column) -> Column:
    """The ways in which a number may be printed: two decimals, one, six digits at most, and below 1 with a leading dot."""

    def forms(v: Column) -> Column:
        dot = lambda c: F.when((v > 0) & (v < 1), F.substr(c, F.lit(2)))
        printed = F.struct(_fixed(v, 2).alias("two"), _fixed(v, 1).alias("one"))
        return once(printed, lambda s: F.array_distinct(F.array_compact(F.array(s["two"], s["one"], _short(v), dot(s["two"]), dot(s["one"])))))

    return once(value, forms)


#: Fixed value: numbers of a native text, as they are compared.
NUMBER_TOKEN = r"\d+\.?\d*"


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(0))


def grounded(value: Column, text: Column) -> Column:
    """Whether a number is printed in the text as a token of its own."""
    return F.arrays_overlap(value_forms(value), number_tokens(text))


def grounding(value: Column, evidence: Column, tokens_: Column) -> Column:
    """struct(value, grounded, keep) of a number that a model claims to have read.

    A value that is missing or 0 is taken from the first number of its evidence.
    Without any value it is kept, grounded null; on a page without text (no
    tokens) it is kept, grounded false; else it is kept if it is printed there.
    """
    read = F.regexp_extract(evidence, r"\d+(?:\.\d+)?", 0).try_cast("double")
    v = F.when(value.isNull() | (value == 0), F.coalesce(read, value)).otherwise(value)

    def judged(s: Column) -> Column:
        printed = F.coalesce(F.size(s["tokens"]) > 0, F.lit(False)) & F.arrays_overlap(value_forms(s["value"]), s["tokens"])
        bare = F.coalesce(F.size(s["tokens"]), F.lit(0)) == 0
        return once(F.struct(printed.alias("printed"), bare.alias("bare")), lambda t: F.struct(s["value"].alias("value"), F.when(s["value"].isNotNull(), t["printed"]).alias("grounded"), (s["value"].isNull() | t["bare"] | t["printed"]).alias("keep")))

    return once(F.struct(v.alias("value"), tokens_.alias("tokens")), judged)


def token_in_text(value: Column, text: Column) -> Column:
    """Whether one of the three plain forms of a number stands anywhere in the text."""
    return F.coalesce(text.contains(F.format_string("%.2f", value)) | text.contains(F.format_string("%.1f", value)) | text.contains(_short(value)), F.lit(False))


#: Ordered words of file names, and the kind of document and the city that they tell.
DOC_TYPES = [
    ("nbc", "NBC"), ("national_building", "NBC"), ("amendment", "AMENDMENT"), ("amendments", "AMENDMENT"), ("notification", "AMENDMENT"), ("gazette", "AMENDMENT"), ("revised setback", "AMENDMENT"), ("parking", "PARKING"), ("fire", "FIRE"),
    ("dcr", "DCR"), ("byelaw", "DCR"), ("bye-law", "DCR"), ("bylaw", "DCR"), ("building_bylaw", "DCR"), ("zoning", "DCR"), ("master_plan", "DCR"),
]
CITIES = [
    ("nbc", "NATIONAL"), ("national_building", "NATIONAL"), ("bbmp", "Bengaluru"), ("bangalore", "Bengaluru"), ("bengaluru", "Bengaluru"), ("mcgm", "Mumbai"), ("mumbai", "Mumbai"), ("dda", "Delhi"), ("delhi", "Delhi"), ("pmc", "Pune"), ("pune", "Pune"), ("gvmc", "Vizag"),
]


def document_kind(file_name: Column) -> Column:
    return first_keyword(file_name, DOC_TYPES, "UNKNOWN")


def document_city(file_name: Column) -> Column:
    return first_keyword(file_name, CITIES, "UNKNOWN")


# ---------------------------------------------------------------- values beside their labels

#: Labels of values in one text, most special first, their fields and units; qualifiers of what is built, and of limits.
LABELLED = [
    ("plot.net_area", r"(?i)NET\s+(?:AREA\s+OF\s+)?PLOT[^0-9\-]{0,20}(\d+(?:\.\d+)?)", "m2"),
    ("plot.area", r"(?i)(?:AREA\s+OF\s+PLOT|PLOT\s+AREA|SITE\s+AREA)[^0-9\-]{0,20}(\d+(?:\.\d+)?)", "m2"),
    ("building.footprint_area", r"(?i)(?:PROPOSED\s+COVERAGE\s+AREA|GROUND\s+COVERAGE\s+AREA|GROUND\s+FLOOR\s+AREA|PLINTH\s+AREA)[^0-9\-]{0,20}(\d+(?:\.\d+)?)", "m2"),
    ("coverage", r"(?i)COVERAGE[^0-9\-%]{0,20}(\d+(?:\.\d+)?)\s*%", "%"),
    ("far", r"(?i)\bFAR\b[^0-9\-%]{0,20}(\d+(?:\.\d+)?)", "ratio"),
    ("building.gross_built_up_area", r"(?i)(?:TOTAL|GROSS)\s+BUILT[- ]?UP\s+AREA[^0-9\-]{0,20}(\d+(?:\.\d+)?)", "m2"),
]
BUILT, LIMIT = r"(?i)ACHIEVED|\bNET\b|PROPOSED", r"(?i)PERMISSIBLE|ALLOWABLE|\bMAX\b|\bPERM\b|BALANCE|\bTDR\b|PREMIUM|\bTOTAL\b"
#: A road's width, units of it, and words of the sides of a plot.
ROAD_WIDTH = r"(?i)(\d+(?:\.\d+)?)\s*(m|mt|mtr|metres?|meters?|ft|feet|foot)?\s*(?:WIDE\s+)?R\s*O\s*A\s*D\b"
SIDE_WORDS = {"front": "FRONT", "rear": "REAR|BACK", "left": "LEFT", "right": "RIGHT"}


def labelled_values(text: Column) -> Column:
    """array of struct(field, value, unit): the labelled values of one text, row references left out."""
    clean = without_row_formula(text)
    found = [F.struct(F.lit(n).alias("field"), F.regexp_extract(clean, p, 1).try_cast("double").alias("value"), F.lit(u).alias("unit")) for n, p, u in LABELLED]
    return F.filter(F.array(*found), lambda s: s["value"].isNotNull())


def label_rank(text: Column) -> Column:
    """0 for a label of what is built, 1 for one without qualifier, 2 for a limit or a remainder."""
    return F.when(text.rlike(BUILT), 0).when(text.rlike(LIMIT), 2).otherwise(1)


def road_width(text: Column) -> Column:
    """Metres of a text such as ``9.14 M WIDE ROAD``; null without."""
    unit = F.lower(F.regexp_extract(text, ROAD_WIDTH, 2))
    return F.regexp_extract(text, ROAD_WIDTH, 1).try_cast("double") * F.when(unit.isin("ft", "feet", "foot"), 0.3048).otherwise(1.0)


def setback_label(text: Column, side: str) -> Column:
    """The number behind ``FRONT SETBACK`` and its like; null without."""
    return F.regexp_extract(text, rf"(?i)\b(?:{SIDE_WORDS[side]})\s*SETBACK\b[^0-9\-]{{0,15}}(\d+(?:\.\d+)?)", 1).try_cast("double")


#: Kinds of dimensions by the words of their labels.
DIMENSION_LABELS = {
    "PLOT_WIDTH": r"(?i)\b(plot|site|property)\b.*\b(width|frontage)\b",
    "PLOT_DEPTH": r"(?i)\b(plot|site|property)\b.*\b(depth|length)\b",
    "BUILDING_WIDTH": r"(?i)\b(building|house|block)\b.*\b(width)\b",
    "BUILDING_DEPTH": r"(?i)\b(building|house|block)\b.*\b(depth|length)\b",
    "ROAD_WIDTH": r"(?i)\broad\b",
}
SETBACK_WORD, SIDE_LABELS = r"(?i)\bset\s*-?back\b", {"front": r"(?i)\bfront\b", "rear": r"(?i)\b(rear|back)\b", "left": r"(?i)\bleft\b", "right": r"(?i)\bright\b"}
ROOM_WORD = r"(?i)\b(bed\s*room|bedroom|kitchen|hall|toilet|bath(room)?|w\.?c\.?|living|dining|store|balcony|passage|room|verandah|veranda|puja|study)\b"


def keyword_scores(label: Column) -> Column:
    """map kind -> score of a label's words: 1 for a named setback (0.25 each where no side is named), 0.6 for the others."""
    label = F.coalesce(label, F.lit(""))
    setback, named = label.rlike(SETBACK_WORD), [label.rlike(p) for p in SIDE_LABELS.values()]
    some = reduce(lambda a, b: a | b, named)
    parts = [F.when(setback & hit, F.struct(F.lit(f"{s.upper()}_SETBACK").alias("key"), F.lit(1.0).alias("value"))).when(setback & ~some, F.struct(F.lit(f"{s.upper()}_SETBACK").alias("key"), F.lit(0.25).alias("value"))) for s, hit in zip(SIDE_LABELS, named, strict=True)]
    parts += [F.when(label.rlike(p), F.struct(F.lit(k).alias("key"), F.lit(0.6).alias("value"))) for k, p in [("ROOM_DIMENSION", ROOM_WORD), *DIMENSION_LABELS.items()]]
    return F.map_from_entries(F.filter(F.array(*parts), lambda s: s.isNotNull()))
