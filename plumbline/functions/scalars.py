"""Column expressions for dates, numbers on screen, labels and JSON pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_date(value: ColumnLike, strict: bool = True) -> Column:
    """Date from text in one of five layouts; an unknown layout is an error unless ``strict`` is off."""
    text = F.trim(_c(value).cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in fixed.DATE_FORMATS]).cast("date")
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("Unrecognised date "), text)).cast("date")
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(problem)


def _bare_number(text: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"[,$%]", ""))


def is_integer_text(text: ColumnLike) -> Column:
    return _bare_number(text).rlike(r"^-?\d+$")


def parse_number(text: ColumnLike) -> Column:
    """Plain number shown on screen (``$1,234``, ``12%``, ``-.5``); null for anything else (``$240K``)."""
    bare = _bare_number(text)
    return F.when(bare.rlike(r"^-?\d+$|^-?\d*\.\d+$"), bare.try_cast("double"))


def _lines(text: ColumnLike) -> Column:
    return F.transform(F.split(_c(text), fixed.LINE_BREAK), lambda line: F.trim(line))


def last_line(text: ColumnLike) -> Column:
    """Last non-empty line of a card."""
    return F.try_element_at(F.filter(_lines(text), lambda line: line != ""), F.lit(-1))


def total_value(text: ColumnLike, offset: int = 1) -> Column:
    """Number that follows the ``Total`` line of a table's text."""
    lines = _lines(text)
    place = F.array_position(lines, F.lit("Total"))
    return F.when(place > 0, parse_number(F.get(lines, (place - 1 + offset).cast("int"))))


def slug(text: ColumnLike, limit: int = 80) -> Column:
    hyphens = F.regexp_replace(F.lower(_c(text).cast("string")), r"[^a-z0-9]+", "-")
    short = F.btrim(F.substring(F.btrim(hyphens, F.lit("-")), 1, limit), F.lit("-"))
    return F.when(short == "", "article").otherwise(short)


def anchor_slug(text: ColumnLike) -> Column:
    short = F.btrim(F.regexp_replace(F.coalesce(_c(text).cast("string"), F.lit("")), r"[^A-Za-z0-9_-]+", "-"), F.lit("-"))
    return F.when(short == "", "component").otherwise(short)


def first_sentence(text: ColumnLike) -> Column:
    head = F.get(F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"(?<=[.!?])\s+"), F.lit(0))
    return F.trim(F.regexp_replace(F.trim(head), r"\.+$", ""))


def first_clause(text: ColumnLike, limit: int = 110) -> Column:
    words = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))
    body = F.regexp_replace(words, "^Defect: ", "")
    head = F.trim(F.get(F.split(body, fixed.CLAUSE_END, 2), F.lit(0)))
    clause = F.when(head == "", body).otherwise(head)
    cut = F.regexp_replace(F.substring(clause, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(clause) <= limit, clause).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+$", ""), F.lit("...")))


def strip_prefix(text: ColumnLike, prefix: ColumnLike) -> Column:
    body = F.trim(F.coalesce(_c(text), F.lit("")))
    head = F.concat(_c(prefix), F.lit(": "))
    return F.when(F.coalesce(F.startswith(body, head), F.lit(False)), F.substr(body, F.length(head) + 1)).otherwise(body)


def format_number(value: ColumnLike) -> Column:
    """Thousands separators; whole numbers without decimals, others with at most two; empty for null."""
    number = _c(value).cast("double")
    whole = number == F.floor(number)
    two = F.regexp_replace(F.format_number(F.bround(number, 2), 2), r"\.?0+$", "")
    return F.when(number.isNull(), "").when(whole, F.format_number(number, 0)).otherwise(two)


def spell(count: ColumnLike) -> Column:
    number = _c(count).cast("int")
    words = F.array(*[F.lit(w) for w in fixed.NUMBER_WORDS])
    return F.when(number.between(0, len(fixed.NUMBER_WORDS) - 1), F.get(words, number)).otherwise(format_number(number))


def pretty_key(key: ColumnLike) -> Column:
    base = F.regexp_replace(F.trim(_c(key).cast("string")), r"(?i)_table$", "")
    text = F.trim(F.regexp_replace(base, r"[_\-]+", " "))
    return F.when(text == "", _c(key)).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))


def figure_name(kind: ColumnLike, key: ColumnLike) -> Column:
    base = pretty_key(key)
    titled = F.when(F.contains(F.lower(base), F.lit("total")), base).otherwise(F.concat(base, F.lit(" total")))
    return F.when(_c(kind) == "card", _c(key).cast("string")).otherwise(titled)


def screen_date(text: ColumnLike) -> Column:
    """``M/D/YYYY`` as shown on screen, else null."""
    value = F.trim(_c(text).cast("string"))
    return F.when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(value, F.lit("M/d/yyyy")).cast("date"))


def date_range_text(start: ColumnLike, end: ColumnLike) -> Column:
    """``July 1–13``, ``July 1 – August 3`` or the full dates across years."""
    a, b = _c(start), _c(end)

    def part(d, fmt):
        return F.date_format(d, fmt)
    same_month = (F.year(a) == F.year(b)) & (F.month(a) == F.month(b))
    return (F.when(a == b, part(a, "MMMM d"))
            .when(same_month, F.concat(part(a, "MMMM d"), F.lit("–"), part(b, "d")))
            .when(F.year(a) == F.year(b), F.concat(part(a, "MMMM d"), F.lit(" – "), part(b, "MMMM d")))
            .otherwise(F.concat(part(a, "MMMM d, yyyy"), F.lit(" – "), part(b, "MMMM d, yyyy"))))


def range_relation(old_start: ColumnLike, old_end: ColumnLike, new_start: ColumnLike, new_end: ColumnLike) -> Column:
    """same / narrowed / widened / moved for two date ranges; null when a date is missing."""
    a, b, c, d = _c(old_start), _c(old_end), _c(new_start), _c(new_end)
    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return F.when(known, F.when((a == c) & (b == d), "same").when((c >= a) & (d <= b), "narrowed")
                  .when((c <= a) & (d >= b), "widened").otherwise("moved"))


def weekday_name(day: ColumnLike) -> Column:
    return F.date_format(_c(day), "EEEE")


def pointer_value(document: ColumnLike, pointer: str) -> Column:
    """JSON text at an RFC 6901 pointer of a JSON document column, null when absent."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("expected a JSON pointer")
    path = "$"
    for token in pointer.split("/")[1:]:
        name = token.replace("~1", "/").replace("~0", "~")
        path += f"[{name}]" if name.isdigit() else "['" + name.replace("'", "\\'") + "']"
    return F.to_json(F.try_variant_get(F.try_parse_json(_c(document)), path, "variant"))


def pointer_path(pointer: ColumnLike) -> Column:
    """Path of a JSON pointer held in a column: every token one step, numbers as positions; the leading slash is optional."""
    steps = F.transform(F.split(F.regexp_replace(_c(pointer), "^/", ""), "/"), lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(
        F.concat(F.lit("['"), F.replace(F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")), F.lit("'"), F.lit("\\'")), F.lit("']"))))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def type_tag(json_text: ColumnLike) -> Column:
    """Type of a JSON value; every fractional number counts as one type, whole numbers as another."""
    tag = F.schema_of_variant(F.try_parse_json(_c(json_text)))
    # a whole number beyond 64 bits is held as a decimal too; its text tells
    return F.when(_c(json_text).rlike(r"^\s*-?[0-9]+\s*$"), "BIGINT").otherwise(F.regexp_replace(tag, r"DECIMAL\(\d+,\d+\)|DOUBLE", "FLOAT"))


def typed_equal(a: ColumnLike, b: ColumnLike) -> Column:
    """Equal value and equal JSON type (1, 1.0 and true all differ), recursively."""
    left, right = _c(a), _c(b)
    same = F.to_json(F.try_parse_json(left)) == F.to_json(F.try_parse_json(right))
    return F.coalesce((type_tag(left) == type_tag(right)) & same, F.lit(False))


def technical_token(text: ColumnLike) -> Column:
    """Earliest technical token in a sentence written for a reader, or null.

    At equal positions the pattern listed first wins.
    """
    body = F.coalesce(_c(text).cast("string"), F.lit(""))
    hits = []
    for rank, pattern in enumerate(fixed.TECHNICAL_PATTERNS):
        found = F.regexp_extract(body, pattern, 1)
        hits.append(F.when(F.regexp_instr(body, F.lit(pattern)) > 0, F.struct(
            F.regexp_instr(body, F.lit(pattern)).alias("at"), F.lit(rank).alias("rank"), found.alias("token"))))
    return F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))["token"]


def sha256_hex(value: ColumnLike) -> Column:
    return F.sha2(_c(value), 256)


def quote_regex(term: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch == "_" or ord(ch) > 127) else ch for ch in term)


def term_pattern(term: str) -> str:
    """Case-insensitive literal, whole-word where the term starts or ends with a word character."""
    head = r"\b" if term[:1].isalnum() else ""
    tail = r"\b" if term[-1:].isalnum() else ""
    return "(?i)(?U)" + head + quote_regex(term) + tail


def lookup(value: Column, table: dict, default=None) -> Column:
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], table.items(), [])
    found = F.create_map(*pairs)[value]
    return found if default is None else F.coalesce(found, F.lit(default))
