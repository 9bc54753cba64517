"""Logical types: alias map, inference flags, and cleaning on load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.functions.names import safe_column_names
from sheetscope.functions.numbers import FLOATING, INTEGRAL, TEMPORAL, finite, known, quoted, text_literal
from sheetscope.sources.tables import union_all

# Accepted type names and the logical type each stands for.
TYPE_ALIASES = {
    "Integer": "Int",
    "Int": "Int",
    "Float": "Numeric",
    "Numeric": "Numeric",
    "Bool": "Bool",
    "Toggle": "Bool",
    "Ref": "Reference",
    "Reference": "Reference",
    "Reference List": "RefList",
    "RefList": "RefList",
    "Choice": "Choice",
    "ChoiceList": "ChoiceList",
    "Attachment": "Attachment",
    "DateTime": "DateTime",
    "Date": "Date",
    "Text": "Text",
}

# Spark type that stores each logical type.
SPARK_TYPES = {
    "Text": "string",
    "Int": "bigint",
    "Numeric": "double",
    "Bool": "boolean",
    "Date": "date",
    "DateTime": "timestamp_ntz",
    "Choice": "string",
    "ChoiceList": "array<string>",
    "Reference": "bigint",
    "RefList": "array<bigint>",
}

# Texts that read as a switch, those that mean "on", and the date
# layouts tried after the ISO one, by the shape of text they can read.
SWITCH_TEXTS = ("true", "false", "vrai", "faux", "oui", "non", "1", "0")
SWITCH_ON_TEXTS = ("true", "vrai", "oui", "1")
DATE_LAYOUTS = {
    r"^\d{4}/\d{1,2}/\d{1,2}": ("yyyy/M/d[ H:m[:s]]",),
    r"^\d{1,2}-\d{1,2}-\d{4}": ("d-M-yyyy[ H:m[:s]]",),
    r"^\d{1,2}\.\d{1,2}\.\d{4}": ("d.M.yyyy[ H:m[:s]]",),
    r"^\d{1,2} \p{L}{3} \d{4}$": ("d MMM yyyy",),
    r"^\p{L}{3} \d{1,2}, \d{4}$": ("MMM d, yyyy",),
    r"^\p{L}{3} \d{1,2} \d{4}$": ("MMM d yyyy",),
    r"^\d{1,2} \p{L}+ \d{4}$": ("d MMMM yyyy",),
    r"^\p{L}+ \d{1,2}, \d{4}$": ("MMMM d, yyyy",),
}

_NUMBER = (
    r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
    r"|(?i:inf|infinity|nan))\s*$"
)
# Two numbers that may be month and day in either order, a year, and a time of day.
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
_WHOLE = r"^\s*[+-]?\d+(_\d+)*\s*$"
_LONGEST_SWITCH = 5
#: Text columns whose types one scan infers.
TEXTS_PER_SCAN = 1


def canonical_type(col: Column) -> Column:
    """Logical type of a type name; unknown names pass through."""
    pairs = F.create_map(*[F.lit(part) for pair in TYPE_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(pairs, col), col)


def canonical_type_name(name: str) -> str:
    return TYPE_ALIASES.get(name, name)


def text_to_number(col: Column) -> Column:
    """Number written in a text, or null."""
    return F.when(col.rlike(_NUMBER), F.replace(F.trim(col), F.lit("_"), F.lit("")).try_cast("double"))


def _slashed_parts(text: Column) -> Column:
    """The numbers of a slashed date as texts, from one match; null for any other text."""
    return F.when(F.contains(text, F.lit("/")) & text.rlike(_SLASHED), F.split(F.translate(text, " :", "//"), "/"))


def _from_slashed(parts: Column, day_first: bool) -> Column:
    """The moment that ``_slashed_parts`` spell; impossible months and days are left out before they are tried."""
    part = lambda i: F.try_element_at(parts, F.lit(i)).cast("int")
    month, day = (part(2), part(1)) if day_first else (part(1), part(2))
    clock = [F.coalesce(part(i), F.lit(0)) for i in (4, 5, 6)]
    return F.when(month.between(1, 12) & day.between(1, 31), F.try_make_timestamp_ntz(part(3), month, day, *clock))


def _iso(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d{4}"), text.try_cast("timestamp_ntz"))


def _by_layout(text: Column) -> Column:
    """The moment of a text that is not slashed day, month, year."""
    tries = [_iso(text)]
    for shape, layouts in DATE_LAYOUTS.items():
        parsed = [F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in layouts]
        tries.append(F.when(text.rlike(shape), F.coalesce(*parsed)))
    return F.coalesce(*tries)


def text_to_timestamp(col: Column, day_first: bool = False) -> Column:
    """Date or timestamp written in a text, or null.

    A layout is tried only on text of its shape: a failed parse costs far more
    than the pattern that rules it out. Slashed dates are put together from their
    parts, month first unless ``day_first``, so neither order costs an exception.
    """
    text = F.trim(col)
    return F.when(col.rlike(r"\d"), F.coalesce(_from_slashed(_slashed_parts(text), day_first), _by_layout(text)))


def _is_switch(col: Column) -> Column:
    return (F.length(col) <= _LONGEST_SWITCH) & F.lower(col).isin(*SWITCH_TEXTS)


def _parsed(df: DataFrame) -> DataFrame:
    """Per column ``i`` the known value ``v``; for texts also the number ``n`` and the moments ``t`` and ``d`` they spell.

    The two moments differ in slashed dates alone: month first and day first. Their parts
    are matched once and all other layouts tried once, and a text that reads as a number
    is tried as a bare year only. Each step is a projection of its own, so that nothing is
    worked out again where it is used twice.
    """
    texts = [i for i, field in enumerate(df.schema.fields) if isinstance(field.dataType, T.StringType)]
    values = df.select([known(field.name, field.dataType).alias(f"v{i}") for i, field in enumerate(df.schema.fields)])
    numbers = values.withColumns({f"n{i}": text_to_number(F.col(f"v{i}")) for i in texts})
    parts = {}
    for i in texts:
        text, plain = F.trim(F.col(f"v{i}")), F.col(f"n{i}").isNull() & F.col(f"v{i}").rlike(r"\d")
        parts[f"s{i}"] = F.when(plain, _slashed_parts(text))
        parts[f"o{i}"] = F.when(F.col(f"n{i}").isNotNull(), _iso(text)).when(plain, _by_layout(text))
    moments = {}
    for i in texts:
        moments[f"t{i}"] = F.coalesce(_from_slashed(F.col(f"s{i}"), False), f"o{i}")
        moments[f"d{i}"] = F.coalesce(_from_slashed(F.col(f"s{i}"), True), f"o{i}")
    return numbers.withColumns(parts).withColumns(moments)


def _kind_sql(data_type: T.DataType, i: int) -> str:
    """SQL aggregate that yields the logical type of parsed column ``i``."""
    value, number, moment = f"v{i}", f"n{i}", f"t{i}"
    whole = "bool_and(if(isnan({0}) or abs({0}) = double('inf'), false, rint({0}) = {0}))"
    clock = "if(bool_or(date_trunc('day', {0}) <> {0}), 'DateTime', 'Date')"
    if isinstance(data_type, T.BooleanType):
        kind = "'Toggle'"
    elif isinstance(data_type, INTEGRAL):
        kind = f"if(bool_and({value} in (0, 1)), 'Toggle', 'Int')"
    elif isinstance(data_type, FLOATING):
        kind = f"if({whole.format(value)}, 'Int', 'Numeric')"
    elif isinstance(data_type, T.DecimalType):
        kind = "'Numeric'"
    elif isinstance(data_type, T.DateType):
        kind = "'Date'"
    elif isinstance(data_type, TEMPORAL):
        kind = clock.format(value)
    elif isinstance(data_type, T.StringType):
        switches = ", ".join(f"'{text}'" for text in SWITCH_TEXTS)
        kind = (
            f"case when bool_and(length({value}) <= {_LONGEST_SWITCH} and lower({value}) in ({switches})) then 'Toggle' "
            f"when count({number}) = count({value}) then if({whole.format(number)}, 'Int', 'Numeric') "
            f"when count({moment}) = count({value}) then {clock.format(moment)} "
            f"when count(d{i}) = count({value}) then {clock.format(f'd{i}')} else 'Text' end"
        )
    elif isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        kind = "'ChoiceList'"
    else:
        kind = "'Text'"
    return f"if(count({value}) = 0, 'Text', {kind})"


def _day_first_sql(data_type: T.DataType, i: int) -> str:
    """SQL aggregate: whether a text column's dates are read day first."""
    return f"count(t{i}) < count(v{i}) and count(d{i}) = count(v{i})" if isinstance(data_type, T.StringType) else "false"


def infer_types(df: DataFrame, texts_per_scan: int = TEXTS_PER_SCAN) -> DataFrame:
    """One row per column: ``position, column, inferred, logical_type, day_first``.

    Rules in order: nothing known is Text; only switch texts is Toggle; only
    numbers is Int or Numeric; only dates is Date or DateTime; else Text. The whole
    column decides how its slashed dates are read: month first only if that reads every
    value, else day first. Each value is parsed once and every rule is a map-side aggregate, so a table of any size
    sends one row per task.

    Text columns are taken ``texts_per_scan`` at a time and the others together: a scan of
    a columnar file reads its own columns alone, and the code generated for few of them
    stays small enough to be compiled. Give more for sources that read whole lines.
    """
    fields = list(enumerate(df.schema.fields))
    texts = [f for f in fields if isinstance(f[1].dataType, T.StringType)]
    others = [f for f in fields if not isinstance(f[1].dataType, T.StringType)]
    blocks = [others] * bool(others) + [texts[i : i + texts_per_scan] for i in range(0, len(texts), texts_per_scan)]
    found = union_all([_inferred(df, block) for block in blocks])
    return found.select("position", "column", "inferred", canonical_type(F.col("inferred")).alias("logical_type"), "day_first")


def _inferred(df: DataFrame, block: list[tuple[int, T.StructField]]) -> DataFrame:
    """``position, column, inferred, day_first`` of some columns, from one aggregate."""
    parsed = _parsed(df.select(*(F.col(quoted(field.name)) for _, field in block)))
    kinds = ", ".join(
        f"'k{i}', {_kind_sql(field.dataType, i)}, 'f{i}', {_day_first_sql(field.dataType, i)}" for i, (_, field) in enumerate(block)
    )
    rows = ", ".join(
        f"named_struct('position', {at}, 'column', {text_literal(field.name)}, 'inferred', m.k{i}, 'day_first', m.f{i})"
        for i, (at, field) in enumerate(block)
    )
    return parsed.agg(F.expr(f"named_struct({kinds})").alias("m")).selectExpr(f"inline(array({rows}))")


def to_logical(col: Column, data_type: T.DataType, logical: str, day_first: bool = False) -> Column:
    """``col`` stored under a logical type; values that do not fit become null.

    Whole numbers written in texts are cast straight to integers, so ids of any size
    keep their value.
    """
    target = SPARK_TYPES.get(canonical_type_name(logical), "string")
    if isinstance(data_type, T.StringType):
        if target == "boolean":
            return F.when(_is_switch(col), F.lower(col).isin(*SWITCH_ON_TEXTS))
        if target in ("bigint", "double"):
            number = finite(text_to_number(col))
            if target == "double":
                return number
            whole = F.when(col.rlike(_WHOLE), F.replace(F.trim(col), F.lit("_"), F.lit("")).try_cast("bigint"))
            return F.coalesce(whole, F.when(~col.rlike(_WHOLE), number.try_cast("bigint")))
        if target in ("date", "timestamp_ntz"):
            return text_to_timestamp(col, day_first).cast(target)
    if target == "boolean" and isinstance(data_type, INTEGRAL):
        return col != 0
    if isinstance(data_type, FLOATING):
        col = finite(col)
    return col.try_cast(target)


def interval_text(col: Column) -> Column:
    """``1 days 02:03:04``, with six digits of a second where there is a fraction."""
    micros = F.expr("bigint(0)") + F.unix_micros(F.timestamp_seconds(F.lit(0)) + col)
    day, second = 86_400_000_000, 1_000_000
    days = F.floor(micros / day)
    rest = F.pmod(micros, F.lit(day))
    clock = F.format_string(
        "%d days %02d:%02d:%02d", days, F.floor(rest / (3600 * second)), F.floor(rest / (60 * second)) % 60, F.floor(rest / second) % 60
    )
    return F.when(rest % second == 0, clock).otherwise(F.concat(clock, F.format_string(".%06d", rest % second)))


def clean_value(name: str, data_type: T.DataType) -> Column:
    """A value ready for text-based storage.

    NaN and infinities become null, dates and timestamps their ISO form, and
    intervals their text.
    """
    col = known(name, data_type)
    if isinstance(data_type, FLOATING):
        return finite(col)
    if isinstance(data_type, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(data_type, TEMPORAL):
        whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(F.date_trunc("second", col) == col, whole).otherwise(micros)
    if isinstance(data_type, T.DayTimeIntervalType):
        return interval_text(col)
    return col


def clean_table(df: DataFrame) -> DataFrame:
    """Rename to safe identifiers and clean every value, in one projection."""
    names = safe_column_names(df.columns)
    return df.select([clean_value(f.name, f.dataType).alias(name) for f, name in zip(df.schema.fields, names)])
