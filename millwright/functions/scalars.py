"""Column expressions for dirty shop-floor values.  All are pure: no UDF, and null stays null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand in an id cell without being an id, the status vocabulary, the
# location rules, the timestamp formats in the order they are tried and the shape of a tool's name.
NOT_A_TOOL = ["소계", "합계", "총계", "계", "-", "n/a", "na"]
STATUS = {"사용중": "in_use", "사용": "in_use", "가동중": "in_use", "대기중": "standby", "대기": "standby", "보관중": "standby", "보관": "standby",
          "수리중": "repair", "수리": "repair", "정비중": "repair", "폐기": "retired", "폐기됨": "retired", "불용": "retired"}
AT_MACHINE = "설비"
LOCATION_WORDS = [("수리", "repair"), ("폐기", "retired"), ("불용", "retired")]
TIME_FORMATS = ["yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy.M.d H:m:s", "yyyy.M.d H:m", "yyyy.M.d", "yyyy/M/d H:m:s", "yyyy/M/d"]
SPACE = r"(?U)[\s\x1c-\x1f]+"  # white space of any script
TOOL_SHAPE = r"^#?[A-Za-z]{1,3}\d{4,}$"
# Times of a process log: the formats above, and with fractions of a second or an offset.
LOG_TIMES = [*TIME_FORMATS, "yyyy-M-d'T'H:m", "yyyy-M-d H:m:s.SSS", "yyyy-M-d'T'H:m:s.SSS", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d H:m:sXXX", "yyyy-M-d'T'H:m:sXXX", "yyyy/M/d H:m", "yyyyMMdd", "yyyyMMddHHmmss", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_c(c), F.lit(" \t\n\x0b\x0c\r\u00a0\u3000"))


def blank_to_null(c: Column) -> Column:
    """A stripped text; null where nothing is left."""
    c = stripped(c)
    return F.when(c != "", c)


def cell_to_text(cell_type, text, num, ts, flag) -> Column:
    """a typed cell as text; whole numbers lose their fraction, blank is null.

    Fractions are written with all their digits and no more, below 0.0001 with an exponent (``5e-05``); times in
    ISO form, with microseconds where there are any."""
    num, ts, flag = _c(num), _c(ts), _c(flag)
    digits = num.cast("string")
    plain = F.regexp_replace(F.regexp_replace(digits.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", "")
    tiny = F.regexp_replace(F.regexp_replace(F.regexp_replace(digits, r"\.0E", "E"), r"E-(\d)$", "E-0$1"), "E", "e")
    number = F.when(num % 1 == 0, num.try_cast("decimal(38,0)").cast("string")).when(F.abs(num) < 1e-4, tiny).when(digits.contains("E"), plain).otherwise(digits)
    second = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    kind = _c(cell_type)
    return (
        F.when(kind.isin("int", "float"), number)
        .when(kind == "bool", F.when(flag, "TRUE").otherwise("FALSE"))
        .when(kind == "datetime", F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(second))
        .when(kind == "date", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(blank_to_null(_c(text)))
    )


def normalize_text(c) -> Column:
    """F2."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[\s\u00A0\u3000]+", " ")))


def normalize_tool(c) -> Column:
    """tool id without leading #, upper case; total words and blanks are null."""
    t = F.upper(stripped(F.regexp_replace(stripped(c), "^#+", "")))
    return F.when((t != "") & ~F.lower(t).isin(NOT_A_TOOL), t)


def is_tool_name(c) -> Column:
    """F4."""
    return F.coalesce(stripped(c).rlike(TOOL_SHAPE), F.lit(False))


def normalize_status(c) -> Column:
    """F5."""
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.try_element_at(table, F.regexp_replace(_c(c), SPACE, ""))


def status_from_location(c) -> Column:
    """the place is the state; any unknown place is a store."""
    t = F.regexp_replace(_c(c), SPACE, "")
    out = F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).when(t == AT_MACHINE, "in_use")
    for word, status in LOCATION_WORDS:
        out = out.when(t.contains(word), status)
    return out.otherwise("standby")


def to_float(c) -> Column:
    """commas dropped, a percent sign divides by 100, anything else is null (also 1_000, inf, nan)."""
    t = F.regexp_replace(stripped(c), ",", "")
    percent = t.endswith("%")
    value = plain_number(F.regexp_replace(t, "%$", ""))
    return F.when(percent, value / 100).otherwise(value)


def plain_number(c) -> Column:
    """A number as digits, point and exponent; what only some readers take (1d, 0x1, inf, nan) is null."""
    body = stripped(c)
    return F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), body.try_cast("double"))


def to_int(c) -> Column:
    """F8.  Digits alone, at most as many as a double holds, are read at once."""
    return F.when(_c(c).rlike(r"^\d{1,15}\z"), _c(c).try_cast("bigint")).otherwise(to_float(c).try_cast("bigint"))


def to_datetime(c) -> Column:
    """the formats in order; none fits: null."""
    return _first_time(c, TIME_FORMATS)


def log_time(c) -> Column:
    """A time of a process log."""
    return _first_time(c, LOG_TIMES)


def _shape(pattern: str) -> str:
    """Regular expression of the texts that a time format can read."""
    part = {"XXX": r"(?:Z|[+-]\d\d:\d\d)", "'T'": "T"}
    one = lambda m: part.get(m[0]) or (re.escape(m[0]) if not m[0].isalpha() else rf"\d{{{len(m[0])}}}" if len(m[0]) > 1 else r"\d{1,2}")
    return "^" + re.sub(r"'T'|([A-Za-z])\1*|.", one, pattern) + "$"


def _first_time(c, formats: list[str]) -> Column:
    """The first format that reads the text.  Only formats whose shape fits are tried: a try that fails costs an exception.

    The text is the variable of a function, so that what it comes from is computed once and not for every format."""
    read = lambda t: F.coalesce(*[F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in formats])
    return F.get(F.transform(F.array(stripped(c)), read), F.lit(0))


def run_date(c) -> Column:
    """first date of a period label; with two kinds of separators it is none.

    What is cut out is a date alone, so no time format is tried."""
    day = F.regexp_extract(_c(c), r"(\d{4}[-./]\d{1,2}[-./]\d{1,2})", 1)
    return F.when(day.rlike(r"^\d+([-./])\d+\1\d+$"), F.translate(day, "./", "--").try_cast("date"))


def a1_column(letters) -> Column:
    """column letters to a 1-based number."""
    chars = F.split(F.upper(_c(letters)), "")
    return F.aggregate(F.filter(chars, lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)


def a1_row_col(address) -> Column:
    """``$B$3`` to struct(row_no 3, col_no 2); malformed: null."""
    t = F.regexp_replace(_c(address), r"\$", "")
    ok = t.rlike(r"^[A-Za-z]{1,3}\d+$")
    return F.when(ok, F.struct(F.regexp_extract(t, r"(\d+)$", 1).try_cast("int").alias("row_no"), a1_column(F.regexp_extract(t, "^([A-Za-z]+)", 1)).alias("col_no")))


def column_letters(n) -> Column:
    """27 to AA, up to three letters."""
    n = _c(n).cast("int")
    letter = lambda k: F.char(k + 65)
    one = n - 1
    two, three = n - 27, n - 703
    div = lambda a, b: F.floor(a / b).cast("int")
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(div(two, 26)), letter(two % 26)))
        .otherwise(F.concat(letter(div(three, 676)), letter(div(three, 26) % 26), letter(three % 26)))
    )


def a1_offset(address, rows, cols) -> Column:
    """the address so many rows down and columns right; beyond the sheet's edges: null."""
    at = a1_row_col(address)
    row, col = at["row_no"] + rows, at["col_no"] + cols
    return F.when((row >= 1) & (col >= 1), F.concat(column_letters(col), row.cast("string")))


def type_name(cell_type) -> Column:
    """the kind of a cell; bool is not a number."""
    k = _c(cell_type)
    return F.when(k.isin("bool", "datetime", "int", "float", "str"), k).otherwise("other")


def measured(c) -> Column:
    """a reading of exactly 0 means not measured."""
    return F.nullif(_c(c), F.lit(0.0))


def title(c, limit: int = 40, empty: str = "새 대화") -> Column:
    """first message as a title."""
    t = F.trim(F.regexp_replace(F.trim(_c(c)), "\n", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", empty).when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def role(kind) -> Column:
    """F18."""
    k = _c(kind)
    return F.when(k == "human", "user").when(k == "ai", "assistant").otherwise("system")


def coverage_label(covered, expected, ended_at) -> Column:
    """whether a rate rests on all its days."""
    covered, expected = _c(covered), _c(expected)
    return (
        F.when(_c(ended_at).isNull(), "가동 중").when(expected.isNull() | (expected == 0), "—")
        .when(covered >= expected, F.concat(expected.cast("string"), F.lit("일"))).otherwise(F.concat_ws("", covered.cast("string"), F.lit("/"), expected.cast("string"), F.lit("일")))
    )
