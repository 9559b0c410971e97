"""Scalar functions by name.

Unless a function says otherwise, a null argument or too few arguments give null. Each
builder gets typed arguments and returns a typed column made of built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import LONG_MIN, RequestError, Typed, common, comparable, null, to_datetime, to_double, to_long, to_str, trimmed, truthy

REGISTRY: dict[str, Callable[..., Typed]] = {}
#: The longest text that SPACE and REPEAT make.
MOST_REPEATS = 65535
#: What the information functions answer.
SERVER_VERSION, SERVER_USER, SERVER_CONNECTION = "8.0.30-x-db", "root@localhost", 0


def function(*names: str, least: int = 1, kind: str = "string"):
    """Registers a builder; with fewer arguments than least the result is null of the kind."""

    def add(build):
        def guarded(args: list[Typed], collation: int = 0) -> Typed:
            return build(*args) if len(args) >= least else null(kind)

        for name in names:
            REGISTRY[name] = guarded
        return build

    return add


def build(name: str, args: list[Typed], collation: int = 0) -> Typed:
    found = REGISTRY.get(name.upper())
    if not found:
        raise RequestError(f"unknown function {name}")
    return found(args, collation)


def text(c: Column) -> Typed:
    return Typed(c, "string")


def whole(c: Column) -> Typed:
    return Typed(c.cast("bigint"), "int")


def real(c: Column) -> Typed:
    return Typed(c.cast("double"), "double")


def all_given(args: tuple[Typed, ...], out: Column) -> Column:
    """out where no argument is null."""
    ok = args[0].col.isNotNull()
    for a in args[1:]:
        ok = ok & a.col.isNotNull()
    return F.when(ok, out)


# control


@function("IF", least=3)
def _if(cond, a, b):
    kind, (x, y) = common([a, b])
    return Typed(F.when(F.coalesce(truthy(cond), F.lit(False)), x).otherwise(y), kind)


@function("IFNULL", least=2)
def _ifnull(a, b):
    kind, (x, y) = common([a, b])
    return Typed(F.coalesce(x, y), kind)


@function("NULLIF", least=2)
def _nullif(a, b):
    x, y = comparable(a, b)
    a = a.shown()
    return Typed(F.when(x.eqNullSafe(y), F.lit(None)).otherwise(a.col), a.kind)


@function("COALESCE")
def _coalesce(*args):
    kind, cols = common(list(args))
    return Typed(F.coalesce(*cols), kind)


# text


@function("CONCAT")
def _concat(*args):
    return text(F.concat(*map(to_str, args)))


@function("CONCAT_WS")
def _concat_ws(sep, *args):
    parts = F.filter(F.array(*map(to_str, args)), lambda x: x.isNotNull()) if args else None
    if parts is None:
        return text(F.when(sep.col.isNotNull(), F.lit("")))
    s = to_str(sep)
    joined = F.reduce(parts, F.lit(None).cast("string"), lambda done, x: F.when(done.isNull(), x).otherwise(F.concat(done, s, x)))
    return text(F.when(s.isNotNull(), F.coalesce(joined, F.lit(""))))


@function("LENGTH", "CHAR_LENGTH", "CHARACTER_LENGTH", kind="int")
def _length(a, *_):
    return whole(F.char_length(to_str(a)))


@function("UPPER", "UCASE")
def _upper(a, *_):
    return text(F.upper(to_str(a)))


@function("LOWER", "LCASE")
def _lower(a, *_):
    return text(F.lower(to_str(a)))


@function("TRIM")
def _trim(a, *_):
    return text(trimmed(to_str(a)))


@function("LTRIM")
def _ltrim(a, *_):
    return text(F.regexp_replace(to_str(a), r"^(?U)\s+", ""))


@function("RTRIM")
def _rtrim(a, *_):
    return text(F.regexp_replace(to_str(a), r"(?U)\s+$", ""))


@function("REVERSE")
def _reverse(a, *_):
    return text(F.reverse(to_str(a)))


@function("SPACE")
def _space(n, *_):
    return text(F.repeat(F.lit(" "), F.least(F.greatest(to_long(n), F.lit(0)), F.lit(MOST_REPEATS)).cast("int")))


@function("REPEAT", least=2)
def _repeat(a, n, *_):
    return text(F.repeat(to_str(a), F.least(F.greatest(to_long(n), F.lit(0)), F.lit(MOST_REPEATS)).cast("int")))


def _clipped(c: Column) -> Column:
    """A count as 32 bits, for built-in functions that want that."""
    return F.least(F.greatest(c, F.lit(-(2**31) + 1)), F.lit(2**31 - 1)).cast("int")


@function("SUBSTR", "SUBSTRING", "MID")
def _substr(a, *more):
    s = to_str(a)
    size = F.char_length(s).cast("bigint")
    pos = F.coalesce(to_long(more[0]), F.lit(0)) if more else F.lit(1).cast("bigint")
    n = F.coalesce(to_long(more[1]), F.lit(0)) if len(more) > 1 else size
    start = F.when(pos > 0, pos - 1).otherwise(F.greatest(size + pos, F.lit(0)))
    n = F.when((n < 0) & (start < size), F.raise_error(F.lit("SUBSTR: negative length")).cast("bigint")).otherwise(n)
    out = F.when((pos == 0) | (start >= size), F.lit("")).otherwise(F.substring(s, _clipped(start + 1), _clipped(n)))
    return text(F.when(s.isNotNull(), out))


@function("LEFT", least=2)
def _left(a, n, *_):
    s, k = to_str(a), to_long(n)
    return text(all_given((a, n), F.when(k <= 0, F.lit("")).otherwise(F.left(s, _clipped(k)))))


@function("RIGHT", least=2)
def _right(a, n, *_):
    s, k = to_str(a), to_long(n)
    bad = F.raise_error(F.lit("RIGHT: negative length")).cast("string")
    return text(all_given((a, n), F.when(k < 0, bad).when(k == 0, F.lit("")).otherwise(F.right(s, _clipped(k)))))


@function("REPLACE", least=3)
def _replace(a, old, new, *_):
    s, o, n = to_str(a), F.coalesce(to_str(old), F.lit("NULL")), F.coalesce(to_str(new), F.lit("NULL"))
    # an empty search text stands at every place
    between = F.concat(n, F.array_join(F.transform(F.split(s, ""), lambda c: F.concat(c, n)), ""))
    return text(F.when(s.isNotNull(), F.when(o != "", F.replace(s, o, n)).when(s == "", n).otherwise(between)))


def _pad(f):
    def make(a, n, pad, *_):
        s, k, p = to_str(a), to_long(n), F.coalesce(to_str(pad), F.lit("NULL"))
        k = F.coalesce(k, F.lit(0))
        return text(F.when(s.isNotNull() & (p != "") & (k >= 0), f(s, _clipped(k), p)))

    return make


function("LPAD", least=3)(_pad(F.lpad))
function("RPAD", least=3)(_pad(F.rpad))


@function("LOCATE", "INSTR", "POSITION", least=2, kind="int")
def _locate(sub, a, *more):
    """All three take the text sought first, then the text, then where to begin."""
    start = F.greatest(F.coalesce(to_long(more[0]), F.lit(0)), F.lit(1)) if more else F.lit(1).cast("bigint")
    x, s = to_str(sub), to_str(a)
    found = F.when(x == "", F.least(start, F.char_length(s) + 1)).otherwise(F.call_function("locate", x, s, _clipped(start)))
    return whole(all_given((sub, a), found))


@function("HEX")
def _hex(a, *_):
    a = a.shown()
    return text(F.hex(a.col) if a.kind == "int" else F.hex(to_str(a).cast("binary")))


@function("UNHEX")
def _unhex(a, *_):
    s = to_str(a)
    return text(F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.decode(F.unhex(s), "UTF-8")))


# numbers


@function("ABS", kind="double")
def _abs(a, *_):
    a = a.shown()
    if a.kind == "int" and a.literal != LONG_MIN:  # that one has no positive twin; in a column it raises an overflow
        return whole(F.abs(a.col))
    return real(F.abs(to_double(a)))


@function("CEIL", "CEILING", kind="int")
def _ceil(a, *_):
    return whole(to_long(real(F.ceil(to_double(a)))))


@function("FLOOR", kind="int")
def _floor(a, *_):
    return whole(to_long(real(F.floor(to_double(a)))))


def _digits(args: tuple[Typed, ...]) -> int:
    """A scale must be known when the request is compiled."""
    if not args:
        return 0
    if args[0].literal is None:
        raise RequestError("the number of digits must be a constant")
    return int(args[0].literal)


def _exact(a: Typed) -> Column:
    """The shortest decimal text of a double, as an exact number."""
    return to_double(a).try_cast("string").try_cast("decimal(38,18)")


@function("ROUND", kind="int")
def _round(a, *more):
    d = _digits(more)
    out = F.round(_exact(a), d)
    return whole(out) if d == 0 else real(out)


@function("TRUNCATE", least=2, kind="int")
def _truncate(a, n, *_):
    d = _digits((n,))
    x = _exact(a)
    if d == 0:
        return whole(F.when(x < 0, -F.floor(-x)).otherwise(F.floor(x)))
    scale = F.lit(10**d).cast("decimal(20,0)") if d > 0 else F.lit(1)
    if d < 0:
        step = F.lit(10**-d).cast("decimal(20,0)")
        return real(F.when(x < 0, -F.floor(-x / step) * step).otherwise(F.floor(x / step) * step))
    part = F.floor(F.abs(x) * scale).cast("double") / F.lit(float(10**d))
    return real(F.when(x < 0, -part).otherwise(part))


@function("MOD", least=2, kind="int")
def _mod(a, b, *_):
    return whole(F.try_mod(to_long(a), to_long(b)))


@function("SQRT", kind="double")
def _sqrt(a, *_):
    x = to_double(a)
    return real(F.when(x >= 0, F.sqrt(x)))


@function("POW", "POWER", least=2, kind="double")
def _pow(a, b, *_):
    return real(F.pow(to_double(a), to_double(b)))


@function("LOG", kind="double")
def _log(a, *more):
    x = to_double(a)
    if not more:
        return real(F.when(x > 0, F.ln(x)))
    y = to_double(more[0])
    return real(F.when((x > 0) & (x != 1) & (y > 0), F.ln(y) / F.ln(x)))


@function("LOG2", kind="double")
def _log2(a, *_):
    x = to_double(a)
    return real(F.when(x > 0, F.ln(x) / F.ln(F.lit(2.0))))


@function("LOG10", "LOG_10", kind="double")
def _log10(a, *_):
    x = to_double(a)
    return real(F.when(x > 0, F.log10(x)))


@function("EXP", kind="double")
def _exp(a, *_):
    return real(F.exp(to_double(a)))


@function("SIGN", kind="int")
def _sign(a, *_):
    return whole(F.signum(to_double(a)))


@function("PI", least=0, kind="double")
def _pi(*_):
    return real(F.pi())


@function("RAND", least=0, kind="double")
def _rand(*_):
    return real(F.rand())


@function("CRC32", kind="int")
def _crc32(a, *_):
    return whole(F.crc32(to_str(a).cast("binary")))


def _extreme(f):
    def make(*args):
        kind, cols = common(list(args))
        out = f(*cols) if len(cols) > 1 else cols[0]
        return Typed(all_given(tuple(Typed(c, kind) for c in cols), out), kind)

    return make


function("GREATEST")(_extreme(F.greatest))
function("LEAST")(_extreme(F.least))


# dates


def stamp(c: Column) -> Typed:
    return Typed(c.cast("timestamp_ntz"), "datetime")


@function("NOW", "CURRENT_TIMESTAMP", least=0, kind="datetime")
def _now(*_):
    return stamp(F.localtimestamp())


@function("CURDATE", "CURRENT_DATE", least=0, kind="datetime")
def _curdate(*_):
    return stamp(F.current_date())


@function("CURTIME", "CURRENT_TIME", least=0)
def _curtime(*_):
    return text(F.date_format(F.localtimestamp(), "HH:mm:ss.SSSSSS"))


for _names, _f in {
    ("YEAR",): F.year,
    ("MONTH",): F.month,
    ("DAY", "DAYOFMONTH"): F.dayofmonth,
    ("HOUR",): F.hour,
    ("MINUTE",): F.minute,
    ("SECOND",): F.second,
    ("DAYOFWEEK",): F.dayofweek,
    ("DAYOFYEAR",): F.dayofyear,
}.items():
    function(*_names, kind="int")(lambda a, *_, f=_f: whole(f(to_datetime(a))))


@function("DATEDIFF", least=2, kind="int")
def _datediff(a, b, *_):
    return whole(F.datediff(to_datetime(a), to_datetime(b)))


def _days(sign):
    def make(a, n, *_):
        return stamp(to_datetime(a) + F.make_dt_interval(_clipped(to_long(n) * sign)))

    return make


function("DATE_ADD", "ADDDATE", least=2, kind="datetime")(_days(1))
function("DATE_SUB", "SUBDATE", least=2, kind="datetime")(_days(-1))


@function("UNIX_TIMESTAMP", least=0, kind="int")
def _unix_timestamp(*args):
    return whole(F.unix_timestamp(to_datetime(args[0]).cast("timestamp") if args else F.current_timestamp()))


@function("FROM_UNIXTIME", kind="datetime")
def _from_unixtime(a, *_):
    return stamp(F.timestamp_seconds(to_long(a)))


#: Format marks and the letters they stand for, replaced one after another.
DATE_MARKS = (("%Y", "yyyy"), ("%y", "yy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%i", "mm"), ("%s", "ss"), ("%S", "ss"), ("%M", "MMMM"), ("%b", "MMM"), ("%W", "EEEE"), ("%a", "EEE"), ("%j", "DDD"), ("%T", "HH:mm:ss"), ("%r", "hh:mm:ss a"))


@function("DATE_FORMAT", least=2)
def _date_format(a, pattern, *_):
    if pattern.kind == "null":
        return null()
    if pattern.literal is None:
        p = to_str(pattern)
        for mark, letters in DATE_MARKS:
            p = F.replace(p, F.lit(mark), F.lit(letters))
        return text(F.call_function("date_format", to_datetime(a), p))
    p = str(pattern.literal)
    for mark, letters in DATE_MARKS:
        p = p.replace(mark, letters)
    return text(F.date_format(to_datetime(a), p))


# information


@function("VERSION", least=0)
def _version(*_):
    return text(F.lit(SERVER_VERSION))


@function("DATABASE", "SCHEMA", least=0)
def _database(*_):
    return null()


@function("USER", "CURRENT_USER", least=0)
def _user(*_):
    return text(F.lit(SERVER_USER))


@function("CONNECTION_ID", least=0, kind="int")
def _connection(*_):
    return whole(F.lit(SERVER_CONNECTION))

