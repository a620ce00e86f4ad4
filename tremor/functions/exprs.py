"""Scalar column expressions.  All are built-ins, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor import dims

# RFC 3986 splitting; lenient, unlike parse_url which rejects loose URLs.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# What counts as white space at the ends of a text.
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is
    used: a plain Python variable would repeat the whole expression."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    """Trim all white space (``trim`` alone only removes blanks)."""
    return F.trim(col(c), F.lit(_BLANKS))


def null_if_blank(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_url(u: Column | str) -> Column:
    """Lower-case scheme and host, strip trailing slashes, drop the fragment,
    keep the query; blank -> null.  A URL without scheme gets ``http``.

    One regex pass cuts the URL into four pieces; the rest works on those.
    """
    sep = "\x01"
    clean = F.translate(strip(u), "\t\r\n", "")
    pieces = F.split(F.regexp_replace(F.nullif(clean, F.lit("")), _URL, f"$1{sep}$2{sep}$3{sep}$4"), sep, -1)

    def build(p: Column) -> Column:
        scheme = F.when(p[0] == "", F.lit("http")).otherwise(F.lower(p[0]))
        path = F.rtrim(p[2], F.lit("/"))
        path = F.when(path == "", F.lit("/")).otherwise(path)
        host = F.when((p[1] != "") | (F.rtrim(p[2], F.lit("/")) == "") | p[2].startswith("/"),
                      F.concat(F.lit("//"), F.lower(p[1]))).otherwise(F.lit(""))
        query = F.when(p[3] != "", F.concat(F.lit("?"), p[3])).otherwise(F.lit(""))
        return F.concat(scheme, F.lit(":"), host, path, query)

    return let(pieces, build)


def event_id(source: Column | str, url: Column | str, source_id: Column | str) -> Column:
    """sha256 of ``source|normalized url`` (or native id); null = reject."""
    key = F.coalesce(normalize_url(url), F.when(col(source_id) != "", col(source_id)))
    return F.sha2(F.concat(col(source), F.lit("|"), key), 256)


def http_only(u: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(u), r"(?is)^\s*(http.*?)\s*$", 1), F.lit(""))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    # least/greatest skip nulls, so keep null explicitly.
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi)))


def tolerant_clip(x: Column | str, default: float) -> Column:
    """A value above 1 on a 0-1 scale is read as a percentage."""
    v = col(x)
    return F.coalesce(clip(F.when(v > 1.0, v / 100.0).otherwise(v), 0.0, 1.0), F.lit(default))


def severity_band(score: Column | str) -> Column:
    s = clip(score, 0.0, 1.0)
    out = None
    for band, _lo, hi, _n, _m in dims.SEVERITY_BANDS:
        out = F.when(s < hi, band) if out is None else out.when(s < hi, band)
    return out


def severity_midpoint(band: Column | str) -> Column:
    b = col(band)
    out = None
    for n, _lo, _hi, _n, mid in dims.SEVERITY_BANDS:
        out = F.when(b == n, mid) if out is None else out.when(b == n, mid)
    return out


def time_decay(days: Column | str, half_life: float = dims.HALF_LIFE_DAYS) -> Column:
    """0.5 ** (days / half_life); negative age is an error, as is h <= 0."""
    if half_life <= 0:
        raise ValueError("half_life must be > 0")
    d = col(days).cast("double")
    return F.when(d < 0, F.raise_error(F.lit("negative age")).cast("double")).otherwise(
        F.pow(F.lit(0.5), d / half_life))


def decay_factor(days: Column | str, half_life: float = dims.HALF_LIFE_DAYS) -> Column:
    """As :func:`time_decay` without the guard, for ages already known >= 0."""
    return F.pow(F.lit(0.5), col(days).cast("double") / half_life)


def path_impact(weights: Column | str, hop_penalty: float = 1.0) -> Column:
    w = col(weights)
    product = F.aggregate(w, F.lit(1.0), lambda a, x: a * x)
    return product * F.pow(F.lit(float(hop_penalty)), F.greatest(F.size(w) - 1, F.lit(0)).cast("double"))


def propagated_impact(base: Column | str, days: Column | str,
                      half_life: float = dims.HALF_LIFE_DAYS) -> Column:
    return col(base) * time_decay(days, half_life)


def price_delta_pct(close: Column | str, prior: Column | str) -> Column:
    c, p = col(close), col(prior)
    return F.when(p.isNotNull() & (p != 0), (c - p) / p * 100.0)


def price_delta_dir(close: Column | str, prior: Column | str) -> Column:
    c, p = col(close), col(prior)
    return F.when(p.isNull(), F.lit("")).when(c - p >= 0, "yes").otherwise("no")


def tier(x: Column | str, cuts: tuple[float, float]) -> Column:
    v = col(x)
    return F.when(v < cuts[0], "Weak").when(v < cuts[1], "Moderate").otherwise("Strong")


def clean_note(note: Column | str) -> Column:
    """Strip a leading "<section sign>anchor: " from an edge note."""
    return F.regexp_replace(col(note), "^§.*?: ", "")


def lookup(c: Column | str, table: dict[str, str]) -> Column:
    """Literal map lookup; null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


def coded_countries(actor1: Column | str, actor2: Column | str, place: Column | str,
                    actors: dict[str, str] | None = None, places: dict[str, str] | None = None) -> Column:
    """Distinct sorted country names of both actors and the action place."""
    actors = dims.CAMEO_TO_NAME if actors is None else actors
    places = dims.FIPS_TO_NAME if places is None else places
    names = F.array(lookup(actor1, actors), lookup(actor2, actors), lookup(place, places))
    return F.array_sort(F.array_distinct(F.array_compact(names)))


def corridor(countries: Column | str, country_nodes: Sequence[str]) -> Column:
    """Sorted countries that are graph nodes; null when none is left."""
    kept = F.array_sort(F.filter(col(countries), lambda c: c.isin(list(country_nodes))))
    return F.when(F.size(kept) > 0, kept)


def split_of_date(d: Column | str, bounds: dict[str, tuple[str, str]]) -> Column:
    """First matching inclusive range, in train / val / test order."""
    out = F.lit(None).cast("string")
    for name in ("test", "val", "train"):
        lo, hi = bounds[name]
        out = F.when(col(d).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), name).otherwise(out)
    return out


def finite_or_null(c: Column | str) -> Column:
    """Non-finite doubles become null (stored artefacts are plain JSON)."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_floats(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def finite_within(c: Column | str, kind: T.DataType) -> Column:
    """Non-finite numbers become null at every level of a value of type
    ``kind``: fields of structs, elements of arrays, values of maps.  The
    expression is built once from the type; parts without floating-point numbers
    stay as they are, and null containers stay null."""
    x = col(c)
    if not _holds_floats(kind):
        return x
    if isinstance(kind, T.StructType):
        whole = F.struct(*[finite_within(x.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(x.isNotNull(), whole)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: finite_within(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: finite_within(v, kind.valueType))
    return finite_or_null(x)


def finite_rows(df: DataFrame) -> DataFrame:
    """Every column of a stored artefact with its non-finite numbers as null."""
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return df.select(*[finite_within(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])


def json_list(c: Column | str, element: str = "string") -> Column:
    """A stored JSON list; bad JSON and nulls give an empty one."""
    kind = f"array<{element}>"
    parsed = F.from_json(col(c), kind)
    return F.filter(F.coalesce(parsed, F.array().cast(kind)), lambda x: x.isNotNull())


def json_object(c: Column | str, ddl: str) -> Column:
    """A stored JSON object as a struct; bad JSON gives one of nulls."""
    parsed = F.from_json(col(c), ddl)
    fields = [f.strip().split()[0] for f in ddl.split(",")]
    return F.struct(*[parsed.getField(n).alias(n) for n in fields])


def lookback_days(half_life: Column | str, epsilon: float) -> Column:
    """Days after which decay with this half-life lies below ``epsilon``."""
    return F.ceil(col(half_life) * F.log2(F.lit(1.0 / epsilon)))


def fractional_days(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(86400e6)
