"""Scalar functions on ids, properties, rings and coordinates, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of a part's own columns (fixed values).
CANONICAL = (
    "object_id", "part_id", "parent_part_id", "part_level", "ground_elevation_m", "base_height_agl_m", "top_height_agl_m", "part_height_m", "base_elevation_m", "top_elevation_m",
    "area_m2", "perimeter_m", "oriented_length_m", "oriented_width_m", "dimension_method", "orientation_deg", "volume_m3", "delta_z_m", "expected_pixel_count", "valid_pixel_count",
    "support_pixel_count", "valid_coverage_ratio", "decomposition_reason", "parent_containment_ratio", "interior_ring_count", "geometry_method",
)


def normalize_id(json: Column) -> Column:
    """An id given as JSON text: strings are trimmed, whole numbers lose their point, other numbers their last zeros; booleans, null, blanks, lists and objects are missing."""
    text = F.trim(json)
    string = F.nullif(F.trim(F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")), F.lit(""))
    number, size = text.try_cast("double"), F.abs(text.try_cast("double"))
    whole = F.coalesce(number.try_cast("decimal(38,0)").cast("string"), text)
    short = F.when((size >= 1e-3) & (size < 1e7), number.cast("string")).when(text.rlike("^-?[0-9]+\\.[0-9]+$"), F.regexp_replace(text, "0+$", "")).otherwise(F.lower(number.cast("string")))
    return (
        F.when(text.startswith('"'), string).when(~text.rlike("^-?[0-9]") | number.isNull() | F.isnan(number) | (size == float("inf")), None)
        .when(text.rlike("^-?[0-9]+$"), F.when(number == 0, "0").otherwise(text)).when(number == F.floor(number), whole).otherwise(short)
    )


def half_even(x: Column, digits: int) -> Column:
    """Rounded to decimals by the number's exact binary value, halves to even: 2.675 is below its half and becomes 2.67.

    The product with the power of ten is taken with its rounding error, which decides near halves.  The number
    is bound to a lambda's variable, so that nested calls don't repeat it.
    """
    scale = float(10**digits)
    split = 134217729.0  # 2 ** 27 + 1: cuts a number's bits in halves
    top = scale * split - (scale * split - scale)
    rest = scale - top

    def rounded(v: Column, product: Column) -> Column:
        high = (v * split) - ((v * split) - v)
        low = v - high
        error = ((high * top - product) + high * rest + low * top) + low * rest
        floor = F.floor(product).cast("double")
        over = (product - floor - 0.5) + error
        up = F.when(over > 0, 1.0).when((over == 0) & (F.pmod(floor, F.lit(2.0)) == 1), 1.0).otherwise(0.0)
        return F.when(F.abs(product) < 2.0**52, (floor + up) / scale).otherwise(v)

    pairs = F.transform(F.array(x.cast("double")), lambda v: F.struct(v.alias("v"), (v * scale).alias("p")))
    return F.get(F.transform(pairs, lambda q: rounded(q["v"], q["p"])), F.lit(0))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def keep_properties(props: Column, names: list[str] | None = None) -> Column:
    """The wanted properties (None: all); those that clash with a part's own columns get the prefix src_."""
    kept = props if names is None else F.map_filter(props, lambda k, _: k.isin(*names) if names else F.lit(False))
    return F.transform_keys(kept, lambda k, _: F.when(k.isin(*CANONICAL), F.concat(F.lit("src_"), k)).otherwise(k))


def hex_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.hex(F.encode(value, "UTF-8"))))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def _next(a: Column) -> Column:
    return F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.lit(1)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def signed_area(xs: Column, ys: Column) -> Column:
    """Shoelace; positive for rings that run counter-clockwise."""
    return (_sum(F.zip_with(xs, _next(ys), lambda a, b: a * b)) - _sum(F.zip_with(_next(xs), ys, lambda a, b: a * b))) / 2


def edge_lengths(xs: Column, ys: Column) -> Column:
    dx, dy = F.zip_with(_next(xs), xs, lambda a, b: a - b), F.zip_with(_next(ys), ys, lambda a, b: a - b)
    return F.zip_with(dx, dy, lambda a, b: F.hypot(a, b))


def perimeter(xs: Column, ys: Column) -> Column:
    return _sum(edge_lengths(xs, ys))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, below 180."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(180.0))


def circularity(area: Column, length: Column) -> Column:
    return F.when(length > 0, 4 * F.pi() * area / (length * length)).otherwise(0.0)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def names_of(text: str) -> list[str]:
    """The names in a list with commas, trimmed, blanks left out, each once."""
    return list(dict.fromkeys(n.strip() for n in text.split(",") if n.strip()))
