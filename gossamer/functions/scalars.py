"""Scalar rules on values, texts and times, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_KINDS = ("station", "official", "authority")
PEOPLE_KINDS = ("human", "bot")

# Fixed values of the trust and event rules.
TRUST_K = 4.0
TRUST_PRIOR = 0.5
TRUSTED = 0.8
HALF_LIFE_DAYS = 180.0
NEW_BELOW = 3
SAME_PLACE_KM = 0.2
SAME_PLACE_WEIGHT = 0.3
GRID_WEIGHT = 0.5
Z80 = 1.2815515655446008


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def is_reference(kind="kind") -> Column:
    return _c(kind).isin(*REFERENCE_KINDS)


def is_people(kind="kind") -> Column:
    return _c(kind).isin(*PEOPLE_KINDS)


def signal_key(source, source_id) -> Column:
    """Row key of a reading: first 16 hex digits of sha1('source::source_id')."""
    return F.substring(F.sha1(F.concat_ws("::", _c(source), _c(source_id))), 1, 16)


def in_range(value, lo, hi) -> Column:
    """inclusive; an open side passes."""
    v = _c(value)
    return (F.coalesce(v >= _c(lo), F.lit(True))) & (F.coalesce(v <= _c(hi), F.lit(True)))


def severity(value, thresholds, direction) -> Column:
    """Highest severity among thresholds (array of structs at, severity) the value reaches."""
    v, below = _c(value), _c(direction) == "below"
    return F.aggregate(
        _c(thresholds), F.lit(0.0),
        lambda acc, t: F.when(F.when(below, v <= t["at"]).otherwise(v >= t["at"]), F.greatest(acc, t["severity"])).otherwise(acc))


def compatible(a, b, is_flag, tol_abs, tol_rel) -> Column:
    """Flags always agree; no tolerance agrees; else within max(abs, rel x the larger magnitude)."""
    a, b, ta, tr = _c(a), _c(b), _c(tol_abs), _c(tol_rel)
    allowed = F.greatest(F.coalesce(ta, F.lit(0.0)), F.coalesce(tr * F.greatest(F.abs(a), F.abs(b)), F.lit(0.0)))
    return _c(is_flag) | (ta.isNull() & tr.isNull()) | (F.abs(a - b) <= allowed)


def aqi_of(value, bands: list[tuple[float, float, int, int]]) -> Column:
    """Truncate to a tenth, then the piecewise scale; above the table, its top."""
    v = _c(value)
    c = (v * 10).cast("long") / F.lit(10.0)
    out = None
    for lo, hi, i_lo, i_hi in bands:
        step = F.bround(F.lit((i_hi - i_lo) / (hi - lo)) * (F.greatest(c, F.lit(lo)) - lo) + i_lo, 0).cast("long")
        out = F.when(c <= hi, step) if out is None else out.when(c <= hi, step)
    return F.when(v.isNotNull(), out.otherwise(F.lit(bands[-1][3]).cast("long")))


def public_handle(sensor_id) -> Column:
    """X12."""
    return F.concat(F.lit("s-"), F.substring(F.sha1(_c(sensor_id).cast("string")), 1, 5))


def area_keys(state, county_slug, zip5, zip9) -> Column:
    """State, county, ZIP, ZIP+4, coarse to fine; missing levels drop out."""
    st = F.lower(_c(state))
    return F.array_compact(F.array(
        st, F.concat(st, F.lit("."), _c(county_slug)),
        F.concat(st, F.lit(".zip."), _c(zip5)), F.concat(st, F.lit(".zip."), _c(zip9))))


def title_key(title) -> Column:
    """Drop the text after the last ' - ' (head at least 12, tail at most 60), lower, letters and digits only."""
    t = F.coalesce(_c(title), F.lit(""))
    head = F.regexp_extract(t, r"(?s)^(.{12,}) - .{0,60}$", 1)
    base = F.when(head != "", head).otherwise(t)
    return F.trim(F.regexp_replace(F.lower(base), "[^a-z0-9]+", " "))


def county_slug(name) -> Column:
    """X16."""
    return F.regexp_replace(F.replace(F.lower(_c(name)), F.lit(" county"), F.lit("")), "[^a-z0-9]", "")


def slug(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def parse_zip5(text) -> Column:
    """The ZIP5 of '62704', '62704-1234', '62704 1234' or '627041234'."""
    z = F.regexp_extract(F.trim(_c(text)), r"^(\d{5})(?:[- ]?\d{4})?$", 1)
    return F.when(z != "", z)


def parse_zip9(text) -> Column:
    t = F.trim(_c(text))
    a, b = F.regexp_extract(t, r"^(\d{5})[- ]?(\d{4})$", 1), F.regexp_extract(t, r"^(\d{5})[- ]?(\d{4})$", 2)
    return F.when(a != "", F.concat(a, F.lit("-"), b))


def nice_number(x) -> Column:
    """Three significant figures, thousands separators, no exponent."""
    v = _c(x).cast("double")
    mag = F.abs(v)
    digits = F.when(mag > 0, F.floor(F.log10(mag)).cast("int")).otherwise(0)
    step = F.pow(F.lit(10.0), digits - 2)
    big = F.format_string("%,.0f", F.rint(v / step) * step)
    mid = F.format_string("%,.0f", F.rint(v))
    # below 100: round to 2 - digits decimals as the exact binary value falls (the product's rounding error decides ties)
    dec = F.least(F.greatest(2 - digits, F.lit(0)), F.lit(6))
    m = F.element_at(F.array(*[F.lit(float(10**d)) for d in range(7)]), dec + 1)
    p = v * m
    high = v * 134217729.0 - (v * 134217729.0 - v)
    err = (high * m - p) + (v - high) * m
    tie = p - F.floor(p) == 0.5
    n = F.when(tie & (err > 0), F.floor(p) + 1).when(tie & (err < 0), F.floor(p)).otherwise(F.rint(p))
    small = F.call_function("format_number", n / m, dec)
    small = F.when(small.contains("."), F.regexp_replace(small, r"\.?0+$", "")).otherwise(small)
    tiny = F.format_string("%.2f", v)
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(mag >= 10000, big).when(mag >= 100, mid)
            .when((mag < 1e-4) & (mag > 0), tiny).otherwise(small))


def fraction(x) -> Column:
    """Sixteenths below 3 ('1/16', '1 1/2'), whole numbers from 3 up."""
    v = _c(x)
    q = F.bround(v * 16, 0).cast("long")
    whole, rest = F.floor(q / 16).cast("long"), F.pmod(q, F.lit(16))
    g = F.when(rest % 8 == 0, 8).when(rest % 4 == 0, 4).when(rest % 2 == 0, 2).otherwise(1)
    part = F.concat((rest / g).cast("long").cast("string"), F.lit("/"), (F.lit(16) / g).cast("long").cast("string"))
    return (F.when(v >= 3, F.format_string("%,.0f", F.bround(v, 0)))
            .when(rest == 0, whole.cast("string"))
            .when(whole > 0, F.concat(whole.cast("string"), F.lit(" "), part)).otherwise(part))


def parse_iso(text) -> Column:
    """ISO with or without an offset, or 'YYYY-MM-DD HH:MM:SS'; no offset means UTC."""
    return F.try_to_timestamp(_c(text))


def iso(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def local_time(ts, zone: str, pattern: str = "EEE h:mm a") -> Column:
    """X23."""
    return F.date_format(F.from_utc_timestamp(_c(ts), zone), pattern)


def window_minutes(text) -> Column:
    """X27: '30m', '6h', '2d' in minutes; NULL when it isn't one."""
    t = F.lower(F.trim(_c(text)))
    n, u = F.regexp_extract(t, r"^(\d+)\s*([mhd])$", 1), F.regexp_extract(t, r"^(\d+)\s*([mhd])$", 2)
    k = F.when(u == "m", 1).when(u == "h", 60).when(u == "d", 1440)
    return F.when(n != "", n.try_cast("long") * k)


def shrunk(agree, disagree, prior) -> Column:
    return (F.lit(TRUST_K) * _c(prior) + _c(agree)) / (F.lit(TRUST_K) + _c(agree) + _c(disagree))


def faded_weight(at, now) -> Column:
    """Weight left of an outcome recorded at ``at``."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(_c(now)) - F.unix_micros(_c(at))) / F.lit(86400e6))
    return F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)


def standing_interval(agree, disagree, prior) -> Column:
    """struct(trust, low, high), an 80 % interval of the beta posterior."""
    a = F.lit(TRUST_K) * _c(prior) + _c(agree)
    b = F.lit(TRUST_K) * (F.lit(1.0) - _c(prior)) + _c(disagree)
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.struct(mean.alias("trust"), F.greatest(F.lit(0.0), mean - Z80 * sd).alias("low"),
                    F.least(F.lit(1.0), mean + Z80 * sd).alias("high"))


def event_score(severity_, n_sensors, mean_trust, n_reference, reference=None) -> Column:
    """Severity x corroboration x trust x reference agreement, three decimals half-even."""
    corroboration = F.lit(1.0) + F.lit(0.5) * F.log1p(F.greatest(F.lit(0), _c(n_sensors) - 1).cast("double"))
    mt = F.when(_c(mean_trust).isNull() | (_c(mean_trust) == 0), F.lit(TRUST_PRIOR)).otherwise(_c(mean_trust))
    trust = F.least(F.lit(2.0), F.greatest(F.lit(0.4), mt / TRUST_PRIOR))
    ref = F.lit("none") if reference is None else _c(reference)
    factor = (F.when((_c(n_reference) >= 1) | (ref == "agree"), 1.25).when(ref == "disagree", 0.7).otherwise(1.0))
    return F.bround(_c(severity_) * corroboration * trust * factor, 3)


def verified(n_sensors, n_reference, mean_trust) -> Column:
    """X32."""
    return ((F.coalesce(_c(n_sensors), F.lit(0)) >= 2) | (F.coalesce(_c(n_reference), F.lit(0)) >= 1)
            | (F.coalesce(_c(mean_trust), F.lit(0.0)) >= TRUSTED))


def flood_category(stage, stages) -> Column:
    """Name of the highest category (array of structs stage, name) whose stage is reached."""
    hit = F.array_max(F.filter(_c(stages), lambda s: s["stage"].isNotNull() & (_c(stage) >= s["stage"])))
    return hit["name"]


def numbers_in(text) -> Column:
    """Clock times as whole tokens, then numbers, of a text."""
    return F.regexp_extract_all(_c(text), F.lit(r"(\d{1,2}:\d{2}|\d+(?:\.\d+)?)"), F.lit(1))


def grounded(text, facts) -> Column:
    """Every number of the text occurs among the facts' numbers."""
    clean = lambda c: F.regexp_replace(_c(c), r"(?<=\d),(?=\d)", "")
    return F.size(F.array_except(numbers_in(clean(text)), numbers_in(clean(facts)))) == 0
