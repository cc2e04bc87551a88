"""Mixed timestamp strings to one UTC instant.

Every format is compiled into one regular expression, run once a value; its groups come out through a
single replacement, are checked against calendar ranges, and become an instant by integer day
arithmetic. All of it stays in the JVM, so the scan, the parse and the zone lookup are one narrow stage.

Defined results: null, empty, relative ("yesterday") and impossible values give null; a value without
zone needs site_zone, else null; digits-only day/month order follows the locale (en-US and alike put the
month first) and is null where the locale is unknown and both readings are possible; a local time that
occurs twice is the first of the two, a skipped one uses the offset before the change.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets of zone abbreviations, in minutes.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120,
    "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "art": -180, "brt": -180,
}

# Month names of en, de, es, fr with their usual short forms.
MONTHS = (
    "january jan januar jänner enero ene janvier janv",
    "february feb februar febrero février févr fevrier",
    "march mar märz mrz maerz marzo mars",
    "april apr abril abr avril avr",
    "may mai mayo",
    "june jun juni junio juin",
    "july jul juli julio juillet juil",
    "august aug agosto ago août aout",
    "september sep sept septiembre setiembre septembre",
    "october oct oktober okt octubre octobre",
    "november nov noviembre novembre",
    "december dec dezember dez diciembre dic décembre déc decembre",
)

# Locales that write the month before the day in digits-only dates.
MONTH_FIRST = ("en-us", "en-ph", "en-pr", "es-pr", "fil-ph")

_CLOCK = r"(?<h{n}>\d{{1,2}})(?::|h)(?<i{n}>\d\d)(?::(?<s{n}>\d\d)(?:[.,](?<f{n}>\d{{1,9}}))?)?(?: ?(?<p{n}>[ap])\.?m\.?)?(?: uhr)?(?: ?(?<z{n}>[+-]\d\d(?::?\d\d)?|[a-z]{{1,5}}))?"
_FORMS = {
    "1": r"(?<y1>\d{4})[-/](?<m1>\d{1,2})[-/](?<d1>\d{1,2})(?:(?:t| +)" + _CLOCK.format(n=1) + r"(?:\[(?<r1>[^\]]+)\])?)?",
    "2": r"(?<y2>\d{4})(?<m2>\d\d)(?<d2>\d\d)t(?<h2>\d\d)(?<i2>\d\d)(?:(?<s2>\d\d)(?:[.,](?<f2>\d{1,9}))?)?(?<z2>z|[+-]\d\d(?::?\d\d)?)?",
    "3": r"(?<g3>\d{4,17})",
    "4": r"(?:\p{L}{2,10}\.?,? +)?(?<d4>\d{1,2})(?:\.|er|st|nd|rd|th|º)? +(?:de +)?(?<n4>\p{L}{3,10})\.?,? +(?:de +|del +)?(?<y4>\d{4})(?:,? +(?:at +|à +|um +|a las +)?" + _CLOCK.format(n=4) + ")?",
    "5": r"(?:\p{L}{2,10}\.?, +)?(?<n5>\p{L}{3,10})\.? +(?<d5>\d{1,2})(?:st|nd|rd|th)?,? +(?<y5>\d{4})(?:,? +(?:at +)?" + _CLOCK.format(n=5) + ")?",
    "6": r"(?<a6>\d{1,2})(?<x6>[-/.])(?<b6>\d{1,2})\k<x6>(?<y6>\d{4})(?:,? +(?:at +|à +|um +)?" + _CLOCK.format(n=6) + ")?",
}
PATTERN = "^(?:" + "|".join(_FORMS.values()) + ")$"
_PARTS = "y m n d a b h i s f p z r g".split()
_SEP, _HIT = "\x01", "\x02"


def _replacement() -> str:
    """One field for every component; of the alternatives only one matched, so the others add nothing."""
    named = lambda part: "".join("${%s%s}" % (part, n) for n, form in _FORMS.items() if f"(?<{part}{n}>" in form)
    return _HIT + _SEP.join(named(p) for p in _PARTS)


def _lookup(table: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _with_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Columns behind a generator, which the optimizer doesn't inline into every later use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    div = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    y2 = y.cast("long") - F.when(m <= 2, 1).otherwise(0)
    era = div(y2, 400)
    yoe = y2 - era * 400
    doy = div((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 1
    return era * 146097 + yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy - 719468


def known_zone(name: Column) -> Column:
    """The IANA zone of that name, whatever its case; null for any other text."""
    zones = {z.lower(): z for z in sorted(available_timezones())}
    return F.try_element_at(F.create_map(*[F.lit(x) for item in zones.items() for x in item]), F.lower(F.trim(name)))


def with_utc_ms(df: DataFrame, value: str, zone: str, locale: str, digits: str = "epoch", out: str = "utc_ms") -> DataFrame:
    """Add `out` (long, null where the value names no instant).

    value, zone, locale: column names; zone holds IANA names (known_zone) or null. digits: what a value of digits only is: "epoch" (10 digits seconds,
    13 milliseconds, 8 and 14 a calendar date) or "cdx" (a UTC calendar prefix of 4 to 17 digits).
    """
    text = F.lower(F.regexp_replace(F.regexp_replace(F.translate(F.col(value), _SEP + _HIT, ""), r"[\s\x1c-\x1f\x85\p{Z}]+", " "), "^ | $", ""))
    # "İ" and its kin may change length when lowered; no format contains them
    hit = F.regexp_replace(text, PATTERN, _replacement())
    names = {p: f"__ts_{p}" for p in _PARTS}
    out_df = df.withColumn("__ts", F.when(F.startswith(hit, F.lit(_HIT)), F.split(F.substring(hit, 2, 2_147_483_647), _SEP)))
    part = lambda p: F.nullif(F.get(F.col("__ts"), _PARTS.index(p)), F.lit(""))
    out_df = _with_fields(out_df, {names[p]: part(p) for p in _PARTS})
    c = {p: F.col(n) for p, n in names.items()}
    num = lambda col: col.cast("int")

    size = F.length(c["g"])
    calendar = c["g"].isNotNull() & (size.isin(4, 6, 8, 10, 12, 14, 17) if digits == "cdx" else size.isin(8, 14))
    cut = lambda a, n, low: F.when(calendar, F.when(size >= a + n - 1, num(F.substring(c["g"], a, n))).otherwise(low))
    month_first = F.lower(F.translate(F.col(locale), "_", "-")).isin(*MONTH_FIRST)
    a, b = num(c["a"]), num(c["b"])
    # without a locale only an order that is the sole possible one counts
    first_is_month = F.coalesce(month_first, F.when((a > 12) & (b <= 12), False).when((b > 12) & (a <= 12), True).when(a == b, True))
    months = {w: i + 1 for i, ws in enumerate(MONTHS) for w in ws.split()}
    y = F.coalesce(num(c["y"]), cut(1, 4, None))
    m = F.coalesce(num(c["m"]), _lookup(months, c["n"]), F.when(first_is_month, a).when(~first_is_month, b), cut(5, 2, 1))
    d = F.coalesce(num(c["d"]), F.when(first_is_month, b).when(~first_is_month, a), cut(7, 2, 1))
    h0 = F.coalesce(num(c["h"]), cut(9, 2, 0), F.lit(0))
    pm = c["p"]
    h = F.when(pm.isNull(), h0).when((h0 >= 1) & (h0 <= 12), h0 % 12 + F.when(pm == "p", 12).otherwise(0))
    i = F.coalesce(num(c["i"]), cut(11, 2, 0), F.lit(0))
    s = F.coalesce(num(c["s"]), cut(13, 2, 0), F.lit(0))
    ms = F.coalesce(num(F.rpad(F.substring(c["f"], 1, 3), 3, "0")), cut(15, 3, 0), F.lit(0))
    out_df = _with_fields(out_df, {"__tv_Y": y, "__tv_M": m, "__tv_D": d, "__tv_H": h, "__tv_I": i, "__tv_S": s, "__tv_F": ms})
    y, m, d, h, i, s, ms = (F.col(f"__tv_{p}") for p in "YMDHISF")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    possible = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last) & h.between(0, 23) & i.between(0, 59) & s.between(0, 59)
    local = (days_from_civil(y, m, d) * 86400 + h.cast("long") * 3600 + i * 60 + s) * 1000 + ms
    z = c["z"]
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    hhmm = F.regexp_replace(z, "[+:-]", "")
    zh, zm = num(F.substring(hhmm, 1, 2)), F.coalesce(num(F.nullif(F.substring(hhmm, 3, 2), F.lit(""))), F.lit(0))
    minutes = F.when(z.rlike("^[+-]"), F.when((zh <= 18) & (zm <= 59), sign * (zh * 60 + zm))).otherwise(_lookup(ZONE_MINUTES, z))
    if digits == "cdx":
        named_instant = local
    else:
        zone_name = F.when(c["r"].isNotNull(), known_zone(c["r"])).otherwise(F.col(zone))
        named_instant = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), zone_name))
    instant = F.when(possible, F.when(z.isNotNull(), local - minutes.cast("long") * 60_000).otherwise(named_instant))
    if digits == "epoch":
        stamp = c["g"].cast("long")
        instant = F.when(size == 10, stamp * 1000).when(size == 13, stamp).when(size == 16, F.floor(stamp / 1000)).otherwise(instant)
    out_df = out_df.withColumn(out, instant.cast("long"))
    return out_df.drop("__ts", *names.values(), *(f"__tv_{p}" for p in "YMDHISF"))


def normalise_timestamps(values: DataFrame, sites: DataFrame, digits: str = "epoch") -> DataFrame:
    """values(src, rec_id, domain, value) joined to sites(domain, site_zone, locale) -> (src, rec_id, utc_ms), nulls left out.

    A domain without a row in sites counts as one without zone and locale. sites is left to the planner:
    broadcast below spark.sql.autoBroadcastJoinThreshold, sorted and merged beyond it.
    """
    places = sites.select(F.lower(F.trim("domain")).alias("__place"), known_zone(F.col("site_zone")).alias("site_zone"), "locale").where("__place is not null").dropDuplicates(["__place"])
    joined = values.select("src", "rec_id", "value", F.lower(F.trim("domain")).alias("__place")).where("value is not null").join(places, "__place", "left")
    return with_utc_ms(joined, "value", "site_zone", "locale", digits).where("utc_ms is not null").select("src", "rec_id", "utc_ms")
