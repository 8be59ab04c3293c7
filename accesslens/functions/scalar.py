"""Per-row expressions; all stay inside whole-stage code generation."""

import math
from itertools import chain

from pyspark.sql import Column, functions as F

from accesslens import constants as C


def lookup_map(mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def epoch_seconds(ts) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def epoch_micros(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; 1-a is clamped so rounding never takes the root of a negative."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * C.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def temporal(ts="timestamp") -> dict:
    """Clock and calendar features; Monday is 0 and 05:59 still counts as night."""
    t = F.col(ts)
    hour, dow = F.hour(t), F.weekday(t)
    return {
        "hour": hour.cast("long"),
        "day_of_week": dow.cast("long"),
        "is_weekend": (dow >= 5).cast("long"),
        "is_night": ((hour >= 22) | (hour <= 5)).cast("long"),
        "day_of_month": F.dayofmonth(t).cast("long"),
        "minute_of_day": (hour * 60 + F.minute(t)).cast("long"),
        "hour_sin": F.sin(hour * (2 * math.pi / 24)),
        "hour_cos": F.cos(hour * (2 * math.pi / 24)),
        "dow_sin": F.sin(dow * (2 * math.pi / 7)),
        "dow_cos": F.cos(dow * (2 * math.pi / 7)),
    }


def geo_part(index, geo="geo_location") -> Column:
    """One coordinate of ``lat,lon`` text, null where it does not parse."""
    return F.try_element_at(F.split(F.col(geo), ","), F.lit(index + 1)).try_cast("double")


def coordinates(geo="geo_location") -> dict:
    """Latitude and longitude; a pair that does not parse becomes (0, 0) as a whole."""
    lat, lon = geo_part(0, geo), geo_part(1, geo)
    good = lat.isNotNull() & lon.isNotNull()
    return {"latitude": F.when(good, lat).otherwise(0.0), "longitude": F.when(good, lon).otherwise(0.0)}


def cmd_count(commands="command_sequence") -> Column:
    return F.coalesce(F.json_array_length(F.col(commands)), F.lit(0)).cast("long")


def has_suspicious_cmd(commands="command_sequence") -> Column:
    return F.coalesce(F.lower(F.col(commands)).rlike("|".join(C.SUSPICIOUS_TERMS)), F.lit(False)).cast("long")


def fingerprint_parts(fingerprint="device_fingerprint") -> Column:
    return F.when(F.col(fingerprint).isNull(), 0).otherwise(F.size(F.split(F.col(fingerprint), r"\|"))).cast("long")


def log_duration(duration="session_duration") -> Column:
    return F.log1p(F.greatest(F.col(duration), F.lit(0)).cast("double"))


def behaviour() -> dict:
    return {
        "cmd_count": cmd_count(),
        "has_suspicious_cmd": has_suspicious_cmd(),
        "fingerprint_parts": fingerprint_parts(),
        "auth_success_int": F.col("auth_success").cast("long"),
        "log_session_duration": log_duration(),
    }


def repaired(value) -> Column:
    """Missing and NaN become 0, infinities become +/-1e6."""
    x = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return (F.when(x == float("inf"), 1e6).when(x == float("-inf"), -1e6).otherwise(x))


def display_name(feature) -> Column:
    return F.coalesce(F.try_element_at(lookup_map(C.DISPLAY_NAMES), feature), feature)


def attack_description(label) -> Column:
    return F.coalesce(F.try_element_at(lookup_map(C.ATTACK_DESCRIPTIONS), label), label)


def severity_color(severity) -> Column:
    colors = {name: color for name, _, _, color in C.SEVERITY_TIERS}
    return F.coalesce(F.try_element_at(lookup_map(colors), severity), F.lit(C.DEFAULT_COLOR))


def severity(risk, contiguous=False) -> Column:
    """Tier of a risk score.

    By default the published bounds are closed on both sides, so a score between two tiers
    (84.5, say) is Low; ``contiguous`` uses half-open tiers without holes.
    """
    out = F.when(risk > 100, "Critical")
    for name, low, high, _ in C.SEVERITY_TIERS:
        inside = (risk >= low) if contiguous else ((risk >= low) & (risk <= high))
        out = out.when(inside, name)
    return out.otherwise("Low")


def format_timestamp(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def hash_uniform(*parts, seed=42) -> Column:
    """A number in [0, 1) that depends only on its arguments: 52 bits of the md5 of their texts and the seed, so any
    engine can repeat it."""
    texts = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    digest = F.md5(F.concat_ws(":", *texts, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_normal(*parts, seed=42) -> Column:
    """Standard normal from two hash uniforms (Box-Muller)."""
    u1 = F.greatest(hash_uniform(*parts, seed=seed), F.lit(1e-12))
    u2 = hash_uniform(*parts, seed=seed + 7919)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
