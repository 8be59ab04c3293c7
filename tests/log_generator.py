"""Synthetic access logs: entity profiles, normal events and seven kinds of injected attacks.

All draws are hashes of (row, salt), so any task can make any row again and the output does not depend on
partitioning. Entities come as a frame with a dense ``entity_no`` (0, 1, ...).
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.functions.scalar import hash_normal, hash_uniform
from accesslens.plans.replicate import replicate

# Invented pools of this generator, by entity type.
RESOURCES = {
    "user": [f"/home/page{i}" for i in range(12)],
    "service_account": [f"/jobs/task{i}" for i in range(10)],
    "edge_device": [f"/sensor/channel{i}" for i in range(10)],
}
SENSITIVE_RESOURCES = ["/home/page1", "/jobs/task2", "/home/page3", "/jobs/task4"]
AUTH_WEIGHTS = {
    "user": {"password": 0.6, "token": 0.4},
    "service_account": {"token": 0.7, "certificate": 0.3},
    "edge_device": {"certificate": 0.8, "token": 0.2},
}
NORMAL_COMMANDS = {
    "user": [["open", "read", "close"], ["open", "write", "close"]],
    "service_account": [["start", "run", "stop"], ["start", "check", "stop"]],
    "edge_device": [["wake", "send", "sleep"], ["wake", "measure", "send", "sleep"]],
}
SUSPICIOUS_COMMANDS = [["open", "escalate", "dump", "close"], ["open", "disable_logging", "close"]]
OPERATING_SYSTEMS = {kind: [f"{kind} system {i}" for i in range(4)] for kind in RESOURCES}
PROTOCOLS = {kind: [f"protocol {i}" for i in range(3)] for kind in RESOURCES}
# Share of all events per attack kind, and the events one injection stands for.
ATTACK_RATES = {
    "brute_force": (0.004, 20), "impossible_travel": (0.003, 2), "credential_stuffing": (0.003, 25),
    "lateral_movement": (0.004, 7), "device_spoofing": (0.003, 1), "low_and_slow": (0.003, 10), "insider_drift": (0.005, 5),
}


START = "2026-04-01 00:00:00"
DAYS = 90


def _pick(values, u):
    """Element of a literal list by a uniform number."""
    items = F.array(*[F.lit(x) for x in values])
    return F.element_at(items, (F.floor(u * len(values)) + 1).cast("int"))


def _weighted(weights, u):
    out, acc = None, 0.0
    names = [(n, w) for n, w in weights.items() if w > 0]
    for name, w in names[:-1]:
        acc += w
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return out.otherwise(names[-1][0])


def _by_type(make):
    """A column that depends on the entity type; ``make(type)`` gives the column for one type."""
    kinds = list(C.ENTITY_TYPES)
    out = F.when(F.col("entity_type") == kinds[0], make(kinds[0]))
    for kind in kinds[1:]:
        out = out.when(F.col("entity_type") == kind, make(kind))
    return out


def _shuffled(values, *seed_parts, seed):
    """The literal list in an order drawn per row."""
    items = F.array(*[
        F.struct(hash_uniform(*seed_parts, F.lit(i), seed=seed).alias("u"), F.lit(v).alias("v"))
        for i, v in enumerate(values)])
    return F.transform(F.sort_array(items), lambda s: s["v"])


def _json(commands):
    return "[" + ", ".join(f'"{c}"' for c in commands) + "]"


def _ip(*parts, seed):
    octet = lambda k, lo, hi: (F.lit(lo) + F.floor(hash_uniform(*parts, seed=seed + k) * (hi - lo))).cast("string")
    return F.concat_ws(".", octet(0, 11, 100), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 255))


def _mac(*parts, seed):
    h = F.lpad(F.hex(F.xxhash64(*parts, F.lit(seed))), 16, "0")
    return F.lower(F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)]))


def entity_profiles(entities: DataFrame, seed=42) -> DataFrame:
    """Habits of each entity: type mix 60/25/15, hours, one or two cities, 3-6 resources, usual authentication."""
    no = F.col("entity_no")
    u = lambda k: hash_uniform(no, seed=seed + k)
    slot = no % 20
    kind = F.when(slot < 12, "user").when(slot < 17, "service_account").otherwise("edge_device")
    out = entities.withColumn("entity_type", kind)
    prefix = _by_type(lambda t: F.lit(C.ENTITY_PREFIX[t]))
    hours = {"user": (7, 20), "service_account": (0, 24), "edge_device": (0, 24)}
    hour_std = {"user": (1.0, 2.5), "service_account": (0.5, 1.5), "edge_device": (1.0, 3.0)}
    session = {"user": (300, 3600), "service_account": (5, 120), "edge_device": (60, 600)}
    per_day = {"user": (3, 15), "service_account": (20, 100), "edge_device": (10, 50)}
    between = lambda table, k: _by_type(lambda t: F.lit(float(table[t][0])) + u(k) * float(table[t][1] - table[t][0]))
    resources = _by_type(lambda t: _shuffled(RESOURCES[t], no, seed=seed + 20))
    cities = _shuffled(list(range(len(C.CITIES))), no, seed=seed + 21)
    return out.select(
        "entity_no", "entity_type",
        F.concat(prefix, F.lit("_"), F.lpad(no.cast("string"), 4, "0")).alias("entity_id"),
        F.floor(between(hours, 1)).cast("long").alias("preferred_hour"),
        between(hour_std, 2).alias("hour_std"),
        F.slice(cities, F.lit(1), F.when(u(3) < 0.7, 1).otherwise(2)).alias("cities"),
        F.slice(resources, F.lit(1), (F.floor(u(4) * 4) + 3).cast("int")).alias("typical_resources"),
        resources.alias("all_resources"),
        _by_type(lambda t: _weighted(AUTH_WEIGHTS[t], u(5))).alias("preferred_auth"),
        between(session, 6).alias("session_mean"),
        _by_type(lambda t: _pick(OPERATING_SYSTEMS[t], u(7))).alias("os"),
        _mac(no, seed=seed + 8).alias("mac"),
        _by_type(lambda t: _pick(PROTOCOLS[t], u(9))).alias("protocol"),
        _ip(no, seed=seed + 10).alias("base_ip"),
        between(per_day, 14).alias("events_per_day"))


def _at(days, hours=0, minutes=0, seconds=0):
    part = lambda x, kind="int": (F.lit(x) if isinstance(x, int) else x).cast(kind)
    shift = F.make_dt_interval(part(days), part(hours), part(minutes), part(seconds, "decimal(18,6)"))
    return F.lit(START).cast("timestamp_ntz") + shift


def _habit_hour(*parts, seed):
    h = F.col("preferred_hour") + hash_normal(*parts, seed=seed) * F.col("hour_std")
    return F.floor(F.least(F.greatest(h, F.lit(0.0)), F.lit(23.0)))


def _geo(lat, lon):
    return F.format_string("%.4f,%.4f", lat, lon)


def _city(index, field):
    return F.element_at(F.array(*[F.lit(c[field]) for c in C.CITIES]), (index + 1).cast("int"))


def _habitual(rows: DataFrame, at, label, *key, seed):
    """Fill an event from the entity's habits; ``key`` identifies the row for the draws."""
    u = lambda k: hash_uniform(*key, seed=seed + k)
    place = F.element_at("cities", (F.floor(u(1) * F.size("cities")) + 1).cast("int"))
    habit = _by_type(lambda t: _pick(list(AUTH_WEIGHTS[t]), u(4)))
    commands = _by_type(lambda t: _pick([_json(c) for c in NORMAL_COMMANDS[t]], u(5)))
    duration = F.floor(F.exp(F.log("session_mean") + hash_normal(*key, seed=seed + 6) * 0.3))
    return rows.withColumn("_place", place).withColumns({
        "timestamp": at,
        "source_ip": F.col("base_ip"),
        "geo_location": _geo(_city(F.col("_place"), 1) + hash_normal(*key, seed=seed + 7) * 0.05,
                             _city(F.col("_place"), 2) + hash_normal(*key, seed=seed + 8) * 0.05),
        "geo_city": _city(F.col("_place"), 0),
        "resource_accessed": F.element_at(
            "typical_resources", (F.floor(u(2) * F.size("typical_resources")) + 1).cast("int")),
        "auth_method": F.when(u(3) < 0.85, F.col("preferred_auth")).otherwise(habit),
        "session_duration": F.greatest(F.lit(1), duration).cast("long"),
        "command_sequence": commands,
        "device_fingerprint": F.concat_ws("|", "os", "mac", "protocol"),
        "auth_success": F.lit(True),
        "label": F.lit(label),
    })


def _finish(rows: DataFrame, *key):
    """Log columns with a key drawn from the row's identity."""
    return rows.select(F.xxhash64("label", *key).alias("event_id"), *C.ACCESS_LOG_COLUMNS[1:])


def normal_events(profiles: DataFrame, total_events, days=DAYS, seed=42) -> DataFrame:
    """Events in proportion to activity, at least five per entity."""
    quota = int(total_events * (1 - sum(rate for rate, _ in ATTACK_RATES.values())))
    activity = profiles.agg(F.sum("events_per_day").alias("_all"))
    shared = profiles.crossJoin(F.broadcast(activity))
    times = F.greatest(F.lit(5), F.floor(quota * F.col("events_per_day") / F.col("_all")))
    rows = replicate(shared, times, "entity_no", "n").drop("_all")
    key = ("entity_no", "n")
    cols = [F.col(k) for k in key]
    u = lambda k: F.floor(hash_uniform(*cols, seed=seed + 100 + k) * (days if k == 0 else 60))
    at = _at(u(0), _habit_hour(*cols, seed=seed + 110), u(1), u(2))
    return _finish(_habitual(rows, at, "normal", *cols, seed=seed + 120), *key)


def _targets(profiles, entities, kind, count, users_only, devices_only, seed):
    """``count`` injections, each aimed at a drawn entity. Types follow the entity number, so a draw is arithmetic."""
    inj = profiles.sparkSession.range(count).withColumnRenamed("id", "inj")
    i = F.col("inj")
    salt = seed + 1000 * (1 + C.ATTACKS.index(kind))
    if users_only or devices_only:
        width, first = (12, 0) if users_only else (3, 17)
        group = F.floor(hash_uniform(i, seed=salt) * max(1, entities // 20))
        no = group * 20 + first + F.floor(hash_uniform(i, seed=salt + 1) * width)
    else:
        no = F.floor(hash_uniform(i, seed=salt) * entities)
    return inj.withColumn("entity_no", no.cast("long")).join(profiles, "entity_no"), salt


def attack_events(profiles: DataFrame, total_events, days=DAYS, seed=42) -> DataFrame:
    """The seven attack kinds; each has max(1, int(total * rate / events per injection)) injections."""
    entities = profiles.count()
    count = {k: max(1, int(total_events * rate / per)) for k, (rate, per) in ATTACK_RATES.items()}
    aim = lambda kind, users=False, devices=False: _targets(profiles, entities, kind, count[kind], users, devices, seed)
    i, n = F.col("inj"), F.col("n")
    draw = lambda salt, k, hi, *more: F.floor(hash_uniform(i, *more, seed=salt + k) * hi)
    many = lambda rows, times: replicate(rows, times, "inj", "n")
    parts = []

    rows, s = aim("brute_force")
    rows = many(rows, 10 + draw(s, 10, 41))
    at = _at(draw(s, 11, days), draw(s, 12, 24), draw(s, 13, 60), 1 + draw(s, 14, 299, n))
    place = draw(s, 15, len(C.CITIES), n)
    parts.append(_habitual(rows, at, "brute_force", i, n, seed=s + 20).withColumns({
        "source_ip": _ip(i, seed=s + 30), "geo_location": _geo(_city(place, 1), _city(place, 2)),
        "geo_city": _city(place, 0), "resource_accessed": F.lit("/auth/login"), "auth_method": F.lit("password"),
        "session_duration": (1 + draw(s, 16, 4, n)).cast("long"), "command_sequence": F.lit(_json(["login_attempt_failed"])),
        "device_fingerprint": F.concat(F.lit("Unknown|"), _mac(i, n, seed=s + 31), F.lit("|HTTPS")),
        "auth_success": F.lit(False)}))

    rows, s = aim("impossible_travel", users=True)
    rows = many(rows, F.lit(2))
    at = _at(draw(s, 10, days), 8 + draw(s, 11, 12), F.when(n == 1, 10 + draw(s, 12, 36)).otherwise(0))
    home = F.element_at("cities", 1)
    # Every city has another one more than 500 km away; fixed table of such cities per city.
    far = F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in _far_cities()]), (home + 1).cast("int"))
    there = F.element_at(far, (draw(s, 13, 1 << 20) % F.size(far) + 1).cast("int"))
    place = F.when(n == 0, home).otherwise(there)
    parts.append(_habitual(rows, at, "impossible_travel", i, n, seed=s + 20).withColumns({
        "geo_location": _geo(_city(place, 1), _city(place, 2)), "geo_city": _city(place, 0),
        "source_ip": F.when(n == 0, F.col("base_ip")).otherwise(_ip(i, seed=s + 30))}))

    s = seed + 1000 * (1 + C.ATTACKS.index("credential_stuffing"))
    raids = profiles.sparkSession.range(count["credential_stuffing"]).withColumnRenamed("id", "inj")
    raids = many(raids, F.least(20 + draw(s, 10, 21), F.lit(entities)))
    # Consecutive entity numbers from a drawn start: distinct targets without drawing again.
    raids = raids.withColumn("entity_no", ((draw(s, 11, entities) + n) % entities).cast("long")).join(profiles, "entity_no")
    ok = hash_uniform(i, n, seed=s + 12) < 0.15
    place = draw(s, 13, len(C.CITIES))
    source = draw(s, 15, 1 << 20, n) % (1 + draw(s, 14, 3))
    at = _at(draw(s, 16, days), 1 + draw(s, 17, 5), 0, draw(s, 18, 1800, n))
    parts.append(_habitual(raids, at, "credential_stuffing", i, n, seed=s + 20).withColumns({
        "source_ip": _ip(i, source, seed=s + 30), "geo_location": _geo(_city(place, 1), _city(place, 2)),
        "geo_city": _city(place, 0), "resource_accessed": F.lit("/auth/login"), "auth_method": F.lit("password"),
        "session_duration": (1 + draw(s, 19, 9, n)).cast("long"),
        "command_sequence": F.when(ok, _json(["login", "enumerate_accounts"])).otherwise(_json(["login_attempt_failed"])),
        "device_fingerprint": F.concat(F.lit("Linux|"), _mac(i, n, seed=s + 31), F.lit("|HTTPS")), "auth_success": ok}))

    rows, s = aim("lateral_movement")
    everything = [r for pool in RESOURCES.values() for r in pool]
    unusual = F.array_except(_shuffled(everything, i, seed=s + 9), "typical_resources")
    rows = many(rows, 5 + draw(s, 10, 6))
    at = _at(draw(s, 11, days), draw(s, 12, 24), n * (2 + draw(s, 13, 13, n)))
    parts.append(_habitual(rows, at, "lateral_movement", i, n, seed=s + 20).withColumns({
        "resource_accessed": F.element_at(unusual, (n + 1).cast("int")),
        "command_sequence": _pick([_json(c) for c in SUSPICIOUS_COMMANDS], hash_uniform(i, n, seed=s + 14))}))

    rows, s = aim("device_spoofing", devices=True)
    rows = rows.withColumn("n", F.lit(0).cast("long"))
    systems = [o for pool in OPERATING_SYSTEMS.values() for o in pool]
    other = F.element_at(F.array_except(_shuffled(systems, i, seed=s + 9), F.array("os")), 1)
    at = _at(draw(s, 10, days), draw(s, 11, 24), draw(s, 12, 60))
    parts.append(_habitual(rows, at, "device_spoofing", i, n, seed=s + 20).withColumn(
        "device_fingerprint", F.concat_ws("|", other, _mac(i, seed=s + 30), F.col("protocol"))))

    rows, s = aim("low_and_slow")
    rows = many(rows, F.lit(12))
    week = F.when(n < 2, 0).when(n < 6, 1).otherwise(2)
    day = draw(s, 10, max(1, days - 21)) + week * 7 + draw(s, 11, 7, n)
    rows = rows.withColumn("_day", day).where(F.col("_day") < days)
    at = _at(F.col("_day"), 2 + draw(s, 12, 4, n), draw(s, 13, 60, n))
    parts.append(_habitual(rows, at, "low_and_slow", i, n, seed=s + 20).withColumns({
        "resource_accessed": _pick(SENSITIVE_RESOURCES, hash_uniform(i, n, seed=s + 14)),
        "session_duration": (60 + draw(s, 15, 240, n)).cast("long")}))

    rows, s = aim("insider_drift", users=True)
    fresh = F.array_except("all_resources", "typical_resources")
    # One or two new resources in each of four weeks: two slots a week, the second taken half of the time.
    rows = many(rows, F.lit(8)).where((n % 2 == 0) | (draw(s, 9, 2, F.floor(n / 2)) == 1))
    week = F.floor(n / 2)
    rows = rows.where(n < F.size(fresh)).withColumn(
        "_day", draw(s, 10, max(1, days - 30)) + week * 7 + draw(s, 11, 7, n)).where(F.col("_day") < days)
    at = _at(F.col("_day"), _habit_hour(i, n, seed=s + 12), draw(s, 13, 60, n))
    parts.append(_habitual(rows, at, "insider_drift", i, n, seed=s + 20).withColumn(
        "resource_accessed", F.element_at(fresh, (n + 1).cast("int"))))

    return reduce(DataFrame.unionByName, [_finish(p, "inj", "n") for p in parts])


def _far_cities(minimum=500.0):
    from math import asin, cos, radians, sin, sqrt

    def km(a, b):
        lat1, lon1, lat2, lon2 = map(radians, (*a, *b))
        h = sin((lat2 - lat1) / 2) ** 2 + cos(lat1) * cos(lat2) * sin((lon2 - lon1) / 2) ** 2
        return 2 * C.EARTH_RADIUS_KM * asin(sqrt(h))

    points = [(lat, lon) for _, lat, lon in C.CITIES]
    return [[j for j, q in enumerate(points) if km(p, q) > minimum] for p in points]


def generate_access_log(entities: DataFrame, total_events, days=DAYS, seed=42) -> DataFrame:
    """Normal events and attacks as one log."""
    profiles = entity_profiles(entities, seed)
    return normal_events(profiles, total_events, days, seed).unionByName(attack_events(profiles, total_events, days, seed))
