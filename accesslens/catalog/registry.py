"""Query registry: Spark function and, where it can be written, the SQL twin."""

from functools import cached_property

from pyspark.sql import functions as F

from accesslens.operators import profiles as P
from accesslens.operators.features import build_features, plain_features
from accesslens.operators.queue import temporal_split
from accesslens.operators.risk import alerts as build_alerts
from accesslens.plans.segments import EntitySegments
from accesslens.session import CODEGEN, materialize
from accesslens.sources.access_log import access_log

QUERIES = {}
SQL = {}


class Views:
    """The derived views of one data folder, built on demand for one query."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def log(self):
        return access_log(self.spark, self.sf_dir)

    @cached_property
    def segments(self):
        return EntitySegments.probe(self.log)

    @cached_property
    def split_log(self):
        """The log marked train or test by time; the passes that find the cut run once."""
        return temporal_split(self.log)

    @cached_property
    def features(self):
        return build_features(self.log, self.segments)

    @cached_property
    def plain(self):
        """Features without category codes."""
        return plain_features(self.log, self.segments)

    @cached_property
    def stored_features(self):
        """Features written once, for queries that pass over them several times."""
        return materialize(self.features, "features")

    @cached_property
    def profiled(self):
        """What profiles and statistical scores need of the features, written once: one feature pass serves both."""
        return materialize(self.plain.select(*P.PROFILED), "profiled")

    @cached_property
    def profiles(self):
        # Exact percentiles hold all counted values of an entity in one group: hot entities take theirs from bins.
        if self.segments.hot:
            return P.entity_profiles(self.profiled, self.segments)
        return P.profiles_of_states(P.profile_states(self.profiled))

    @cached_property
    def stored_profiles(self):
        return materialize(self.profiles, "profiles")

    @cached_property
    def peers(self):
        return P.peer_groups(self.stored_profiles)

    @cached_property
    def alerts(self):
        """Profiles, scores and the speed range each pass over the features, so these are written once."""
        return build_alerts(materialize(self.plain, "plain-features"), self.segments, self.log)

    def stored_alerts(self, *columns):
        """The named alert columns written once; only they are computed."""
        return materialize(self.alerts.select(*columns), "alerts")


def query(name, sql=None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(name)

        def run(spark, sf_dir):
            for key, value in {"spark.sql.session.timeZone": "UTC", **CODEGEN}.items():
                spark.conf.set(key, value)
            return fn(Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def rnd(column, digits=6, name=None):
    """Rounded double (rounding never yields a negative zero here)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits).alias(name or column)


def sql_rnd(expr, name=None, digits=6):
    x = f"round(cast({expr} AS double), {digits})"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE {x} END AS {name or expr}"


def text_time(column="timestamp", name=None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def sql_time(expr='"timestamp"', name='"timestamp"'):
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"
