"""Column expressions of the activity queue: backoff, leases, keys, labels. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the queue's model.
PRIORITIES = {1: "Low", 2: "Normal", 3: "High", 4: "Critical"}
LABELS = {"pending": "Pending", "scheduled": "Scheduled", "processing": "Running", "completed": "Completed", "failed": "Failed", "retrying": "Retrying", "dead_letter": "DeadLetter", "waiting": "Waiting"}
TERMINAL = ["completed", "failed", "dead_letter"]
DUE = ["scheduled", "retrying", "waiting"]
#: Seconds that fit in a signed 64-bit count of nanoseconds.
MOST_SECONDS = 9223372036
DEFAULT_CAP_SECONDS = 3600
LEASE_MARGIN_SECONDS = 10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def status_label(status) -> Column:
    """The public name of a stored status; an unknown one counts as pending."""
    out = None
    for stored, label in LABELS.items():
        out = F.when(_c(status) == stored, label) if out is None else out.when(_c(status) == stored, label)
    return out.otherwise("Pending")


def clamp_priority(priority) -> Column:
    """Values of 1 or less are Low, values above 4 are Normal."""
    p = _c(priority)
    return F.when(p <= 1, 1).when(p > 4, 2).otherwise(p).cast("int")


def can_retry(retry_count, max_retries) -> Column:
    """max_retries counts attempts in total; 0 is no limit."""
    return (_c(max_retries) == 0) | (_c(retry_count) + 1 < _c(max_retries))


def retry_delay_seconds(base, retry_count, cap) -> Column:
    """min(cap, base * 2**min(retry_count + 1, 62)), without overflow; a base of 0 gives 0, a cap of 0 an hour."""
    base, cap = _c(base).cast("long"), _c(cap).cast("long")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(_c(retry_count) + 1, F.lit(62)).cast("int"))
    grown = F.when(base <= 0, F.lit(0).cast("long")).when(base <= F.floor(F.lit(MOST_SECONDS) / power), base * power).otherwise(F.lit(MOST_SECONDS).cast("long"))
    return F.least(F.when(cap <= 0, F.lit(DEFAULT_CAP_SECONDS).cast("long")).otherwise(cap), grown)


def epoch_ms(ts) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def lease_deadline_ms(start_ms, timeout_seconds, lease_ms: int) -> Column:
    """The engine's lease, or the timeout and a margin if that is later."""
    return _c(start_ms) + F.greatest(F.lit(lease_ms).cast("long"), (_c(timeout_seconds).cast("long") + LEASE_MARGIN_SECONDS) * 1000)


def plus_seconds(ts, seconds) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(seconds).cast("decimal(18,6)"))


def is_cron(metadata) -> Column:
    """Never null: no metadata and no source are not cron."""
    return F.coalesce(F.get_json_object(_c(metadata), "$.source") == "cron", F.lit(False))


def step_key(root, parent, name) -> Column:
    return F.concat(F.lit("rq:step:"), _c(root).cast("string"), F.lit(":"), _c(parent).cast("string"), F.lit(":"), _c(name))


def step_label(key) -> Column:
    """The step name of a step key, or null."""
    found = F.regexp_extract(_c(key), r"^rq:step:[^:]*:[^:]*:(.*)$", 1)
    return F.when(_c(key).rlike(r"^rq:step:[^:]*:[^:]*:"), found)


def signal_key(key, activity_type) -> Column:
    return F.concat(_c(key), F.lit("-"), _c(activity_type))


def step_kind(step) -> Column:
    """What stands before the first colon; without one, 'step'."""
    return F.when(F.instr(_c(step), ":") > 0, F.substring_index(_c(step), ":", 1)).otherwise("step")


def step_name(step) -> Column:
    at = F.instr(_c(step), ":")
    return F.when(at > 0, F.substring(_c(step), at + 1, F.length(_c(step)))).otherwise("")


def checkpoint_id(namespace, name) -> Column:
    """UUID version 5 of a UUID and a name."""
    digest = F.sha1(F.concat(F.unhex(F.regexp_replace(_c(namespace), "-", "")), F.encode(_c(name), "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), nibble % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def valid_queue_name(name) -> Column:
    """1 to 48 letters, digits and underscores, the first not a digit."""
    return F.coalesce(_c(name).rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,47}$"), F.lit(False))


def bare_event_type(event_type) -> Column:
    """Old rows hold the type as a JSON string; its quotes go."""
    return F.when(_c(event_type).rlike('^".*"$'), F.regexp_replace(_c(event_type), '^"|"$', "")).otherwise(_c(event_type))


def merged_metadata(maps):
    """An array of JSON maps as one: of equal keys the later one wins, whatever its value, null too. Null maps count as empty; none at all give null."""
    kind = "map<string,string>"
    maps = F.transform(F.filter(maps, lambda m: m.isNotNull()), lambda m: F.from_json(m, kind))
    # what comes later replaces, so that no key is there twice whatever spark.sql.mapKeyDedupPolicy says
    merge = lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m)
    return F.when(F.size(maps) > 0, F.to_json(F.aggregate(maps, F.create_map().cast(kind), merge)))
