"""Filter verdicts, rule helpers and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.catalogue.registry import query
from eventloom.catalogue.shapes import enriched_events
from eventloom.catalogue.tables import ENR, EV, canonical_events, table
from eventloom.functions import predicates as fn
from eventloom.functions.fields import same_object, same_reference
from eventloom.operators.filters import choose, exists_one, matches, verdict
from eventloom.operators.flow_index import match_many
from eventloom.operators.guard import guarded
from eventloom.operators.metrics import Metric, count_metrics, drop_counts, filter_drops
from eventloom.operators.networks import most_specific_network
from eventloom.operators.observe import counted, observe_outcomes, observe_verdicts
from eventloom.operators.routing import match, route
from eventloom.operators.routing import verdict_counts as count_verdicts
from eventloom.operators.sanitize import SanitizeSpec, sanitize
from eventloom.plans.spec import Flow

FLOWS = [
    Flow("alerts", sinks=("webhook", "archive"), filters=("type = 'Warning'",)),
    Flow("busy", sinks=("archive", "metrics"), filters=("type = 'Normal'", "int(labels['k']) >= 50")),
    Flow("east", sinks=("webhook", "metrics"), filters=("series.count > 10",), watches=("team-0", "team-1")),
    Flow("all", sinks=("archive",)),
]

_VERDICTS = f"""WITH {EV}, v AS (
  SELECT uid, seq, 'alerts' AS flow, CASE WHEN type = 'Warning' THEN 'matched' ELSE 'unmatched' END AS verdict FROM ev
  UNION ALL
  SELECT uid, seq, 'busy', CASE WHEN type <> 'Normal' THEN 'unmatched' WHEN label_k IS NULL THEN 'eval_error'
    WHEN CAST(label_k AS INT) >= 50 THEN 'matched' ELSE 'unmatched' END FROM ev
  UNION ALL
  SELECT uid, seq, 'east', CASE WHEN watch NOT IN ('team-0', 'team-1') THEN 'unbound'
    WHEN NOT has_series THEN 'eval_error' WHEN series_count > 10 THEN 'matched' ELSE 'unmatched' END FROM ev
  UNION ALL SELECT uid, seq, 'all', 'matched' FROM ev)"""


@query(
    f"""WITH {EV} SELECT namespace, reason, count(*) AS events FROM ev
    WHERE type = 'Warning' GROUP BY namespace, reason"""
)
def warnings_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: sanitise, filter, route, and count what reaches one sink."""
    flows = [Flow("alerts", sinks=("metrics",), filters=("type = 'Warning'",))]
    routed = route(match(sanitize(canonical_events(spark, sf_dir), SanitizeSpec()), flows))
    metric = Metric("warnings", labels={"namespace": "namespace", "reason": "reason"})
    counted = count_metrics(routed, [metric])
    return counted.select(
        F.col("labels")["namespace"].alias("namespace"),
        F.col("labels")["reason"].alias("reason"),
        F.col("value").alias("events"),
    )


@query(
    f"""WITH {EV} SELECT uid, CASE WHEN type <> 'Normal' THEN 'unmatched' WHEN r_kind <> 'Customer' THEN 'unmatched'
      WHEN label_k IS NULL THEN 'eval_error' WHEN label_k <> '42' THEN 'matched' ELSE 'unmatched' END AS verdict
    FROM ev"""
)
def filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["type = 'Normal'", "regarding.kind = 'Customer'", "labels['k'] <> '42'"]
    return canonical_events(spark, sf_dir).select("uid", verdict(rules).alias("verdict"))


@query(
    f"""WITH {EV} SELECT uid,
      CASE WHEN type = 'Normal' THEN CASE WHEN label_k IS NULL THEN 'eval_error'
           WHEN label_k = '1' THEN 'matched' ELSE 'unmatched' END ELSE 'unmatched' END AS false_then_error,
      CASE WHEN label_k IS NULL THEN 'eval_error' WHEN label_k <> '1' THEN 'unmatched'
           WHEN type = 'Normal' THEN 'matched' ELSE 'unmatched' END AS error_then_false,
      CASE WHEN type <> 'Normal' THEN 'unmatched' WHEN label_k IS NULL THEN 'eval_error'
           WHEN label_k = '1' THEN 'matched' ELSE 'unmatched' END AS absorbed,
      CASE WHEN label_k IS NULL THEN 'eval_error' WHEN label_k = '2' AND type = 'Normal' THEN 'matched'
           WHEN label_k <> '2' AND type = 'Warning' THEN 'matched' ELSE 'unmatched' END AS chosen
    FROM ev"""
)
def filter_error_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = F.col("labels")["k"] == "2"
    chosen = choose(unknown, F.col("type") == "Normal", F.col("type") == "Warning")
    return canonical_events(spark, sf_dir).select(
        "uid",
        verdict(["type = 'Normal'", "labels['k'] = '1'"]).alias("false_then_error"),
        verdict(["labels['k'] = '1'", "type = 'Normal'"]).alias("error_then_false"),
        verdict(["type = 'Normal' AND labels['k'] = '1'"]).alias("absorbed"),
        verdict([chosen]).alias("chosen"),
    )


# Rules that fail on some rows, each with the SQL of its verdict: NULL is an error.
_FAILING = {
    "by_zero": ("1 / (series.count - series.count) > 0", "CASE WHEN has_series THEN NULL END::BOOLEAN"),
    "remainder": ("100 % series.count = 0", "CASE WHEN series_count > 0 THEN 100 % series_count = 0 END"),
    "bad_cast": ("int(labels['kind']) > 3", "NULL::BOOLEAN"),
    "number": ("int(labels['k']) > 30", "CAST(label_k AS INT) > 30"),
    "mixed": ("resourceVersion > 2000", "TRY_CAST(rv AS BIGINT) > 2000"),
    "overflow": ("int(labels['k']) + 2147483600 > 0", "CASE WHEN CAST(label_k AS INT) <= 47 THEN true END"),
    "product": ("bigint(labels['k']) * 200000000000000000 > 0", "CASE WHEN CAST(label_k AS INT) = 0 THEN false WHEN CAST(label_k AS INT) <= 46 THEN true END"),
    "beyond": ("element_at(split(note, ','), 9) = 'x'", "NULL::BOOLEAN"),
    "index": ("split(resourceVersion, 'x')[1] = '7'", "CASE WHEN rv LIKE 'x%' THEN rv[2:] = '7' END"),
    "date": ("date(concat('2024-', labels['k'], '-01')) > date'2024-06-01'", "TRY_CAST('2024-' || (CASE WHEN label_k::INT BETWEEN 1 AND 12 THEN label_k END) || '-1' AS DATE) > DATE '2024-06-01'"),
    "absorbed": ("type = 'Warning' OR int(labels['kind']) > 3", "CASE WHEN type = 'Warning' THEN true END"),
    "absorbed_after": ("int(labels['kind']) > 3 AND type = 'Warning'", "CASE WHEN type <> 'Warning' THEN false END"),
    "any_value": ("exists(map_values(labels), v -> int(v) > 30)", "CASE WHEN CAST(label_k AS INT) > 30 THEN true END"),
    "every_value": ("forall(map_values(labels), v -> int(v) > 30)", "CASE WHEN CAST(label_k AS INT) <= 30 THEN false END"),
}


def _verdict_sql(held: str) -> str:
    return f"CASE WHEN ({held}) IS NULL THEN 'eval_error' WHEN {held} THEN 'matched' ELSE 'unmatched' END"


@query(f"WITH {EV} SELECT uid, {', '.join(f'{_verdict_sql(sql)} AS {name}' for name, (_, sql) in _FAILING.items())} FROM ev")
def filter_runtime_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose evaluation fails on some events: an error of those events, and of no other."""
    found = [verdict([rule]).alias(name) for name, (rule, _) in _FAILING.items()]
    return canonical_events(spark, sf_dir).select("uid", *found)


@query(
    f"""WITH {EV} SELECT uid, CAST(label_k AS INT) AS as_int, CAST(label_k AS DOUBLE) / 4 AS quarter,
      CAST(label_k AS INT) % 7 AS modulo, -CAST(label_k AS INT) AS negative, CAST(series_count AS VARCHAR) AS as_text,
      TRY_CAST(rv AS BIGINT) - 1000 AS version, epoch_us(event_time) // 1000000 AS seconds,
      CASE WHEN series_count > 0 THEN 1000 // series_count END AS per_count
    FROM ev"""
)
def rule_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts and arithmetic of rules, NULL where they fail."""
    values = {
        "as_int": "int(labels['k'])",
        "quarter": "double(labels['k']) / 4",
        "modulo": "int(labels['k']) % 7",
        "negative": "-int(labels['k'])",
        "as_text": "string(series.count)",
        "version": "bigint(resourceVersion) - 1000",
        "seconds": "unix_seconds(eventTime)",
        "per_count": "1000 div series.count",
    }
    events = canonical_events(spark, sf_dir)
    found = [column.alias(name) for name, column in zip(values, guarded(list(values.values()), events.schema), strict=True)]
    return events.select("uid", *found)


@query(
    f"""WITH {EV} SELECT uid, r_kind = 'Order' AND r_namespace = namespace AND seq % 13 = 0 AS same_ref,
      NOT has_series OR series_last IS NULL AS same_series,
      label_k IS NOT DISTINCT FROM nullif(k, '7') AS same_object,
      (label_k IS NOT NULL AND label_k = '3')::BOOLEAN AS one_is_three,
      CASE WHEN label_k IS NULL THEN 1 ELSE 2 END AS label_count FROM ev"""
)
def content_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, series and objects compared by what they hold; maps in whatever order of their entries."""
    other = F.expr(
        """named_struct('kind', 'Order', 'namespace', namespace, 'name', regarding.name, 'uid', 'stale',
             'apiVersion', 'shop.example.com/v1', 'resourceVersion', '', 'fieldPath', '')"""
    )
    first_only = F.when(F.col("series").isNotNull(), F.struct(F.col("series.count").alias("count"), F.lit(None).cast("timestamp").alias("lastObservedTime")))
    k = F.get_json_object("note", "$.k")
    turned = F.map_filter(F.create_map(F.lit("k"), k, F.lit("kind"), F.col("reason")), lambda name, value: (name != "k") | (value != "7"))

    def held(labels: Column) -> Column:
        owner = F.col("regarding").alias("owner")
        return F.struct(labels.alias("labels"), F.col("annotations"), owner, F.lit(False).alias("terminating"))

    return canonical_events(spark, sf_dir).select(
        "uid",
        same_reference(F.col("regarding"), other).alias("same_ref"),
        same_reference(F.col("series"), first_only).alias("same_series"),
        same_object(held(F.col("labels")), held(turned)).alias("same_object"),
        exists_one(F.map_values("labels"), lambda value: value == "3").alias("one_is_three"),
        F.size("labels").alias("label_count"),
    )


def _bench(rule: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = canonical_events(spark, sf_dir).filter(matches([rule]))
    return kept.groupBy("namespace").agg(F.count("*").alias("events"))


@query(f"WITH {EV} SELECT namespace, count(*) AS events FROM ev WHERE type = 'Warning' GROUP BY 1")
def bench_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench("type = 'Warning'", spark, sf_dir)


@query(f"WITH {EV} SELECT namespace, count(*) AS events FROM ev WHERE contains(note, '9') GROUP BY 1")
def bench_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench("contains(note, '9')", spark, sf_dir)


@query(f"WITH {EV} SELECT namespace, count(*) AS events FROM ev WHERE r_kind = 'Customer' GROUP BY 1")
def bench_ref_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench("regarding.kind = 'Customer'", spark, sf_dir)


@query(
    f"""WITH {EV} SELECT namespace, count(*) AS events FROM ev WHERE type = 'Normal' AND r_kind = 'Customer'
      AND reason <> 'view' AND namespace <> 'team-4' AND contains(note, '1') GROUP BY 1"""
)
def bench_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (
        "type = 'Normal' AND regarding.kind = 'Customer' AND reason <> 'view' AND namespace <> 'team-4' "
        "AND contains(note, '1')"
    )
    return _bench(rule, spark, sf_dir)


@query(
    f"""WITH {EV} SELECT verdict, count(*) AS events FROM (
      SELECT CASE WHEN len(list_filter(range(0, 100), lambda i: contains(reason || '-' || note || '-' || i, '77}}-'))) = 0
        THEN 'matched' ELSE 'unmatched' END AS verdict FROM ev) GROUP BY verdict"""
)
def bench_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over every one of a hundred labels."""
    prefix = F.concat("reason", F.lit("-"), "note", F.lit("-"))
    keys, values = [F.lit(f"k{i}") for i in range(100)], [F.concat(prefix, F.lit(str(i))) for i in range(100)]
    events = canonical_events(spark, sf_dir).withColumn("labels", F.map_from_arrays(F.array(*keys), F.array(*values)))
    rule = "forall(map_values(labels), v -> NOT contains(v, '77}-'))"
    return events.groupBy(verdict([rule]).alias("verdict")).agg(F.count("*").alias("events"))


@query(
    f"""WITH {ENR} SELECT enrich_result, CASE WHEN enrich_result <> 'hit' THEN 'eval_error'
      WHEN segment = 'BUILDING' THEN 'matched' ELSE 'unmatched' END AS verdict, count(*) AS events
    FROM enr GROUP BY 1, 2"""
)
def filter_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = "regardingObject.labels['segment'] = 'BUILDING'"
    return (
        enriched_events(spark, sf_dir)
        .groupBy("enrich_result", verdict([rule]).alias("verdict"))
        .agg(F.count("*").alias("events"))
    )


@query(
    f"""{_VERDICTS}, sinks(flow, sink) AS (VALUES ('alerts', 'webhook'), ('alerts', 'archive'), ('busy', 'archive'),
      ('busy', 'metrics'), ('east', 'webhook'), ('east', 'metrics'), ('all', 'archive'))
    SELECT DISTINCT uid, sink FROM v JOIN sinks USING (flow) WHERE verdict = 'matched'"""
)
def route_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route(match(canonical_events(spark, sf_dir), FLOWS)).select("uid", "sink")


@query(
    f"""WITH {EV}, flows AS (SELECT k, 'f' || k AS flow FROM range(3000) r(k)), v AS (
      SELECT flow, CASE WHEN label_k IS NULL THEN 'eval_error' WHEN CAST(label_k AS INT) >= flows.k % 100 THEN 'matched' END AS verdict
      FROM ev JOIN flows ON r_name = 'customer-' || flows.k WHERE flows.k % 3 <> 2 OR watch IN ('team-1', 'team-2')
      UNION ALL SELECT 'any-' || kind, 'matched' FROM ev JOIN (VALUES ('click'), ('view')) kinds(kind) ON reason = kind)
    SELECT flow, verdict, count(*) AS events FROM v WHERE verdict IS NOT NULL GROUP BY 1, 2"""
)
def many_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three thousand flows, each for one customer, found by their keys."""
    flows = [
        Flow(f"f{k}", (f"s{k % 7}",), (f"regarding.name = 'customer-{k}' AND int(labels['k']) >= {k % 100}",), ("team-1", "team-2") if k % 3 == 2 else None)
        for k in range(3000)
    ]
    flows += [Flow(f"any-{kind}", ("kinds",), (f"reason = '{kind}'",)) for kind in ("click", "view")]
    return count_verdicts(match_many(canonical_events(spark, sf_dir), flows))


@query(
    f"""{_VERDICTS} SELECT flow, verdict, count(*) AS events FROM v
    WHERE verdict IN ('matched', 'eval_error') GROUP BY 1, 2"""
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_verdicts(match(canonical_events(spark, sf_dir), FLOWS))


@query(
    f"""{_VERDICTS} SELECT 'filter' AS stage, 'eval_error' AS reason, flow, '' AS sink,
      CAST(count(*) AS BIGINT) AS events FROM v WHERE verdict = 'eval_error' GROUP BY flow"""
)
def filter_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_counts(filter_drops(match(canonical_events(spark, sf_dir), FLOWS)))


@query(
    f"""{_VERDICTS} SELECT verdict AS name, flow AS subject, count(*) AS events FROM v
    WHERE verdict IN ('matched', 'eval_error') GROUP BY 1, 2
    UNION ALL SELECT 'routed', sink, count(DISTINCT uid) FROM (SELECT uid, unnest(CASE flow WHEN 'alerts' THEN ['webhook', 'archive']
      WHEN 'busy' THEN ['archive', 'metrics'] WHEN 'east' THEN ['webhook', 'metrics'] ELSE ['archive'] END) AS sink
      FROM v WHERE verdict = 'matched') GROUP BY sink"""
)
def observed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the rules, taken while the events are routed and counted by sink: one scan for both."""
    observation = Observation("verdicts")
    matched = observe_verdicts(match(canonical_events(spark, sf_dir), FLOWS), FLOWS, observation)
    routed = route(matched).groupBy("sink").agg(F.count("*").alias("events")).collect()  # one row a sink
    sinks = spark.createDataFrame([("routed", row["sink"], row["events"]) for row in routed], "name string, subject string, events bigint")
    return counted(spark, observation.get).union(sinks)


@query(f"WITH {ENR} SELECT enrich_result AS name, '' AS subject, count(*) AS events FROM enr GROUP BY 1")
def observed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of the object look-up, counted while the enriched events are written."""
    observation = Observation("outcomes")
    observe_outcomes(enriched_events(spark, sf_dir), observation).write.format("noop").mode("overwrite").save()
    return counted(spark, observation.get)


# --- rule helpers ------------------------------------------------------------

_NETS = """nets AS (
  SELECT 10 * 16777216 + n_nationkey * 65536 AS lo, 65536 AS n, '10.' || n_nationkey || '.0.0/16' AS cidr,
    n_name AS tag FROM nation
  UNION ALL
  SELECT 10 * 16777216 + s_suppkey % 150 * 65536 + s_nationkey * 256, 256,
    '10.' || (s_suppkey % 150) || '.' || s_nationkey || '.0/24', s_name FROM supplier)"""


@query(
    f"""WITH {EV},{_NETS} SELECT uid, cidr, tag FROM ev
    JOIN nets ON 10 * 16777216 + user_id % 150 * 65536 + CAST(k AS INT) * 256 + seq % 256 BETWEEN lo AND lo + n - 1"""
)
def cidr_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(
        "concat('ev-', event_id) AS uid",
        "concat('10.', user_id % 150, '.', get_json_object(props, '$.k'), '.', event_id % 256) AS ip",
    )
    nations = table(spark, sf_dir, "nation").selectExpr(
        "concat('10.', n_nationkey, '.0.0/16') AS cidr", "n_name AS tag"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "concat('10.', s_suppkey % 150, '.', s_nationkey, '.0/24') AS cidr", "s_name AS tag"
    )
    networks = nations.unionByName(suppliers)
    return fn.tag_cidr(events, "ip", networks).select("uid", "cidr", "tag")


# Networks of every length of both families around the test addresses, as ranges of a number; IPv6 ones count their last 32 bits.
_NESTED = """nested AS (
  SELECT 4 AS family, lo, lo + (1::BIGINT << (32 - prefix)) - 1 AS hi, prefix, id AS tag FROM (
    SELECT ((10 * 16777216 + s_suppkey % 150 * 65536 + s_nationkey * 256 + s_suppkey % 256) >> (32 - prefix)) << (32 - prefix) AS lo, prefix, id FROM (
      SELECT s_suppkey, s_nationkey, 1 + s_suppkey % 32 AS prefix, 's-' || s_suppkey AS id FROM supplier))
  UNION ALL
  SELECT 6, lo, lo + (1::BIGINT << (128 - prefix)) - 1, prefix, id FROM (
    SELECT ((s_suppkey % 150 * 65536 + s_nationkey * 256 + s_suppkey % 256) >> (128 - prefix)) << (128 - prefix) AS lo, prefix, id FROM (
      SELECT s_suppkey, s_nationkey, 96 + s_suppkey % 33 AS prefix, 's-' || s_suppkey AS id FROM supplier)))"""


@query(
    f"""WITH {EV},{_NESTED}, asked AS (SELECT uid, CASE WHEN seq % 3 = 0 THEN 6 ELSE 4 END AS family,
      CASE WHEN seq % 3 = 0 THEN 0 ELSE 10 * 16777216 END + user_id % 150 * 65536 + CAST(k AS INT) * 256 + seq % 256 AS address FROM ev),
    held AS (SELECT uid, prefix, min(tag) AS tag FROM asked JOIN nested USING (family) WHERE address BETWEEN lo AND hi GROUP BY uid, prefix)
    SELECT uid, coalesce(arg_max(held.tag, held.prefix), '') AS tag, coalesce(max(held.prefix), -1) AS prefix
    FROM asked LEFT JOIN held USING (uid) GROUP BY uid"""
)
def cidr_most_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific of nested networks of all lengths, IPv4 and IPv6."""
    address = """concat(CASE WHEN event_id % 3 = 0 THEN '2001:db8::' ELSE '10.' END,
      CASE WHEN event_id % 3 = 0 THEN concat(lower(hex(user_id % 150)), ':', lower(hex(int(get_json_object(props, '$.k')) * 256 + event_id % 256)))
      ELSE concat(user_id % 150, '.', get_json_object(props, '$.k'), '.', event_id % 256) END)"""
    asked = table(spark, sf_dir, "events").selectExpr("concat('ev-', event_id) AS uid", f"{address} AS ip")
    suppliers = table(spark, sf_dir, "supplier")
    four = suppliers.selectExpr("concat('10.', s_suppkey % 150, '.', s_nationkey, '.', s_suppkey % 256, '/', 1 + s_suppkey % 32) AS cidr", "concat('s-', s_suppkey) AS tag")
    six = suppliers.selectExpr(
        """concat('2001:db8::', lower(hex(s_suppkey % 150)), ':', lower(hex(s_nationkey * 256 + s_suppkey % 256)), '/', 96 + s_suppkey % 33) AS cidr""",
        "concat('s-', s_suppkey) AS tag",
    )
    found = most_specific_network(asked, "ip", four.union(six), span=2000)
    prefix = F.coalesce(F.substring_index("cidr", "/", -1).cast("int"), F.lit(-1))
    return found.select("uid", F.coalesce("tag", F.lit("")).alias("tag"), prefix.alias("prefix"))


@query(
    f"""WITH {EV} SELECT uid,
      CASE WHEN user_id % 3 <> 1 THEN CASE WHEN user_id % 3 < 1 THEN -1 ELSE 1 END
           WHEN CAST(k AS INT) <> 50 THEN CASE WHEN CAST(k AS INT) < 50 THEN -1 ELSE 1 END
           WHEN seq % 10 > 0 THEN 1 WHEN reason = 'error' THEN -1 ELSE 0 END AS against,
      CAST(user_id % 3 AS BIGINT) AS major
    FROM ev"""
)
def semver_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.expr(
        """concat(user_id % 3, '.', get_json_object(props, '$.k'), '.', event_id % 10,
             CASE WHEN event_type = 'error' THEN '-rc.1' ELSE '+build' END)"""
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), "event_id").alias("uid"),
        fn.semver_compare(version, F.lit("1.50.0")).alias("against"),
        fn.semver_major(version).alias("major"),
    )


@query(
    f"""WITH {EV} SELECT uid, instr(note, ':') - 1 AS colon, length(note) - instr(reverse(note), ' ') AS space,
      substring(note, 3, 1) AS at_two, CASE WHEN length(note) >= 9 THEN substring(note, 2, 8) ELSE 'outside' END AS part,
      upper(reason) AS shout, reverse(reason) AS mirror, k AS digits,
      CAST(month(event_time) - 1 AS INT) AS month, CAST(dayofweek(event_time) AS INT) AS weekday,
      CAST(dayofyear(event_time) - 1 AS INT) AS yearday, CAST(hour(event_time) AS INT) AS hour,
      CAST(millisecond(event_time) % 1000 AS INT) AS millis,
      reason IN ('click', 'view') AS listed
    FROM ev"""
)
def rule_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String, time and list helpers of rules."""
    note, time = F.col("note"), F.col("eventTime")
    return canonical_events(spark, sf_dir).select(
        "uid",
        fn.index_of(note, F.lit(":")).cast("bigint").alias("colon"),
        fn.last_index_of(note, F.lit(" ")).cast("bigint").alias("space"),
        fn.char_at(note, 2).alias("at_two"),
        F.coalesce(fn.sub_string(note, 1, 9), F.lit("outside")).alias("part"),
        fn.ascii_upper(F.col("reason")).alias("shout"),
        F.reverse("reason").alias("mirror"),
        fn.find(note, "[0-9]+").alias("digits"),
        fn.month_of(time).alias("month"),
        fn.day_of_week(time).alias("weekday"),
        fn.day_of_year(time).alias("yearday"),
        F.hour(time).alias("hour"),
        fn.milliseconds_of(time).alias("millis"),
        fn.set_intersects(F.array("reason"), F.array(F.lit("click"), F.lit("view"))).alias("listed"),
    )


@query(
    f"""WITH {EV}, p AS (SELECT *, seq % 40 AS place, seq % 7 AS low, seq % 11 AS high FROM ev) SELECT uid,
      CASE WHEN place <= length(note) THEN substring(note, place + 1, 1) ELSE 'outside' END AS character,
      CASE WHEN low <= high AND high <= length(note) THEN substring(note, low + 1, high - low) ELSE 'outside' END AS part,
      CASE WHEN low <= length(reason) THEN substring(reason, low + 1) ELSE 'outside' END AS tail,
      '"' || replace(note, '"', chr(92) || '"') || '"' AS quoted, replace(note, '"', '') AS plain,
      concat_ws('+', reason, type) AS joined, array_to_string(regexp_extract_all(note, '[0-9]'), ',') AS digits,
      list_contains(['click', 'view'], reason) AND list_has_all(['click', 'view', type], [reason, type]) AS held,
      list_has_all([reason, type], [type, reason, reason]) AS same,
      CAST(day(event_time) - 1 AS INT) AS day, CAST(minute(event_time) AS INT) AS minute, CAST(second(event_time) AS INT) AS second
    FROM p"""
)
def rule_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String, list and time helpers whose positions and sets are columns."""
    events, note = canonical_events(spark, sf_dir), F.col("note")
    reason, kind, time = F.col("reason"), F.col("type"), F.col("eventTime")
    at, low, high = F.col("seq") % 40, F.col("seq") % 7, F.col("seq") % 11
    outside = F.lit("outside")
    return events.select(
        "uid",
        F.coalesce(fn.char_at(note, at), outside).alias("character"),
        F.coalesce(fn.sub_string(note, low, high), outside).alias("part"),
        F.coalesce(fn.sub_string(reason, low), outside).alias("tail"),
        fn.quote(note).alias("quoted"),
        F.replace(note, F.lit('"'), F.lit("")).alias("plain"),
        F.concat_ws("+", reason, kind).alias("joined"),
        F.array_join(fn.find_all(note, "[0-9]"), ",").alias("digits"),
        (F.array_contains(F.array(F.lit("click"), F.lit("view")), reason) & fn.set_contains(F.array(F.lit("click"), F.lit("view"), kind), F.array(reason, kind))).alias("held"),
        fn.set_equivalent(F.array(reason, kind), F.array(kind, reason, reason)).alias("same"),
        fn.day_of_month(time).alias("day"),
        F.minute(time).alias("minute"),
        F.second(time).alias("second"),
    )


@query(
    f"""WITH {EV} SELECT CAST(CASE WHEN user_id % 2 = 0 THEN 4 ELSE 6 END AS INT) AS family,
      CASE WHEN user_id % 2 = 0 THEN user_id % 150 = 126 ELSE CAST(k AS INT) < 10 END AS loopback,
      CASE WHEN user_id % 2 = 0 THEN user_id % 150 <> 126 ELSE CAST(k AS INT) BETWEEN 10 AND 89 END AS global_unicast,
      count(*) AS events FROM ev GROUP BY 1, 2, 3"""
)
def ip_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.expr(
        """CASE WHEN user_id % 2 = 0 THEN concat(user_id % 150 + 1, '.', get_json_object(props, '$.k'), '.0.1')
             WHEN int(get_json_object(props, '$.k')) < 10 THEN '::1'
             WHEN int(get_json_object(props, '$.k')) > 89 THEN concat('fe80::', get_json_object(props, '$.k'))
             ELSE concat('2001:db8::', user_id % 10000, ':', get_json_object(props, '$.k')) END"""
    )
    facts = table(spark, sf_dir, "events").select(fn.ip_facts(address).alias("ip"))
    return facts.groupBy("ip.family", "ip.loopback", "ip.global_unicast").agg(F.count("*").alias("events"))
