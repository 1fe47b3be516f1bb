"""Replay of an ordered call log whose settings and policies change on the way."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import detect, policy as pol
from ..functions.redact import redact
from ..functions.rules import AUDIT_RETENTION, POLICIES, WINDOW_US, Policy
from ..operators import audit
from ..operators.config import FIELDS, LIMITS, SWITCHES, Config, config_history, config_intervals
from ..operators.gate import VERDICT, verdict_columns, settings_of
from ..operators.intervals import interval_join
from ..operators.limiter import HOT_ROWS, live_stamps, rate_limit
from ..operators.policies import SCHEMA, as_literals, hits_in_force, load_policies, policy_table, policy_versions
from ..session import ensure_checkpoint_dir
from ..sources.calls import parse_calls, tool_calls


def _policy_hits(calls: DataFrame, versions: DataFrame, known: list[Policy], *keep: str) -> DataFrame:
    """Adds ``block``, ``redact``, ``warn`` (hit counts) and ``hits`` (records
    in policy order) by the policies in force at each call.

    Patterns are literals of the plan and run once per text where it is read.
    The narrow rows that remain are written, so the log is parsed once.
    """
    rows = calls.withColumn("_names", F.col("policy_names")).withColumn(
        "_masks", pol.policy_masks(F.col("text"), known)).select(*keep, "_names", "_masks").checkpoint()
    found = rows.drop("_names", "_masks").join(hits_in_force(rows, versions, known), "seq", "left")
    hits = F.coalesce("hits", F.array().cast(f"array<{pol.RECORD}>"))
    return found.withColumn("hits", hits).select(
        *keep, *[F.size(F.filter("hits", _has(a))).cast("long").alias(a) for a in ("block", "redact", "warn")], "hits")


def _has(action: str):
    return lambda p: p["action"] == action


class Replay:
    """Results of a replayed call log, each planned when first asked for.

    Typed calls are written once.  Setting and policy changes, few against the
    calls, become intervals of seq.  Texts are scanned once per kind of call,
    where they are read, and only masks, counts and hit records travel on.
    """

    def __init__(self, calls: DataFrame, window_us: int, defaults: Config, policies, hot_rows: int, keep: int, carried: DataFrame | None = None):
        spark = calls.sparkSession
        ensure_checkpoint_dir(spark)
        calls = calls.checkpoint()      # every result starts here: the log is read and parsed once
        self._window_us, self._hot_rows, self._keep, self._carried, self._defaults = window_us, hot_rows, keep, carried, defaults
        self._calls = calls.drop(*SWITCHES, *LIMITS)
        control = calls.where("tool in ('update_config', 'add_policy', 'remove_policy')").select(
            "seq", "tool", "name", "pattern", "action", "description", *FIELDS).checkpoint()
        #: settings after each update_config call
        self.settings = config_history(control.where("tool = 'update_config'").select("seq", *FIELDS), defaults=defaults)
        self._spans = config_intervals(self.settings, defaults=defaults).checkpoint()
        changes = control.where("tool <> 'update_config'").select(
            "seq", F.when(F.col("tool") == "add_policy", "add").otherwise("remove").alias("op"),
            "name", "pattern", "action", "description")
        #: policy versions with the calls they hold for
        self.versions = policy_versions(policy_table(spark, policies), changes).checkpoint()

    @property
    def _listed(self) -> Column:
        return F.when(F.col("n_warnings").isNotNull(), F.col("hits")).alias("policy_hits")

    @cached_property
    def _known(self) -> list[Policy]:
        return as_literals(self.versions)

    @cached_property
    def _decided(self) -> DataFrame:
        """Verdicts with the settings they were made under."""
        requests = self._calls.where("tool = 'validate_input'").withColumn(
            "policy_names", F.lit(None).cast("array<string>"))
        screened = _policy_hits(
            requests.withColumn("n_bytes", detect.byte_length(F.col("text")))
            .withColumn("input_mask", detect.input_mask(F.col("text"))),
            self.versions, self._known, "seq", "ts", "user_id", "n_bytes", "input_mask")
        # narrow rows, written once: counting hot users does not parse the log again
        governed = interval_join(screened, "seq", self._spans).checkpoint()
        # with the limiter off a call is neither checked nor recorded: give it
        # a quota of its own
        quota = F.when(F.col("enable_rate_limiting"), F.concat(F.lit("u:"), "user_id")).otherwise(
            F.concat(F.lit("s:"), F.col("seq").cast("string")))
        limited = rate_limit(governed.withColumn("_quota", quota), user="_quota", window_us=self._window_us,
                             max_requests=F.col("max_requests_per_minute"), hot_rows=self._hot_rows, carried=self._carried)
        counts = {a: F.col(a) for a in ("block", "redact", "warn")}
        return verdict_columns(limited, settings_of(None), counts)

    @cached_property
    def verdicts(self) -> DataFrame:
        """One row per validate_input call."""
        return self._decided.select(*VERDICT, self._listed)

    @cached_property
    def checks(self) -> DataFrame:
        """One row per check_policy call."""
        asked = self._calls.where("tool = 'check_policy'")
        return _policy_hits(asked, self.versions, self._known, "seq", "ts").select(
            "seq", "ts", (F.col("block") == 0).alias("allowed"),
            (F.col("block") + F.col("redact")).alias("n_policy_violations"), F.col("warn").alias("n_warnings"),
            F.col("hits").alias("policy_hits"))

    @cached_property
    def outputs(self) -> DataFrame:
        """One row per filter_output call."""
        filtered = redact(self._calls.where("tool = 'filter_output'").select("seq", "ts", "text"))
        on = F.col("enable_output_filtering")
        return interval_join(filtered, "seq", self._spans.select("from_seq", "to_seq", "enable_output_filtering")).select(
            "seq", "ts", (F.col("modified") & on).alias("modified"),
            F.when(on, F.col("redacted")).otherwise(F.col("text")).alias("redacted"),
            F.when(on, F.col("redactions")).alias("redactions"))

    @cached_property
    def audit(self) -> DataFrame:
        """One row per logged event."""
        return audit.events_of_verdicts(self.verdicts).unionByName(audit.events_of_outputs(self.outputs))

    @cached_property
    def stats(self) -> DataFrame:
        """One row per get_stats call: users the limiter had seen by then, events
        logged and blocked, and the settings in force.  Outputs are counted, not
        filtered."""
        asks = self._calls.where("tool = 'get_stats'").select("seq").checkpoint()
        judged = self._decided.select("seq", "user_id", "enable_rate_limiting", "code").checkpoint()
        on = self._spans.where("enable_output_filtering").select("from_seq", "to_seq")
        passed = interval_join(self._calls.where("tool = 'filter_output'").select("seq"), "seq", on, how="left_semi")
        log = judged.select("seq", audit.verdict_event(F.col("code")).alias("event_type")).unionByName(
            passed.select("seq", F.lit("OUTPUT_FILTERED").alias("event_type")))
        seen = judged.where("enable_rate_limiting").groupBy("user_id").agg(F.min("seq").alias("seq"))
        return interval_join(audit.counters_as_of(log, seen, asks), "seq", self._spans)

    @cached_property
    def logs(self) -> DataFrame:
        """The answers of get_audit_logs calls: rows (ask, position, event)."""
        asks = self._calls.where("tool = 'get_audit_logs'").select("seq", "event_type", "limit")
        return audit.logs_as_of(self.audit, asks, keep=self._keep)


    def state(self) -> tuple[Config, list[Policy]]:
        """The settings and policies in force after the last call."""
        last = self.settings.orderBy(F.desc("seq")).limit(1).collect()
        config = Config(**{f: last[0][f] for f in FIELDS}) if last else self._defaults
        return config, load_policies(self.versions.where("to_seq IS NULL").withColumnRenamed("from_seq", "ord"))


def replay(calls: DataFrame, *, window_us: int = WINDOW_US, defaults: Config = Config(),
           policies=POLICIES, hot_rows: int = HOT_ROWS, keep: int = AUDIT_RETENTION) -> Replay:
    """*calls*: tool calls (see ``sources.calls.tool_calls``) with a unique
    order ``seq`` and a time ``ts``; *keep* is how many events the audit log holds."""
    return Replay(calls, window_us, defaults, policies, hot_rows, keep)


def replay_batches(lines: DataFrame, path: str, checkpoint: str, *, window_us: int = WINDOW_US, defaults: Config = Config(),
                   policies=POLICIES, hot_rows: int = HOT_ROWS, late_us: int | None = None, **trigger):
    """Replays a stream of call lines (seq, ts, value) that arrives in the order
    of seq, and starts the query.

    Every micro-batch is replayed as a log of its own that starts from the
    settings, policies and admitted stamps the last one left: ``path/verdicts``,
    ``checks`` and ``outputs`` get its answers, ``path/state`` what it leaves,
    each by batch number, so a repeated batch replaces its own files and starts
    from the same state.  *late_us* is as in ``limit_batches``.
    """
    def step(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        config, rules, before = defaults, policies, None
        if batch_id > 0:
            old = f"{path}/state/batch={batch_id - 1}"
            config = Config(**spark.read.parquet(f"{old}/settings").first().asDict())
            rules = load_policies(spark.read.schema(SCHEMA).parquet(f"{old}/policies"))
            before = spark.read.schema("quota_key string, us long").parquet(f"{old}/stamps")
        run = Replay(tool_calls(parse_calls(batch)), window_us, config, rules, hot_rows, AUDIT_RETENTION, before)
        key = F.when(F.col("enable_rate_limiting"), F.concat(F.lit("u:"), "user_id")).alias("quota_key")
        parts = {"verdicts": run._decided.select(*VERDICT, run._listed, key), "checks": run.checks, "outputs": run.outputs}
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        decided = spark.read.schema(parts["verdicts"].schema).parquet(f"{path}/verdicts/batch={batch_id}")
        used = decided.where("quota_key IS NOT NULL AND coalesce(code, '') <> 'RATE_LIMIT'").select("quota_key", F.unix_micros("ts").alias("us"))
        config, rules = run.state()
        new = f"{path}/state/batch={batch_id}"
        live_stamps(used, before, window_us, late_us).write.mode("overwrite").parquet(f"{new}/stamps")
        spark.createDataFrame([tuple(getattr(config, f) for f in FIELDS)], ", ".join(
            f"{f} {'boolean' if f in SWITCHES else 'long'}" for f in FIELDS)).write.mode("overwrite").parquet(f"{new}/settings")
        policy_table(spark, rules).write.mode("overwrite").parquet(f"{new}/policies")

    return (lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
