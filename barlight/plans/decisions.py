"""Signal events, execution decisions, intents, ledgers and conservation checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.operators import layout as L
from barlight.plans.monitor import direction_name, timeframe_ms

# Execution policy.
GATE = {"version": "exec-v1", "max_spread": 25.0, "max_age": 5000, "depth_multiple": 2.5, "min_notional": 5.0,
        "exit_divisor": 1.5, "exit_warning": 2.0, "min_volume": 500_000.0, "min_oi": 500_000.0}


def _text() -> Column:
    return F.lit(None).cast("string")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(on, name) for on, name in pairs]))


def stable_id(prefix: str, *cols: str, length: int = 32) -> Column:
    """Deterministic id from the named columns, in name order."""
    body = F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, length))


def set_id(prefix: str, ids: Column, length: int = 32) -> Column:
    """Deterministic id of an unordered set of ids."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array_sort(F.array_distinct(ids))), 256), 1, length))


# --- events ------------------------------------------------------------------------


def transitions(signals: DataFrame) -> DataFrame:
    """Position changes of each stream as events, from the sparse signal table."""
    by = ["symbol", "timeframe", "strategy_id"]
    chunk = L.BLOCK if L.BLOCK in signals.columns else None
    seen = L.neighbour(signals, by, "t", {"_b": "sig"}, chunk)
    before = F.coalesce("_b", F.lit(0))
    rows = seen.withColumn("state_before", before).where(F.col("sig") != F.col("state_before")).drop("_b")
    close_t = F.col("t") + timeframe_ms(F.col("timeframe"))
    rows = rows.withColumns({
        "state_after": F.col("sig"), "candle_close_t": close_t, "side": direction_name(F.col("sig")),
        "transition": F.concat(direction_name(F.col("state_before")), F.lit("→"), direction_name(F.col("sig")))})
    rows = rows.withColumn("event_id", stable_id("sig_", *by, "candle_close_t", "transition"))
    return rows.select("event_id", *by, "candle_close_t", "transition", "side", "state_before", "state_after")


def signal_snapshot(signals: DataFrame, last: DataFrame) -> DataFrame:
    """Per stream: position, and ages in bars of the last raw signal and last change."""
    by = ["symbol", "timeframe", "strategy_id"]
    raw = signals.where("mode = 'REVERSAL'").groupBy(*by).agg(F.max("t").alias("raw_t"))
    events = transitions(signals)
    tf = timeframe_ms(F.col("timeframe"))
    moved = events.groupBy(*by).agg(F.max("candle_close_t").alias("move_close"),
                                    F.max_by("state_after", "candle_close_t").alias("position"))
    rows = moved.join(raw, by, "left").join(last, ["symbol", "timeframe"])
    move_t = F.col("move_close") - tf
    raw_t = F.coalesce("raw_t", move_t)
    age = lambda t: F.round((F.col("last_t") - t) / tf).cast("long")
    return rows.select(*by, "position", direction_name(F.col("position")).alias("direction"),
                       age(raw_t).alias("raw_age"), age(move_t).alias("transition_age"),
                       (age(move_t) == 0).alias("fresh"), "last_t")


def arming_status(events: DataFrame, mode: str, arming_t: int, now: int, reason: str | None = None) -> DataFrame:
    """SUPPRESSED, MISSED or ELIGIBLE with a reason."""
    age = F.lit(now) - F.col("candle_close_t")
    if mode != "ARMED":
        why = (reason or "DISARMED") if mode == "DISARMED" else "RECONSTRUCTING"
        return events.withColumns({"arming": F.lit("SUPPRESSED"), "arming_reason": F.lit(why)})
    early, late = F.col("candle_close_t") <= arming_t, age > timeframe_ms(F.col("timeframe"))
    return events.withColumns({
        "arming": F.when(early, "SUPPRESSED").when(late, "MISSED").otherwise("ELIGIBLE"),
        "arming_reason": F.when(early, "PRE_ARMING").when(late, "DOWNTIME")})


def freshness(events: DataFrame, now: int) -> DataFrame:
    age = F.greatest(F.lit(0), F.lit(now) - F.col("candle_close_t"))
    late = age > timeframe_ms(F.col("timeframe"))
    return events.withColumns({"freshness": F.when(late, "MISSED").otherwise("FRESH"),
                               "freshness_reason": F.when(late, "OBSERVATION_LAG"), "age_ms": age})


def latest_snapshot(events: DataFrame, snapshots: DataFrame, at: str, span_ms: int = 3_600_000) -> DataFrame:
    """As-of join: the newest snapshot of the symbol at or before ``at``.

    Both sides meet only inside one time bucket of their symbol; the newest
    snapshot of earlier buckets comes from a table of bucket edges.
    """
    cols = [c for c in snapshots.columns if c not in ("symbol", "snapshot_t")]
    pack = F.struct("snapshot_t", *cols)
    snaps = snapshots.select("symbol", F.floor(F.col("snapshot_t") / span_ms).alias("_k"), F.col("snapshot_t").alias("_t"),
                             pack.alias("_s"), F.lit(0).alias("_e"), F.lit(None).cast("string").alias("event_id"))
    keyed = events.withColumn("_k", F.floor(F.col(at) / span_ms))
    marks = keyed.select("symbol", "_k", F.col(at).alias("_t"), F.lit(None).cast(snaps.schema["_s"].dataType).alias("_s"),
                         F.lit(1).alias("_e"), "event_id")
    both = snaps.unionByName(marks)
    inner = Window.partitionBy("symbol", "_k").orderBy("_t", "_e").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("_s", ignorenulls=True).over(inner)).where("_e = 1")
    edges = both.groupBy("symbol", "_k").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_t"))).alias("_s"))
    outer = Window.partitionBy("symbol").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("symbol", "_k", F.last("_s", ignorenulls=True).over(outer).alias("_before"))
    found = inside.join(carried, ["symbol", "_k"], "left").select("event_id", F.coalesce("_in", "_before").alias("snap"))
    return events.join(found, "event_id", "left")


def execution_gate(events: DataFrame, now: Column, notional: Column, policy: dict = GATE) -> DataFrame:
    """One ordered verdict per event that carries ``arming`` and its snapshot ``snap``."""
    s = lambda c: F.col(f"snap.{c}")
    side = F.col("side")
    entry = F.coalesce(F.when(side == "LONG", s("askDepth10bps")).otherwise(s("bidDepth10bps")), F.lit(0.0))
    leave = F.coalesce(F.when(side == "LONG", s("bidDepth10bps")).otherwise(s("askDepth10bps")), F.lit(0.0))
    cap = F.greatest(F.lit(0.0), leave / policy["exit_divisor"])
    rules = [
        (F.col("arming") == "SUPPRESSED", "SUPPRESSED", F.col("arming_reason")),
        (F.col("arming") == "MISSED", "MISSED", F.col("arming_reason")),
        (F.col("arming") != "ELIGIBLE", "DEFER", F.lit("INFRA_ARMING_UNKNOWN")),
        (F.col("snap").isNull(), "DEFER", F.lit("INFRA_NO_MARKET_SNAPSHOT")),
        (s("snapshot_t").isNull(), "DEFER", F.lit("INFRA_INVALID_SNAPSHOT_TIME")),
        (now - s("snapshot_t") > policy["max_age"], "DEFER", F.lit("INFRA_STALE_MARKET_SNAPSHOT")),
        (s("symbolStatus") != "TRADING", "REJECT", F.lit("SYMBOL_NOT_TRADING")),
        (F.coalesce(s("spreadBps"), F.lit(float("inf"))) > policy["max_spread"], "REJECT", F.lit("SPREAD_HARD")),
        (side == "FLAT", "ALLOW", F.lit("STRATEGY_EXIT")),
        (~side.isin("LONG", "SHORT"), "REJECT", F.lit("INVALID_DIRECTION")),
        (~F.coalesce(notional > 0, F.lit(False)), "REJECT", F.lit("INVALID_ORDER_NOTIONAL")),
        (entry < notional * policy["depth_multiple"], "REJECT", F.lit("ENTRY_DEPTH_HARD")),
        (cap < policy["min_notional"], "REJECT", F.lit("SIZE_BELOW_MIN")),
    ]
    verdict, why = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for on, v, r in rules[1:]:
        verdict, why = verdict.when(on, v), why.when(on, r)
    out = events.withColumns({"verdict": verdict.otherwise("ALLOW"), "reason": why, "entry_depth": entry, "exit_depth": leave})
    entered = (F.col("verdict") == "ALLOW") & (side != "FLAT")
    warn = reasons(
        (entered & (leave < notional * policy["exit_warning"]), "EXIT_LIQUIDITY_WARNING"),
        (entered & (F.coalesce(s("quoteVolume24h"), F.lit(float("inf"))) < policy["min_volume"]), "COHORT_VOLUME_WARNING"),
        (entered & (F.coalesce(s("openInterestNotional"), F.lit(float("inf"))) < policy["min_oi"]), "COHORT_OI_WARNING"))
    return out.withColumns({
        "warnings": warn, "max_notional": F.when(entered, F.least(notional, cap)),
        "policy_version": F.lit(policy["version"]), "snapshot_t": s("snapshot_t")}).withColumn(
        "decision_id", stable_id("dec_", "event_id", "policy_version", "snapshot_t", "verdict", "reason"))


# --- intents -----------------------------------------------------------------------


def arbitrate(decisions: DataFrame, positions: DataFrame, ledger: DataFrame, requested: float) -> DataFrame:
    """One outcome per symbol and close time of the allowed decisions.

    Entries outrank exits; the notional is the smallest cap; the lead is the
    smallest signal id.  Streams per symbol and close time are the catalogue's
    size at most.
    """
    ok = decisions.where("verdict = 'ALLOW'")
    entry = F.col("side") != "FLAT"
    groups = ok.groupBy("symbol", "candle_close_t").agg(
        F.min(F.when(entry, F.col("side"))).alias("s0"), F.max(F.when(entry, F.col("side"))).alias("s1"),
        F.count_if(entry).alias("entries"),
        F.array_sort(F.collect_list(F.when(entry, F.col("event_id")))).alias("in_ids"),
        F.array_sort(F.collect_list(F.when(~entry, F.col("event_id")))).alias("out_ids"),
        F.min(F.when(entry, F.col("max_notional"))).alias("cap"))
    ids = F.when(F.col("entries") > 0, F.col("in_ids")).otherwise(F.col("out_ids"))
    rows = groups.withColumns({"signal_ids": ids, "side": F.coalesce("s0", F.lit("FLAT"))})
    rows = rows.withColumn("intent_id", set_id("int_", F.col("signal_ids")))
    held = positions.select("symbol", F.col("side").alias("_open"))
    rows = rows.join(held, "symbol", "left").join(ledger.select("intent_id", F.lit(True).alias("_old")), "intent_id", "left")
    status = (
        F.when(F.col("s0") != F.col("s1"), "DIRECTION_CONFLICT")
        .when(F.col("_open") == F.col("s0"), "EXISTING_POSITION_SAME_SIDE")
        .when(F.col("_open").isNotNull() & F.col("s0").isNotNull(), "REVERSE_REQUIRES_POSITION_MANAGER")
        .when(F.col("_old"), "DUPLICATE").otherwise("CREATED"))
    out = rows.withColumn("status", status)
    made = F.col("status").isin("CREATED", "DUPLICATE")
    action = F.when(F.col("side") == "LONG", "ENTER_LONG").when(F.col("side") == "SHORT", "ENTER_SHORT").otherwise("EXIT_TO_FLAT")
    size = F.when(F.col("side") != "FLAT", F.least(F.lit(float(requested)), F.coalesce("cap", F.lit(float(requested)))))
    return out.select(
        "symbol", "candle_close_t", "status", F.when(made, F.col("intent_id")).alias("intent_id"),
        F.when(made, F.col("side")).alias("side"), F.when(made, action).alias("action"), F.when(made, size).alias("notional"),
        F.size("signal_ids").alias("support"), F.element_at("signal_ids", 1).alias("lead_id"), "signal_ids",
        F.when(made, F.concat(F.lit("bl-"), F.substring(F.sha2(F.col("intent_id"), 256), 1, 28))).alias("client_order_id"))


def simple_arbiter(signals: DataFrame, by: list[str]) -> DataFrame:
    """NO_FRESH_SIGNAL, DIRECTION_CONFLICT or AGGREGATED per group."""
    hit = F.col("fresh") & (F.col("state") != 0)
    s = signals.groupBy(*by).agg(F.count_if(hit).alias("support"), F.min(F.when(hit, F.col("state"))).alias("lo"),
                                 F.max(F.when(hit, F.col("state"))).alias("hi"))
    reason = (F.when(F.col("support") == 0, "NO_FRESH_SIGNAL").when(F.col("lo") != F.col("hi"), "DIRECTION_CONFLICT")
              .otherwise("AGGREGATED"))
    decision = F.when((F.col("support") == 0) | (F.col("lo") != F.col("hi")), "NO_TRADE").when(F.col("lo") > 0, "LONG").otherwise("SHORT")
    return s.select(*by, decision.alias("decision"), "support", reason.alias("reason"))


# Census counters and the sums that must agree.
CENSUS = ("expected_evaluations", "evaluated", "not_evaluated", "raw_signal_observations", "transition_events", "no_transition",
          "execution_allow", "execution_defer", "execution_reject", "execution_suppressed", "execution_missed",
          "intents_created", "arbiter_suppressed", "intent_open", "intent_filled", "intent_cancelled", "intent_expired",
          "intent_rejected")
EQUATIONS = (
    ("EXPECTED_EVALUATION_CONSERVATION", "expected_evaluations", ("evaluated", "not_evaluated")),
    ("EVALUATION_TO_TRANSITION_CONSERVATION", "evaluated", ("transition_events", "no_transition")),
    ("TRANSITION_TO_EXECUTION_CONSERVATION", "transition_events",
     ("execution_allow", "execution_defer", "execution_reject", "execution_suppressed", "execution_missed")),
    ("ALLOW_TO_ARBITER_CONSERVATION", "execution_allow", ("intents_created", "arbiter_suppressed")),
    ("INTENT_TERMINAL_CONSERVATION", "intents_created",
     ("intent_open", "intent_filled", "intent_cancelled", "intent_expired", "intent_rejected")),
)


def census_checks(census: DataFrame, by: list[str] = [], only_violations: bool = True) -> DataFrame:  # noqa: B006
    """The five conservation equations of each census row."""
    have = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in census.columns else F.lit(0).alias(c) for c in CENSUS]
    rows = census.select(*by, *have)
    cells = [F.struct(F.lit(n).alias("name"), F.col(l).alias("left"), reduce(lambda a, b: a + b, [F.col(x) for x in r]).alias("right"))
             for n, l, r in EQUATIONS]
    out = rows.select(*by, F.explode(F.array(*cells)).alias("e")).select(*by, "e.*").withColumn("delta", F.col("left") - F.col("right"))
    return out.where("delta <> 0") if only_violations else out


def events_since(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each stream's cursor up to its newest close; a new stream only starts its cursor."""
    by = ["symbol", "timeframe", "strategy_id"]
    rows = events.join(cursors, by).where(F.col("last_close_t").isNotNull())
    return rows.where((F.col("candle_close_t") > F.col("last_close_t")) & (F.col("candle_close_t") <= F.col("latest_close_t"))).drop(
        "last_close_t", "latest_close_t")


def evidence_totals(cycles: DataFrame, counters: list[str]) -> DataFrame:
    """Running state folded from an append-only cycle table."""
    return cycles.agg(F.count("*").alias("cycles"), *[F.sum(c).alias(c) for c in counters],
                      F.array_sort(F.array_distinct(F.flatten(F.collect_set("coverage")))).alias("coverage"))


def recent_unique(events: DataFrame, keep: int = 500) -> DataFrame:
    """The newest distinct events; the first copy of an id stands for it."""
    cols = [c for c in events.columns if c not in ("event_id", "seen_t")]
    once = events.groupBy("event_id").agg(F.min("seen_t").alias("seen_t"), F.min_by(F.struct(*cols), F.struct("seen_t", *cols)).alias("r"))
    return once.select("event_id", "seen_t", "r.*").orderBy(F.desc("seen_t"), F.desc("event_id")).limit(keep)


def cycle_checks(cycles: DataFrame) -> DataFrame:
    decided = reduce(lambda a, b: a + b, [F.col(c) for c in ("allow", "defer", "reject", "suppressed", "missed")])
    return cycles.withColumn("errors", reasons(
        (F.col("expected") != F.col("evaluated") + F.col("not_evaluated"), "EVALUATION_CONSERVATION"),
        (F.col("transitions") != decided, "TRANSITION_DECISION_CONSERVATION"),
        (F.col("allow") != F.col("intents_created") + F.col("arbiter_suppressed"), "ALLOW_ARBITER_CONSERVATION")))


def catchup_actions(rows: DataFrame, recent: DataFrame, now: int) -> DataFrame:
    """Rows whose recent allowed event still matches the current direction get a late action.

    ``rows``: one per stream (underlying, symbol, timeframe, strategy_id) with
    ``direction`` and, if any, this cycle's ``event_id, verdict, side``.
    """
    stream = ["underlying", "symbol", "timeframe", "strategy_id"]
    age = F.lit(now) - F.col("candle_close_t")
    fresh = recent.where((age >= 0) & (age <= timeframe_ms(F.col("timeframe"))) & (F.col("verdict") == "ALLOW"))
    new = fresh.join(rows.where(F.col("event_id").isNotNull()).select("event_id"), "event_id", "left_anti")
    held = new.join(rows.select(*stream, "direction"), stream).where(F.col("direction") == F.col("side"))
    latest = held.groupBy(*stream).agg(F.max_by(F.struct("event_id", "candle_close_t", "side"), "candle_close_t").alias("late"))
    return rows.join(latest, stream, "left")


def row_status(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """Status and action of each stream from its event, verdict and intent.

    ``intents`` has ``lead_id`` and the array ``signal_ids``.
    """
    use_late = F.col("event_id").isNull() & F.col("late").isNotNull()
    rows = rows.withColumns({
        "ev": F.coalesce("event_id", "late.event_id"), "ev_side": F.coalesce(F.col("side"), F.col("late.side"), F.col("direction")),
        "ev_verdict": F.when(use_late, "ALLOW").otherwise(F.col("verdict")), "catchup": use_late})
    links = intents.select(F.explode("signal_ids").alias("ev"), "lead_id", "intent_id")
    j = rows.join(links, "ev", "left")
    allowed, has = F.col("ev_verdict") == "ALLOW", F.col("ev").isNotNull()
    lead = F.coalesce(F.col("ev") == F.col("lead_id"), F.lit(False))
    go = F.coalesce(has & allowed & lead, F.lit(False))
    side = F.coalesce("ev_side", F.lit("FLAT"))
    status = (
        F.when(~has, F.when(side == "FLAT", "FLAT").otherwise("ACTIVE_TREND"))
        .when(F.col("ev_verdict") == "DEFER", "EXECUTION_DEFER").when(F.col("ev_verdict") == "REJECT", "EXECUTION_REJECT")
        .when(F.col("ev_verdict") == "SUPPRESSED", "SUPPRESSED").when(F.col("ev_verdict") == "MISSED", "MISSED")
        .when(allowed & F.col("intent_id").isNull(), "ARBITER_SUPPRESSED").when(allowed & ~lead, "SUPPORTING_SIGNAL")
        .when(go, F.when(side == "FLAT", "FRESH_EXIT").otherwise("FRESH_ENTRY")).otherwise("ACTIVE_TREND"))
    action = (F.when(go, F.when(side == "LONG", "ENTER_LONG").when(side == "SHORT", "ENTER_SHORT").otherwise("EXIT_TO_FLAT"))
              .when(side == "LONG", "HOLD_LONG").when(side == "SHORT", "HOLD_SHORT").otherwise("FLAT"))
    return j.withColumns({"status": status, "action": action, "fresh": go, "row_direction": side})


def row_action(rows: DataFrame) -> DataFrame:
    """ENTER, EXIT_FLAT or NONE, and when a pending entry expires."""
    has = F.col("fresh") & F.col("entry_t").isNotNull()
    enter = has & (F.col("status") == "FRESH_ENTRY") & ~F.col("direction_conflict") & F.col("direction").isin("LONG", "SHORT")
    leave = has & (F.col("action") == "EXIT_TO_FLAT")
    pending = has & ~F.col("direction_conflict") & F.col("direction").isin("LONG", "SHORT")
    return rows.withColumns({
        "kind": F.when(enter, "ENTER").when(leave, "EXIT_FLAT").otherwise("NONE"),
        "expires_t": F.when(pending, F.col("entry_t") + timeframe_ms(F.col("timeframe")))})


def pending_entries(log: DataFrame, now: int) -> DataFrame:
    """Latest pending entry of each underlying that has not expired."""
    cols = [c for c in log.columns if c != "underlying"]
    return (log.groupBy("underlying").agg(F.max_by(F.struct(*cols), F.struct("entry_t", *cols)).alias("r")).select("underlying", "r.*")
            .where(F.col("expires_t") > now))


# --- ledgers and audits --------------------------------------------------------------


def lineage(records: DataFrame) -> DataFrame:
    """Missing links of each record, from signal to fill."""
    no = lambda c: F.col(c).isNull()
    allow, fill = F.coalesce(F.col("verdict") == "ALLOW", F.lit(False)), F.col("fill_id").isNotNull()
    return records.withColumn("errors", reasons(
        (no("event_id"), "MISSING_SIGNAL_EVENT_ID"), (allow & no("decision_id"), "MISSING_EXECUTION_DECISION_ID"),
        (allow & no("intent_id"), "MISSING_INTENT_ID"), (F.col("intent_id").isNotNull() & no("client_order_id"), "MISSING_CLIENT_ORDER_ID"),
        (fill & no("order_id"), "FILL_MISSING_EXCHANGE_ORDER_ID"), (fill & no("event_id"), "ORPHAN_FILL")))


def fill_ledger(records: DataFrame) -> DataFrame:
    """RECORDED, DUPLICATE, CONFLICT or ORPHAN_FILL for each arriving fill (in ``seq`` order)."""
    checked = lineage(records)
    cols = sorted(c for c in records.columns if c not in ("seq",))
    body = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    rows = checked.withColumn("_body", body)
    first = rows.where(F.size("errors") == 0).groupBy("fill_id").agg(F.min("seq").alias("_s"), F.min_by("_body", "seq").alias("_b"))
    joined = rows.join(first, "fill_id", "left")
    status = (F.when(F.size("errors") > 0, "ORPHAN_FILL").when(F.col("seq") == F.col("_s"), "RECORDED")
              .when(F.col("_body") == F.col("_b"), "DUPLICATE").otherwise("CONFLICT"))
    return joined.withColumn("status", status).drop("_body", "_s", "_b")


def halted_symbols(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'ORPHAN_FILL'").select("symbol").distinct()


def journal_chain(commits: DataFrame, by: list[str] = ["stream"], chunk_size: int = 1_000_000) -> DataFrame:  # noqa: B006
    """Commits whose from-hash is not the previous to-hash; repeats of a commit id count once."""
    once = commits.groupBy(*by, "commit_id").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("from_hash", "to_hash"), "seq").alias("r")).select(*by, "commit_id", "seq", "r.*")
    chunked = once.withColumn("_chunk", F.floor(F.col("seq") / chunk_size))
    rows = L.neighbour(chunked, by, "seq", {"head": "to_hash"}, "_chunk").drop("_chunk")
    return rows.withColumn("ok", F.col("head").isNull() | (F.col("head") == F.col("from_hash")))


def path_parity(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Event hashes of two paths side by side."""
    digest = F.sha2(F.to_json(F.struct(*sorted(cols))), 256)
    x = a.select("event_id", digest.alias("ha"))
    y = b.select("event_id", digest.alias("hb"))
    status = (F.when(F.col("ha").isNull(), "ONLY_RIGHT").when(F.col("hb").isNull(), "ONLY_LEFT")
              .when(F.col("ha") == F.col("hb"), "EQUAL").otherwise("DIFFERENT"))
    return x.join(y, "event_id", "full").withColumn("parity", status)


def readiness(evidence: DataFrame, required: list[str], least: int = 30) -> DataFrame:
    """Reasons against leaving shadow mode; nothing here enables execution."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    base = reasons(
        (off("ci_green"), "CI_NOT_GREEN"), (off("restart_parity"), "RESTART_PARITY_NOT_EXACT"),
        (off("event_parity"), "EVENT_PARITY_NOT_EXACT"), (off("census_clean"), "CENSUS_NOT_CLEAN"),
        (F.coalesce("orphan_fills", F.lit(1)) != 0, "ORPHAN_FILL_PRESENT"),
        (F.coalesce("unexplained", F.lit(1)) != 0, "UNEXPLAINED_DECISION_DIFFERENCE"),
        (off("rollback_rehearsed"), "ROLLBACK_NOT_REHEARSED"),
        (F.col("comparable") < least, "INSUFFICIENT_COMPARABLE_DECISIONS"))
    missing = F.transform(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("coverage")),
                          lambda x: F.concat(F.lit("MISSING_DECISION_COVERAGE_"), x))
    out = evidence.withColumn("reasons", F.concat(base, missing))
    return out.withColumns({"status": F.when(F.size("reasons") == 0, "READY_FOR_MANUAL_REVIEW").otherwise("SHADOW_ONLY"),
                            "can_enable_execution": F.lit(False)})


AUTHORITIES = ("STRATEGY_EXIT", "PROTECTION_TRIGGER", "EMERGENCY_STOP", "PROTECTION_INSTALL_FAILED")


def position_action(rows: DataFrame) -> DataFrame:
    gate = F.col("verdict").isin("DEFER", "REJECT", "SUPPRESSED", "MISSED")
    close = F.coalesce(F.col("close_authority").isin(*AUTHORITIES), F.lit(False))
    return rows.withColumns({
        "action": F.when(~F.col("is_open"), "NO_POSITION").when(close, "CLOSE").when(~F.col("is_protected"), "HALT_AND_PROTECT")
        .otherwise("HOLD_PROTECTED"),
        "action_reason": F.when(~F.col("is_open"), _text()).when(close, F.col("close_authority"))
        .when(~F.col("is_protected"), "OPEN_POSITION_UNPROTECTED").when(gate, "ENTRY_GATE_NOT_EXIT_AUTHORITY")})


def risk_screen(requests: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Every limit an entry request would break; ``requests`` carries its account snapshot."""
    eq, req = F.col("equity"), F.col("requested")
    e = F.greatest(eq, F.lit(1e-9))
    return requests.withColumn("reasons", reasons(
        (F.col("mode") != "RUNNING", "SYSTEM_NOT_RUNNING"), (~F.coalesce(eq > 0, F.lit(False)), "INVALID_EQUITY"),
        (~F.coalesce(req > 0, F.lit(False)), "INVALID_NOTIONAL"),
        (F.col("symbol_notional") + req > e * limits["symbol_pct"], "SYMBOL_NOTIONAL_LIMIT"),
        (F.col("portfolio_notional") + req > e * limits["portfolio_pct"], "PORTFOLIO_NOTIONAL_LIMIT"),
        ((F.col("portfolio_notional") + req) / e > limits["leverage"], "EFFECTIVE_LEVERAGE_LIMIT"),
        (F.col("open_positions") >= limits["positions"], "MAX_OPEN_POSITIONS"),
        (eq <= F.col("day_start") * (1 - limits["daily_pct"]), "DAILY_LOSS_BREAKER"),
        (eq <= F.col("week_start") * (1 - limits["weekly_pct"]), "WEEKLY_LOSS_BREAKER"),
        (eq <= F.col("peak") * (1 - limits["drawdown_pct"]), "DRAWDOWN_BREAKER"))).withColumn("allowed", F.size("reasons") == 0)


def reconcile_positions(orders: DataFrame, known: DataFrame, expected: DataFrame, actual: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Foreign open orders and position differences per symbol."""
    foreign = orders.where(F.col("client_order_id").isNotNull()).join(known, "client_order_id", "left_anti").groupBy("symbol").agg(
        F.count("*").alias("foreign_orders"))
    both = expected.select("symbol", F.col("net").alias("expected")).join(
        actual.select("symbol", F.col("position").alias("actual")), "symbol", "full").na.fill(0.0)
    out = both.join(foreign, "symbol", "full").na.fill(0, ["foreign_orders"]).na.fill(0.0)
    mismatch = F.abs(F.col("actual") - F.col("expected")) > tol
    return out.withColumns({"mismatch": mismatch, "halt": mismatch | (F.col("foreign_orders") > 0)})


def classify_account_event(payload: Column) -> Column:
    """Kind of an account event from its JSON text."""
    get = lambda p: F.get_json_object(payload, p)
    e, why = get("$.e"), F.coalesce(get("$.a.m"), get("$.m"))
    order = F.when((get("$.o.x") == "CALCULATED") | (get("$.o.X") == "EXPIRED_IN_MATCH"), "LIQUIDATION").otherwise("ORDER")
    update = (F.when(why == "FUNDING_FEE", "FUNDING_FEE").when(why == "ADL", "ADL")
              .when(why.isin("MARGIN_TRANSFER", "MARGIN_TYPE_CHANGE"), "MARGIN_EVENT").when(why == "ORDER", "ORDER").otherwise("UNKNOWN"))
    return (F.when(e == "ORDER_TRADE_UPDATE", order).when(e == "ACCOUNT_UPDATE", update)
            .when(e.isin("MARGIN_CALL", "forceOrder"), "LIQUIDATION").otherwise("UNKNOWN"))


def flatness_proof(passes: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Flat only if at least two passes were readable with no position and no order.

    The first failing pass decides the reason.
    """
    bad = (F.when(~F.coalesce("ok", F.lit(False)), "RECONCILIATION_READ_FAILED")
           .when(F.col("position").isNull() | F.isnan("position"), "POSITION_NOT_NUMERIC")
           .when(F.abs("position") > 1e-12, "POSITION_REMAINS_OPEN")
           .when((F.col("regular_orders") > 0) | (F.col("algo_orders") > 0), "OPEN_ORDERS_REMAIN"))
    s = passes.withColumn("_bad", bad).groupBy("symbol").agg(
        F.count("*").alias("passes"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("pass_no"))).alias("_why"))
    j = s.join(unavailable.select("symbol", F.lit(True).alias("_gone")), "symbol", "left")
    gone = F.coalesce("_gone", F.lit(False))
    why = F.when(F.col("passes") < 2, "INSUFFICIENT_RECONCILIATION_PASSES").otherwise(F.col("_why"))
    out = j.withColumn("_w", why)
    return out.select(
        "symbol", "passes",
        F.when(F.col("_w").isNotNull(), "CRITICAL_UNRESOLVED").when(gone, "SKIPPED_UNAVAILABLE_VERIFIED_FLAT").otherwise("FLAT").alias("status"),
        F.coalesce("_w", F.when(gone, "UNAVAILABLE_BUT_EXCHANGE_FLAT_PROVEN").otherwise("EXCHANGE_FLAT_PROVEN")).alias("reason"))


def floor_to_step(x: Column, step: Column) -> Column:
    return F.when(step > 0, F.round(F.floor((x + 2.220446049250313e-16) / step) * step, 12)).otherwise(x)


def order_rule_screen(orders: DataFrame, rules: DataFrame) -> DataFrame:
    """Orders floored to their symbol's steps, with the first broken rule."""
    j = orders.join(rules, "symbol", "left").withColumns({
        "p": floor_to_step(F.col("price"), F.col("tickSize")), "q": floor_to_step(F.col("quantity"), F.col("stepSize"))})
    p, q, ref = F.col("p"), F.col("q"), F.col("reference_price")
    c = F.col
    reason = (
        F.when(c("status").isNull(), "SYMBOL_NOT_FOUND").when(c("status") != "TRADING", "SYMBOL_NOT_TRADING")
        .when(~((p > 0) & (q > 0)), "INVALID_NORMALIZED_ORDER")
        .when((c("minPrice") > 0) & (p < c("minPrice")), "PRICE_BELOW_MIN").when((c("maxPrice") > 0) & (p > c("maxPrice")), "PRICE_ABOVE_MAX")
        .when((ref > 0) & (c("multiplierUp") > 0) & (p > ref * c("multiplierUp")), "PRICE_ABOVE_PERCENT_BAND")
        .when((ref > 0) & (c("multiplierDown") > 0) & (p < ref * c("multiplierDown")), "PRICE_BELOW_PERCENT_BAND")
        .when((c("minQty") > 0) & (q < c("minQty")), "QTY_BELOW_MIN").when((c("maxQty") > 0) & (q > c("maxQty")), "QTY_ABOVE_MAX")
        .when((c("minNotional") > 0) & (p * q < c("minNotional")), "NOTIONAL_BELOW_MIN"))
    return j.withColumns({"notional": p * q, "reject_reason": reason})


def reference_positions(log: DataFrame, chunk: str | None = None) -> DataFrame:
    """Paper positions of symbols without a venue, from actions (underlying, t, side, price).

    An action without a usable price is blocked and leaves the position alone.
    """
    from barlight.plans.monitor import paper_journal

    usable = log.where(F.col("price") > 0)
    return paper_journal(usable, chunk=chunk, cost=0.0)
