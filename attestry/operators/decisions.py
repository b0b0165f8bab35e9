"""Runs, decisions and locks as a table of events that is played as sets: what each event comes to, and where every run stands in the end.

The rules are those of the review store: a run is saved once; a decision counts if it names the revision at which the run stands and its mode allows it,
the same decision again is a replay and another one a conflict; only an approved run is locked. A run has three states, so the events that count are the
first save, the first decision after it that is valid, and the first lock after that, if it approves: three aggregations by request, each partial before
it is shuffled, and no request's events are brought together in one place.

events: request_id, seq (any type with an order, different for every event of a request), kind (save, decide or lock); of saves status, tier, candidate; of
decisions expected (revision), approve, mode, accepted, reason. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAVED, DECIDED, LOCKED = 1, 2, 3
#: What an approval is refused for, in order, over the run (``run``) and the event's own columns.
_REFUSED = [
    ("nothing_selectable", "run.status not in ('recommendation_ready', 'reference_review_required') or coalesce(run.candidate, '') = ''"),
    ("override_required", "run.tier = 'REFERENCE_ONLY' and (mode <> 'override' or trim(coalesce(reason, '')) = '')"),
    ("acceptance_required", "run.tier = 'USABLE_WITH_ASSUMPTIONS' and not coalesce(accepted, false)"),
]
_REFUSAL = "case when not coalesce(approve, false) then null " + " ".join(f"when coalesce({t}, true) then '{k}'" for k, t in _REFUSED) + " end"
_SAME = "coalesce(approve, false) = coalesce(decision.approve, false) and mode <=> decision.mode and coalesce(accepted, false) = coalesce(decision.accepted, false) and coalesce(reason, '') = coalesce(decision.reason, '')"


def _first(events: DataFrame, test: str, name: str, *fields: str) -> DataFrame:
    """Per request the first event that passes ``test``, as a struct of its seq and fields."""
    row = F.struct("seq", *fields)
    return events.where(test).groupBy("request_id").agg(F.min_by(row, "seq").alias(name))


def played(events: DataFrame) -> DataFrame:
    """``events`` with ``outcome`` (applied, replayed, or why not) and the ``revision`` that an applied event makes."""
    events = events.where("request_id is not null")
    df = events.join(_first(events, "kind = 'save'", "run", "status", "tier", "candidate"), "request_id", "left")
    valid = f"kind = 'decide' and seq > run.seq and expected = {SAVED} and ({_REFUSAL}) is null"
    df = df.join(_first(df, valid, "decision", "approve", "mode", "accepted", "reason"), "request_id", "left")
    df = df.join(_first(df, "kind = 'lock' and seq > decision.seq and decision.approve", "locked"), "request_id", "left")
    outcome = (
        "case when kind = 'save' then if(seq = run.seq, 'applied', 'run_exists') when not coalesce(seq > run.seq, false) then 'no_run' "
        f"when kind = 'decide' then case when seq = decision.seq then 'applied' when seq > decision.seq then if({_SAME}, 'replayed', 'another_decision') when coalesce(expected <> {SAVED}, true) then 'stale' else {_REFUSAL} end "
        "when kind = 'lock' then case when seq = locked.seq then 'applied' when seq > locked.seq then 'replayed' else 'not_approved' end else 'unknown_kind' end"
    )
    df = df.withColumn("outcome", F.expr(outcome))
    return df.withColumn("revision", F.expr(f"if(outcome = 'applied', case kind when 'save' then {SAVED} when 'decide' then {DECIDED} else {LOCKED} end, null)")).drop("run", "decision", "locked")


def states(events: DataFrame) -> DataFrame:
    """Where every saved run stands: revision, state (open, approved, rejected, locked), candidate, and how many events did not count."""
    own = played(events).groupBy("request_id").agg(
        F.max("revision").alias("revision"), F.expr("max(if(outcome = 'applied', candidate, null)) filter (where kind = 'save')").alias("candidate"),
        F.expr("bool_or(approve) filter (where outcome = 'applied' and kind = 'decide')").alias("approved"), F.expr("count_if(outcome <> 'applied')").alias("refused"),
    )
    state = f"case when revision = {LOCKED} then 'locked' when revision = {SAVED} then 'open' when coalesce(approved, false) then 'approved' else 'rejected' end"
    return own.where("revision is not null").select("request_id", "revision", F.expr(state).alias("state"), "candidate", "refused")
