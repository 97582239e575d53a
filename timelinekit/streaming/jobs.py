"""Candidates, edits, ledgers, silence and stale work as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timelinekit.functions.text import title_key

# ---- fixed values -------------------------------------------------------------------------
LATENESS = "30 hours"
REWRITE_CHARS, NOTE_CHARS = 120, 8000
RUNNING = {"phase1": "PHASE1_RUNNING", "phase2": "PHASE2_RUNNING", "phase3": "PHASE3_RUNNING"}
BEGINS_FROM = {"phase1": ("NEW",), "phase2": ("PHASE2_PENDING",), "phase3": ("PHASE3_READY",)}
GATE_STATE = {"gate1": "GATE1_REVIEW", "gate2": "GATE2_REVIEW", "final": "FINAL_REVIEW"}
GATE_FROM = {
    "gate1": ("PHASE1_RUNNING", "GATE1_REVIEW"),
    "gate2": ("PHASE2_RUNNING", "REVISIONS_RUNNING"),
    "final": ("PHASE3_RUNNING", "REVISIONS_RUNNING"),
}
APPROVED = {"gate1": "PHASE2_PENDING", "gate2": "PHASE3_READY", "final": "COMPLETED"}
ACTIVE = ("PHASE1_RUNNING", "PHASE2_RUNNING", "PHASE3_RUNNING", "REVISIONS_RUNNING")
FAILED = "FAILED_RECOVERABLE"
# -------------------------------------------------------------------------------------------


def stream_candidates(items: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Late items leave, repeated title keys are dropped within the horizon.

    This approximates the batch rule: the first *arrival* wins instead of the newest item, a
    key blocks even if its row was dropped for its url, and urls are not compared.
    """
    keyed = items.withColumn("title_key", title_key(F.col("title")))
    return keyed.withWatermark("published", lateness).dropDuplicatesWithinWatermark(["title_key"])


def clean_edits(records: DataFrame) -> DataFrame:
    """Edits as the desk accepts them: whole numbers as cut indexes, rewrites and notes cut to size.

    ``records``: desk_id, at, action, cut_words array<string>, rewrites map<string,string>, note.
    """
    whole = r"^-*[0-9]+$"
    cuts = F.filter(F.transform(F.filter("cut_words", lambda w: w.rlike(whole)), lambda w: w.try_cast("int")), lambda w: w.isNotNull())
    usable = F.map_filter("rewrites", lambda k, v: k.rlike(whole) & (F.trim(v) != ""))
    return records.select(
        "desk_id", "at", "action", cuts.alias("cut_words"),
        F.transform_values(usable, lambda _, v: F.left(v, F.lit(REWRITE_CHARS))).alias("rewrites"),
        F.left(F.coalesce("note", F.lit("")), F.lit(NOTE_CHARS)).alias("note"),
    )


def latest_drafts(edits: DataFrame) -> DataFrame:
    """The last draft per desk of a batch or table."""
    drafts = edits.filter("action = 'draft'")
    fields = [c for c in edits.columns if c != "desk_id"]
    last = drafts.groupBy("desk_id").agg(F.max_by(F.struct(*fields), "at").alias("_d"))
    return last.select("desk_id", "_d.*")


def stream_edits(records: DataFrame, drafts_path: str, submits_path: str, checkpoint: str):
    """Start the edit stream: submits are appended; drafts are written per batch, and readers
    take the last one per desk with ``latest_drafts``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so nothing is written twice.
        latest_drafts(batch).write.mode("overwrite").parquet(f"{drafts_path}/batch={batch_id}")
        batch.filter("action = 'submit'").write.mode("overwrite").parquet(f"{submits_path}/batch={batch_id}")

    return clean_edits(records).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transitions() -> dict[tuple[str, str | None, str], str]:
    """(event kind, its name, state) to the next state; what is not listed is not allowed."""
    table = {("begin", n, s): RUNNING[n] for n, states in BEGINS_FROM.items() for s in states}
    table |= {("gate", n, s): GATE_STATE[n] for n, states in GATE_FROM.items() for s in states}
    table |= {("approve", n, GATE_STATE[n]): to for n, to in APPROVED.items()}
    return table | {("fail", None, s): FAILED for s in ACTIVE}


def next_state(state: str, phase: str | None, attempt: int, kind: str, name: str | None) -> tuple[str, str | None, int, str | None]:
    """(state, phase, attempt, reason code) after one event; an event that is not allowed changes nothing."""
    if kind == "resume":
        if state != FAILED or phase is None:
            return state, phase, attempt, "RESUME_NOT_ALLOWED"
        return RUNNING.get(phase, "REVISIONS_RUNNING"), phase, attempt + 1, None
    after = transitions().get((kind, None if kind == "fail" else name, state))
    if after is None:
        return state, phase, attempt, f"{kind.upper()}_NOT_ALLOWED" if kind in ("begin", "gate", "approve", "fail") else "EVENT_UNKNOWN"
    if kind == "begin":
        return after, name, 1, None
    return after, phase if kind == "fail" else None, attempt, None


LEDGER_OUTPUT = "project string, revision int, kind string, state string, attempt int, error string"
LEDGER_STATE = "state string, phase string, attempt int, revision int"


def stream_ledger(events: DataFrame) -> DataFrame:
    """State of each project after each event (project, seq, kind, name, expected_revision).

    State is one small row per project. An event that expects another revision is stale and
    changes nothing.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        state, phase, attempt, revision = store.get if store.exists else ("NEW", None, 0, 0)
        rows = []
        events_now = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for event in events_now.itertuples():
            error = None
            if pd.notna(event.expected_revision) and int(event.expected_revision) != revision:
                error = "stale revision"
            else:
                name = event.name if isinstance(event.name, str) else None
                state, phase, attempt, error = next_state(state, phase, attempt, event.kind, name)
                revision += error is None
            rows.append((key[0], revision, event.kind, state, attempt, error))
        store.update((state, phase, attempt, revision))
        yield pd.DataFrame(rows, columns=["project", "revision", "kind", "state", "attempt", "error"])

    return events.groupBy("project").applyInPandasWithState(update, LEDGER_OUTPUT, LEDGER_STATE, "append", GroupStateTimeout.NoTimeout)


SILENCE_OUTPUT = "k string, start_s double, end_s double"
SILENCE_STATE = "run_start double, last_t double"


def stream_silence(levels: DataFrame, threshold: float, step: float, minimum: float, idle: str = "10 minutes") -> DataFrame:
    """Quiet runs online (k, ts, t, level): a run closes at the next loud sample, or when its
    key stays silent for ``idle`` of event time, a step after the last sample."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        run_start, last_t = store.get if store.exists else (None, None)
        out = []
        if store.hasTimedOut:
            if run_start is not None and last_t + step - run_start >= minimum:
                out.append((str(key[0]), round(run_start, 6), round(last_t + step, 6)))
            store.remove()
        else:
            newest = None
            for sample in pd.concat(list(batches)).sort_values("t", kind="stable").itertuples():
                newest = sample.ts
                quiet = sample.level < threshold
                if quiet and run_start is None:
                    run_start = sample.t
                elif not quiet and run_start is not None:
                    if sample.t - run_start >= minimum:
                        out.append((str(key[0]), round(run_start, 6), round(sample.t, 6)))
                    run_start = None
                last_t = sample.t
            store.update((run_start, last_t))
            store.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + idle_ms, store.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "start_s", "end_s"])

    watched = levels.withWatermark("ts", "0 seconds")
    return watched.groupBy("k").applyInPandasWithState(update, SILENCE_OUTPUT, SILENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_stale_work(beats: DataFrame, limit: str = "3600 seconds") -> DataFrame:
    """Heartbeats per job in sessions; a session that closes is a job gone quiet for ``limit``."""
    return (
        beats.withWatermark("heartbeat_at", "0 seconds")
        .groupBy("job_id", F.session_window("heartbeat_at", limit))
        .agg(F.max("heartbeat_at").alias("last_beat"), F.count(F.lit(1)).alias("beats"))
        .select("job_id", "last_beat", "beats")
    )


