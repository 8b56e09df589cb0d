"""Freshness of collections: when changed collections are due for an update, in batch and as a stream."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweir.sources.files import IGNORED_DIRS

#: Fixed values, in milliseconds: quiet time before and longest delay of a keyword refresh, quiet time of a semantic one, backoffs.
KEYWORD_QUIET, KEYWORD_CAP, SEMANTIC_QUIET = 30_000, 300_000, 300_000
ERROR_BACKOFF, UNAVAILABLE_BACKOFF, BLOCK_BACKOFF = 60_000, 600_000, 3_600_000
LEAST_INTERVAL_MINUTES = 5
#: Fixed values, in milliseconds: between safety scans with events, between polls without.
SCAN_INTERVAL, POLL_INTERVAL = 3_600_000, 300_000


def quiet_sessions(events: DataFrame, key: str, ts: str, quiet_ms: int) -> DataFrame:
    """(key, first_event, last_event, events): runs of events without a gap of ``quiet_ms`` or more, by gaps and islands."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t")
    df = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(key, ts, at.alias("_t")).withColumn("_gap", F.coalesce(F.col("_t") - F.lag("_t").over(w), F.lit(1 << 60)))
    df = df.withColumn("_s", F.sum(F.when(F.col("_gap") >= quiet_ms * 1000, 1).otherwise(0)).over(w))
    return df.groupBy(key, "_s").agg(F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), F.count("*").alias("events")).drop("_s")


def fold_due(times_us: list[int], quiet_us: int, cap_us: int) -> list[tuple[int, int, int]]:
    """(due, first, events) per refresh for ascending event times: due when quiet for long enough or dirty for too long."""
    out: list[tuple[int, int, int]] = []
    first = last = n = 0
    for t in times_us:
        if n and t >= min(last + quiet_us, first + cap_us):
            out.append((min(last + quiet_us, first + cap_us), first, n))
            n = 0
        first = t if not n else first
        last, n = t, n + 1
    return [*out, (min(last + quiet_us, first + cap_us), first, n)] if n else out


def due_refreshes(events: DataFrame, key: str, ts: str, quiet_ms: int = KEYWORD_QUIET, cap_ms: int = KEYWORD_CAP) -> DataFrame:
    """(key, due, first_event, events): the refreshes of a batch of events; sorted rows stream through tasks, nothing but one
    key's open refresh is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, first, last, n = None, 0, 0, 0
        q, c = quiet_ms * 1000, cap_ms * 1000
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                if n and (k != key_now or t >= min(last + q, first + c)):
                    out.append((key_now, min(last + q, first + c), first, n))
                    n = 0
                first = t if not n else first
                key_now, last, n = k, t, n + 1
            yield pd.DataFrame(out, columns=["k", "due", "first", "events"])
        if n:
            yield pd.DataFrame([(key_now, min(last + q, first + c), first, n)], columns=["k", "due", "first", "events"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    done = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(run, f"k {kind}, due bigint, first bigint, events bigint")
    return done.select(F.col("k").alias(key), F.timestamp_micros("due").alias("due"), F.timestamp_micros("first").alias("first_event"), "events")


def due_refreshes_stream(events: DataFrame, key: str, ts: str, quiet_ms: int = KEYWORD_QUIET, cap_ms: int = KEYWORD_CAP, late: str = "0 seconds") -> DataFrame:
    """The same as a stream: keyed state of the open refresh, timers on the watermark of ``ts``; output mode append."""
    q, c = quiet_ms * 1000, cap_ms * 1000

    def step(k, batches, state):
        first, last, n = state.get if state.exists else (0, 0, 0)
        out: list[tuple[int, int, int]] = []
        if state.hasTimedOut:
            out.append((min(last + q, first + c), first, n))
            state.remove()
        else:
            times = sorted(t for pdf in batches for t in pdf["t"])
            for t in times:
                if n and t >= min(last + q, first + c):
                    out.append((min(last + q, first + c), first, n))
                    n = 0
                first = t if not n else first
                last, n = max(t, last) if n else t, n + 1
            state.update((first, last, n))
            due_ms = -(-min(last + q, first + c) // 1000)
            state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(str(k[0]), d, f, m) for d, f, m in out], columns=["k", "due", "first", "events"])

    rows = events.where(F.col(key).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = rows.select(F.col(key).cast("string").alias("k"), "_ts", F.unix_micros("_ts").alias("t"))
    done = rows.groupBy("k").applyInPandasWithState(step, "k string, due bigint, first bigint, events bigint", "first bigint, last bigint, n bigint", "append", "EventTimeTimeout")
    return done.select(F.col("k").alias(key), F.timestamp_micros("due").alias("due"), F.timestamp_micros("first").alias("first_event"), "events")


def change_counts(events: DataFrame, key: str, ts: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, changes) per event-time window, for batches and streams."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.window("_ts", window).alias("w"), key).agg(F.count("*").alias("changes")).select(F.col("w.start").alias("window_start"), key, "changes")


def sync_catalog(known: DataFrame, current: DataFrame) -> DataFrame:
    """(space_name, collection_name, change): collections added, removed or at another path."""
    k, c = known.alias("k"), current.alias("c")
    keys = ["space_name", "collection_name"]
    change = F.when(F.col("k.path").isNull(), "added").when(F.col("c.path").isNull(), "removed").when(F.col("k.path") != F.col("c.path"), "path_changed")
    return k.join(c, [F.col(f"k.{x}") == F.col(f"c.{x}") for x in keys], "full_outer").select(*[F.coalesce(f"k.{x}", f"c.{x}").alias(x) for x in keys], change.alias("change")).where("change is not null")


@dataclass
class _Dirty:
    first: int
    last: int
    semantic_from: int | None = None
    not_before: int = 0


@dataclass
class RefreshScheduler:
    """State machine of refreshes per (space, collection), on a clock in milliseconds that the caller passes."""

    dirty: dict[tuple[str, str], _Dirty] = field(default_factory=dict)
    semantic: dict[tuple[str, str], int] = field(default_factory=dict)
    held: dict[tuple[str, str], int] = field(default_factory=dict)
    blocked: dict[str, int] = field(default_factory=dict)

    def mark_dirty(self, target: tuple[str, str], now: int) -> None:
        """The first time of being dirty stays, the last event moves."""
        d = self.dirty.setdefault(target, _Dirty(now, now))
        d.last = max(d.last, now)
        if target in self.semantic:
            self.semantic[target] = now

    def keyword_due(self, target: tuple[str, str], now: int) -> bool:
        """Quiet for long enough, or dirty for too long, and not held back."""
        d = self.dirty.get(target)
        return d is not None and now >= d.not_before and (now - d.last >= KEYWORD_QUIET or now - d.first >= KEYWORD_CAP)

    def semantic_due(self, target: tuple[str, str], now: int, pending_chunks: int) -> bool:
        """Chunks are pending, the collection was quiet for long enough, and neither it nor its space is held back."""
        since = self.semantic.get(target)
        return since is not None and pending_chunks > 0 and now - since >= SEMANTIC_QUIET and now >= self.held.get(target, 0) and now >= self.blocked.get(target[0], 0)

    def due(self, now: int, pending: dict[tuple[str, str], int]) -> list[tuple[str, tuple[str, str]]]:
        """All due actions; of a space whose block has just ended one collection tries first."""
        keyword = [("keyword", t) for t in sorted(self.dirty) if self.keyword_due(t, now)]
        semantic, tried = [], set()
        for t in sorted(self.semantic):
            if self.semantic_due(t, now, pending.get(t, 0)):
                if t[0] in self.blocked and t[0] in tried:
                    continue
                tried.add(t[0])
                semantic.append(("semantic", t))
        return keyword + semantic

    def keyword_success(self, target: tuple[str, str], now: int, started: int) -> None:
        """Clean unless events came after the start; a semantic refresh is wanted from now on."""
        d = self.dirty.get(target)
        if d and d.last <= started:
            del self.dirty[target]
        elif d:
            d.first = d.last
        self.semantic.setdefault(target, now)

    def update_error(self, target: tuple[str, str], now: int) -> None:
        """Tries again after a minute."""
        if target in self.dirty:
            self.dirty[target].not_before = now + ERROR_BACKOFF

    def semantic_success(self, target: tuple[str, str]) -> None:
        """Nothing is pending, and the space works."""
        self.semantic.pop(target, None)
        self.held.pop(target, None)
        self.blocked.pop(target[0], None)

    def semantic_unavailable(self, target: tuple[str, str], now: int) -> None:
        """Holds the collection back for ten minutes."""
        self.held[target] = now + UNAVAILABLE_BACKOFF

    def space_blocked(self, space: str, now: int) -> None:
        """Holds all of a space's collections back for an hour."""
        self.blocked[space] = now + BLOCK_BACKOFF


    def all_dirty(self, targets: list[tuple[str, str]], now: int) -> None:
        """Everything may have changed, as after lost events."""
        for t in targets:
            self.mark_dirty(t, now)


@dataclass
class Watcher:
    """A scheduler over a source of events: routes changed paths, falls back to scans where events were lost, runs what is due.

    ``roots`` maps (space, collection) to the folder of a collection. ``update`` refreshes keyword indexes, ``embed`` vectors;
    ``scan`` tells which collections a detection scan finds changed. All clocks are the caller's.
    """

    roots: dict[tuple[str, str], str]
    update: Callable[[tuple[str, str]], object]
    embed: Callable[[tuple[str, str]], object]
    scan: Callable[[], list[tuple[str, str]]] = lambda: []
    scheduler: RefreshScheduler = field(default_factory=RefreshScheduler)
    native: bool = True
    next_scan: int = 0
    last_error: str | None = None

    def route(self, path: str) -> tuple[str, str] | None:
        """The collection with the longest root above a path; paths in ignored folders and ignored files have none."""
        hits = [(len(r), t) for t, r in self.roots.items() if path == r or path.startswith(r.rstrip("/") + "/")]
        if not hits:
            return None
        target = max(hits)[1]
        below = path[len(self.roots[target].rstrip("/")) + 1 :].split("/")
        if any(p.lower() in IGNORED_DIRS for p in below[:-1]) or below[-1] == ".DS_Store" or below[-1].lower().endswith(".lock"):
            return None
        return target

    def events(self, paths: list[str] | None, now: int) -> None:
        """Changed paths; None says that events were lost: from then on scans look for changes, and everything is dirty."""
        if paths is None:
            self.native, self.last_error = False, "events were lost"
            self.scheduler.all_dirty(list(self.roots), now)
            return
        for target in filter(None, map(self.route, paths)):
            self.scheduler.mark_dirty(target, now)

    def tick(self, now: int, pending: dict[tuple[str, str], int], rng: random.Random) -> list[tuple[str, tuple[str, str]]]:
        """Scan if it is time (at the start, then hourly with jitter, every five minutes without events), and run what is due."""
        if now >= self.next_scan:
            for t in self.scan():
                self.scheduler.mark_dirty(t, now)
            self.next_scan = now + (jittered(SCAN_INTERVAL, rng) if self.native else POLL_INTERVAL)
        done = self.scheduler.due(now, pending)
        for action, target in done:
            if action == "keyword":
                try:
                    self.update(target)
                    self.scheduler.keyword_success(target, now, now)
                except Exception as e:  # noqa: BLE001
                    self.last_error = str(e)
                    self.scheduler.update_error(target, now)
            else:
                try:
                    self.embed(target)
                    self.scheduler.semantic_success(target)
                except SpaceBlocked as e:
                    self.last_error = str(e)
                    self.scheduler.space_blocked(target[0], now)
                except Exception as e:  # noqa: BLE001
                    self.last_error = str(e)
                    self.scheduler.semantic_unavailable(target, now)
        return done


class SpaceBlocked(RuntimeError):
    """The vectors of a whole space cannot be refreshed now."""


def run_schedule(job: Callable[[], object], lock: Callable[[], object | None], save: Callable[[dict], None], clock: Callable[[], str]) -> dict:
    """Run a schedule's update now: its state is saved at the start and at the end; where the lock is taken the run is skipped.

    ``lock`` gives an object with ``release``, or None where another operation holds it.
    """
    state = {"last_started": clock(), "last_finished": None, "last_result": None, "last_error": None}
    save(dict(state))
    held = lock()
    if held is None:
        state |= {"last_finished": clock(), "last_result": "skipped_lock"}
        save(dict(state))
        return state
    try:
        job()
        state |= {"last_result": "success"}
    except Exception as e:
        state |= {"last_result": "failed", "last_error": str(e)}
        raise
    finally:
        held.release()
        state["last_finished"] = clock()
        save(dict(state))
    return state


def jittered(interval_ms: int, rng: random.Random, share: float = 0.25) -> int:
    """An interval moved by up to ``share`` either way."""
    return round(interval_ms * (1 + rng.uniform(-share, share)))


def normalize_interval(minutes: int) -> int:
    """Minutes between scheduled runs, five at least."""
    if minutes < LEAST_INTERVAL_MINUTES:
        raise ValueError(f"intervals have at least {LEAST_INTERVAL_MINUTES} minutes")
    return minutes


def normalize_time(text: str) -> str:
    """HH:MM of a time of day in 12 or 24 hour form."""
    m = re.fullmatch(r"\s*(\d{1,2})(?::(\d{2}))?\s*([ap])?\.?(?:m\.?)?\s*", text.lower())
    if not m or (m[2] is None and m[3] is None):
        raise ValueError(f"not a time: {text!r}")
    hour, minute = int(m[1]), int(m[2] or 0)
    if m[3]:
        if not 1 <= hour <= 12:
            raise ValueError(f"not a time: {text!r}")
        hour = hour % 12 + (12 if m[3] == "p" else 0)
    if hour > 23 or minute > 59:
        raise ValueError(f"not a time: {text!r}")
    return f"{hour:02d}:{minute:02d}"


def add_schedule(schedules: list[dict], trigger: str, targets: list[str]) -> tuple[list[dict], str]:
    """Schedules with one more and its id (s1, s2, ...); an equal one is found again instead."""
    wanted = {"trigger": trigger, "targets": sorted(set(targets))}
    for s in schedules:
        if {k: s[k] for k in wanted} == wanted:
            return schedules, s["id"]
    taken = {s["id"] for s in schedules}
    new = next(f"s{k}" for k in range(1, len(schedules) + 2) if f"s{k}" not in taken)
    return [*schedules, {"id": new, **wanted}], new


def schedule_status(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """(id, status): installed, drifted, missing, or an orphan that nobody wants. Both have (id, trigger)."""
    w, i = wanted.alias("w"), installed.alias("i")
    status = F.when(F.col("w.id").isNull(), "orphan").when(F.col("i.id").isNull(), "missing").when(F.col("w.trigger") != F.col("i.trigger"), "drifted").otherwise("installed")
    return w.join(i, F.col("w.id") == F.col("i.id"), "full_outer").select(F.coalesce("w.id", "i.id").alias("id"), status.alias("status"))
