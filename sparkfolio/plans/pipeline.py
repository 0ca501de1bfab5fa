"""A pipeline of named stages over DataFrames: dependencies, retries, a record of attempts; registries of plug-ins."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    """run takes the context (artifacts by name) and gives what the stage produces, by name."""

    name: str
    run: Callable[[dict], dict[str, DataFrame]]
    consumes: set[str] = field(default_factory=set)
    produces: set[str] = field(default_factory=set)
    optional: bool = False


def validate(stages: list[Stage], given: set[str] = frozenset()) -> list[str]:
    """What is wrong with a definition: repeated names, and inputs that nothing before produces."""
    there, seen, wrong = set(given), set(), []
    for s in stages:
        if s.name in seen:
            wrong.append(f"stage {s.name} is there twice")
        wrong += [f"stage {s.name} needs {x}, which no earlier stage produces" for x in sorted(s.consumes - there)]
        seen.add(s.name)
        there |= s.produces
    return wrong


class Recorder:
    """What a runner tells of each attempt; a subclass keeps what it wants."""

    def started(self, stage: str, attempt: int) -> None: ...

    def completed(self, stage: str, attempt: int) -> None: ...

    def failed(self, stage: str, attempt: int, error: str) -> None: ...


class TimedOut(Exception):
    pass


class Cancelled(Exception):
    pass


def limited(work: Callable[[], object], seconds: float | None, spark: SparkSession | None = None):
    """work() in a thread of its own, given up after so many seconds; the Spark jobs that it has begun are cancelled then."""
    if seconds is None:
        return work()
    tag, done = f"stage-{uuid.uuid4().hex}", []

    def run() -> None:
        try:
            if spark is not None:
                spark.addTag(tag)
            done.append((True, work()))
        except BaseException as e:  # handed on below
            done.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        if spark is not None:
            spark.interruptTag(tag)
        raise TimedOut(f"timed out after {seconds:g} s")
    ok, value = done[0]
    if not ok:
        raise value
    return value


class Runner:
    """Runs stages one after another. A failed attempt is repeated after a growing pause, unless it took too long; an optional
    stage may fail for good. recorder hears of each attempt; cancel() stops before the next one."""

    SCHEMA = "stage string, attempt int, status string, started_at timestamp, duration_ms long, error string"

    def __init__(
        self, stages: list[Stage], retries: int = 2, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep, seconds: float | None = 360.0, spark: SparkSession | None = None, recorder: Recorder | None = None
    ):
        if wrong := validate(stages):
            raise ValueError("; ".join(wrong))
        self.stages, self.retries, self.pause, self.sleep = stages, retries, pause, sleep
        self.seconds, self.spark, self.recorder = seconds, spark, recorder or Recorder()
        self.attempts: list[tuple] = []
        self.cancelled = False

    def cancel(self) -> None:
        self.cancelled = True

    def run(self, context: dict | None = None, progress: Callable[[str, float], None] = lambda stage, share: None) -> tuple[str, dict]:
        """("completed", "partial", "failed" or "cancelled", context); progress hears of each stage's end and the share that is done."""
        context, partial = dict(context or {}), False
        for k, stage in enumerate(self.stages, 1):
            if self.cancelled:
                return "cancelled", context
            if not self._tried(stage, context):
                if self.cancelled:
                    return "cancelled", context
                if not stage.optional:
                    return "failed", context
                partial = True
            progress(stage.name, k / len(self.stages))
        return ("partial" if partial else "completed"), context

    def _tried(self, stage: Stage, context: dict) -> bool:
        for attempt in range(self.retries + 1):
            if self.cancelled:
                return False
            began, at = time.monotonic(), datetime.now(UTC).replace(tzinfo=None)
            self.recorder.started(stage.name, attempt + 1)
            again = True
            try:
                made = limited(lambda: stage.run(context), self.seconds, self.spark)
                if missing := stage.produces - set(made):
                    raise ValueError(f"{', '.join(sorted(missing))} not produced")
                context.update(made)
                error = None
            except Exception as e:  # what a stage runs is the user's
                error, again = str(e), not isinstance(e, TimedOut)
            self.attempts.append((stage.name, attempt + 1, "failed" if error else "completed", at, int(1000 * (time.monotonic() - began)), error))
            if error is None:
                self.recorder.completed(stage.name, attempt + 1)
                return True
            self.recorder.failed(stage.name, attempt + 1, error)
            if not again:
                return False
            if attempt < self.retries:
                self.sleep(self.pause * 2**attempt)
        return False

    def record(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.attempts, self.SCHEMA)


class Job:
    """Work that is tried up to four times, 5, 10 and 20 seconds apart, and begun once only: who asks again gets its state.

    work(job) may call job.report() and job.check(), which ends it if it was cancelled.
    """

    TERMINAL = ("completed", "failed", "cancelled")

    def __init__(self, work: Callable[[Job], object], attempts: int = 4, pause: float = 5.0, sleep: Callable[[float], None] = time.sleep):
        self.work, self.attempts, self.pause, self.sleep = work, attempts, pause, sleep
        self.state, self.share, self.note, self.tried, self.errors, self.result = "pending", 0.0, "", 0, [], None

    def report(self, share: float, note: str = "") -> None:
        self.share, self.note = max(self.share, min(1.0, share)), note
        self.check()

    def check(self) -> None:
        if self.state == "cancelled":
            raise Cancelled

    def cancel(self) -> bool:
        """Whether there was anything left to cancel."""
        if self.state in self.TERMINAL:
            return False
        self.state = "cancelled"
        return True

    def run(self) -> str:
        if self.state in (*self.TERMINAL, "running"):
            return self.state
        while self.state != "cancelled":
            self.state, self.tried = "running", self.tried + 1
            try:
                self.result = self.work(self)
                self.check()
                self.state, self.share = "completed", 1.0
                break
            except Cancelled:
                break
            except Exception as e:  # what a job runs is the user's
                self.errors.append(str(e))
                if self.state == "cancelled":
                    break
                if self.tried >= self.attempts:
                    self.state = "failed"
                    break
                self.state = "waiting"
                self.sleep(self.pause * 2 ** (self.tried - 1))
        return self.state


class Plugins:
    """Named things (analyzers, gap rules, validators, pipelines), run one by one with failures kept apart."""

    def __init__(self) -> None:
        self.known: dict[str, Callable] = {}

    def register(self, name: str, what: Callable) -> Callable:
        self.known[name] = what
        return what

    def get(self, name: str) -> Callable:
        return self.known[name]

    def run(self, *args) -> tuple[dict[str, object], dict[str, str]]:
        done, errors = {}, {}
        for name, f in self.known.items():
            try:
                done[name] = f(*args)
            except Exception as e:
                errors[name] = str(e)
        return done, errors


def markdown(title: str, tables: dict[str, DataFrame], limit: int = 20) -> str:
    """A report of small result tables: a section each, the first rows only (a report's length); empty ones are left out."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(limit).collect()
        if rows:
            head = [f"## {name}", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
            out += [*head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]
    return "\n".join(out) + "\n"


# -- landscapes -----------------------------------------------------------------------------------------------------------
#: Sections of overview.landscape() in the order of a report: (heading, section, kind, columns as (title, field)).
TABLES = [
    ("Institutions", "institutions", "top", [("Institution", "name"), ("Type", "other"), ("Papers", "value"), ("Authors", "second")]),
    ("Institution Types", "institutions", "type", [("Type", "name"), ("Count", "value")]),
    ("Methodologies", "methodologies", "top", [("Methodology", "name"), ("Papers", "value"), ("Techniques", "other")]),
    ("Technologies", "technologies", "top", [("Technology", "name"), ("Papers", "value")]),
    ("Datasets", "datasets", "top", [("Dataset", "name"), ("Papers", "value")]),
    ("Temporal Trends", "temporal", "year", [("Year", "name"), ("Papers", "value")]),
    ("Institution Collaborations", "collaborations", "institution_edge", [("Institution A", "name"), ("Institution B", "other"), ("Papers", "value")]),
    ("Author Collaborations", "collaborations", "author_edge", [("Author A", "name"), ("Author B", "other"), ("Papers", "value")]),
]


def _shown(v) -> str:
    if v is None:
        return "—"
    if isinstance(v, float):
        return f"{v:g}" if v != int(v) else str(int(v))
    return ", ".join(v.split("|")) if "|" in v else v


def _report_rows(found: DataFrame) -> list:
    """A landscape's rows for a report: lists of bounded length, years and totals; not each technology's first year."""
    rows = found.where("kind <> 'first_year'").collect()
    return sorted(rows, key=lambda r: (r["section"], r["kind"], r["rank"] is None, r["rank"], r["name"] or ""))


def landscape_markdown(found: DataFrame, observed: DataFrame) -> str:
    """overview.landscape() and observations() as a report; sections without rows are left out."""
    rows = _report_rows(found)
    by = lambda s, k: [r for r in rows if (r["section"], r["kind"]) == (s, k)]
    table = lambda head, body: ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(x) + " |" for x in body), ""]
    totals = [("Total Papers", by("temporal", "total")), ("Years Covered", by("temporal", "span")), *((f"Total {s.capitalize()}", by(s, "total")) for s in ("institutions", "methodologies", "technologies", "datasets", "authors"))]
    overview = [[title, r[0]["name"] or _shown(r[0]["value"])] for title, r in totals if r and r[0]["value"]]
    out = ["# Research Landscape", ""]
    if overview:
        out += ["## Overview", "", *table(["Metric", "Value"], overview)]
    for heading, section, kind, columns in TABLES:
        if own := by(section, kind):
            out += [f"## {heading}", "", *table([c for c, _ in columns], [[_shown(r[f]) for _, f in columns] for r in own])]
            for d in by(section, "diversity") if kind == "top" else []:
                n = by(section, "total")[0]["value"]
                out += [f"**Diversity:** {_shown(n)} {section}, {_shown(d['second'])} papers, {_shown(d['value'])} on average", ""]
    for kind in ("institution", "author"):
        for n in by("collaborations", f"{kind}_network"):
            first = by("collaborations", f"{kind}_central")[:1]
            central = [f"- **Most Central:** {first[0]['name']} (centrality {first[0]['value']:.2f})"] if first else []
            out += [f"## {kind.capitalize()} Network", "", f"- **Nodes:** {_shown(n['value'])}", f"- **Edges:** {_shown(n['second'])}", *central, ""]
    if said := observed.orderBy("position").collect():  # at most thirteen
        out += ["## Key Observations", "", *(f"- **{o['label']}:** {o['text']}" for o in said), ""]
    return "\n".join(out).strip() + "\n"


def landscape_json(found: DataFrame, observed: DataFrame) -> dict:
    """The same as nested dictionaries: section -> kind -> rows; sections without rows are left out."""
    out: dict = {}
    for r in _report_rows(found):
        out.setdefault(r["section"], {}).setdefault(r["kind"], []).append({k: r[k] for k in ("rank", "name", "other", "value", "second") if r[k] is not None})
    if said := observed.orderBy("position").collect():
        out["observations"] = [{"category": o["category"], "label": o["label"], "value": o["text"]} for o in said]
    return out
