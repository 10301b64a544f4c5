"""Seams for reviewers, which a language model or a person can fill, and the guards around what they return.

Everything here is deterministic: reviewers are injected, and what they claim is checked against the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tracelake.functions.tables import kept
from tracelake.operators.evidence import key_differences, merge_evidence, rejected, uncited, updated_insights
from tracelake.sources.common import Snapshot

STATES = ("match", "no_match", "unknown")
ROUNDS = 12


class GuardError(ValueError):
    """A reviewer claimed something that the tables don't bear out."""


def _some(rows: DataFrame, column: str) -> list[str]:
    return [str(r[0]) for r in rows.select(column).limit(5).collect()]


# --- predicates over whole traces ----------------------------------------------------------------------------------

Predicate = Callable[[pd.DataFrame], tuple[str, Iterable[str]]]


def scan_all(spans: DataFrame, predicates: dict[str, Predicate]) -> DataFrame:
    """(name, trace_id, state, witnesses, error) of predicates over each trace's spans, in depth-first order if spans have dfs_index.

    All predicates look at a trace while it is in hand, so the spans are scanned once, however many there are. A
    predicate gets the spans of one trace (variants as JSON text) and gives match, no_match or unknown, and the span ids that
    show it. error tells another state, a match without a witness in that trace, or what a predicate raised; state is null then.
    """
    columns = [F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in spans.dtypes]

    def told(predicate: Predicate, part: pd.DataFrame) -> tuple[str | None, list[str], str | None]:
        trace = part["trace_id"].iloc[0]
        try:
            state, witnesses = predicate(part.copy(deep=False))
            witnesses = list(dict.fromkeys(witnesses))
        except Exception as error:  # noqa: BLE001 - whatever a predicate raises is its own failure
            return None, [], f"trace {trace}: {str(error).strip() or type(error).__name__}"
        lost = set(witnesses) - set(part["span_id"])
        wrong = f"{state!r} is no state" if state not in STATES else "a match needs a witness" if state == "match" and not witnesses else f"no span {', '.join(sorted(map(str, lost)))}" if lost else None
        return (state, witnesses, None) if wrong is None else (None, [], f"trace {trace}: {wrong}")

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dfs_index") if "dfs_index" in part else part
        rows = [(name, part["trace_id"].iloc[0], *told(predicate, part)) for name, predicate in predicates.items()]
        return pd.DataFrame(rows, columns=["name", "trace_id", "state", "witnesses", "error"])

    kind = dict(spans.dtypes)["trace_id"]
    return spans.select(*columns).groupBy("trace_id").applyInPandas(judge, f"name string, trace_id {kind}, state string, witnesses array<string>, error string")


class Stepper(Protocol):
    """A predicate that sees a trace's spans one after the other."""

    def step(self, span: Row) -> None: ...

    def result(self) -> tuple[str, Iterable[str]]: ...


def stream_all(spans: DataFrame, steppers: dict[str, Callable[[], Stepper]]) -> DataFrame:
    """The same as scan_all() for steppers, of which each trace gets new ones: no trace is gathered, so it may have any number of spans.

    Spark sorts the spans by trace and dfs_index and streams them through a table function; whether witnesses exist is checked by
    a join afterwards.
    """
    columns = [F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in spans.dtypes]
    kind = dict(spans.dtypes)["trace_id"]

    @F.udtf(returnType=f"name string, trace_id {kind}, state string, witnesses array<string>, error string")
    class Scan:
        def __init__(self):
            self.trace, self.running, self.broken = None, {}, {}

        def eval(self, span: Row):
            if not self.running and not self.broken:
                self.trace = span["trace_id"]
                for name, new in steppers.items():
                    self._guarded(name, lambda name=name, new=new: self.running.__setitem__(name, new()))
            for name, stepper in list(self.running.items()):
                self._guarded(name, lambda stepper=stepper: stepper.step(span))

        def _guarded(self, name, work):
            try:
                return work()
            except Exception as error:  # noqa: BLE001 - whatever a stepper raises is its own failure
                self.running.pop(name, None)
                self.broken[name] = f"trace {self.trace}: {str(error).strip() or type(error).__name__}"

        def _judged(self, stepper):
            state, witnesses = stepper.result()
            witnesses = list(dict.fromkeys(map(str, witnesses)))
            wrong = f"{state!r} is no state" if state not in STATES else "a match needs a witness" if state == "match" and not witnesses else None
            if wrong:
                raise GuardError(wrong)
            return state, witnesses

        def terminate(self):
            for name in steppers:
                found = self._guarded(name, lambda name=name: self._judged(self.running[name])) if name in self.running else None
                yield (name, self.trace, *found, None) if found else (name, self.trace, None, [], self.broken.get(name))

    order = ["dfs_index"] if "dfs_index" in spans.columns else ["span_id"]
    found = kept(Scan(spans.select(*columns).asTable().partitionBy("trace_id").orderBy(*order)))
    ids = spans.select("trace_id", F.col("span_id").alias("witness"))
    cited = found.select("name", "trace_id", F.explode("witnesses").alias("witness"))
    lost = cited.join(ids, ["trace_id", "witness"], "left_anti").groupBy("name", "trace_id").agg(F.array_join(F.sort_array(F.collect_set("witness")), ", ").alias("_lost"))
    out = found.join(lost, ["name", "trace_id"], "left")
    error = F.coalesce("error", F.when(F.col("_lost").isNotNull(), F.concat(F.lit("trace "), "trace_id", F.lit(": no span "), "_lost")))
    bad = F.col("_lost").isNotNull()
    return out.select("name", "trace_id", F.when(~bad, F.col("state")).alias("state"), F.when(bad, F.array().cast("array<string>")).otherwise(F.col("witnesses")).alias("witnesses"), error.alias("error"))


def scan_traces(spans: DataFrame, predicate: Predicate) -> DataFrame:
    """(trace_id, state, witnesses) of one predicate: see scan_all(). An error raises GuardError."""
    refused = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("GuardError: "), "error")).cast("string")).otherwise(F.col("state"))
    return scan_all(spans, {"": predicate}).select("trace_id", refused.alias("state"), "witnesses")


def _whole(predicate: Predicate | type) -> Predicate:
    """A stepper's class as a predicate on the spans of one trace; predicates as they are."""
    if not isinstance(predicate, type):
        return predicate

    def judge(part: pd.DataFrame) -> tuple[str, Iterable[str]]:
        one = predicate()
        for span in part.astype(object).where(part.notna(), None).to_dict("records"):
            one.step(Row(**span))
        return one.result()

    return judge


def check_predicate(predicate: Predicate, examples: dict[str, pd.DataFrame]) -> None:
    """Run a predicate on an example of each state; it has to cover all three and give each its state."""
    if set(examples) != set(STATES):
        raise GuardError(f"examples have to cover {', '.join(STATES)}")
    for state, spans in examples.items():
        found, witnesses = predicate(spans)
        if found != state or state == "match" and not set(witnesses) & set(spans["span_id"]):
            raise GuardError(f"the example of {state} gives {found}")


@dataclass
class Compiled:
    """evidence and updated as merge_evidence() and updated_insights() give them; failed: insights that stay as they were, and why."""

    evidence: DataFrame
    updated: DataFrame
    failed: dict[str, str] = field(default_factory=dict)


def compile_insights(snapshot: Snapshot, walked: DataFrame, saved: DataFrame, predicates: dict[str, tuple[Predicate | type, dict[str, pd.DataFrame]]], today: str) -> Compiled:
    """Scan all traces once, with each insight's predicate or stepper's class, and merge what matches into its saved evidence.

    A predicate that fails its examples, a guard, or matches nothing leaves its insight unchanged.
    """
    failed, ready = {}, {}
    for name, (predicate, examples) in predicates.items():
        try:
            check_predicate(_whole(predicate), examples)
            ready[name] = predicate
        except Exception as error:  # noqa: BLE001 - whatever a predicate raises, its insight stays
            failed[name] = str(error).strip().splitlines()[-1] if str(error).strip() else type(error).__name__
    gathered, streamed = ({n: p for n, p in ready.items() if isinstance(p, type) == kind} for kind in (False, True))
    scans = ([scan_all(walked, gathered)] if gathered or not streamed else []) + ([stream_all(walked, streamed)] if streamed else [])
    found = kept(reduce(DataFrame.unionByName, scans).where("state = 'match' OR error IS NOT NULL"))
    told = found.groupBy("name").agg(F.min("error").alias("error"), F.count_if(F.col("state") == "match").alias("n")).collect()  # a row for each predicate
    matches = {r.name: r.n for r in told}
    failed |= {r.name: r.error for r in told if r.error is not None} | {name: "nothing matches" for name in ready if name not in matches}
    good = F.col("name").isin(*(n for n in ready if n not in failed)) if set(ready) - set(failed) else F.lit(False)
    urls = snapshot.traces.select("trace_id", F.col("source_url").alias("url"))
    new = found.where(good).join(urls, "trace_id").select(F.col("name").alias("insight_id"), "trace_id", "url", F.col("witnesses").alias("spans"))
    merged = merge_evidence(saved, new)
    return Compiled(merged, updated_insights(merged, today), failed)


# --- extractors, detectors, validators -----------------------------------------------------------------------------


def extracted_messages(snapshot: Snapshot, extractor: Callable[[Snapshot], DataFrame]) -> DataFrame:
    """(trace_id, messages) of an extractor, which has to cover exactly the traces of the snapshot."""
    out = extractor(snapshot).select("trace_id", "messages")
    differ = key_differences(out, snapshot.traces)
    rows = differ.limit(5).collect()
    if rows:
        raise GuardError("; ".join(f"trace {r.trace_id} is {'not in the snapshot' if r.side == 'left' else 'left out'}" for r in rows))
    return out


class Detector(Protocol):
    """Finds problems (description, supporting_trace_ids) in a snapshot."""

    def detect(self, snapshot: Snapshot, description: DataFrame, extras: dict[str, object]) -> DataFrame: ...


def detected(detector: Detector | None, snapshot: Snapshot, extras: dict[str, object] | None = None, allowed: DataFrame | None = None) -> DataFrame | None:
    """Problems of a detector, None without one. They may cite only allowed traces (trace_id), by default those of the snapshot."""
    if detector is None:
        return None
    problems = detector.detect(snapshot, snapshot.describe(), extras or {})
    cited = problems.select(F.explode("supporting_trace_ids").alias("trace_id"))
    lost = _some(uncited(cited, snapshot.traces if allowed is None else allowed), "trace_id")
    if lost:
        raise GuardError(f"problems cite traces that weren't given: {', '.join(lost)}")
    return problems


class Fetcher:
    """Gives a reviewer of failed evaluations the traces it asks for, so many rounds at most, and remembers which."""

    def __init__(self, snapshot: Snapshot, rounds: int = ROUNDS):
        self.snapshot, self.left, self.fetched = snapshot, rounds, set()

    def fetch(self, *trace_ids: str) -> Snapshot:
        if self.left <= 0:
            raise GuardError("no rounds are left")
        self.left -= 1
        found = self.snapshot.lookup(*trace_ids)
        self.fetched.update(trace_ids)
        return found

    def checked(self, problems: DataFrame) -> DataFrame:
        """The problems, if they cite only traces that were fetched."""
        spark = problems.sparkSession
        allowed = spark.createDataFrame([(i,) for i in sorted(self.fetched)], "trace_id string")
        lost = _some(uncited(problems.select(F.explode("supporting_trace_ids").alias("trace_id")), allowed), "trace_id")
        if lost:
            raise GuardError(f"problems cite traces that weren't fetched: {', '.join(lost)}")
        return problems


@dataclass
class Verdict:
    """What a validator says of a problem: true, false or None, and how often it looked anything up."""

    holds: bool | None
    lookups: int = 0

    @property
    def settled(self) -> bool | None:
        """A verdict that looked nothing up says nothing."""
        return self.holds if self.lookups > 0 else None


def validated(problems: DataFrame, validator: Callable[[str], Verdict] | None) -> tuple[DataFrame, int]:
    """(problems that stay, number of dropped ones). Problems are few; only a settled false drops one."""
    if validator is None:
        return problems, 0
    verdicts = [(r.description, validator(r.description).settled) for r in problems.select("description").distinct().collect()]
    told = problems.sparkSession.createDataFrame(verdicts, "description string, verdict boolean")
    stays, n = rejected(problems, told)
    return stays, n.first().rejected
