"""Command line: `python -m tracelake run SETTINGS [--output FILE]` and `python -m tracelake coverage SETTINGS [--verbose]`."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from tracelake import config
from tracelake.functions.tables import forget
from tracelake.operators import coverage
from tracelake.plans.insights import merged
from tracelake.plans.passes import built_in
from tracelake.sinks.files import digest, report, write_insights, write_json
from tracelake.sinks.insights import LEAST_TRACES, Insights, InsightStore, read_file
from tracelake.sources import live_rows
from tracelake.sources.common import Snapshot
from tracelake.sources.readers import READERS

#: Endings of files; other places of insights are folders.
FILES = (".yml", ".yaml", ".json")


def load(spark: SparkSession, settings: config.Config) -> Snapshot:
    """The snapshot of the one source that is set."""
    options = dict(settings.options)
    if settings.source.endswith("_live"):
        return live_rows.load(spark, settings.source.removesuffix("_live"), **{k: str(v) for k, v in options.items()})
    numbers = {"limit": int(options["limit"])} if "limit" in options else {}
    texts = {k: v for k, v in options.items() if k not in ("path", "limit")}
    needs = config.SOURCES[settings.source]
    given = [options[k] for k in needs]
    return READERS[settings.source](spark, *given, **numbers, **{k: v for k, v in texts.items() if k not in needs})


def saved_insights(spark: SparkSession, path: str | None) -> Insights:
    """What earlier runs found: a YAML or JSON file, or the folder of an InsightStore."""
    if not path:
        return Insights.none(spark)
    return read_file(spark, path) if path.endswith(FILES) else InsightStore(spark, path).read()


def run(spark: SparkSession, settings: config.Config) -> str:
    """Run the passes, merge their problems into the saved insights, write insights and artifacts, and give the report."""
    store = None if settings.output == "-" or settings.output.endswith(FILES) else InsightStore(spark, settings.output)
    version = store.current() if store else None
    saved = store.read(version) if store and version and not settings.existing else saved_insights(spark, settings.existing)
    snapshot = load(spark, settings)
    results = built_in(settings.passes).analyze_all(snapshot)
    problems: DataFrame | None = None
    for r in results:
        if r.problems is not None:
            problems = r.problems if problems is None else problems.unionByName(r.problems)
        for name, table in r.tables.items() if settings.artifacts else ():
            write_json(table, f"{settings.artifacts}/{r.name}/{name}")
        if settings.artifacts and "anomalies" in r.tables:
            t, counts = r.tables, snapshot.describe().first().asDict()
            text = digest(t["anomalies"], t["failures"], t["cross_tool"], t["verdicts"], t["cluster_summary"], snapshot.traces, counts)
            spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(f"{settings.artifacts}/{r.name}/digest")
    if problems is None:
        problems = spark.createDataFrame([], "name string, description string, supporting_trace_ids array<string>")
    found = merged(snapshot, problems, saved, datetime.now(UTC).isoformat(timespec="seconds"))
    if store:
        store.write(found.insights, version)
    else:
        write_insights(found.insights, settings.output)
    few = [f"{found.too_few} problems have fewer than {LEAST_TRACES} traces and are no insights."] if found.too_few else []
    text = report(results, found.new, found.extended + found.unchanged, extended=found.extended)
    forget(spark)
    return "\n".join([text, *few])


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracelake")
    parser.add_argument("what", choices=["run", "coverage"])
    parser.add_argument("settings")
    parser.add_argument("--output")
    parser.add_argument("--artifacts")
    parser.add_argument("--existing", help="insights of earlier runs: a file, or a folder that a run wrote")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(arguments)
    try:
        settings = config.read(given.settings, {"output": given.output, "artifacts": given.artifacts, "existing": given.existing})
        spark = SparkSession.builder.appName("tracelake").getOrCreate()
        if given.what == "run":
            text = run(spark, settings)
        else:
            snapshot = load(spark, settings)
            found = coverage.presence(snapshot.traces, snapshot.spans)
            text = coverage.report(str(settings.options.get("path") or settings.options.get("url")), found, coverage.rules(found), given.verbose)
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    # The list itself may go to standard output; the report then goes beside it.
    print(text, file=sys.stderr if settings.output == "-" and given.what == "run" else sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
