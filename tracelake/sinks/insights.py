"""Saved insights: a list in a YAML or JSON file, and versioned tables that a run replaces at once or not at all."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.common import ZONED

#: Traces that an insight has to have at least.
LEAST_TRACES = 2
INSIGHTS = "insight_id string, id string, name string, description string, updated_date string"
EVIDENCE = "insight_id string, trace_id string, url string, spans array<string>, span_urls map<string,string>"
#: Characters that a double-quoted YAML text can't hold as they are, though JSON's can.
ODD = re.compile("[\x7f-\x9f\u2028\u2029\ufeff]")


@dataclass
class Insights:
    """insights and their evidence. insight_id is the stored id, else the name."""

    insights: DataFrame
    evidence: DataFrame

    @classmethod
    def none(cls, spark: SparkSession) -> Insights:
        return cls(spark.createDataFrame([], INSIGHTS), spark.createDataFrame([], EVIDENCE))


class InsightError(ValueError):
    """Saved insights that aren't valid, or that another run has replaced meanwhile."""


def _invalid(one: object) -> str | None:
    """What is wrong with an insight of a file."""
    filled = lambda x: isinstance(x, str) and x != ""
    if not isinstance(one, dict):
        return "it is no object"
    lost = [k for k in ("name", "description") if not filled(one.get(k))]
    if lost:
        return f"{' and '.join(lost)} missing"
    if one.get("id") is not None and not filled(one["id"]):
        return "its id is empty"
    evidence = one.get("evidence")
    if not isinstance(evidence, list) or any(not isinstance(e, dict) or not filled(e.get("trace_id")) for e in evidence):
        return "its evidence is no list of traces"
    if len(evidence) < LEAST_TRACES:
        return f"it has fewer than {LEAST_TRACES} traces"
    if any(not isinstance(s, dict) or not filled(s.get("span_id")) for e in evidence for s in e.get("spans") or []):
        return "a span has no id"
    date = one.get("updated_date")
    return None if date is None or re.match(ZONED, str(date)) else "its updated_date has no offset"


def read_file(spark: SparkSession, path: str) -> Insights:
    """The insights of a file, checked. Two of one id, or of one name without ids, are refused."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        rows = json.loads(text)
    except ValueError:
        import yaml

        # Dates stay as they are written.
        plain = type("Plain", (yaml.SafeLoader,), {"yaml_implicit_resolvers": {k: [x for x in v if not x[0].endswith("timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}})
        rows = yaml.load(text, plain)  # noqa: S506 - a safe loader
    if not isinstance(rows, list):
        raise InsightError(f"{path}: not a list of insights")
    insights, evidence, seen = [], [], set()
    for i, one in enumerate(rows):
        wrong = _invalid(one)
        if wrong:
            raise InsightError(f"{path}: insight {i + 1}: {wrong}")
        key = one.get("id") or one["name"]
        if key in seen:
            raise InsightError(f"{path}: insight {i + 1}: {key!r} is there twice")
        seen.add(key)
        insights.append((key, one.get("id"), one["name"], one["description"], one.get("updated_date")))
        for e in one["evidence"]:
            spans = e.get("spans") or []
            evidence.append((key, e["trace_id"], e.get("url"), [s["span_id"] for s in spans], {s["span_id"]: s["url"] for s in spans if s.get("url")}))
    return Insights(spark.createDataFrame(insights, INSIGHTS), spark.createDataFrame(evidence, EVIDENCE))


def _quoted(text: str) -> str:
    return ODD.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def yaml_lines(saved: Insights) -> Iterator[str]:
    """The insights as lines of YAML, by name; empty fields are left out. Rows come one after the other, so an insight may have any number of traces."""
    rows = saved.insights.join(saved.evidence, "insight_id").orderBy("name", "insight_id", "trace_id")
    last = None
    for r in rows.toLocalIterator():
        if r.insight_id != last:
            last, mark = r.insight_id, "- "
            for k in ("id", "name", "description", "updated_date"):
                if r[k] is not None:
                    yield f"{mark}{k}: {_quoted(r[k])}\n"
                    mark = "  "
            yield "  evidence:\n"
        yield f"  - trace_id: {_quoted(r.trace_id)}\n"
        if r.url is not None:
            yield f"    url: {_quoted(r.url)}\n"
        for i, span in enumerate(r.spans or []):
            yield ("    spans:\n" if i == 0 else "") + f"    - span_id: {_quoted(span)}\n"
            if (r.span_urls or {}).get(span):
                yield f"      url: {_quoted(r.span_urls[span])}\n"


class InsightStore:
    """Versions of the insights in a folder of a file system that Spark reads.

    A version's tables are written first; a marker with its number, which only one run can create, then makes it the
    current one. A run that ends early leaves tables without a marker, which nobody reads. Older versions stay readable.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, str | None]:
        """The folder of each version's tables; None for one whose marker wasn't finished."""
        if not self._files.exists(self._path(f"{self.path}/versions")):
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/versions").select(F.col("_metadata.file_name").alias("name"), "value").collect()
        found = {int(s.getPath().getName()): None for s in self._files.listStatus(self._path(f"{self.path}/versions"))}
        return found | {int(r.name): r.value for r in rows if r.value}

    def current(self) -> int:
        """The number of the last finished version, 0 if there is none."""
        return max((n for n, folder in self.versions().items() if folder), default=0)

    def read(self, version: int | None = None) -> Insights:
        """The current version, or an older one."""
        versions = self.versions()
        number = version or max((n for n, folder in versions.items() if folder), default=0)
        if not number:
            return Insights.none(self.spark)
        if not versions.get(number):
            raise InsightError(f"{self.path} has no version {number}")
        read = lambda table, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{versions[number]}/{table}")
        return Insights(read("insights", INSIGHTS), read("evidence", EVIDENCE))

    def write(self, saved: Insights, after: int | None = None) -> int:
        """Make these the current version and give its number. after: the version that they follow from; another one since then is an error."""
        versions = self.versions()
        now = max((n for n, folder in versions.items() if folder), default=0)
        if after is not None and now != after:
            raise InsightError(f"{self.path}: version {now} was saved meanwhile")
        folder, number = f"tables/{uuid.uuid4().hex}", max(versions, default=0) + 1
        saved.insights.select("insight_id", "id", "name", "description", "updated_date").write.parquet(f"{self.path}/{folder}/insights")
        saved.evidence.select("insight_id", "trace_id", "url", "spans", "span_urls").write.parquet(f"{self.path}/{folder}/evidence")
        marker = self._path(f"{self.path}/versions/{number:08d}")
        try:
            out = self._files.create(marker, False)
        except Exception as error:
            raise InsightError(f"{self.path}: version {number} was saved meanwhile") from error
        try:
            out.write(bytearray(folder.encode()))
        finally:
            out.close()
        return number
