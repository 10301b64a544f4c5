"""Source links: which URLs may be kept, how providers' pages are addressed, and text inside provider SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What no URL may contain: white space and control characters.
UNSAFE = r"[\s\p{Cntrl}]"


def valid_url(url: Column) -> Column:
    """The URL if it is http(s) with a host, or a file URL with an absolute path; without credentials; else NULL."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host, user = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("USERINFO"))
    path = F.try_parse_url(url, F.lit("PATH"))
    web = scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != "")
    local = (scheme == "file") & F.startswith(path, F.lit("/")) & F.coalesce(host, F.lit("")).isin("", "localhost")
    return F.when((web | local) & user.isNull() & ~url.rlike(UNSAFE), url)


def page(base: Column | str, *parts: Column) -> Column:
    """A page below a base URL; parts are escaped."""
    start = F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/"))
    return F.concat_ws("/", start, *(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in parts))


def mlflow_page(base: str, experiment: Column, trace: Column) -> Column:
    """The page of a trace in an MLflow tracking server."""
    link = F.concat(F.lit(base.rstrip("/") + "/#/experiments/"), F.url_encode(experiment), F.lit("/traces?selectedEvaluationId="), F.url_encode(trace))
    return F.when(experiment.isNotNull() & trace.isNotNull(), link)


def langfuse_page(host: str, html_path: Column) -> Column:
    """The page of a trace from the path that the provider gives."""
    return F.when(html_path.isNotNull(), F.concat(F.lit(host.rstrip("/") + "/"), F.ltrim(html_path, F.lit("/"))))


def braintrust_page(app: str, organisation: str, project: str, root: Column) -> Column:
    """A link to the root span of a trace in a project's logs."""
    return F.concat(page(F.lit(app + "/app"), F.lit(organisation), F.lit("p"), F.lit(project), F.lit("logs")), F.lit("?r="), F.url_encode(root))


def file_page(path: Column, line: Column) -> Column:
    """A line of a local file."""
    return F.concat(path, F.lit("#L"), line.cast("string"))


def sql_literal(text: str) -> str:
    """A text inside a provider's SQL, quoted; backslashes and quotes are doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"
