"""Rule documents: rules as data, compiled once, and run over files and facts.

A document is a mapping: macros (name to text), presets (names of bundled rule sets) and rules, each with id, kind, severity, message, language, include, exclude, enabled, and
what its kind needs.  Kinds: pattern (a tree pattern, with inside or not_inside), type (a pattern, the subject's name and the type it
must satisfy), sql (a query over fact views), flow (from, to, not_through as roles or variables of flow events).
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.extract import python as source
from factweave.functions import names, types
from factweave.operators import checks, patterns, ranges
from factweave.sources import scan

SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    severity: str = "warning"
    message: str = ""
    languages: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    enabled: bool = True
    body: dict = field(default_factory=dict)


def listed(value) -> tuple:
    return () if value is None else tuple(value) if isinstance(value, (list, tuple)) else (value,)


def expanded(text: str, macros: Mapping[str, str], depth: int = 10) -> str:
    """{name} of a macro is replaced by its text, in the texts of macros too; names that refer to themselves raise."""
    if depth < 0:
        raise ValueError("macros refer to themselves")
    out = re.sub(r"\{([A-Za-z_]\w*)\}", lambda m: macros.get(m[1], m[0]), text)
    return out if out == text else expanded(out, macros, depth - 1)


def compiled(document: Mapping, presets: Mapping[str, list] | None = None) -> list[Rule]:
    """Rules of a document and of the presets that it names; a rule's id decides once, the document's own first."""
    macros = document.get("macros") or {}
    raw = [*(document.get("rules") or []), *(r for p in listed(document.get("presets")) for r in (presets or PRESETS)[p])]
    out: dict[str, Rule] = {}
    for r in raw:
        kind = r.get("kind") or next((k for k in ("pattern", "sql", "type", "flow") if k in r), None)
        if kind not in ("pattern", "sql", "type", "flow"):
            raise ValueError(f"rule {r.get('id')!r} has no kind")
        severity = r.get("severity", "warning")
        if severity not in SEVERITIES:
            raise ValueError(f"not a severity: {severity!r}")
        body = {k: expanded(v, macros) if isinstance(v, str) else [expanded(x, macros) for x in v] if isinstance(v, (list, tuple)) else v for k, v in r.items()}
        if kind == "flow" and not (body.get("from") and body.get("to")):
            raise ValueError(f"flow rule {r.get('id')!r} needs from and to")
        rule = Rule(r["id"], kind, severity, r.get("message", ""), listed(r.get("language")), listed(r.get("include")), listed(r.get("exclude")), bool(r.get("enabled", True)), body)
        out.setdefault(rule.id, rule)
    return list(out.values())


def document(text: str) -> dict:
    """A rule document from JSON, or from YAML where a reader for it is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("the rules aren't JSON, and no YAML reader is installed") from missing
        return yaml.safe_load(text)


def applicable(files: DataFrame, rule: Rule) -> DataFrame:
    language = F.col("language") if "language" in files.columns else scan.language(F.col("file_path"))
    return files.where(names.rule_applies(F.col("file_path"), language, rule.enabled, rule.languages, rule.include, rule.exclude))


def pattern_rule(files: DataFrame, rule: Rule) -> DataFrame:
    """Places where the pattern stands (inside, or outside of, a kind of statement)."""
    found = patterns.find(applicable(files, rule), rule.body["pattern"], rule.body.get("inside"), rule.body.get("not_inside"))
    return checks.violations(found, rule.id, rule.severity, rule.message)


def lint(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations of all plain pattern rules, each file parsed once, without those that a comment `noqa` or `noqa: id, id` suppresses."""
    plain = [r for r in rules if r.kind == "pattern" and not r.body.get("inside") and not r.body.get("not_inside")]
    found = patterns.find_many(files, {r.id: r.body["pattern"] for r in plain if r.enabled})
    about = {r.id: r for r in plain}
    allowed = [applicable(files, r).select("file_path", F.lit(r.id).alias("rule")) for r in plain if r.enabled]
    if allowed:
        found = found.join(reduce(DataFrame.unionByName, allowed), ["file_path", "rule"], "left_semi")
    severity, message = F.lit("warning"), F.lit("")
    for r in about.values():
        severity = F.when(F.col("rule") == r.id, r.severity).otherwise(severity)
        message = F.when(F.col("rule") == r.id, r.message).otherwise(message)
    out = found.select("rule", severity.alias("severity"), "file_path", "line", F.col("col").cast("long").alias("col"), message.alias("message"))
    return ranges.suppressed(out, noqa_ranges(files)).select(*checks.COLUMNS)


def noqa_ranges(files: DataFrame) -> DataFrame:
    """file_path, start, end and tags (null: all rules) of the comments that suppress findings of their line."""
    marks = source.comments(files).where(F.col("value").rlike(r"(?i)#\s*noqa\b"))
    tags = F.regexp_extract("value", r"(?i)#\s*noqa\s*:\s*([\w\s,.-]+)", 1)
    return marks.select("file_path", F.col("line").alias("start"), F.col("line").alias("end"), F.when(tags != "", F.transform(F.split(tags, ","), F.trim)).alias("tags"))


def type_rule(files: DataFrame, rule: Rule, type_binding: DataFrame | None) -> DataFrame:
    """Matches whose subject's type doesn't satisfy the rule's; without types one finding a file says so.

    type_binding: file_path, symbol_qn, line, type_str.  A subject's type is that of its last part at the line.
    """
    found = patterns.find(applicable(files, rule), rule.body["pattern"])
    if type_binding is None:
        missing = found.select("file_path").distinct().select("file_path", F.lit(0).alias("line"))
        return checks.violations(missing, f"{rule.id}:unavailable", rule.severity, rule.message)
    subject = F.element_at("captures", F.lit(rule.body["subject"]))
    known = type_binding.select("file_path", "line", names.short_name(F.col("symbol_qn")).alias("subject"), types.type_satisfies(F.col("type_str"), rule.body["type"]).alias("ok")).where("ok").select("file_path", "line", "subject").distinct()
    asked = found.select("file_path", "line", "col", names.short_name(subject).alias("subject"))
    return checks.violations(asked.join(known, ["file_path", "line", "subject"], "left_anti"), rule.id, rule.severity, rule.message)


def flow_rule(events: DataFrame, edges: DataFrame, rule: Rule) -> DataFrame:
    """Sinks that a source reaches by value edges past no sanitizer; one finding a pair, at the sink.

    from, to and not_through are expressions over the text of an event; events: file_path, event_id, text, start_line,
    start_col; edges: file_path, from_event, to_event.
    """
    key = F.concat_ws("#", "file_path", F.col("event_id").cast("string"))
    of = lambda given: events.where(reduce(lambda a, b: a | b, [F.col("text").rlike(x) for x in listed(given)], F.lit(False))).select(key.alias("node"))
    ways = edges.select(F.concat_ws("#", "file_path", F.col("from_event").cast("string")).alias("src"), F.concat_ws("#", "file_path", F.col("to_event").cast("string")).alias("dst"))
    pairs = checks.flow_violations(ways, of(rule.body["from"]), of(rule.body["to"]), of(rule.body.get("not_through")))
    at = events.select(key.alias("sink"), "file_path", F.col("start_line").alias("line"), F.col("start_col").alias("col"))
    return checks.violations(pairs.join(at, "sink"), rule.id, rule.severity, rule.message)


def run(spark: SparkSession, files: DataFrame, rules: list[Rule], views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Violations of every rule, in order of place; views: fact relations for sql, type and flow rules."""
    views = dict(views or {})
    found = [lint(files, rules)] if any(r.kind == "pattern" for r in rules) else []
    for r in rules:
        if not r.enabled:
            continue
        if r.kind == "pattern" and (r.body.get("inside") or r.body.get("not_inside")):
            found.append(pattern_rule(files, r))
        elif r.kind == "sql":
            found.append(checks.violations(spark.sql(r.body["sql"], **{k: v for k, v in views.items() if f"{{{k}}}" in r.body["sql"]}), r.id, r.severity, r.message))
        elif r.kind == "type":
            found.append(type_rule(files, r, views.get("type_binding")))
        elif r.kind == "flow":
            found.append(flow_rule(views["flow_event"], views["flow_edge"], r))
    return checks.in_order(checks.union(*found)) if found else checks.violations(files.limit(0), "none")


#: Small bundled rule sets; a document's own rules go before them.
PRESETS: dict[str, list] = {
    "unsafe-python": [
        {"id": "eval", "pattern": "eval($...A)", "severity": "error", "message": "evaluates text"},
        {"id": "exec", "pattern": "exec($...A)", "severity": "error", "message": "runs text"},
    ],
    "input-to-shell": [{"id": "input-to-shell", "kind": "flow", "from": r"^input\(", "to": r"^os\.system\(", "not_through": r"quote\(", "severity": "error", "message": "input reaches a shell"}],
}
