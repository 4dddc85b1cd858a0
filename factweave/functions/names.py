"""Scalar functions over names, paths, patterns and types, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(name: Column) -> Column:
    """Qualified name with ::, / and \\ as dots; quotes and empty parts are dropped."""
    dotted = F.regexp_replace(F.regexp_replace(name, "['\"`]", ""), r"::|[/\\]", ".")
    return F.regexp_replace(F.regexp_replace(dotted, r"\.{2,}", "."), r"^\.+|\.+$", "")


def words(name: Column) -> Column:
    """Lower-case words of a snake or camel case identifier."""
    parts = F.split(name, r"_+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def segments(name: Column) -> Column:
    """Parts between case borders or underscores, case kept."""
    return F.filter(F.split(name, r"_|(?<=[a-z])(?=[A-Z])"), lambda x: x != "")


def short_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, r"\."), -1)


def glob_regex(pattern: str) -> str:
    """Anchored expression of a glob with * and ?; /.../ is an expression as it stands."""
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return pattern[1:-1]
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def glob_match(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    return value.rlike(("(?i)" if ignore_case else "") + glob_regex(pattern))


def smart_case_regex(name: str) -> str:
    """snake_case, camelCase and PascalCase spellings of a name."""
    parts = [p.lower() for p in re.split(r"_+|(?<=[a-z0-9])(?=[A-Z])", name) if p]
    camel = parts[0] + "".join(p.capitalize() for p in parts[1:]) if parts else ""
    return "(?i)^(?:" + "|".join(map(re.escape, dict.fromkeys(["_".join(parts), camel, camel[:1].upper() + camel[1:]]))) + ")$"


def path_glob_regex(pattern: str) -> str:
    """Glob over path components: ** spans any number of them, * and ? stay inside one; a bare directory is its subtree."""
    pattern = pattern.strip("/")
    out = ""
    parts = pattern.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part) + ("" if last else "/")
    tail = "" if any(c in parts[-1] for c in "*?.") else "(?:/.*)?"
    return "^" + out + tail + "$"


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(test_[^/]*|[^/]*_test(\.[^/]*)?|[^/]*\.(test|spec)\.[^/]*)$|(^|/)(tests?|__tests__)/")


def is_test_symbol(name: Column) -> Column:
    return name.rlike(r"(^|[.:])(test_|Test)|(^|[.:])(describe|it|test)$")


def in_subsequence(value: Column, query: str) -> Column:
    """Whether the query's characters occur in order."""
    return F.lower(value).rlike(".*?".join(re.escape(c) for c in query.lower())) if query else F.lit(True)


def fuzzy_subsequence(value: Column, query: str, most: int = 1) -> Column:
    """Whether the query's characters occur in order if up to `most` of them may stand for any other character.

    A replaced character still takes up one of the value's.
    """
    q, low = query.lower(), F.lower(value)
    if not q:
        return F.lit(True)
    # For each number of replacements the least end of the part of the value that is used up; null if it can't be.
    ends: list[Column] = [F.lit(0)] + [F.lit(None).cast("int")] * most
    for c in q:
        now = []
        for k in range(most + 1):
            kept = F.nullif(F.call_function("locate", F.lit(c), low, ends[k] + 1), F.lit(0))
            ways = [kept]
            if k:
                ways.append(F.when(ends[k - 1] < F.length(low), ends[k - 1] + 1))
            now.append(F.least(*ways) if len(ways) > 1 else kept)
        ends = now
    return F.coalesce(*ends).isNotNull()


def symbol_score(name: Column, qualified: Column, query: str) -> Column:
    """Rank of a symbol: exact 1000, prefix 900, segment start 800, substring 700 or 600, qualified name 400, fuzzy 200."""
    q = query.lower()
    low = F.lower(name)
    starts = F.exists(segments(name), lambda s: F.lower(s).startswith(q))
    return (
        F.when(low == q, 1000.0)
        .when(low.startswith(q), 900.0)
        .when(starts, 800.0)
        .when(F.contains(name, F.lit(query)), 700.0)
        .when(F.contains(low, F.lit(q)), 600.0)
        .when(F.contains(F.lower(qualified), F.lit(q)), 400.0)
        .when(fuzzy_subsequence(name, q), 200.0)
        .otherwise(0.0)
    )


def file_score(path: Column, query: str) -> Column:
    """Rank of a path: base name 1100, stem 1080, start of the base name 1050, part of the path 300."""
    q = query.lower()
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(base == q, 1100.0)
        .when(F.regexp_replace(base, r"\.[^.]*$", "") == q, 1080.0)
        .when(base.startswith(q), 1050.0)
        .when(F.contains(F.lower(path), F.lit(q)), 300.0)
        .otherwise(0.0)
    )


def type_matches(type_name: Column, constraint: str) -> Column:
    """A&!B|C over short or full type names: alternatives of conjunctions."""
    one = lambda t: (type_name == t) | (short_name(type_name) == t)
    term = lambda t: ~one(t[1:]) if t.startswith("!") else one(t)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [term(t.strip()) for t in alt.split("&")]) for alt in constraint.split("|")])


def pattern_words(pattern: str) -> list[str]:
    """Identifiers that every text with a match of a code pattern must hold."""
    return sorted(set(re.findall(r"(?<![$\w])[A-Za-z_]\w*", re.sub(r"\$(?:\.\.\.)?\w*(?::\w+(?:\[[^\]]*\])?)?", " ", pattern))))


def holds_words(text: Column, pattern: str) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in pattern_words(pattern)], F.lit(True))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"/__init__$", ""), "/", ".")


def like_escaped(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def singular(name: Column) -> Column:
    """A plural name's singular by the usual endings."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=[^aeiou])ies$", "y"), r"(?<!s)s$", "")


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def named_groups(text: Column) -> Column:
    """Distinct names of the groups that a regular expression defines, or that .group("name") reads."""
    defined = F.regexp_extract_all(text, F.lit(r"\(\?P<([A-Za-z_]\w*)>"), F.lit(1))
    used = F.regexp_extract_all(text, F.lit(r"\.group\(\s*['\"]([A-Za-z_]\w*)['\"]\s*\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(defined, used)))


def rule_applies(path: Column, language: Column, enabled: bool = True, languages: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a rule holds for a file: switched on, of its languages, in an included path if any are given, in no excluded one."""
    keep = F.lit(enabled)
    if languages:
        keep = keep & language.isin(list(languages))
    if include:
        keep = keep & reduce(lambda a, b: a | b, [path.rlike(path_glob_regex(g)) for g in include])
    return keep & ~reduce(lambda a, b: a | b, [path.rlike(path_glob_regex(g)) for g in exclude], F.lit(False))
