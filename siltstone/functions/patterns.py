"""Globs, rule lists and static prefixes, translated on the driver to Catalyst predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INCLUDE, EXCLUDE = "include", "exclude"
#: Java constructs that a linear-time regex engine does not have; rules with them are refused.
_FOREIGN = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")


class RuleError(ValueError):
    """A rule that cannot be parsed, with its line number."""

    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message}")
        self.line = line


@dataclass(frozen=True)
class Rule:
    action: str
    kind: str
    pattern: str
    line: int = 0

    def matches(self, path: Column) -> Column:
        """Whether a path, its backslashes read as slashes, matches."""
        path = F.translate(path, "\\", "/")
        if self.kind == "path":
            return path == F.lit(self.pattern)
        return path.rlike(glob_regex(self.pattern) if self.kind == "glob" else self.pattern)


def glob_regex(pattern: str) -> str:
    """An anchored Java regex for a rule glob: ``*`` and ``?`` also match ``/``; ``**/`` matches any number of leading components."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            alone = (i == 0 or pattern[i - 1] == "/") and (i + 2 == len(pattern) or pattern[i + 2] == "/")
            if not alone:
                raise ValueError("** must be a whole path component")
            if i + 2 == len(pattern):
                out.append(".*")
                i += 2
            else:
                out.append("(?:.*/)?")
                i += 3
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError("unclosed character class")
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def object_glob_regex(pattern: str) -> str:
    """For object keys: ``*`` any run, ``?`` one character, all else literal, the whole key."""
    plain = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c not in "/_" else c for c in pattern)
    return f"(?s)^{plain}$"


def static_prefix(pattern: str) -> str:
    """What a pattern says before its first wildcard."""
    return re.split(r"[*?]", pattern, maxsplit=1)[0]


def object_glob(key: Column, pattern: str) -> Column:
    """The glob as a prefix test, which reaches the scan, and a regex."""
    test = key.rlike(object_glob_regex(pattern))
    prefix = static_prefix(pattern)
    return key.startswith(prefix) & test if prefix else test


def parse_rule(line: str, number: int = 1) -> Rule:
    """``[!] +|-|include|exclude [glob:|regex:|path:] pattern``; ``!`` turns the action around."""
    text = line.strip()
    invert = text.startswith("!")
    text = text[1:].strip() if invert else text
    for lead, action in (("+ ", INCLUDE), ("- ", EXCLUDE), ("include ", INCLUDE), ("exclude ", EXCLUDE)):
        if text.startswith(lead):
            rest = text[len(lead) :].strip()
            break
    else:
        raise RuleError(number, f"no action in {line!r}")
    kind = "glob"
    for name in ("glob", "regex", "path"):
        if rest.startswith(f"{name}:"):
            kind, rest = name, rest[len(name) + 1 :].strip()
            break
    if not rest:
        raise RuleError(number, "the pattern is empty")
    try:
        if kind == "glob":
            glob_regex(rest)
        elif kind == "regex":
            if _FOREIGN.search(rest):
                raise ValueError("look-around, back-references and possessive repeats are not allowed")
            re.compile(rest)
    except (ValueError, re.error) as error:
        raise RuleError(number, str(error)) from error
    if invert:
        action = EXCLUDE if action == INCLUDE else INCLUDE
    return Rule(action, kind, rest, number)


def parse_rules(text: str) -> list[Rule]:
    """A rule file: blank lines and ``#`` comments are skipped, the first bad line raises."""
    rules = []
    for number, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.strip().startswith("#"):
            rules.append(parse_rule(line, number))
    return rules


def rule_list(include: list[str] = (), exclude: list[str] = (), file_text: str = "") -> list[Rule]:
    """All includes, then all excludes, then the rules of a file."""
    return [parse_rule(f"+ {p}") for p in include] + [parse_rule(f"- {p}") for p in exclude] + parse_rules(file_text)


def evaluate(rules: list[Rule], path: Column) -> Column:
    """include, exclude or no_match: the first rule that matches decides; one CASE."""
    case = None
    for rule in rules:
        case = (F.when if case is None else case.when)(rule.matches(path), F.lit(rule.action))
    return F.lit("no_match") if case is None else case.otherwise(F.lit("no_match"))


def should_include(rules: list[Rule], path: Column, default: str = INCLUDE) -> Column:
    decision = evaluate(rules, path)
    return F.when(decision == "no_match", F.lit(default == INCLUDE)).otherwise(decision == INCLUDE)


def survives_pruning(rules: list[Rule], path: Column, default: str = INCLUDE) -> Column:
    """Included, and below no excluded directory: a pruned directory hides its whole subtree."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    ancestors = F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    pruned = F.exists(ancestors, lambda a: ~should_include(rules, a, default))
    return should_include(rules, path, default) & ~pruned


def excluded_by_globs(globs: list[str], path: Column) -> Column:
    """The old exclusion list: any glob that matches excludes; globs that cannot be parsed are ignored."""
    test = F.lit(False)
    for g in globs:
        try:
            test = test | F.translate(path, "\\", "/").rlike(glob_regex(g))
        except ValueError:
            continue
    return test
