"""Predicates on nodes and file paths. The four notions of a test file differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slashes

# Patterns over lower-cased paths.
TEST_RANKING = r"[/\\](test|spec)|__test__|_test\.|\.(test|spec)\.|/(fixture|mock|stub|fake)|test\.(ts|js)$"
TEST_SEGMENTS = r"(^|/)(test|tests|spec|specs|fixture|fixtures|mock|mocks|__tests__|__mocks__|testfixtures)(/|$)"
TEST_NAMES = r"tests?\.java$|test\.(rs|tsx?|jsx?|py|go)$|tests?\.cs$|_test\.dart$|\.(spec|test)\.|(^|/)test_[^/]*$|(^|/)conftest\.py$"
TEST_SERVICE = r"/(test|spec|fixture|mock)|__tests__|\.(test|spec)\.|_test\."
TEST_AUDIT = r"test|spec"
GENERATED = r"\.min\.(js|css)$|\.(chunk|bundle)\.|/(dist|build|generated)/|/resources/(monitor|static)/"
HASHED = r"(^|/)[^./]*\.[0-9a-f]{8,}\.[^/]*$"
# What a lower-cased name contains that reads like the end of a data flow worth auditing.
SINK_WORDS = ["query", "exec", "eval", "write", "delete", "connect", "send", "request", "fetch", "open", "read_file", "spawn", "database", "sql", "db", "auth", "login", "password"]
SINKS = "|".join(SINK_WORDS)


def is_test_ranking(file: Column) -> Column:
    """The notion that weighs callers in ranking."""
    return F.lower(file).rlike(TEST_RANKING)


def is_test_segment(file: Column) -> Column:
    """By path segment and file name."""
    path = slashes(F.lower(file))
    return path.rlike(TEST_SEGMENTS) | path.rlike(TEST_NAMES)


def is_test_service(file: Column) -> Column:
    return slashes(F.lower(file)).rlike(TEST_SERVICE)


def is_test_audit(file: Column) -> Column:
    """The loosest notion."""
    return F.lower(file).rlike(TEST_AUDIT)


def is_generated(file: Column) -> Column:
    """Minified, bundled, built or hashed files."""
    path = slashes(F.lower(file))
    return path.rlike(GENERATED) | path.rlike(HASHED)


def is_entry_point(name: Column, kind: Column, file: Column) -> Column:
    """Functions and methods that look like program, route, webhook, job or command entries."""
    low, path = F.lower(name), F.lower(file)
    route = low.rlike(r"_(view|handler|controller|endpoint)$|^(handle|get|post|put|delete|patch)_") & path.rlike("route|view|handler|controller|endpoint|api")
    event = low.rlike("webhook|receive|subscribe|^on_") | (low.startswith("handle") & ~path.contains("test"))
    job = low.rlike("job|task|worker|cron|_run$|^(run|execute|process)$") & path.rlike("job|task|worker|cron|celery|sidekiq|background")
    command = low.rlike("command|_cmd$|^(cli|invoke)$")
    return kind.isin("function", "method") & (name.isin("main", "__main__") | route | event | job | command)


def is_flutter_widget(name: Column, kind: Column) -> Column:
    return (kind == "class") & name.rlike("(Widget|State|Page|Screen|View)$")


def is_react_component(name: Column, kind: Column, file: Column) -> Column:
    return kind.isin("function", "class") & file.endswith(".tsx") & name.rlike(r"^\p{Lu}")


def is_event_handler(name: Column, kind: Column) -> Column:
    return kind.isin("function", "method") & F.lower(name).rlike("^(on|handle)|(handler|callback|listener)$")


def is_callback_style(name: Column) -> Column:
    return F.lower(name).rlike("(fn|callback|handler)$|^on_")


def is_dependency_injection(name: Column) -> Column:
    return F.lower(name).rlike("(factory|provider|injector|container)$|singleton")


def severity(hop: Column) -> Column:
    return F.when(hop <= 1, "direct").when(hop <= 3, "transitive").otherwise("distant")


def risk_level(affected: Column) -> Column:
    return F.when(affected > 50, "critical").when(affected > 25, "high").when(affected > 10, "medium").otherwise("low")
