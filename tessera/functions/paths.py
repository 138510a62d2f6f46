"""Predicates and classes of file paths and code symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of edges by use, and their weights.
CALLS = ["CALLS", "CALL_REFERENCE"]
DEPENDENCY = ["CALLS", "CALL_REFERENCE", "IMPORTS", "USES_TYPE", "WRITES", "INHERITS", "IMPLEMENTS", "ROUTE"]
USAGE = [*DEPENDENCY, "TESTS"]
BLAST = [*USAGE, "DEFINES"]
IMPACT = ["CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS"]
HOTSPOT_WEIGHT = {"CALL_REFERENCE": 6, "CALLS": 4, "IMPORTS": 3, "USES_TYPE": 4, "WRITES": 5, "ROUTE": 4, "TESTS": 1, "INHERITS": 5, "IMPLEMENTS": 5, "DEFINES": 0.25}
CLUSTER_WEIGHT = {"CALL_REFERENCE": 7, "CALLS": 3, "IMPORTS": 4, "USES_TYPE": 4, "WRITES": 5, "INHERITS": 7, "IMPLEMENTS": 7, "ROUTE": 4, "TESTS": 1}
BLAST_WEIGHT = {"CALLS": 4, "CALL_REFERENCE": 6, "USES_TYPE": 4, "TESTS": 2, "ROUTE": 4, "WRITES": 3, "IMPORTS": 3, "INHERITS": 5, "IMPLEMENTS": 5, "DEFINES": 1}
SENSITIVE_NAMES = [".env", ".env.local", ".env.production", "credentials.json", "id_rsa", "id_ed25519", ".npmrc", ".pypirc", "secrets.json"]
SENSITIVE_ENDS = [".pem", ".key", ".p12", ".pfx"]
SOURCE_ENDS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
IGNORED_DIRS = ["node_modules", ".git", "dist", "build", "coverage", ".next", "out", "vendor"]


def is_test(path: Column) -> Column:
    return path.startswith("tests/") | F.contains(path, F.lit("/tests/")) | F.contains(path, F.lit("__tests__")) | path.rlike(r"\.(test|spec)\.[^.]+$")


def is_public(path: Column) -> Column:
    return path.rlike(r"(^|/)bin/") | path.rlike(r"(^|/)(index|main|server|cli)\.[^./]+$")


def is_sensitive(path: Column) -> Column:
    base = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    out = base.isin(SENSITIVE_NAMES)
    for end in SENSITIVE_ENDS:
        out = out | base.endswith(end)
    return out


def is_source(path: Column) -> Column:
    out = F.lit(False)
    for end in SOURCE_ENDS:
        out = out | path.endswith(end)
    for d in IGNORED_DIRS:
        out = out & ~F.contains(F.concat(F.lit("/"), path), F.lit(f"/{d}/"))
    return out & ~is_sensitive(path)


def contains_path(root: Column, path: Column) -> Column:
    """Equal, above or below."""
    return (root == path) | path.startswith(F.concat(root, F.lit("/"))) | root.startswith(F.concat(path, F.lit("/")))


def layer(path: Column) -> dict[str, Column]:
    """``layer`` and ``confidence`` by path."""
    # Where the code of each layer lies.
    tests = is_test(path)
    interface = path.startswith("bin/") | path.rlike(r"/(mcp|cli|api|routes|hooks)/")
    application = path.rlike(r"/(runtime|processor|retrieval|snapshot|code-intelligence)/")
    domain = path.rlike(r"/(core|memory)/|(^|/)types\.[^/]+$")
    infrastructure = path.rlike(r"/(storage|production|security|config|utils)/")
    name = F.when(tests, "tests").when(interface, "interface").when(application, "application").when(domain, "domain").when(infrastructure, "infrastructure").otherwise("unknown")
    confidence = F.when(tests, 1.0).when(interface, 0.9).when(application, 0.85).when(domain, 0.9).when(infrastructure, 0.85).otherwise(0.35)
    return {"layer": name, "confidence": confidence}


def subsystem(path: Column) -> Column:
    """``src/x``, ``packages/x``, else the first folder (``root`` if there is none)."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    return F.when(first.isin("src", "packages") & (F.size(parts) > 1), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.coalesce(first, F.lit("root")))


# Names of subsystems for display.
CLUSTER_LABELS = {
    "code-intelligence": "Code Intelligence", "memory": "Memory", "storage": "Storage", "retrieval": "Retrieval", "runtime": "Runtime", "mcp": "MCP", "hooks": "Hooks", "security": "Security", "snapshot": "Snapshots", "production": "Production", "capture": "Capture",
    "processor": "Processor", "core": "Core", "tests": "Tests", "bin": "CLI", "sdk": "SDK", "cli": "CLI",
}


def cluster_label(subsystem_: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(subsystem_, "^src/", ""), "^packages/", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLUSTER_LABELS.items() for x in kv]), plain), plain)


def _first_reason(rules: list[tuple[Column, str]]) -> Column:
    out = None
    for test, reason in rules:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def dangerous_path(path: Column) -> Column:
    """Why a path must not be written to, null if it may."""
    low = F.lower(path)
    has = lambda w: F.contains(low, F.lit(w))
    return _first_reason([
        (low.startswith("/etc/"), "system configuration"), (low.startswith("/usr/"), "system binaries"), (low.startswith("/var/www/") | has("/public_html/"), "production web"), (has("production") | has("prod/"), "production path"),
        (low.endswith(".env") | has(".env."), "environment file"), (has("secret") | has("credential"), "sensitive file"),
    ])


def dangerous_command(command: Column) -> Column:
    """Why a command is dangerous, null if it isn't. Letters are compared in lower case, so a rule with a capital (chown -R) never holds."""
    low = F.lower(command)
    has = lambda *ws: low.rlike("|".join(ws))
    return _first_reason([
        (has("rm -rf /"), "root deletion"), (has("rm -rf ~"), "home deletion"), (has("chmod 777", "chmod -r 777"), "open permissions"), (has("drop database", "drop table", "truncate table"), "loss of data"), (has("systemctl stop", "service stop"), "stop of a service"),
    ])
