"""Line rules for CI workflows and container files, and signals in scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of action references and of expressions that outsiders control.
USES = r"^[ \t]*(?:-[ \t]+)?uses:[ \t]+([^\s@]+)@([^\s#]+)"
PINNED = "^(?:[0-9a-f]{40}|sha256:[0-9a-f]{64})$"
INJECTION = r"\$\{\{[^}]*github\.(?:event\.pull_request\.(?:body|title|head\.ref|head\.label|base\.ref)|event\.issue\.(?:body|title)|event\.comment\.body|event\.review\.body|head_ref|base_ref)[^}]*\}\}"
# Parts of variable names that tell of secrets.
SECRET_NAMES = ("SECRET", "PASSWORD", "PASSWD", "API_KEY", "TOKEN", "PRIVATE_KEY", "ACCESS_KEY", "AUTH_TOKEN", "CLIENT_SECRET")
# What install scripts hold when they reach for the network, a shell or the environment.
SCRIPT_SIGNALS = (
    "eval(", "new Function(", "vm.runInContext", "vm.runInNewContext", "Buffer.from(", "atob(", "btoa(", "require('http')", 'require("http")', "require('https')", 'require("https")', "require('net')", "require('dns')", "require('tls')",
    "fetch(", "axios", "got(", "request(", "superagent", "child_process", "execSync(", "spawnSync(", "exec(", "spawn(", "process.env", "curl ", "wget ",
)
BLOB_LEAST = 120


def workflow_rules(lines: DataFrame) -> DataFrame:
    """lines with rule: actions that aren't pinned to a commit, and outsiders' values in expressions."""
    action, ref = (F.regexp_extract("content", USES, i) for i in (1, 2))
    unpinned = F.when((ref != "") & ~ref.rlike(PINNED) & ~action.startswith("./"), "CI/UnpinnedAction")
    return lines.withColumn("rule", F.explode(F.array_compact(F.array(unpinned, F.when(F.col("content").rlike(INJECTION), "CI/ExpressionInjection")))))


def unpinned_image(image: Column) -> Column:
    """No tag or latest; the tag is the second part by colons."""
    tag = F.coalesce(F.get(F.split(image, ":"), F.lit(1)), F.lit(""))
    return tag.isin("", "latest")


def container_rules(lines: DataFrame, key: str = "path") -> DataFrame:
    """key, line (0: the file as a whole) and rule of container files' findings."""
    t = F.trim("content")
    up = F.upper(t)
    rows = lines.withColumn("t", t).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    after = F.trim(F.substr("t", F.lit(6)))
    words = F.split(after, r"\s+")
    image = F.when(after.startswith("--"), F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise(F.get(words, F.lit(0)))
    copied = F.get(F.split(F.trim(F.substr("t", F.lit(5))), r"\s+"), F.lit(0))
    variable = F.upper(F.get(F.split(F.trim(F.substr("t", F.lit(5))), "[= ]"), F.lit(0)))
    run = F.lower(F.substr("t", F.lit(5)))
    update, install = up.startswith("RUN ") & run.contains("apt-get update"), up.startswith("RUN ") & run.contains("apt-get install")
    # One bit of state: an update on its own, until an install has used or a joint layer has replaced it.
    event = F.when(update & ~install, "update").when(update & install, "joint").when(install, "install")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("event", event).withColumn("last_event", F.last("event", ignorenulls=True).over(before))
    tests = {
        "no-latest-image": up.startswith("FROM ") & (image != "scratch") & ~F.lower(after).contains(" as ") & (F.upper(image) != "AS") & unpinned_image(image),
        "prefer-copy-over-add": up.startswith("ADD ") & ~copied.rlike(r"^https?://|\.(?:tar\.gz|tar\.bz2|tar\.xz|tgz)$"),
        "no-root-user": up.startswith("USER ") & F.trim(F.substr("t", F.lit(6))).isin("root", "0"),
        "secret-in-env": up.startswith("ENV ") & variable.rlike("|".join(SECRET_NAMES)),
        "apt-stale-cache": (F.col("event") == "install") & (F.col("last_event") == "update"),
        "apt-no-recommends": install & ~run.contains("--no-install-recommends"),
    }
    own = rows.withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items()))))).select(key, "line", "rule")
    files = lines.groupBy(key).agg(F.max(F.upper(t).startswith("USER ")).alias("user"), F.max(F.upper(t).startswith("HEALTHCHECK")).alias("health"))
    missing = F.array_compact(F.array(F.when(~F.col("user"), "no-user-directive"), F.when(~F.col("health"), "no-healthcheck")))
    return own.unionByName(files.select(key, F.lit(0).alias("line"), F.explode(missing).alias("rule")))


def script_signals(text: Column) -> Column:
    """The needles that a script holds, in the list's order."""
    return F.filter(F.array(*map(F.lit, SCRIPT_SIGNALS)), lambda s: F.contains(text, s))


def longest_blob(text: Column) -> Column:
    """Length of the longest run of encoded characters with letters and digits that is no path; null below the least."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9+/=_-]{%d,})" % BLOB_LEAST))
    parts = lambda r: F.filter(F.split(r, "/"), lambda s: s != "")
    path = lambda r: r.startswith("/") & (F.size(parts(r)) >= 3) & F.forall(parts(r), lambda s: F.length(s) < 64)
    return F.array_max(F.transform(F.filter(runs, lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]") & ~path(r)), lambda r: F.length(r)))


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """path, container and rule of workload manifests given as variants in ``doc``."""
    get = lambda p, kind: F.try_variant_get("doc", p, kind)
    kinds = ("Deployment", "DaemonSet", "StatefulSet", "Job", "CronJob")
    rows = manifests.withColumn("kind", get("$.kind", "string")).where(F.col("kind").isin(*kinds))
    listed = F.when(F.col("kind") == "CronJob", get("$.spec.jobTemplate.spec.template.spec.containers", "array<variant>")).otherwise(get("$.spec.template.spec.containers", "array<variant>"))
    rows = rows.select("path", "kind", F.explode(listed).alias("c"))
    of = lambda p, kind="string": F.try_variant_get("c", p, kind)
    there = lambda p: of(p, "variant").isNotNull() & ~F.is_variant_null(of(p, "variant"))
    limits = F.coalesce(F.schema_of_variant(of("$.resources.limits", "variant")).startswith("OBJECT"), F.lit(False))
    serves = ~F.col("kind").isin("Job", "CronJob")
    tests = {
        "no-latest-image": unpinned_image(of("$.image")),
        "no-resource-limits": ~limits,
        "no-cpu-limit": limits & ~there("$.resources.limits.cpu"),
        "no-memory-limit": limits & ~there("$.resources.limits.memory"),
        "run-as-root": of("$.securityContext.runAsUser", "bigint") == 0,
        "no-readiness-probe": serves & ~there("$.readinessProbe"),
        "no-liveness-probe": serves & ~there("$.livenessProbe"),
    }
    return rows.select("path", F.coalesce(of("$.name"), F.lit("<unnamed>")).alias("container"), F.explode(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))).alias("rule"))
