"""Changed files to classified units, groups and a prioritised plan.

Classification is a chain of expressions over each row; only grouping shuffles,
after partial sums. Rules are literals compiled into one pattern per classifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import group_component, safe_component
from lodestrata.operators.ordered import rank

# Patterns of risky paths, risky content, generated paths and lock files, and size limits of groups.
PATH_RISK = (
    r"(^|/|[_-])(auth|authentication|permission|permissions|security|oauth|session|sessions|jwt|token|tokens|acl|rbac)(/|[_\.-]|$)",
    r"(^|/)(db|database|sql)/.*(migration|migrations|schema)",
    r"(^|/)(migration|migrations)(/|$)",
    r"(^|/)(payment|payments|billing|invoice|invoices|checkout)(/|[_\.-]|$)",
    r"(^|/)(config|configs|deploy|deployment|infra|infrastructure|terraform|k8s|kubernetes|docker|\.github/workflows)(/|$)",
    r"(^|/|[_-])(concurrency|async|retry|queue|worker|scheduler|delete|deletion|destroy|destructive)(/|[_\.-]|$)",
    r"(^|/|[_-])(crypto|cryptographic|encrypt|decrypt|hash|hashing|sha|sha256|md5|rsa|aes|tls|ssl|cert|certificate|bcrypt|argon2)(/|[_\.-]|$)",
    r"(^|/|[_-])(secret|secrets|credential|credentials|api[_-]?key|apikey|vault|keychain)(/|[_\.-]|$)",
    r"(^|/|[_-])(cors|csrf|xss|sanitize|sanitizer|escape)(/|[_\.-]|$)",
    r"(^|/|[_-])(role|roles|admin|superuser|root|sudo|policy|policies)(/|[_\.-]|$)",
    r"(^|/|[_-])(exec|eval|spawn|subprocess|shell|command|cmd)(/|[_\.-]|$)",
    r"(^|/|[_-])(upload|download|attachment|attachments|file|files)(/|[_\.-]|$)",
    r"(^|/|[_-])(env|environment|settings|configure)(/|[_\.-]|$)",
)
CONTENT_RISK = (
    r"(authorization|authenticate|authentication|permission|permissions|is_admin|oauth|jwt|session|token|secret|password|credential)",
    r"(alter\s+table|drop\s+table|delete\s+from|truncate\s+table|grant\s+|revoke\s+)",
    r"(payment|billing|invoice|checkout|refund)",
    r"(retry|timeout|queue|worker|scheduler|transaction)",
    r"(crypto\.|createcipher|hashlib\.|sha256|sha512|md5|bcrypt\.compare|argon2|aes|rsa|x509|tls|ssl)",
    r"(process\.env\.[a-z0-9_]*(secret|token|key|password)|os\.environ.*(secret|token|key|password)|api[_-]?key|secret[_-]?key|private[_-]?key)",
    r"(eval\s*\(|exec\s*\(|subprocess\.|child_process|spawn\s*\(|system\s*\()",
    r"(cors|csrf|xss|sanitize|sanitizer|escapehtml|escape_html)",
    r"(fs\.unlink|os\.remove|drop\s+database|grant\s+all|chmod\s+777|sudo\s)",
)
GENERATED = (
    r"(^|/)(__snapshots__|snapshots|generated|vendor|vendors|dist|build|coverage)(/|$)",
    r"(\.snap|\.snapshot|\.generated\.|_generated\.|\.min\.(js|css))$",
)
LOCKFILE = (
    r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|composer\.lock|go\.sum)$",
)
TARGET_BYTES, HARD_BYTES = 120_000, 160_000


def alternation(patterns: tuple[str, ...]) -> str:
    """One case-insensitive pattern that matches what any of them matches."""
    return "(?i)(?:" + "|".join(patterns) + ")"


def matches_any(value: Column | str, patterns: tuple[str, ...]) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.rlike(alternation(patterns)), F.lit(False)) if patterns else F.lit(False)


def name_status_numstat(name_status: DataFrame, numstat: DataFrame) -> DataFrame:
    """Left join on (path, old_path), null-safe; counts that are missing or not numbers (binary ``-``) are 0."""
    n = numstat.select(F.col("path").alias("n_path"), F.col("old_path").alias("n_old"), "add", "del")
    on = (name_status.path == n.n_path) & name_status.old_path.eqNullSafe(n.n_old)
    zero = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return name_status.join(n, on, "left").select("path", "old_path", "status", zero("add").alias("additions"), zero("del").alias("deletions"))


def content_risk_files(lines: DataFrame) -> DataFrame:
    """(split_id, current_file) of diffs with a risky added or removed line; ``lines`` carry their current file."""
    changed = (F.col("line").startswith("+") | F.col("line").startswith("-")) & ~F.col("line").startswith("+++") & ~F.col("line").startswith("---")
    risky = matches_any(F.expr("substring(line, 2)"), CONTENT_RISK)
    return lines.where(changed & risky).select("split_id", "current_file").distinct()


def classify(units: DataFrame, content_risk: Column, custom: tuple[str, ...] = ()) -> DataFrame:
    """First match wins: high risk, generated-like, lock file, else module; adds risk_tag, group_id, risk, reason."""
    part = safe_component(group_component("path"))
    high = matches_any("path", PATH_RISK) | matches_any("path", custom) | F.coalesce(content_risk, F.lit(False))
    chain = (
        (high, "high-risk", F.concat(F.lit("high-risk-"), part), "high", "path-or-content-risk"),
        (matches_any("path", GENERATED), "generated-like", F.concat(F.lit("consistency-"), part), "consistency", "generated-like"),
        (matches_any("path", LOCKFILE), "lockfile", F.lit("consistency-lockfiles"), "consistency", "lockfile"),
    )
    tag, group, risk, reason = F.lit("medium"), F.concat(F.lit("module-"), part), F.lit("medium"), F.lit("module")
    for test, t, g, r, why in reversed(chain):
        tag, group = F.when(test, F.lit(t)).otherwise(tag), F.when(test, g).otherwise(group)
        risk, reason = F.when(test, F.lit(r)).otherwise(risk), F.when(test, F.lit(why)).otherwise(reason)
    return units.withColumns({"risk_tag": tag, "group_id": group, "risk": risk, "reason": reason})


def budget_status(size: Column | str, target: int = TARGET_BYTES, hard: int = HARD_BYTES) -> Column:
    c = F.col(size) if isinstance(size, str) else size
    return F.when(c > hard, "split-required").when(c > target, "over-target").otherwise("ok")


def group_units(units: DataFrame, target: int = TARGET_BYTES, hard: int = HARD_BYTES) -> DataFrame:
    """Units to groups: files, bytes, risk, reason of the first unit by path, and budget status."""
    grouped = units.groupBy("repo_id", "group_id").agg(
        F.min_by("risk", "path").alias("risk"), F.min_by("reason", "path").alias("reason"),
        F.sum("diff_bytes").alias("diff_bytes"), F.count("*").alias("n_files"),
    )
    return grouped.withColumn("budget_status", budget_status("diff_bytes", target, hard))


def plan(groups: DataFrame) -> DataFrame:
    """Priority and action of each group."""
    split = F.col("budget_status") == "split-required"
    priority = F.when(split, 1).when(F.col("risk") == "high", 2).when(F.col("risk") == "consistency", 3).otherwise(4)
    return groups.withColumns({
        "priority": priority.cast("int"), "action": F.when(split, "split").otherwise("review"),
        "split_source": F.when(split, "Split Suggestions and Split Unit Diff Preview").otherwise("none"),
        "notes": F.when(split, "replace-with-split-suggestions-before-review").otherwise("review-complete-group-before-coverage-validation"),
    })


def plan_totals(planned: DataFrame) -> DataFrame:
    """Groups, files at high risk and groups to split, per repository."""
    return planned.groupBy("repo_id").agg(
        F.count("*").alias("review_groups"), F.sum(F.when(F.col("risk") == "high", F.col("n_files")).otherwise(0)).alias("high_risk_units"),
        F.count_if(F.col("action") == "split").alias("split_required_groups"),
    )


def top_churn(units: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` files with most changed lines; ties by path, descending."""
    churn = units.withColumn("churn", F.col("additions") + F.col("deletions"))
    return churn.orderBy(F.desc("churn"), F.desc("path"), F.desc("file_id")).limit(k).select("file_id", "path", "churn")


def review_queue(units: DataFrame) -> DataFrame:
    """Each unit's place per repository: high risk, then medium by churn, then generated, then lock files."""
    kind = F.when(F.col("risk_tag") == "high-risk", 0).when(F.col("risk_tag") == "medium", 1).when(F.col("risk_tag") == "generated-like", 2).otherwise(3)
    keyed = units.select("file_id", "repo_id", "risk_tag", kind.alias("kind_"), (F.col("additions") + F.col("deletions")).alias("churn_"), "path")
    return rank(keyed, ["repo_id"], ["kind_", F.desc("churn_"), "path", "file_id"], "queue_no").select("file_id", "repo_id", "risk_tag", "queue_no")


def language(path: Column | str) -> Column:
    """Language by suffix, of those whose structure is read; others are unknown."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    # Suffixes of languages.
    return (
        F.when(p.endswith(".rs"), "rust").when(p.endswith(".toml"), "toml").when(p.rlike(r"\.ya?ml$"), "yaml")
        .when(p.endswith("dockerfile") | p.contains("dockerfile."), "dockerfile").when(p.endswith(".sql"), "sql").otherwise("unknown")
    )


def skip_reason(path: Column | str) -> Column:
    """The limitation code of a path left out of extraction as vendored, minified or generated; null if it is not."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    minified = p.rlike(r"\.min\.(js|css)$")
    skipped = p.rlike(r"(^|/)(vendor|generated|dist)/") | minified
    code = F.when(p.contains("vendor"), "vendored-structure-skipped").when(minified, "minified-structure-skipped").otherwise("generated-like-structure-skipped")
    return F.when(skipped, code)


def split_suggestions(units: DataFrame, groups: DataFrame, hunks: DataFrame) -> DataFrame:
    """For groups to be split: one row per hunk of their files, or one for the file where it has none."""
    wanted = groups.where("budget_status = 'split-required'").select("repo_id", "group_id")
    files = units.join(wanted, ["repo_id", "group_id"]).select("file_id", "repo_id", "group_id", "path")
    parts = hunks.select(F.col("split_id").alias("file_id"), "hunk_no", "hunk_header", "hunk_bytes")
    out = files.join(parts, "file_id", "left")
    unit = F.when(F.col("hunk_no").isNull(), F.concat(F.lit("file:"), F.col("path"))).otherwise(F.concat_ws(":", F.lit("hunk"), "path", F.col("hunk_no").cast("string")))
    return out.select(
        "file_id", "repo_id", F.col("group_id").alias("parent_group_id"), unit.alias("unit_id"),
        F.when(F.col("hunk_no").isNull(), "file").otherwise("hunk").alias("split_kind"), F.coalesce("hunk_header", F.lit("none")).alias("hunk_header"),
        F.coalesce("hunk_bytes", F.lit(0)).alias("hunk_bytes"),
    )


def dependency_lines(lines: DataFrame) -> DataFrame:
    """Added lines that import, export, declare or define schema, with their kind."""
    body = F.expr("substring(line, 2)")
    kind = (
        F.when(body.rlike(r"^\s*(import|from|use|require|include)\b"), "import")
        .when(body.rlike(r"^\s*(export|pub)\b"), "export")
        .when(body.rlike(r"^\s*(async\s+)?(fn|def|function|class|struct|interface)\b"), "signature")
        .when(body.rlike(r"(?i)^\s*(create|alter|drop)\s+(table|index|view)\b"), "schema")
    )
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    return lines.where(plus).select("split_id", "line_no", kind.alias("kind")).where("kind is not null")
