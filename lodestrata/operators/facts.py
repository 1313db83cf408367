"""Positioned facts from text: rule matches, configuration keys, markers and test hints.

Rules are data: lists compiled into column expressions when the plan is built.
Every operator is a scan with an explode at most; only caps per rule need a
window, within one text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import bounded_text, column_of, contains_any, line_of

# Patterns of configuration keys by suffix, and markers by kind.
KEY_PATTERNS = {
    "toml-key": r"(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*=[ \t]*([^\r\n]*)",
    "yaml-key": r"(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*:[ \t]*([^\r\n]*)",
    "docker-instruction": r"(?mi)^[ \t]*(FROM|ENV|ARG|RUN|EXPOSE|HEALTHCHECK|ENTRYPOINT|CMD)\b([^\r\n]*)",
    "sql-statement": r"(?mi)\b(CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE)\b[^;\r\n]*",
}
MARKERS = {
    "framework": ("spring", "tokio", "actix", "react", "django", "fastapi"),
    "test-marker": ("#[test]", "@test", "describe(", "test(", "pytest"),
    "endpoint": ("/api/", "endpoint", "route", "http://", "https://"),
    "authorization": ("authorization", "permission", "bearer", "jwt", "token", "role"),
    "storage": ("postgres", "mysql", "sqlite", "database", "repository", "s3"),
    "network": ("http://", "https://", "grpc", "socket", "network"),
    "cache": ("cache", "redis", "memcached"),
    "broker": ("kafka", "rabbitmq", "broker", "queue"),
    "search": ("elasticsearch", "opensearch", "search"),
    "lifecycle": ("startup", "shutdown", "healthcheck", "migration", "cleanup"),
}
SUMMARY_OF_KIND = {
    "configured-query": "text-query-match", "test-hint": "test-selection", "framework": "framework-effect", "configuration": "configuration-effect",
    "authorization": "authorization-effect", "storage": "storage-effect", "cache": "storage-effect", "search": "storage-effect",
    "network": "network-effect", "broker": "network-effect", "endpoint": "network-effect", "lifecycle": "lifecycle-effect",
}
# What makes a path a test's, and the ordered classes of tests: rule, confidence, kind, environment.
TEST_STARTS = ("test/", "tests/", "e2e/", "cypress/", "playwright/", "src/test/", "test_")
TEST_PARTS = ("/test/", "/tests/", "/e2e/", "/cypress/", "/playwright/", "/__tests__/", "/src/test/", "/src/it/", "/src/integrationtest/", "/src/integration-test/", "/test_")
TEST_ENDS = (
    "test.java", "tests.java", "it.java", "itcase.java", "integrationtest.java", "spec.java", "test.kt", "tests.kt", "it.kt", "itcase.kt", "integrationtest.kt", "spec.kt",
    "test.groovy", "spec.groovy", "it.groovy", "integrationtest.groovy", "test.scala", "spec.scala", "it.scala", "integrationtest.scala",
    "test.ts", "spec.ts", "e2e.ts", "cy.ts", "test.tsx", "spec.tsx", "e2e.tsx", "cy.tsx", "test.js", "spec.js", "e2e.js", "cy.js", "test.jsx", "spec.jsx", "e2e.jsx", "cy.jsx", "_test.go", "_test.py", ".spec.py",
)
JVM_PARTS = ("/src/it/", "/src/integrationtest/", "/src/integration-test/")
JVM_ENDS = (
    "it.java", "itcase.java", "integrationtest.java", "it.kt", "itcase.kt", "integrationtest.kt", "it.groovy", "integrationtest.groovy", "it.scala", "integrationtest.scala",
)
CONTENT_CLASSES = (
    ("testcontainers", ("org.testcontainers", "@testcontainers", "@container", "testcontainers-go")),
    ("docker-compose-test", ("dockercomposecontainer", "docker-compose", "docker compose", "compose.yml", "compose.yaml")),
    ("wiremock-test", ("wiremockserver", "wiremockextension", "@autoconfigurewiremock", "com.github.tomakehurst.wiremock", "wiremock.org")),
    ("mockserver-test", ("org.mockserver", "mockservercontainer", "clientandserver")),
    ("spring-cloud-contract", ("@autoconfigurestubrunner", "stubrunner", "spring-cloud-contract", "org.springframework.cloud.contract")),
    ("external-service-config", (
        "jdbc:", "r2dbc:", "spring.datasource.url", "datasource.url", "postgresql", "mysql", "mariadb", "oracle.jdbc", "mongodb://", "redis://", "spring.redis", "spring.data.redis",
        "kafka.bootstrap", "bootstrap.servers", "spring.kafka", "elasticsearch", "opensearch", "rabbitmq", "amqp://", "localstack", "minio",
    )),
    ("quarkus-test-context", ("@quarkustest", "@quarkusintegrationtest", "io.quarkus.test")),
    ("micronaut-test-context", ("@micronauttest", "io.micronaut.test")),
    ("spring-boot-context", ("@SpringBootTest",)),
    ("spring-data-slice", ("@DataJpaTest", "@JdbcTest", "@JooqTest", "@MybatisTest")),
    ("spring-web-slice", ("@WebMvcTest", "@AutoConfigureMockMvc")),
    ("jvm-test-profile", ("@activeprofiles", "spring_profiles_active", "quarkus.test.profile", "micronaut.environments")),
    ("jvm-integration-tag", ('@tag("integration")', '@tag("e2e")', '@tag("contract")', '@tag("slow")', "@category(integrationtest", "@category(e2etest")),
    ("jvm-integration-naming", ()),
    ("pytest-env-marker", (
        "pytest.mark.integration", "pytest.mark.e2e", "pytest.mark.contract", "pytest.mark.system", "pytest.mark.django_db", "pytest.mark.db", "pytest.mark.redis", "pytest.mark.kafka",
        "pytest.mark.elasticsearch",
    )),
    ("playwright-e2e", ("@playwright/test", "playwright/test")),
    ("cypress-e2e", ("cy.visit(", "cypress.")),
    ("node-e2e-or-integration", ("vitest", "jest", "describe(", "test(")),
    ("go-integration-build-tag", ("//go:build integration", "//go:build e2e", "//go:build docker", "// +build integration", "// +build e2e", "// +build docker")),
    ("go-integration-naming", ()),
    ("rust-ignored-test", ("#[ignore]",)),
    ("rust-integration-path", ()),
)


def path_pattern(starts: tuple[str, ...], parts: tuple[str, ...], ends: tuple[str, ...]) -> str:
    """One pattern for paths that start with, hold or end with any of the texts."""
    groups = [f"^({'|'.join(map(re.escape, starts))})"] * bool(starts) + [f"({'|'.join(map(re.escape, parts))})"] * bool(parts) + [f"({'|'.join(map(re.escape, ends))})$"] * bool(ends)
    return "|".join(groups)


TEST_PATH = path_pattern(TEST_STARTS, TEST_PARTS, TEST_ENDS)
EXACT_CASE = frozenset(("spring-boot-context", "spring-data-slice", "spring-web-slice"))
PATH_OF_CLASS = {
    "jvm-integration-naming": path_pattern((), JVM_PARTS, JVM_ENDS), "playwright-e2e": r"\.pw\.(ts|js)$", "cypress-e2e": r"/cypress/|\.cy\.(ts|tsx|js|jsx)$",
    "node-e2e-or-integration": r"/e2e/|\.e2e\.|/integration/", "go-integration-naming": r"(integration|/e2e/).*_test\.go$", "rust-integration-path": r"(^tests/|/tests/|/integration/).*\.rs$",
}
NO_CLASS = "no-known-env-heavy-marker"


def is_test_path(path: Column | str) -> Column:
    return F.lower(F.col(path) if isinstance(path, str) else path).rlike(TEST_PATH)


def test_class(path: Column | str, content: Column | str) -> Column:
    """The first class of test whose path or content it shows; needs both for node tests."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    c = F.col(content) if isinstance(content, str) else content
    low, out = F.lower(c), None
    for name, needles in CONTENT_CLASSES:
        by_content = contains_any(c if name in EXACT_CASE else low, needles)
        by_path = p.rlike(PATH_OF_CLASS[name]) if name in PATH_OF_CLASS else F.lit(False)
        test = by_content & by_path if name == "node-e2e-or-integration" else by_content | by_path
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(NO_CLASS)


def key_rule(path: Column | str) -> Column:
    """Which pattern of keys a path calls for; null for none."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return (
        F.when(p.endswith(".toml"), "toml-key").when(p.endswith(".yaml") | p.endswith(".yml"), "yaml-key")
        .when(p.endswith("dockerfile") | p.contains("dockerfile."), "docker-instruction").when(p.endswith(".sql"), "sql-statement")
    )


def key_values(files: DataFrame) -> DataFrame:
    """(file_id, ordinal, rule_id, match_text) of each configuration key or statement in (file_id, path, text)."""
    rule = key_rule("path")
    keys = F.lit(None).cast("array<string>")
    whole = keys
    for name, pattern in KEY_PATTERNS.items():
        keys = F.when(rule == name, F.regexp_extract_all("text", F.lit(pattern), 1)).otherwise(keys)
        whole = F.when(rule == name, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(whole)
    found = files.where(rule.isNotNull()).select("file_id", rule.alias("rule"), F.posexplode(F.arrays_zip(keys.alias("k"), whole.alias("w"))).alias("ordinal", "m"))
    return found.select("file_id", (F.col("ordinal") + 1).alias("ordinal"), F.concat_ws(":", "rule", F.lower("m.k")).alias("rule_id"), bounded_text("m.w").alias("match_text"))


def earliest_markers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, marker, line, column) of the first marker of each kind; of markers at one place the first listed."""
    texts, low = texts.withColumn("__low", F.lower(text_col)), F.col("__low")  # lower case once, not per marker
    rows = []
    for kind, needles in MARKERS.items():
        places = [F.struct(F.nullif(F.instr(low, n), F.lit(0)).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("marker")) for i, n in enumerate(needles)]
        best = F.array_min(F.filter(F.array(*places), lambda s: s["at"].isNotNull()))
        rows.append(F.struct(F.lit(kind).alias("kind"), best.alias("m")))
    each = texts.select(id_col, text_col, F.explode(F.filter(F.array(*rows), lambda r: r["m"].isNotNull())).alias("r"))
    at = F.col("r.m.at")
    return each.select(id_col, "r.kind", "r.m.marker", line_of(text_col, at).alias("line"), column_of(text_col, at).alias("column"))


def line_matches(texts: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str]], cap: int = 20) -> DataFrame:
    """(id, rule_id, line, match_text, overflow): lines with a match of each rule, the first ``cap`` per text and rule."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line_text"))
    hits = F.array_compact(F.array(*[F.when(F.col("line_text").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.regexp_extract("line_text", p, 0).alias("m"))) for r, p in rules]))
    found = lines.select(id_col, (F.col("at") + 1).alias("line"), F.explode(hits).alias("h")).select(id_col, "h.rule_id", "line", bounded_text("h.m").alias("match_text"))
    group = Window.partitionBy(id_col, "rule_id")
    ranked = found.withColumns({"n": F.row_number().over(group.orderBy("line")), "all": F.count("*").over(group)})
    return ranked.where(F.col("n") <= cap).select(id_col, "rule_id", "line", "match_text", (F.col("all") > cap).alias("overflow"))


def first_hints(files: DataFrame, id_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, rule_id): the first rule, in order, whose path pattern or content pattern matches (empty patterns never do)."""
    out = F.lit(None).cast("string")
    for name, path, content in reversed(rules):
        test = (F.col("path").rlike(path) if path else F.lit(False)) | (F.col("text").rlike(content) if content else F.lit(False))
        out = F.when(test, name).otherwise(out)
    return files.select(id_col, out.alias("rule_id")).where("rule_id is not null")


def grep(texts: DataFrame, id_col: str, text_col: str, queries: list[tuple[str, str]], limit: int) -> DataFrame:
    """(query_id, id, n): the ``limit`` texts with most matching lines per query; a query without any gives one row of nulls."""
    lines = texts.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    counts = lines.groupBy(id_col).agg(*[F.count_if(F.col("line").rlike(p)).alias(q) for q, p in queries])
    long = counts.select(id_col, F.explode(F.array(*[F.struct(F.lit(q).alias("query_id"), F.col(q).alias("n")) for q, _ in queries])).alias("x")).select("x.query_id", id_col, "x.n")
    best = long.where("n > 0").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), id_col))).where(F.col("k") <= limit).drop("k")
    asked = texts.sparkSession.createDataFrame([(q,) for q, _ in queries], "query_id string")
    return asked.join(best, "query_id", "left").select("query_id", id_col, "n")


def summary_kind(kind: Column | str) -> Column:
    """The kind of summary a fact's kind leads to; null for those that lead to none."""
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SUMMARY_OF_KIND.items() for x in pair]), c)
