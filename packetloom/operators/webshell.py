"""Operations sent through a web shell, and commands hidden in expression-language field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import bounded_preview, stable_id
from packetloom.operators.decode import recognized

DETECTOR = "static-webshell-activity"
# Patterns of the wrapper and of the operations behind it.
WRAPPER = "(?is)\\beval\\b.{0,24}?base64_decode\\s*\\(\\s*\\$_POST\\s*\\[\\s*['\"]?([A-Za-z_][A-Za-z0-9_-]*)"
BASE64_POST = "(?is)base64_decode\\s*\\(\\s*\\$_POST\\s*\\[\\s*['\"]?([A-Za-z_][A-Za-z0-9_-]*)"
POST_FIELD = "(?is)\\$_POST\\s*\\[\\s*['\"]?([A-Za-z_][A-Za-z0-9_-]*)"
COMMAND = "(?is)(?:^|[^A-Za-z0-9_])(?:system|exec|passthru|shell_exec|popen|proc_open)\\s*\\("
DATABASE = "(?is)(?:mysqli?_(?:query|connect)|pg_query|sqlite_query|new\\s+PDO\\b)"


def _has(text: Column, *words: str) -> Column:
    condition = F.lit(True)
    for word in words:
        condition = condition & F.contains(F.lower(text), F.lit(word))
    return condition


def _matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _calls(text: Column, name: str) -> Column:
    return _matches(text, f"(?is)(?:^|[^A-Za-z0-9_]){name}\\s*\\(")


def operation(action: Column) -> Column:
    """``struct<kind, confidence, needs_target>`` by the first rule that fits."""
    # Kinds in order of precedence with confidence and whether a target is required.
    rules = [
        (_has(action, "php_uname") & (_has(action, "get_current_user") | _has(action, "posix_geteuid")), "system-information", 0.96, False),
        (_has(action, "opendir(", "readdir("), "directory-listing", 0.97, True),
        (_has(action, "fwrite(") & _matches(action, "(?is)fopen\\s*\\([^,]+,\\s*['\"]w"), "file-write", 0.98, True),
        (_has(action, "fread(", "filesize("), "file-read", 0.98, True),
        (_calls(action, "unlink"), "file-delete", 0.96, True),
        (_calls(action, "rename"), "file-rename", 0.96, True),
        (_calls(action, "mkdir"), "directory-create", 0.95, True),
        (_matches(action, DATABASE), "database-action", 0.92, False),
        (_matches(action, COMMAND), "command-execution", 0.94, True),
    ]

    def result(kind: str, confidence: float, needs: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(needs).alias("needs_target"))

    ladder = F.when(action.isNull(), result("unknown-operation", 0.55, False))
    for condition, kind, confidence, needs in rules:
        ladder = ladder.when(condition, result(kind, confidence, needs))
    return ladder.otherwise(result("unknown-operation", 0.55, False))


def _normal_parts(path: Column, separator: str) -> Column:
    """Path parts with ``.`` dropped and ``..`` undoing the part before."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        F.split(path, separator), empty,
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )


def normalize_target(value: Column) -> Column:
    """Drive paths with backslashes and an upper-case drive, rooted paths without dots, other text with
    single blanks."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, "\\x00", ""), "^\\s+|\\s+$", ""))
    slashed = F.replace(text, F.lit("\\"), F.lit("/"))
    rest = F.array_join(_normal_parts(F.substring(slashed, F.lit(4), F.length(slashed)), "/"), "\\")
    drive = F.concat(F.upper(F.substring(text, 1, 1)), F.lit(":\\"), rest)
    double = F.startswith(text, F.lit("//")) & ~F.startswith(text, F.lit("///"))
    rooted = F.concat(F.when(double, "//").otherwise("/"), F.array_join(_normal_parts(text, "/"), "/"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "(unresolved)")
        .when(F.rlike(text, F.lit("^[A-Za-z]:[\\\\/]")), drive)
        .when(F.startswith(text, F.lit("/")), rooted)
        .otherwise(F.regexp_replace(text, "\\s+", " "))
    )


def decode_fields(fields: DataFrame) -> DataFrame:
    """Form fields with their recognised encoding; only base64 text counts as an action or a target."""
    d = recognized(F.col("value"))
    return fields.withColumn("__d", d).select(
        *fields.columns,
        F.col("__d.transform").alias("transform"),
        F.when(F.col("__d.transform") == "base64", F.try_validate_utf8(F.col("__d.output").cast("string"))).alias("base64_text"),
        F.sha2("__d.output", 256).alias("output_hash"),
    )


TX = ["capture_id", "tx_id"]


def webshell_events(fields: DataFrame, preview_bytes: int = 256) -> DataFrame:
    """One event per request whose fields hold an eval wrapper.

    The wrapper names the action field, the action names target and payload fields; each name is looked up
    with an equi-join on (request, lower-cased name).  When a name occurs twice the later field counts.
    """
    decoded = decode_fields(fields)
    wrappers = (
        decoded.withColumn("action_name", F.lower(F.regexp_extract("value", WRAPPER, 1)))
        .where("action_name <> ''")
        .groupBy(*TX, "request_frame", "response_frame", "method", "uri")
        .agg(F.min_by("action_name", "ordinal").alias("action_name"), F.min("ordinal").alias("wrapper_ordinal"))
    )
    named = decoded.groupBy(*TX, F.lower("name").alias("field_name")).agg(
        F.max_by(F.struct("ordinal", "transform", "base64_text", "output_hash"), "ordinal").alias("f")
    )
    action = named.select(
        *TX, F.col("field_name").alias("action_name"), F.col("f.base64_text").alias("action"), F.col("f.output_hash").alias("__action_hash")
    )
    with_action = wrappers.join(action, [*TX, "action_name"], "left")
    lower_all = F.transform(F.regexp_extract_all("action", F.lit(BASE64_POST), F.lit(1)), F.lower)
    target_name = F.get(F.filter(lower_all, lambda n: n != F.col("action_name")), F.lit(0))
    posts = F.transform(F.regexp_extract_all("action", F.lit(POST_FIELD), F.lit(1)), F.lower)
    staged = with_action.withColumn("op", operation(F.col("action"))).withColumn("target_name", target_name)
    other = F.filter(posts, lambda n: (n != F.col("action_name")) & ~n.eqNullSafe(F.col("target_name")))
    staged = staged.withColumn("payload_name", F.when(F.col("op.kind") == "file-write", F.get(other, F.lit(0))))
    targets = named.select(*TX, F.col("field_name").alias("target_name"), F.col("f.base64_text").alias("target_text"))
    payloads = named.select(*TX, F.col("field_name").alias("payload_name"), F.col("f.ordinal").alias("payload_ordinal"))
    joined = staged.join(targets, [*TX, "target_name"], "left").join(payloads, [*TX, "payload_name"], "left")
    fallback = F.when(F.col("op.kind") == "system-information", "server-environment").otherwise(
        F.coalesce(F.nullif(F.col("uri"), F.lit("")), F.lit("(unresolved)"))
    )
    target = F.when(F.col("target_text").isNotNull(), normalize_target(F.col("target_text"))).otherwise(fallback)
    partial = F.col("action").isNull() | (F.col("op.needs_target") & F.col("target_name").isNull())
    digest = F.when(F.col("action").isNotNull(), F.sha2(F.encode("action", "UTF-8"), 256)).otherwise(F.sha2(F.lit("").cast("binary"), 256))
    return joined.select(
        *TX,
        stable_id("behavior-event", F.lit(DETECTOR), F.col("tx_id")).alias("event_id"),
        F.lit(DETECTOR).alias("detector"),
        F.col("op.kind").alias("event_kind"),
        F.when(partial, "partial").otherwise("complete").alias("status"),
        "request_frame", "response_frame",
        F.concat_ws(" ", F.upper("method"), "uri").alias("endpoint"),
        target.alias("target"),
        "payload_ordinal",
        F.when(partial, F.least(F.col("op.confidence"), F.lit(0.70))).otherwise(F.col("op.confidence")).alias("confidence"),
        bounded_preview(F.coalesce("action", F.lit("")), preview_bytes).alias("preview"),
        stable_id("webshell-semantic", F.col("op.kind"), F.lower(target), digest).alias("semantic_key"),
    )


def endpoint_findings(events: DataFrame, detector: str, severity: str | None = None) -> DataFrame:
    """One finding per endpoint over its events."""
    rows = events.groupBy("capture_id", "endpoint").agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("events"), F.min("request_frame").alias("first_frame")
    )
    level = F.lit(severity) if severity else F.when(F.col("confidence") >= 0.8, "high").otherwise("medium")
    return rows.select(
        "*", F.lit(detector).alias("detector"), stable_id("finding", F.lit(detector), F.col("endpoint")).alias("finding_id"), level.alias("severity")
    )


EXPRESSION_DETECTOR = "struts-ognl-command-injection"
# Markers that an expression reaches the request context and runs a command.
CONTEXT_MARKERS = ["#context", "#request", "#req", "com.opensymphony", "ognl", "struts"]
EXECUTION_MARKERS = ["processbuilder", "java.lang.runtime", "getruntime(", ".exec("]
EXPRESSION_COMMAND = (
    "(?is)(?:ProcessBuilder|(?:Runtime|getRuntime)\\s*\\(\\s*\\)\\s*\\.exec)[^'\"]{0,96}['\"]([^'\"]{1,512})['\"]"
)


def expression_markers(name: Column) -> Column:
    """Markers of a field name; empty unless it is an expression with context and execution markers."""
    lowered = F.lower(name)

    def present(markers: list[str]) -> Column:
        return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(lowered, m))

    context, execution = present(CONTEXT_MARKERS), present(EXECUTION_MARKERS)
    opened = F.contains(name, F.lit("$" + "{")) | F.contains(name, F.lit("%{"))
    both = opened & (F.size(context) > 0) & (F.size(execution) > 0)
    return F.when(both, F.concat(F.array(F.lit("ognl-expression")), context, execution)).otherwise(
        F.array().cast("array<string>")
    )


def expression_events(fields: DataFrame, preview_bytes: int = 256) -> DataFrame:
    """One event per form field whose name runs a command; complete when the request has a response."""
    marked = fields.withColumn("markers", expression_markers(F.col("name"))).where("size(markers) > 0")
    found = F.nullif(F.trim(F.regexp_extract("name", EXPRESSION_COMMAND, 1)), F.lit(""))
    command = F.coalesce(found, F.lit("(command requires payload review)"))
    endpoint = F.concat_ws(" ", F.upper("method"), "uri")
    complete = F.col("response_frame").isNotNull()
    return marked.select(
        *TX,
        stable_id("behavior-event", F.lit(EXPRESSION_DETECTOR), F.col("tx_id"), F.col("ordinal")).alias("event_id"),
        F.lit(EXPRESSION_DETECTOR).alias("detector"),
        F.lit("web-command-execution").alias("event_kind"),
        F.when(complete, "complete").otherwise("partial").alias("status"),
        "request_frame", "response_frame", "ordinal", endpoint.alias("endpoint"), command.alias("target"), "markers",
        F.when(complete, 0.99).otherwise(0.80).alias("confidence"),
        bounded_preview(F.col("name"), preview_bytes).alias("preview"),
        stable_id("ognl-command-semantic", endpoint, F.lower(command)).alias("semantic_key"),
    )
