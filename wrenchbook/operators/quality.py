"""Quality inspection: rules, model findings, grounding, verdicts and results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchbook import schemas
from wrenchbook.functions.scalars import json_keys_at_any_depth, literal_map, micros_between
from wrenchbook.functions.text import content_hash, is_blank, strip, utf8_prefix, uuid5

# Output limits and code forms.
RULE_CODE = r"^[A-Z][A-Z0-9_]{2,127}$"
UUID_TEXT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
BARE_UUID = "^[0-9a-fA-F]{32}$"
MAX_FINDINGS = 20
MAX_FINDING_TEXT = 4000
RAW_RESPONSE_BYTES = 8 * 1024
OUTPUT_INVALID = "QUALITY_OUTPUT_INVALID"
JOB_NAMESPACE = "7b7c22c6-7930-5c01-89ed-7c347a1ddff5"
FINDING_NAMESPACE = "7b7c22c6-7930-5c01-89ed-7c347a1ddff6"

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _iso(moment: Column) -> Column:
    """ISO-8601 text in UTC, with microseconds only where there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(moment, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def _finding(rule: str, passed: Column, evidence: Column) -> Column:
    severity, good, bad = schemas.RULE_TEXTS[rule]
    return F.struct(
        F.lit(rule).alias("rule_code"),
        F.lit(severity).alias("severity"),
        F.when(passed, "PASS").otherwise("FAIL").alias("label"),
        F.to_json(evidence, _KEEP_NULLS).alias("evidence"),
        F.when(passed, good).otherwise(bad).alias("recommendation"),
        F.lit(1.0).alias("confidence"),
        F.lit("RULE").alias("source"),
    )


def rule_summary(summary: Column) -> Column:
    text = strip(F.coalesce(summary, F.lit("")))
    present = F.length(text) > 0
    return _finding(
        "REQUIRED_COMPLETION_SUMMARY", present, F.struct(present.alias("present"), F.length(text).alias("length"))
    )


def rule_range(created: Column, completed: Column) -> Column:
    passed = F.coalesce(completed >= created, F.lit(False))
    return _finding(
        "COMPLETED_AT_RANGE",
        passed,
        F.struct(
            _iso(created).alias("created_at"),
            _iso(completed).alias("completed_at"),
            passed.alias("completed_not_before_created"),
        ),
    )


def rule_sla(completed: Column, due: Column) -> Column:
    """Meeting the due time exactly passes; a missing time fails without a duration."""
    overdue = F.greatest(micros_between(due, completed), F.lit(0)) / F.lit(1e6)
    return _finding(
        "SLA_COMPLETION",
        F.coalesce(completed <= due, F.lit(False)),
        F.struct(
            _iso(completed).alias("completed_at"),
            _iso(due).alias("due_at"),
            F.when(completed.isNotNull() & due.isNotNull(), overdue).alias("overdue_seconds"),
        ),
    )


def rule_attachment(attachment_count: Column, present_count: Column) -> Column:
    total, present = F.coalesce(attachment_count, F.lit(0)), F.coalesce(present_count, F.lit(0))
    return _finding(
        "REQUIRED_ATTACHMENT", present > 0, F.struct(total.alias("attachment_count"), present.alias("present_count"))
    )


def counts_of(attachments: Column) -> tuple[Column, Column]:
    """Total and present attachments of an array column; a missing list is empty."""
    size = F.when(attachments.isNull(), 0).otherwise(F.size(attachments))
    present = F.when(attachments.isNull(), 0).otherwise(F.size(F.filter(attachments, lambda a: a["present"])))
    return size, present


def with_attachment_counts(jobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Counts from an attachment table, so that no job's list is gathered."""
    counts = attachments.groupBy("job_id").agg(
        F.count("*").alias("attachment_count"), F.count_if("present").alias("present_count")
    )
    zero = F.lit(0).cast("long")
    return (
        jobs.join(counts, "job_id", "left")
        .withColumn("attachment_count", F.coalesce("attachment_count", zero))
        .withColumn("present_count", F.coalesce("present_count", zero))
    )


def _rules() -> tuple[Column, ...]:
    return (
        rule_summary(F.col("completion_summary")),
        rule_range(F.col("created_at"), F.col("completed_at")),
        rule_sla(F.col("completed_at"), F.col("due_at")),
        rule_attachment(F.col("attachment_count"), F.col("present_count")),
    )


def any_rule_fails() -> Column:
    """Whether a job fails a rule, from its own row."""
    failed = F.lit(False)
    for rule in _rules():
        failed = failed | (rule["label"] == "FAIL")
    return failed


def evaluate_rules(inputs: DataFrame) -> DataFrame:
    """Four findings per job in fixed order, from columns of the job row alone."""
    return inputs.select("job_id", F.posexplode(F.array(*_rules())).alias("ordinal", "_f")).select(
        "job_id", "ordinal", "_f.*", F.lit(None).cast("string").alias("policy_chunk_id")
    )


def _hyphenated(text: Column) -> Column:
    """A UUID of 32 bare digits in its usual form; any other text as it is."""
    groups = F.regexp_replace(F.lower(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(text.rlike(BARE_UUID), groups).otherwise(text)


def policy_chunk_uuid(chunk_id: Column) -> Column:
    """A chunk id that is no UUID, with hyphens or without, gets a name-based one."""
    plain = _hyphenated(chunk_id)
    return F.when(plain.rlike(UUID_TEXT), F.lower(plain)).otherwise(uuid5(schemas.POLICY_CHUNK_NAMESPACE, chunk_id))


def policy_rule_code(chunk_id: Column) -> Column:
    return F.concat(F.lit("POLICY_"), F.upper(F.replace(policy_chunk_uuid(chunk_id), F.lit("-"), F.lit(""))))


def _is_one_of(value: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def _is_share(value: Column) -> Column:
    return F.coalesce((value >= 0) & (value <= 1) & ~F.isnan(value), F.lit(False))


def _is_text(value: Column) -> Column:
    return F.coalesce(~is_blank(value) & (F.length(value) <= MAX_FINDING_TEXT), F.lit(False))


_RAW_OUTPUT = "verdict string, confidence string, findings array<map<string,string>>"


def _finding_of(raw: Column) -> Column:
    """A finding struct from the map of one JSON object."""

    def value(name: str) -> Column:
        text = F.try_element_at(raw, F.lit(name))
        return _hyphenated(text) if name == "policy_chunk_id" else text

    return F.struct(*[value(f.name).try_cast(f.dataType).alias(f.name) for f in schemas.MODEL_FINDING.fields])


def validate_outputs(outputs: DataFrame, allowed_codes: DataFrame) -> DataFrame:
    """Parses model answers (job_id, payload); adds ``output`` and ``error_code``.

    ``allowed_codes`` has (job_id, rule_code) of the retrieved policies. An
    answer is invalid when it is no single JSON object, its shape, codes, labels,
    texts or shares are wrong, a text is another kind of value, a rule repeats,
    or a code was not retrieved.
    """
    finding_keys = F.array(*[F.lit(n) for n in sorted(schemas.MODEL_FINDING.names)])
    output_keys = F.array(*[F.lit(n) for n in sorted(schemas.MODEL_OUTPUT.names)])
    # A finding is read as a map first: its keys must be exactly the known ones.
    parsed = (
        outputs.withColumn("_raw", F.from_json("payload", _RAW_OUTPUT))
        .withColumn("_keys", F.sort_array(F.json_object_keys("payload")))
        .withColumn("_findings", F.transform("_raw.findings", _finding_of))
        .withColumn("_confidence", F.col("_raw.confidence").try_cast("double"))
        # Parsers stop behind the first value: only before its own hash as the second element is a payload one whole value.
        .withColumn("_mark", F.sha2("payload", 256))
        .withColumn("_whole", F.expr("""try_parse_json(concat('[', payload, ',"', _mark, '"]'))"""))
        .withColumn(
            "_kinds",
            F.expr(
                "transform(try_variant_get(_whole, '$[0].findings', 'array<struct<evidence: variant, recommendation: variant>>'), "
                "f -> struct(schema_of_variant(f.evidence) AS evidence, schema_of_variant(f.recommendation) AS recommendation))"
            ),
        )
    )
    findings, verdict, confidence = F.col("_findings"), F.col("_raw.verdict"), F.col("_confidence")
    codes = F.transform(findings, lambda f: f["rule_code"])

    def well_formed(f: Column) -> Column:
        return (
            _is_one_of(f["severity"], schemas.SEVERITIES)
            & _is_one_of(f["label"], schemas.VERDICTS)
            & _is_share(f["confidence"])
            & F.coalesce(f["rule_code"].rlike(RULE_CODE), F.lit(False))
            & _is_text(f["evidence"])
            & _is_text(f["recommendation"])
            & (f["policy_chunk_id"].isNull() | f["policy_chunk_id"].rlike(UUID_TEXT))
        )

    shape = (
        F.col("_keys").eqNullSafe(output_keys)
        & _is_one_of(verdict, schemas.VERDICTS)
        & _is_share(confidence)
        & findings.isNotNull()
        & (F.size(findings) <= MAX_FINDINGS)
        & F.forall("_raw.findings", lambda raw: F.sort_array(F.map_keys(raw)) == finding_keys)
        & F.forall("_kinds", lambda kinds: (kinds["evidence"] == "STRING") & (kinds["recommendation"] == "STRING"))
        & F.expr("try_variant_get(_whole, '$[1]', 'string') = _mark")
        & F.forall(findings, well_formed)
        & (F.size(F.array_distinct(codes)) == F.size(findings))
    )
    # Each answer is taken apart once; it meets the codes of its job as one row.
    retrieved = allowed_codes.groupBy("job_id").agg(F.collect_set("rule_code").alias("_allowed"))
    unknown = F.size(F.array_except("_codes", F.coalesce("_allowed", F.array().cast("array<string>")))) > 0
    return (
        parsed.withColumn("_shape", F.coalesce(shape, F.lit(False)))
        .withColumn("_codes", codes)
        .join(retrieved, "job_id", "left")
        .withColumn("error_code", F.when(~F.col("_shape") | F.coalesce(unknown, F.lit(False)), OUTPUT_INVALID))
        .withColumn(
            "output",
            F.when(
                F.col("error_code").isNull(),
                F.struct(verdict.alias("verdict"), confidence.alias("confidence"), findings.alias("findings")),
            ),
        )
        .drop("_raw", "_keys", "_findings", "_confidence", "_kinds", "_mark", "_whole", "_shape", "_codes", "_allowed")
    )


def ground_findings(findings: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A finding on a chunk that was not retrieved becomes UNCERTAIN without a chunk."""
    known = retrieved.select("job_id", F.col("chunk_id").alias("policy_chunk_id"), F.lit(True).alias("_known")).distinct()
    missing = F.col("_known").isNull()
    return (
        findings.join(known, ["job_id", "policy_chunk_id"], "left")
        .withColumn("ungrounded", missing)
        .withColumn("label", F.when(missing, "UNCERTAIN").otherwise(F.col("label")))
        .withColumn("policy_chunk_id", F.when(~missing, F.col("policy_chunk_id")))
        .drop("_known")
    )


def ground_verdicts(outputs: DataFrame, grounded: DataFrame) -> DataFrame:
    """Model verdicts after grounding; unchanged when every finding was grounded."""
    state = grounded.groupBy("job_id").agg(
        F.bool_or("ungrounded").alias("_changed"), F.bool_or(F.col("label") == "FAIL").alias("_fails")
    )
    verdict = (
        F.when(~F.coalesce("_changed", F.lit(False)), F.col("verdict"))
        .when(F.col("_fails"), "FAIL")
        .when(F.col("verdict") == "SKIP", "SKIP")
        .otherwise("UNCERTAIN")
    )
    return outputs.join(state, "job_id", "left").withColumn("verdict", verdict).drop("_changed", "_fails")


def policy_versions(hits: DataFrame) -> DataFrame:
    """Per job a map from document key to the highest retrieved version, entries sorted."""
    newest = hits.groupBy("job_id", "document_key").agg(F.max("document_version").alias("version"))
    return newest.groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("document_key", "version")))).alias("policy_versions")
    )


_WEIGHT = {"PASS": 1, "SKIP": 2, "UNCERTAIN": 3, "FAIL": 4}
_BY_WEIGHT = {weight: verdict for verdict, weight in _WEIGHT.items()}


def verdicts(labels: DataFrame) -> DataFrame:
    """Final verdict per job from all labels and verdicts (job_id, label): FAIL, UNCERTAIN, SKIP, PASS.

    One maximum per job, so that it combines before the shuffle.
    """
    top = labels.groupBy("job_id").agg(F.max(F.try_element_at(literal_map(_WEIGHT), F.col("label"))).alias("_top"))
    named = F.create_map(*[F.lit(x) for pair in _BY_WEIGHT.items() for x in pair])
    return top.select("job_id", F.try_element_at(named, F.col("_top")).alias("verdict"))


@dataclass(frozen=True)
class Inspection:
    results: DataFrame
    findings: DataFrame


def inspect(inputs: DataFrame, outputs: DataFrame, model_findings: DataFrame, retrieved: DataFrame) -> Inspection:
    """Results and findings of all jobs.

    A job without a present attachment ends as SKIP with confidence 1 and asks
    no model, even when rules failed; its rule findings are kept. Other jobs
    wait until their model output is there. The rules read the job row alone;
    model findings are summed up once per job.
    """
    jobs = inputs.select("job_id", (F.col("present_count") > 0).alias("_asks"), any_rule_fails().alias("_rule_fails"))
    asked = jobs.filter("_asks").select("job_id")
    grounded = ground_findings(model_findings.join(asked, "job_id", "left_semi"), retrieved)
    per_job = grounded.groupBy("job_id").agg(
        F.bool_or("ungrounded").alias("_changed"),
        F.max(F.try_element_at(literal_map(_WEIGHT), F.col("label"))).alias("_label"),
    )
    fails = F.col("_label") == _WEIGHT["FAIL"]
    model_verdict = (
        F.when(~F.coalesce("_changed", F.lit(False)), F.col("verdict"))
        .when(fails, "FAIL")
        .when(F.col("verdict") == "SKIP", "SKIP")
        .otherwise("UNCERTAIN")
    )
    weight = F.greatest(
        F.when(F.col("_rule_fails"), _WEIGHT["FAIL"]), F.col("_label"), F.try_element_at(literal_map(_WEIGHT), model_verdict)
    )
    named = F.create_map(*[F.lit(x) for pair in _BY_WEIGHT.items() for x in pair])
    results = (
        jobs.join(outputs.select("job_id", "verdict", "confidence"), "job_id", "left")
        .filter(~F.col("_asks") | F.col("verdict").isNotNull())
        .join(per_job, "job_id", "left")
        .select(
            "job_id",
            F.when(~F.col("_asks"), "SKIP").otherwise(F.try_element_at(named, weight)).alias("verdict"),
            F.when(~F.col("_asks") | F.col("_rule_fails"), 1.0).otherwise(F.round("confidence", 4)).alias("confidence"),
        )
    )
    return Inspection(results, _numbered(evaluate_rules(inputs), grounded))


def _numbered(rules: DataFrame, grounded: DataFrame) -> DataFrame:
    """Rule findings keep ordinals 0 to 3; model findings follow in their own order."""
    columns = ["job_id", "ordinal", "rule_code", "severity", "label", "evidence", "policy_chunk_id", "recommendation", "confidence", "source"]
    model = grounded.withColumn("ordinal", (F.col("ordinal") + len(schemas.RULE_TEXTS)).cast("int")).withColumn("source", F.lit("MODEL"))
    for name, kind in (("rule_code", "string"), ("evidence", "string"), ("recommendation", "string"), ("confidence", "double")):
        if name not in model.columns:
            model = model.withColumn(name, F.lit(None).cast(kind))
    return rules.select(*columns).unionByName(model.select(*columns))


def assemble(results: DataFrame, findings: DataFrame, calls: DataFrame) -> DataFrame:
    """One nested row per result: its findings by ordinal and the summary of its model call.

    A result has four rule findings and at most ``MAX_FINDINGS`` model findings,
    which the output check enforces; the array is bounded by that.
    """
    listed = findings.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "rule_code", "severity", "label", "recommendation"))).alias("findings")
    )
    call = calls.select("job_id", F.struct(*[c for c in calls.columns if c != "job_id"]).alias("model_call"))
    return results.join(listed, "job_id", "left").join(call, "job_id", "left")


def result_id(tenant: Column, job: Column) -> Column:
    return uuid5(schemas.RESULT_NAMESPACE, F.concat_ws(":", tenant, job))


def finding_id(tenant: Column, result: Column, ordinal: Column) -> Column:
    return uuid5(FINDING_NAMESPACE, F.concat_ws(":", tenant, result, ordinal.cast("string")))


def call_id(tenant: Column, job: Column, request: Column) -> Column:
    return uuid5(schemas.AUDIT_NAMESPACE, F.concat_ws(":", tenant, job, request))


def request_id(tenant: Column, job: Column, prompt_version: Column) -> Column:
    return uuid5(schemas.REQUEST_NAMESPACE, F.concat_ws(":", tenant, job, prompt_version))


def snapshot_schema(fields: Sequence[str]) -> T.StructType:
    kinds = {"version": T.LongType()}
    return T.StructType([T.StructField(f, kinds.get(f, T.StringType())) for f in fields])


def safe_snapshot(payload: Column, fields: Sequence[str]) -> Column:
    """Only the listed fields of a JSON snapshot, again as JSON; absent fields stay absent."""
    return F.to_json(F.from_json(payload, snapshot_schema(fields)))


def forbidden_keys(payload: Column) -> Column:
    """Sensitive key names found at any depth."""
    listed = F.array(*[F.lit(k) for k in schemas.FORBIDDEN_KEYS])
    return F.filter(
        json_keys_at_any_depth(payload),
        lambda key: F.array_contains(listed, key) | key.endswith("_url") | key.endswith("_uri"),
    )


def check_events(events: DataFrame) -> DataFrame:
    """Adds ``reasons`` to outbox rows; an empty list means the event may be inspected."""
    fields = F.from_json("payload", "id string, tenant_id string, version long, status string, inspection_round int")
    parsed = events.withColumn("_s", fields)
    checks = {
        "identity": ~F.col("_s.id").eqNullSafe(F.col("aggregate_id")),
        "tenant": ~F.col("_s.tenant_id").eqNullSafe(F.col("tenant_id")),
        "version": ~F.coalesce(F.col("_s.version") >= 0, F.lit(False)),
        "status": ~F.col("_s.status").eqNullSafe(F.lit("COMPLETED")),
        "round": F.coalesce(F.col("_s.inspection_round"), F.lit(1)) < 1,
        "forbidden_key": F.size(forbidden_keys(F.col("payload"))) > 0,
    }
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))
    return (
        parsed.withColumn("reasons", reasons)
        .withColumn("work_order_version", F.col("_s.version"))
        .withColumn("inspection_round", F.coalesce("_s.inspection_round", F.lit(1)))
        .drop("_s")
    )


def inspection_query() -> Column:
    """Retrieval text of an inspection: the non-blank fields, one per line."""
    names = ("title", "description", "order_type", "space_path", "completion_summary")
    return F.concat_ws("\n", *[F.when(~is_blank(F.col(n)), strip(F.col(n))) for n in names])


def call_summary(calls: DataFrame) -> DataFrame:
    """Hashes and sizes of model calls (job_id, request, response, verdict, finding_count)."""
    return calls.select(
        "job_id",
        content_hash(F.col("request")).alias("request_hash"),
        content_hash(F.col("response")).alias("response_hash"),
        "verdict",
        "finding_count",
        utf8_prefix(F.col("response"), RAW_RESPONSE_BYTES).alias("raw_response"),
    )
