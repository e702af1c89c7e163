"""Required fields, acceptance, and the outcome of each page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let
from ..functions.urls import is_url
from ..functions.variants import field
from .contracts import entities, entity_type, explode_entities, parse_extractions
from .jsonld import build_error, build_json_ld, price_repairs, with_repairs

OK, BAD_REQUEST, UNPROCESSABLE, SERVER_ERROR = 200, 400, 422, 500


def required_fields(kind: Column) -> Column:
    """ARRAY of the required fields of a type; empty if it requires nothing."""
    rules = [x for t, fs in fixed.REQUIRED_FIELDS.items() if fs
             for x in (F.lit(t), F.array(*map(F.lit, fs)))]
    none = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(F.create_map(*rules), kind), none)


def check_required(raw: Column, kind: Column) -> Column:
    """Why the first failing required field fails, or null; 0 and false are values."""
    names = dict.fromkeys(name for fs in fixed.REQUIRED_FIELDS.values() for name in fs)

    def reason(name):
        path = F.concat(F.lit(" required field: "), kind, F.lit("." + name))
        return let(F.to_json(field(raw, name)), lambda f: F.when(
            f.isNull() | f.isin("null", '""'), F.concat(F.lit("Missing"), path)
        ).when(f == "[]", F.concat(F.lit("Empty"), path)))

    # Field by field in the rule's order: the first reason found is the answer.
    checks = [
        F.when(kind.isin(*[t for t, fs in fixed.REQUIRED_FIELDS.items() if name in fs]),
               reason(name))
        for name in names
    ]
    return F.coalesce(*checks)


def with_reason(entity_rows: DataFrame) -> DataFrame:
    """+ reason: why an entity is rejected, null if it is accepted."""
    return entity_rows.withColumn("reason", check_required(F.col("raw"), F.col("type")))


def validate(entity_rows: DataFrame) -> DataFrame:
    """+ reason, accepted, json_ld, repairs, entity_error; one row per entity, no shuffle.

    Only accepted entities are built; page_url is the base of relative URLs.
    """
    raw, kind = F.col("raw"), F.col("type")
    rows = with_reason(entity_rows).withColumn(
        "accepted", kind.isNotNull() & F.col("reason").isNull()
    )
    accepted = F.col("accepted")
    none = F.array().cast("array<string>")
    return with_repairs(rows).withColumns({
        "entity_error": F.when(accepted, build_error(raw, kind)),
        "json_ld": F.when(accepted, build_json_ld(raw, kind)),
        "repairs": F.when(accepted & (kind == "Product"), price_repairs(raw)).otherwise(none),
    }).drop("base", "urls", "dates", "passed", "source")


def accepted_entities(validated: DataFrame) -> DataFrame:
    """(page_id, idx, type, json_ld)."""
    return validated.where("accepted").select("page_id", "idx", "type", "json_ld")


def rejected_entities(validated: DataFrame) -> DataFrame:
    """(page_id, idx, type, reason)."""
    return validated.where(F.col("reason").isNotNull() & F.col("idx").isNotNull()).select(
        "page_id", "idx", "type", "reason"
    )


def page_validation(extractions: DataFrame) -> DataFrame:
    """One row per page: stage and reason of a failure (null on success) and the counts.

    The entities of a page leave one task as one partial aggregate, so what is shuffled is
    one small row per page.  A page fails at extraction if its payload has no list or any
    entity lacks a text @type; at the validator by its first entity error, else if nothing
    was accepted.
    """
    rows = with_reason(entities(extractions, outer=True)).withColumn(
        "accepted", F.col("type").isNotNull() & F.col("reason").isNull()
    )
    rows = rows.withColumn(
        "entity_error", F.when(F.col("accepted"), build_error(F.col("raw"), F.col("type")))
    )
    present = F.col("idx").isNotNull()
    broken = ~F.col("has_schemas") | (present & F.col("type").isNull())
    error_idx = F.when(F.col("entity_error").isNotNull(), F.col("idx"))
    pages = rows.groupBy("page_id").agg(
        F.bool_or(broken).alias("broken"),
        F.min_by("entity_error", error_idx).alias("entity_error"),
        F.count(F.when(present, 1)).alias("n_entities"),
        F.count(F.when(F.col("accepted"), 1)).alias("n_accepted"),
        F.count(F.when(present & F.col("reason").isNotNull(), 1)).alias("n_rejected"),
    )
    failure = F.coalesce(
        "entity_error", F.when(F.col("n_accepted") == 0, fixed.NOTHING_ACCEPTED)
    )
    return pages.select(
        "page_id",
        F.when(F.col("broken"), "extraction").when(failure.isNotNull(), "validator").alias("stage"),
        F.when(F.col("broken"), fixed.BAD_EXTRACTION).otherwise(failure).alias("reason"),
        "n_entities", "n_accepted", "n_rejected",
    )


def extraction_failures(extractions: DataFrame) -> DataFrame:
    """(page_id, reason) of pages whose payload cannot be used; found inside the row."""
    rows = entities(extractions, outer=True)
    broken = ~F.col("has_schemas") | (F.col("idx").isNotNull() & F.col("type").isNull())
    pages = rows.groupBy("page_id").agg(F.bool_or(broken).alias("broken"))
    return pages.where("broken").select("page_id", F.lit(fixed.BAD_EXTRACTION).alias("reason"))


def page_result(extractions: DataFrame) -> DataFrame:
    """Per successful page: accepted types, JSON-LD and repairs, each in entity order."""
    rows = validate(entities(extractions, outer=True))
    broken = ~F.col("has_schemas") | (F.col("idx").isNotNull() & F.col("type").isNull())
    done = F.when(F.col("accepted"), F.struct("idx", "type", "json_ld", "repairs"))
    pages = rows.groupBy("page_id").agg(
        F.bool_or(broken | F.col("entity_error").isNotNull()).alias("failed"),
        F.sort_array(F.collect_list(done)).alias("done"),
    )
    return pages.where(~F.col("failed") & (F.size("done") > 0)).select(
        "page_id",
        F.col("done")["type"].alias("entity_types"),
        F.col("done")["json_ld"].alias("json_ld"),
        F.flatten(F.col("done")["repairs"]).alias("repairs"),
    )


def page_failed(schemas: Column) -> Column:
    """Whether a page fails, worked out inside its row: no list, an entity without a text @type,
    an entity error, or nothing accepted."""
    def accepted(e):
        return F.coalesce(check_required(e, entity_type(e)).isNull(), F.lit(False))

    def has_error(e):
        return accepted(e) & build_error(e, entity_type(e)).isNotNull()

    return (
        schemas.isNull()
        | F.exists(schemas, lambda e: entity_type(e).isNull())
        | F.exists(schemas, has_error)
        | ~F.exists(schemas, accepted)
    )


def successful_entities(extractions: DataFrame) -> DataFrame:
    """Entities with reason and accepted, of the pages that did not fail; one read, no shuffle."""
    rows = parse_extractions(extractions)
    good = rows.where(~F.coalesce(page_failed(F.col("schemas")), F.lit(True)))
    kept = with_reason(explode_entities(good))
    return kept.withColumn("accepted", F.col("type").isNotNull() & F.col("reason").isNull())


def gate_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """+ reason: why a URL is refused, else null."""
    u = F.col(url)
    reason = F.when(u.isNull() | (u == ""), fixed.URL_REQUIRED).when(
        ~is_url(u), fixed.URL_INVALID
    )
    return pages.withColumn("reason", reason)


def gate_status(pages: DataFrame, status: str = "status") -> DataFrame:
    """+ reason of a failed fetch, else null."""
    code = F.col(status)
    return pages.withColumn(
        "reason", F.when(code >= 400, F.concat(F.lit("HTTP error: "), code.cast("string")))
    )


def page_outcomes(pages: DataFrame, validation: DataFrame) -> DataFrame:
    """(page_id, success, stage, reason): the first stage that failed.

    `pages` may carry status and error; `validation` is page_validation's result.
    """
    gated = gate_urls(pages).withColumnRenamed("reason", "url_reason")
    status = F.lit(None).cast("string")
    if "status" in pages.columns:
        gated = gate_status(gated).withColumnRenamed("reason", "status_reason")
        status = F.col("status_reason")
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    fetched = gated.select(
        "page_id", F.coalesce("url_reason", status).alias("fetch_reason"),
        error.alias("server_error"), F.col("html").isNull().alias("no_html"),
    )
    v = validation.select(
        "page_id", F.col("stage").alias("v_stage"), F.col("reason").alias("v_reason"),
        F.lit(True).alias("extracted"),
    )
    joined = fetched.join(v, "page_id", "left")
    missing = F.col("extracted").isNull()
    stage = (
        F.when(F.col("server_error").isNotNull(), "api")
        .when(F.col("fetch_reason").isNotNull(), "ingestion")
        .when(F.col("no_html"), "cleaning")
        .when(missing, "extraction")
        .otherwise(F.col("v_stage"))
    )
    reason = (
        F.when(F.col("server_error").isNotNull(), F.col("server_error"))
        .when(F.col("fetch_reason").isNotNull(), F.col("fetch_reason"))
        .when(F.col("no_html"), "No HTML")
        .when(missing, "No extraction result")
        .otherwise(F.col("v_reason"))
    )
    return joined.select(
        "page_id", stage.isNull().alias("success"), stage.alias("stage"), reason.alias("reason")
    )


def outcome_code(outcomes: DataFrame) -> DataFrame:
    """+ code: 200, 400 for a refused URL, 422 for a failed stage, 500 for other errors."""
    refused = F.col("reason").isin(fixed.URL_REQUIRED, fixed.URL_INVALID)
    return outcomes.withColumn(
        "code",
        F.when(F.col("success"), OK)
        .when((F.col("stage") == "ingestion") & refused, BAD_REQUEST)
        .when(F.col("stage") == "api", SERVER_ERROR)
        .otherwise(UNPROCESSABLE),
    )


def token_usage(extractions: DataFrame) -> DataFrame:
    """(page_id, prompt_tokens, completion_tokens, total_tokens), from either naming."""
    usage = F.try_parse_json("usage")

    def first_of(*keys):
        found = [F.try_variant_get(usage, f"$.{k}", "long") for k in keys]
        return F.coalesce(*found, F.lit(0).cast("long"))

    return extractions.select(
        "page_id",
        first_of("promptTokens", "inputTokens").alias("prompt_tokens"),
        first_of("completionTokens", "outputTokens").alias("completion_tokens"),
        first_of("totalTokens").alias("total_tokens"),
    )
