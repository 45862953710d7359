"""Clickstream hits: consent, identity, internal traffic, limits, payloads, union of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestream import constants as C
from placestream.functions.text import client_id, consent_cookie, session_id

# The events of both layers with their parameters. A question mark marks one that may be
# absent; its values are of a type, or one of those listed.
_LINK = {"link_url": "text", "link_text": "text", "link_domain": "text"}
CLIENT_PARAMS = {
    "page_view": {"page_path": "text", "page_title?": "text"},
    "outbound_click": _LINK,
    "internal_link_click": _LINK,
    "nav_click": {"link_url": "text", "link_text": "text", "nav_location": "header or footer"},
    "project_cta_click": {"project_slug": "text", "cta_label": "text"},
    "download_click": {"project_slug": "text", "link_url": "text"},
    "citation_click": _LINK,
    "page_not_found": {"page_path": "text", "referrer": "text"},
    "web_vitals": {"metric_name": "text", "metric_value": "number", "metric_rating": "good or needs-improvement or poor", "metric_id": "text", "page_path": "text"},
    "throw_started": {"input_method": "drag or fling"},
    "throw_input_method": {"input_method": "drag or tap or fling or keyboard"},
    "throw_abandoned": {"input_method": "drag or fling"},
    "throw_completed": {
        "outcome": "preich or dernaebe", "throw_quality": "sufer or gschlämpert or chnorz", "canton?": "text", "municipality?": "text", "elevation?": "number or null", "distance_km?": "number",
        "bearing?": "text", "water?": "flag", "miss_reason?": "usland or grenzwasser",
    },
    "throw_off_map": {},
    "throw_api_error": {"status?": "number or null"},
    "shared_throw_opened": {},
    "panel_toggle": {"open": "flag"},
    "map_engaged": {},
    "share_attempt": {},
    "share_result": {"share_method": "native or clipboard", "outcome": "shared or dismissed or copied or unsupported or failed"},
    "result_action": {"action": "again or show_on_map or share"},
    "setting_changed": {"setting_name": "view or throw_style or dart_skin or sound", "setting_value": "text"},
    "throw_log_entry_click": {"art": "preich or dernaebe"},
    "throw_log_cleared": {"entry_count": "number"},
    "canton_collected": {"canton": "text", "cantons_collected": "number"},
    "all_cantons_collected": {"throw_count": "number"},
    "dart_skin_unlocked": {"dart_skin": "text", "threshold": "number"},
}
SERVER_PARAMS = {
    "throw_resolved_server": {"art": "text", "upstream_ms": "number", "kanton?": "text", "wasser?": "flag", "hoechi?": "number", "distanz_km?": "number", "richtig?": "text", "grund?": "text"},
    "swisstopo_error_server": {"upstream_ms": "number"},
    "og_unfurl_server": {"has_wurf": "flag", "resolved": "flag"},
    "design_fetch_failed_server": {"status": "number"},
}
EVENT_PARAMS = CLIENT_PARAMS | SERVER_PARAMS
CLIENT_EVENTS, SERVER_EVENTS = tuple(CLIENT_PARAMS), tuple(SERVER_PARAMS)


def resolve_consent(hits: DataFrame, cookie: str = "cookie", gpc: str = "gpc", dnt: str | None = None) -> DataFrame:
    """Hits with a column per consent category: a privacy signal denies all, else the cookie, else defaults.

    A cookie that is valid JSON but no object leaves its categories undefined (null); JSON null and
    broken cookies count as absent.
    """
    signal = F.coalesce(F.col(gpc), F.lit(False))
    if dnt:
        signal = signal | F.coalesce(F.col(dnt) == "1", F.lit(False))
    v = consent_cookie(cookie)
    absent = v.isNull() | F.is_variant_null(v)
    out = {}
    for name, default in C.CONSENT_DEFAULTS.items():
        # a path into anything but an object gives null
        given = F.try_variant_get(v, f"$.{name}", "string")
        out[name] = F.when(signal, "denied").when(absent, default).otherwise(given)
    return hits.withColumns(out)


def consented_only(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("analytics_storage") == "granted")


def enabled_only(hits: DataFrame, enabled: bool = True) -> DataFrame:
    """The layer switch: no hit at all when it is off."""
    return hits if enabled else hits.filter(F.lit(False))


def tag_internal(hits: DataFrame) -> DataFrame:
    return hits.withColumn("traffic_type", F.when(F.col("internal"), "internal"))


def valid_event(name: Column, params: Column) -> Column:
    """Whether the collector keeps an event: name and number of JSON params within limits."""
    n = F.coalesce(F.size(F.json_object_keys(params)), F.lit(0))
    return (F.length(name) <= C.MAX_EVENT_NAME) & (F.greatest(n, F.lit(0)) <= C.MAX_EVENT_PARAMS)


def tag_dropped(hits: DataFrame, name: str = "name", params: str = "params") -> DataFrame:
    """Hits with ``will_be_dropped``; filtering is left to the caller."""
    return hits.withColumn("will_be_dropped", ~valid_event(F.col(name), F.col(params)))


def derive_client(hits: DataFrame, stream: str = "S", cookie: str = "cookie", deterministic: bool = False, key: str = "hit_id") -> DataFrame:
    """Hits with client_id, client_source and session_id from the cookie, else a synthetic id."""
    found = client_id(cookie)
    synthetic = F.sha2(F.col(key).cast("string").cast("binary"), 256) if deterministic else F.uuid()
    return hits.withColumns({
        "client_id": F.coalesce(found, synthetic),
        "client_source": F.when(found.isNotNull(), "cookie").otherwise("synthetic"),
        "session_id": session_id(cookie, stream),
    })


def server_payload(hits: DataFrame, name: str = "name", params: str = "params") -> DataFrame:
    """Hits with ``payload``: JSON of the client id and one event, its params with their own types.

    ``params`` is a struct, map or VARIANT; absent fields are left out. The engagement time is a
    number, the session id is there only if known.
    """
    given = F.coalesce(F.to_json(params), F.lit("{}"))
    extra = F.to_json(F.struct(F.lit(1).alias("engagement_time_msec"), "client_source", "session_id"))
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    merged = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner(given), F.lit("")), inner(extra)), F.lit("}"))
    # the name and the id as JSON texts, quoted and escaped
    head = F.to_json(F.struct("client_id"))
    event = F.to_json(F.struct(F.col(name).alias("name")))
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    return hits.withColumn("payload", F.concat(cut(head), F.lit(',"events":['), cut(event), F.lit(',"params":'), merged, F.lit("}]}")))


def contract_problems(name: Column, params: Column) -> Column:
    """array<string> of the parameters of a known event that are missing or of another type or value; null for an unknown name.

    ``params`` is JSON text; anything but an object has no parameters. Parameters beyond the contract are let pass.
    """
    parsed = F.try_parse_json(params)
    out = None
    for event, fields in EVENT_PARAMS.items():
        checks = []
        for field, allowed in fields.items():
            key = field.rstrip("?")
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            kind = F.schema_of_variant(value)
            if allowed == "text":
                good = kind == "STRING"
            elif allowed == "flag":
                good = kind == "BOOLEAN"
            elif allowed in ("number", "number or null"):
                good = kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)") | ((kind == "VOID") if allowed != "number" else F.lit(False))
            else:
                good = (kind == "STRING") & F.try_variant_get(parsed, f"$.{key}", "string").isin(*allowed.split(" or "))
            checks.append(F.when(~F.when(value.isNull(), F.lit(field.endswith("?"))).otherwise(F.coalesce(good, F.lit(False))), F.lit(key)))
        found = F.array_compact(F.array(*checks)) if checks else F.expr("cast(array() as array<string>)")
        out = F.when(name == event, found) if out is None else out.when(name == event, found)
    return out


def all_hits(client: DataFrame, server: DataFrame) -> DataFrame:
    """Both layers under one schema with a ``layer`` column; their vocabularies are kept apart by suffix."""
    return client.withColumn("layer", F.lit("client")).unionByName(server.withColumn("layer", F.lit("server")), allowMissingColumns=True)


def unknown_events(hits: DataFrame) -> DataFrame:
    """Hits whose name is in neither layer's contract."""
    return hits.filter(~F.coalesce(F.col("name").isin(*CLIENT_EVENTS, *SERVER_EVENTS, "set_user_properties"), F.lit(False)))


def vocabulary_overlap(hits: DataFrame) -> DataFrame:
    """Names that occur in both layers (there should be none), or whose suffix contradicts the layer."""
    by_name = hits.groupBy("name").agg(F.count_distinct("layer").alias("layers"), F.min("layer").alias("layer"))
    return by_name.filter((F.col("layers") > 1) | (F.col("name").endswith("_server") != (F.col("layer") == "server"))).select("name", "layers")


def count_where(**conditions: Column) -> list[Column]:
    """Named counts of the rows where each condition is true."""
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]


