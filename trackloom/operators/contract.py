"""Event contract: envelopes as JSON text to valid rows and a quarantine with reasons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import labels_digest

# Fixed values of the contract.
FIELDS = ("event_id", "event_type", "event_version", "trace_id", "run_id", "produced_at", "source_service", "idempotency_key", "payload")
SERVICES = {
    "audio.metadata": ("ingestion",),
    "audio.segment.ready": ("ingestion",),
    "audio.features": ("processing",),
    "system.metrics": ("ingestion", "processing", "writer"),
}
#: topic -> field -> (kind, required). Kinds: s text, i whole number, n number, b truth value, o object, t UTC time.
PAYLOADS = {
    "audio.metadata": {
        "run_id": "s", "track_id": "i", "artist_id": "i", "genre": "s", "source_audio_uri": "s", "validation_status": "s", "duration_s": "n",
        "subset": "s?", "manifest_uri": "s?", "checksum": "s?",
    },
    "audio.segment.ready": {
        "run_id": "s", "track_id": "i", "segment_idx": "i", "artifact_uri": "s", "checksum": "s", "sample_rate": "i", "duration_s": "n",
        "is_last_segment": "b", "manifest_uri": "s?",
    },
    "audio.features": {
        "ts": "t", "run_id": "s", "track_id": "i", "segment_idx": "i", "artifact_uri": "s", "checksum": "s", "rms": "n", "silent_flag": "b",
        "mel_bins": "i", "mel_frames": "i", "processing_ms": "n", "manifest_uri": "s?",
    },
    "system.metrics": {
        "ts": "t", "run_id": "s", "service_name": "s", "metric_name": "s", "metric_value": "n", "labels_json": "o?", "unit": "s?",
    },
}
RANGES = {
    "audio.metadata": (lambda p: p["duration_s"] > 0, lambda p: p["subset"].isNull() | (p["subset"] == "small")),
    "audio.segment.ready": (lambda p: p["sample_rate"] >= 1, lambda p: p["duration_s"] > 0),
    "audio.features": (lambda p: p["mel_bins"] >= 1, lambda p: p["mel_frames"] >= 1, lambda p: p["processing_ms"] >= 0),
    "system.metrics": (),
}
SCOPED = ("run_total", "processing_record", "writer_record")
SQL_TYPES = {"s": "string", "i": "bigint", "n": "double", "b": "boolean", "o": "string", "t": "string"}
#: schema_of_variant results that a kind accepts, as a pattern.
ACCEPTS = {"s": "STRING", "i": "BIGINT", "n": "(?:BIGINT|DOUBLE|DECIMAL\\(\\d+,\\d+\\))", "b": "BOOLEAN", "o": "OBJECT<(?s:.*)>", "t": "STRING"}


def is_utc(text: Column) -> Column:
    """RFC 3339 with an offset of exactly zero."""
    shape = text.rlike("^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]00:00)$")
    return F.coalesce(shape & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def is_run_id(text: Column) -> Column:
    """One safe path segment."""
    return F.coalesce(text.rlike("^[^\\s/\\\\:.]+$"), F.lit(False))


def key_tail(p: dict[str, Column], parse: Callable[[Column], Column] = F.parse_json) -> Column:
    """What of a track, of a segment, or of a metric an idempotency key names, after type, version and run."""
    if "service_name" in p:
        labels = F.coalesce(p["labels_json"], F.lit("{}"))
        scope = F.get_json_object(labels, "$.scope")
        point = F.when(scope.isin(*SCOPED), scope).otherwise(p["ts"])
        return F.concat_ws(":", p["service_name"], p["metric_name"], point, labels_digest(labels, parse))
    track = p["track_id"].cast("string")
    return F.concat(track, F.lit(":"), p["segment_idx"].cast("string")) if "segment_idx" in p else track


def idempotency_key(event_type: Column, p: dict[str, Column]) -> Column:
    """The key that an event must carry, from its payload fields."""
    return F.concat(event_type, F.lit(":v1:"), p["run_id"], F.lit(":"), key_tail(p))


def shape(topic: str) -> str:
    """Pattern of ``schema_of_variant`` for payloads of a topic: its fields in order of their names, each of its type.

    The text of an object ends before the next field of the contract: what follows it has no bracket but the
    payload's last. Foreign fields behind an object are left to the payload's keys.
    """
    parts = [f"(?:{f}: {ACCEPTS[k[0]]}(?:, |>$))" + ("?" if k.endswith("?") else "") for f, k in sorted(PAYLOADS[topic].items())]
    return "^OBJECT<" + "".join(parts) + "$"


def payload_fields() -> dict[str, Column]:
    """Each field that a payload of some topic has, once: a name is of one type in all topics. Topics without it are not asked."""
    kinds = {f: k[0] for spec in PAYLOADS.values() for f, k in spec.items()}
    out = {f: F.get_json_object("payload", f"$.{f}") if k == "o" else F.try_variant_get("_p", f"$.{f}", SQL_TYPES[k]) for f, k in kinds.items()}
    without = {f: [t for t, spec in PAYLOADS.items() if f not in spec] for f in kinds}
    return {f"_{f}": F.when(F.col("event_type").isin(*without[f]), F.lit(None)).otherwise(c) if without[f] else c for f, c in out.items()}


def payload_of(topic: str) -> dict[str, Column]:
    return {f: F.col(f"_{f}") for f in PAYLOADS[topic]}


def payload_ok(topic: str) -> Column:
    """Are all fields of a payload known, of strict type, and in range? One pattern tells names and types of all.

    Texts and times are left to ``texts_ok`` and ``times_ok``, which ask once for all topics.
    """
    spec = PAYLOADS[topic]
    p = payload_of(topic)
    ok = F.col("_shape").rlike(shape(topic))
    if any(k[0] == "o" for k in spec.values()):
        ok = ok & (F.size(F.array_except(F.json_object_keys("payload"), F.array(*[F.lit(f) for f in spec]))) == 0)
    for rule in RANGES[topic]:
        ok = ok & F.coalesce(rule(p), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def texts_ok() -> Column:
    """Is no text of a payload empty? Those that a topic needs are there, by its pattern; others are null."""
    names = sorted({f for spec in PAYLOADS.values() for f, k in spec.items() if k[0] == "s"})
    return F.coalesce(F.least(*[F.octet_length(f"_{f}") for f in names]) > 0, F.lit(True))


def times_ok(event: Column) -> Column:
    """Are a payload's times UTC?"""
    topics = {f: [t for t, spec in PAYLOADS.items() if f in spec] for spec in PAYLOADS.values() for f, k in spec.items() if k == "t"}
    return reduce(Column.__and__, [~event.isin(*ts) | is_utc(F.col(f"_{f}")) for f, ts in topics.items()])


def stepped(df: DataFrame, **found: Column) -> DataFrame:
    """``df`` with the columns ``found`` as those of one generated row.

    What follows is code of its own, so that no method exceeds the 8,000 bytes up to which the JVM compiles it; filters on
    these columns stay above, where the optimizer would copy all that makes them into each use.
    """
    kept = [F.col(c) for c in df.columns if c not in found]
    rows = df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))).alias("_row"))
    return rows.select(*kept, "_row.*")


def as_written(df: DataFrame, topic: Column | str | None, value: str) -> DataFrame:
    """Adds ``_e``, a record's envelope and payload by their types, its payload's text ``_body``, and ``_plain``: is it a valid
    record in the very text that ``envelopes`` writes?

    Typed values that give the record's text again leave no doubt about names and types of its fields, so such a record needs
    no look at each of them. Whatever is written otherwise (order, spaces, numbers, escapes) is not plain, valid or not.
    """
    kinds = {f: k[0] for spec in PAYLOADS.values() for f, k in spec.items()}
    names = sorted(kinds)
    payload = ", ".join(f"{f}: {SQL_TYPES[kinds[f]]}" for f in names)
    schema = "struct<" + ", ".join(f"{f}: struct<{payload}>" if f == "payload" else f"{f}: string" for f in sorted(FIELDS)) + ">"
    # numbers that are none stay texts; a very large record is left to the rules
    short = F.when(F.octet_length(value) < 1_000_000, F.col(value))
    df = df.withColumn("_e", F.from_json(short, schema, {"allowNonNumericNumbers": "false"}))
    e, p = {f: F.col(f"_e.{f}") for f in FIELDS}, {f: F.col(f"_e.payload.{f}") for f in names}
    body = F.to_json(F.struct(*[p[f].alias(f) for f in names if kinds[f] != "o"]))
    objects = [f for f in names if kinds[f] == "o"]
    for f in objects:  # kept as text; an object comes first in its payload
        body = F.when(p[f].isNull(), body).otherwise(F.concat(F.lit(f'{{"{f}":'), p[f], F.lit(","), F.substring(body, 2, 1 << 30)))
    # which fields a payload has, a bit each
    has = reduce(Column.__add__, [F.when(p[f].isNotNull(), 1 << k).otherwise(0) for k, f in enumerate(names)])
    df = df.withColumns({"_body": body, "_has": has})
    text = lambda fields: F.to_json(F.struct(*[e[f].alias(f) for f in fields]))
    head, rest = text([f for f in sorted(FIELDS) if f < "payload"]), text([f for f in sorted(FIELDS) if f > "payload"])
    same = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.col("_body"), F.lit(","), F.substring(rest, 2, 1 << 30)) == F.col(value)
    df = df.withColumn("_same", F.coalesce(same, F.lit(False)))
    event, run = e["event_type"], e["run_id"]
    envelope = [
        F.col("_same"), *[c.isNotNull() for f, c in e.items() if f != "payload"], e["event_version"] == "v1", is_run_id(run), p["run_id"] == run, is_utc(e["produced_at"]),
        e["trace_id"].startswith(F.concat(F.lit("run/"), run, F.lit("/"))), F.lit(True) if topic is None else event == (F.col(topic) if isinstance(topic, str) else topic),
    ]
    df = stepped(df, _e=F.col("_e"), _body=F.col("_body"), _has=F.col("_has"), _enveloped=F.coalesce(reduce(Column.__and__, envelope), F.lit(False)))
    texts = F.least(*[F.octet_length(p[f]) for f in names if kinds[f] == "s"]) > 0
    values = [p[f].isNull() | (p[f].startswith("{") & F.try_parse_json(p[f]).isNotNull()) for f in objects] + [p[f].isNull() | is_utc(p[f]) for f in names if kinds[f] == "t"]
    df = df.withColumn("_whole", F.col("_enveloped") & F.coalesce(reduce(Column.__and__, [texts, *values]), F.lit(False)))
    ok = F.lit(False)
    for t, spec in PAYLOADS.items():
        bits = lambda fields: sum(1 << names.index(f) for f in fields)
        needed, allowed = bits(f for f, k in spec.items() if not k.endswith("?")), bits(spec)
        service = e["source_service"].isin(*SERVICES[t])
        if "service_name" in spec:
            service = service & (e["source_service"] == p["service_name"])
        fields = (F.col("_has").bitwiseAND(F.lit(needed)) == needed) & (F.col("_has").bitwiseOR(F.lit(allowed)) == allowed)
        ok = F.when(event == t, reduce(Column.__and__, [service, fields, *[rule(p) for rule in RANGES[t]]])).otherwise(ok)
    df = df.withColumn("_ranged", F.coalesce(F.col("_whole") & ok, F.lit(False)))
    tail = lambda t: key_tail({f: p[f] for f in PAYLOADS[t]}, F.try_parse_json)
    tails = F.when(event == "system.metrics", tail("system.metrics")).when(event == "audio.metadata", tail("audio.metadata")).otherwise(tail("audio.features"))
    key = e["idempotency_key"] == F.concat(event, F.lit(":v1:"), run, F.lit(":"), tails)
    return df.withColumn("_plain", F.coalesce(F.col("_ranged") & key, F.lit(False)))


def judged(df: DataFrame, topic: Column | str | None) -> DataFrame:
    """Adds the envelope's fields and ``_reasons`` of the records ``_text``, by each rule.

    A record is parsed once and its payload's fields are taken out once. That, the rules by topic and the
    others are three steps: the method generated for all of them at once would exceed the 8,000 bytes up to
    which the JVM compiles a method. Rules of a topic are evaluated for records of that topic alone.
    """
    df = df.withColumn("_v", F.try_parse_json("_text"))
    df = df.withColumns({"_ok": F.coalesce(F.col("_v").isNotNull() & F.col("_text").rlike("^[ \\t\\r\\n]*\\{"), F.lit(False)), "_p": F.try_variant_get("_v", "$.payload", "variant")})
    text = F.when(F.col("_ok"), F.col("_text"))
    df = df.withColumns(
        {
            **{f: F.try_variant_get("_v", f"$.{f}", "string") for f in FIELDS if f != "payload"},
            "payload": F.get_json_object(text, "$.payload"),
            "_keys": F.coalesce(F.sort_array(F.json_object_keys(text)), F.array().cast("array<string>")),
            "_shape": F.schema_of_variant("_p"),
        }
    )
    event = F.col("event_type")
    by_type = lambda f: F.coalesce(F.coalesce(*[F.when(event == t, f(t)) for t in PAYLOADS]), F.lit(False))
    tail = F.when(event == "system.metrics", key_tail(payload_of("system.metrics"))).when(event == "audio.metadata", key_tail(payload_of("audio.metadata"))).otherwise(key_tail(payload_of("audio.features")))
    df = df.withColumns(payload_fields()).withColumns({"_payload": by_type(payload_ok) & texts_ok()})
    df = stepped(df, _payload=F.col("_payload") & times_ok(event), _tail=tail, **{c: F.col(c) for c in ("_run_id", "_service_name", "_ok", "_keys", *FIELDS)})
    run, service = F.col("_run_id"), F.col("_service_name")
    rules = {
        "not_json_object": F.col("_ok"),
        "fields": F.array_distinct("_keys") == F.array(*[F.lit(f) for f in sorted(FIELDS)]),
        "version": F.col("event_version") == "v1",
        "event_type": event.isin(*PAYLOADS) if topic is None else event == (F.col(topic) if isinstance(topic, str) else topic),
        "run_id": is_run_id(F.col("run_id")),
        "trace_id": F.col("trace_id").startswith(F.concat(F.lit("run/"), F.col("run_id"), F.lit("/"))),
        "produced_at": is_utc(F.col("produced_at")),
        "source_service": by_type(lambda t: F.col("source_service").isin(*SERVICES[t]))
        & ((event != "system.metrics") | (F.col("source_service") == service)),
        "run_mismatch": (run != "") & (run == F.col("run_id")),
        "payload": F.col("_payload"),
        "idempotency_key": F.col("idempotency_key") == F.concat(event, F.lit(":v1:"), run, F.lit(":"), F.col("_tail")),
    }
    # without a lambda, which would take all rules below it out of the generated code
    failed = F.array_except(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), F.array(F.lit(None).cast("string")))
    return df.withColumn("_reasons", F.when(~F.col("_ok"), F.array(F.lit("not_json_object"))).otherwise(failed))


def checked(raw: DataFrame, topic: Column | str | None = None, value: str = "value", typed: bool = False) -> DataFrame:
    """``raw`` with the envelope's fields, ``payload`` as text and ``reasons`` (empty: valid).

    ``typed``: with the payload's fields, of whatever topic, as columns in the place of its text; they are null where a record is bad.

    Rules: JSON object without NaN; exactly the nine fields; version v1; event type of the
    topic; safe run id; trace id under the run; UTC time; service allowed for the type and
    equal to the payload's; payload's run equals; payload fields closed and of strict type,
    in range; idempotency key as recomputed.

    Valid records in the text that ``envelopes`` writes are told by their typed values; only the others are
    judged rule by rule, the rules find no text of the first.
    """
    df = as_written(raw, topic, value)
    told = {c: F.col(c) for c in ("_e", "_plain", *([] if typed else ["_body"]))}
    df = judged(stepped(df, **told, _text=F.when(~F.col("_plain"), F.col(value))).select(*raw.columns, *told, "_text"), topic)
    kept = [c for c in raw.columns if c not in (*FIELDS, "reasons")]
    df = stepped(df.select(*kept, *told, *FIELDS, "_reasons"), **told, **{n: F.col(n) for n in (*FIELDS, "_reasons")})
    plain = F.col("_plain")
    fields = [F.when(plain, F.col(f"_e.{f}")).otherwise(F.col(f)).alias(f) for f in FIELDS if f != "payload"]
    reasons = F.when(plain, F.array().cast("array<string>")).otherwise(F.col("_reasons")).alias("reasons")
    if not typed:
        return df.select(*kept, *fields, F.when(plain, F.col("_body")).otherwise(F.col("payload")).alias("payload"), reasons)
    kinds = {f: SQL_TYPES[k[0]] for spec in PAYLOADS.values() for f, k in sorted(spec.items())}
    other = F.from_json(F.when(~plain & (F.size("_reasons") == 0), F.col("payload")), ", ".join(f"{f} {kinds[f]}" for f in sorted(kinds)))
    return df.select(*kept, *fields, reasons, F.when(plain, F.col("_e.payload")).otherwise(other).alias("_typed")).select(*kept, *[f for f in FIELDS if f != "payload"], "reasons", *[f"_typed.{f}" for f in kinds if f != "run_id"])


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") == 0)


def quarantined(df: DataFrame, value: str = "value", more: tuple[str, ...] = ()) -> DataFrame:
    """Bad rows with the context that can be had, the class of the failure, and ``more`` columns of the records."""
    context = lambda f, t: F.try_variant_get(F.try_parse_json(F.col(value)), f"$.payload.{f}", t)
    return df.filter(F.size("reasons") > 0).select(
        *more, value, "event_type", "run_id", "trace_id", context("track_id", "bigint").alias("track_id"), context("segment_idx", "int").alias("segment_idx"),
        F.array_join("reasons", ";").alias("reasons"), failure_class(F.col("reasons")[0]).alias("failure_class"), is_retryable(failure_class(F.col("reasons")[0])).alias("retryable"),
    )


#: Failures of the surroundings, which another attempt may not meet; those of an event itself stay.
RETRYABLE = ("artifact_missing", "checksum_mismatch", "artifact_not_ready", "publish_failed", "write_failed")


def is_retryable(failure: Column) -> Column:
    return F.coalesce(failure.isin(*RETRYABLE), F.lit(False))


def failure_class(reason: Column) -> Column:
    """Class of a rule that an event broke; classes of processing (``RETRYABLE``) pass as they are."""
    return (
        F.when(is_retryable(reason), reason)
        .when(reason == "not_json_object", "deserialization_error")
        .when(reason.isin("payload", "run_mismatch"), "payload_validation_error")
        .otherwise("envelope_validation_error")
    )


def routed(df: DataFrame, event_type: str) -> DataFrame:
    """Valid rows of one topic with typed payload columns."""
    spec = PAYLOADS[event_type]
    if "payload" not in df.columns:  # typed already
        own = [f for f in ("event_id", "trace_id", "produced_at", "idempotency_key") if f in df.columns]
        return valid(df).filter(F.col("event_type") == event_type).select(*own, *spec)
    schema = ", ".join(f"{f} {SQL_TYPES[k[0]]}" for f, k in spec.items())
    rows = valid(df).filter(F.col("event_type") == event_type)
    own = [f for f in ("event_id", "trace_id", "produced_at", "idempotency_key") if f in rows.columns]
    return rows.select(*own, F.from_json("payload", schema).alias("p")).select(*own, "p.*")


def envelopes(payloads: DataFrame, event_type: str, service: str, produced_at: Column, event_id: Column, **more: Column) -> DataFrame:
    """Wrap typed payload rows as (key, value) records with sorted keys; null payload fields are left out. ``more`` columns go with them."""
    spec = PAYLOADS[event_type]
    cols = {f: F.col(f) if f in payloads.columns else F.lit(None).cast(SQL_TYPES[k[0]]) for f, k in spec.items()}
    keyed = cols.get("track_id", cols.get("service_name"))
    trace = F.concat(F.lit("run/"), cols["run_id"], F.lit("/track/" if "track_id" in spec else "/service/"), keyed.cast("string"))
    fields = {
        "event_id": event_id, "event_type": F.lit(event_type), "event_version": F.lit("v1"), "idempotency_key": idempotency_key(F.lit(event_type), cols),
        "payload": F.to_json(F.struct(*[c.alias(f) for f, c in sorted(cols.items()) if f != "labels_json"])), "produced_at": produced_at,
        "run_id": cols["run_id"], "source_service": F.lit(service), "trace_id": trace,
    }
    if "labels_json" in spec:
        body = fields["payload"]
        fields["payload"] = F.when(cols["labels_json"].isNull(), body).otherwise(
            F.concat(F.lit('{"labels_json":'), cols["labels_json"], F.when(body == "{}", "").otherwise(","), F.substring(body, 2, 1 << 30))
        )
    text = lambda names: F.to_json(F.struct(*[fields[f].alias(f) for f in names]))
    before, after = [f for f in sorted(fields) if f < "payload"], [f for f in sorted(fields) if f > "payload"]
    head = text(before)
    value = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.expr("',\"payload\":'"), fields["payload"], F.lit(","), F.substring(text(after), 2, 1 << 30))
    return payloads.select(keyed.cast("string").alias("key"), value.alias("value"), *[c.alias(n) for n, c in more.items()])
