"""Saved connections: values, readiness, revisions and activation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, filled
from .profiles import PIN

# Shared listener port by protocol and lower layer.
LISTENER_PORTS = {("HL7", ""): 2575, ("ASTM", "LIS01_A"): 12001, ("ASTM", "E1381_95"): 12011}


def intervals(activations: DataFrame) -> DataFrame:
    """Activation instants -> (active_from, active_to); activations of one connection are operator actions, few."""
    after = Window.partitionBy("connection_id").orderBy("at")
    return activations.withColumn("active_to", F.lead("at").over(after)).withColumnRenamed("at", "active_from")


def effective_values(requests: DataFrame) -> DataFrame:
    """Profile defaults <- existing declared values <- supplied values; a SERVER keeps no port.

    Needs maps ``defaults``, ``existing`` (NULL for a new connection), ``supplied`` and the array ``declared``.
    """
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(
        F.coalesce("existing", empty),
        lambda k, v: (F.array_contains("declared", k) | (k == "codeOverrides")) & ~F.map_contains_key(F.coalesce("supplied", empty), k),
    )

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)

    merged = over(over(F.coalesce("defaults", empty), kept), F.coalesce("supplied", empty))
    rows = requests.withColumn("_v", merged)
    role = F.try_element_at("_v", F.lit("connectionRole"))
    was_server = F.coalesce(F.try_element_at("existing", F.lit("connectionRole")) == "SERVER", F.lit(False))
    turned = was_server & (role == "CLIENT") & ~F.map_contains_key(F.coalesce("supplied", empty), F.lit("port"))
    drop = F.coalesce(turned | (role == "SERVER"), F.lit(False)) | ~F.array_contains("declared", F.lit("port"))
    return rows.withColumn("values", F.map_filter("_v", lambda k, v: ~((k == "port") & drop))).drop("_v")


def visibility(fields: DataFrame, max_depth: int = 8) -> DataFrame:
    """Which fields of each connection are shown, following ``visibleWhen`` upwards.

    ``fields`` holds (connection_id, key, required, parent, operator, expected ARRAY, value, parent_value). A field is
    shown when its own condition holds and its controlling field is shown; the chain is at most as long as the
    profile's field list, and a chain that returns to itself hides its fields.
    """
    holds = (
        F.when(F.col("parent").isNull(), True)
        .when(F.col("operator") == "EQUALS", F.col("parent_value").eqNullSafe(F.get("expected", F.lit(0))))
        .when(F.col("operator") == "NOT_EQUALS", ~F.col("parent_value").eqNullSafe(F.get("expected", F.lit(0))))
        .when(F.col("operator") == "IN", F.coalesce(F.array_contains("expected", F.col("parent_value")), F.lit(False)))
        .when(F.col("operator") == "NOT_IN", ~F.coalesce(F.array_contains("expected", F.col("parent_value")), F.lit(False)))
        .otherwise(False)
    )
    base = fields.withColumn("_own", holds)
    edges = base.select("connection_id", F.col("key").alias("_next"), F.col("parent").alias("_up"), F.col("_own").alias("_up_own"))
    rows = base.withColumn("_next", F.col("parent")).withColumn("visible", F.col("_own"))
    for _ in range(max_depth):
        rows = rows.join(edges, ["connection_id", "_next"], "left").withColumn(
            "visible", F.col("visible") & F.coalesce("_up_own", F.lit(True))).withColumn("_next", F.col("_up")).drop("_up", "_up_own")
    # Whoever is still climbing after the deepest possible chain climbs in a circle.
    return rows.withColumn("visible", F.col("visible") & F.col("_next").isNull()).drop("_next", "_own")


def visible_by_document(fields: Column, values: Column) -> Column:
    """D26 inside one connection's row: the array of shown fields.

    A profile's field list is one bounded array, so the climb is a few passes over it and needs no join. ``fields``:
    array of (key, required, parent, operator, expected); ``values``: map of the connection's values.
    """

    def own(f: Column) -> Column:
        actual = F.try_element_at(values, f["parent"])
        listed = F.coalesce(F.array_contains(f["expected"], actual), F.lit(False))
        return (
            F.when(f["parent"].isNull(), True)
            .when(f["operator"].isin("EQUALS", "IN"), listed)
            .when(f["operator"].isin("NOT_EQUALS", "NOT_IN"), ~listed)
            .otherwise(False)
        )

    shown_alone = F.filter(fields, own)
    keys = F.transform(fields, lambda f: f["key"])

    def settle(shown: Column) -> Column:
        names = F.transform(shown, lambda f: f["key"])
        return F.filter(shown, lambda f: f["parent"].isNull() | ~F.array_contains(keys, f["parent"]) | F.array_contains(names, f["parent"]))

    # Each pass hides the fields whose controller was hidden; as many passes as fields reach the bottom.
    return F.aggregate(fields, shown_alone, lambda shown, _: settle(shown))


def missing_required(fields: DataFrame) -> DataFrame:
    """Shown required fields without a value. Needs connection_id, fields, values (see visible_by_document)."""
    shown = visible_by_document(F.col("fields"), F.col("values"))
    lacking = F.filter(shown, lambda f: f["required"] & ~filled(F.try_element_at("values", f["key"])))
    return fields.withColumn("missing", F.array_sort(F.transform(lacking, lambda f: f["key"])))


def value_issues(rows: DataFrame) -> DataFrame:
    """Supplied values that the profile does not allow. Needs connection_id, values (map of JSON texts),
    descriptors (array of key, input_kind, choices), protocol."""
    each = rows.select("connection_id", "descriptors", "protocol", F.explode(F.map_entries("values")).alias("v"))
    key, raw = F.col("v.key"), F.col("v.value")
    d = F.get(F.filter("descriptors", lambda x: x["key"] == F.col("v.key")), F.lit(0))
    text = F.when(raw.startswith('"'), F.substring(raw, F.lit(2), F.length(raw) - 2))
    number = raw.rlike(r"\A-?\d+(?:\.\d+)?\z")
    kind_ok = (
        F.when(d["input_kind"] == "NUMBER", number)
        .when(d["input_kind"] == "BOOLEAN", raw.isin("true", "false"))
        .when(d["input_kind"].isin("TEXT", "SECRET", "FILE_PATH", "SELECT"), text.isNotNull())
        .otherwise(False)
    )
    is_port = key.isin("port", "outboundPort") & F.col("protocol").isin("ASTM", "HL7")
    port_ok = raw.rlike(r"\A\d+\z") & raw.try_cast("int").between(1, 65535)
    issue = (
        F.when(~filled(key), "blank_key")
        .when(key == "codeOverrides", None)
        .when(d.isNull() & (key == "port"), None)
        .when(d.isNull(), "undeclared")
        .when(raw == "null", "null")
        .when(~kind_ok, "type")
        .when((d["input_kind"] == "SELECT") & ~F.array_contains(d["choices"], text), "choice")
        .when(is_port & ~F.coalesce(port_ok, F.lit(False)), "port_range")
    )
    return each.select("connection_id", key.alias("key"), issue.cast("string").alias("issue")).filter("issue IS NOT NULL")


def upserts(current: DataFrame, requests: DataFrame) -> DataFrame:
    """What each save request does: CREATED, UNCHANGED, UPDATED (revision + 1) or CONFLICT.

    ``current``: connection_id, revision, fingerprint; ``requests``: connection_id, expected_revision, fingerprint.
    """
    now = current.select("connection_id", F.col("revision").alias("_rev"), F.col("fingerprint").alias("_fp"))
    rows = requests.join(now, "connection_id", "left")
    result = (
        F.when(F.col("_rev").isNull(), "CREATED")
        .when(~F.col("expected_revision").eqNullSafe(F.col("_rev")), "CONFLICT")
        .when(F.col("_fp") == F.col("fingerprint"), "UNCHANGED")
        .otherwise("UPDATED")
    )
    revision = F.when(result == "CREATED", 1).when(result == "UPDATED", F.col("_rev") + 1).otherwise(F.col("_rev"))
    return rows.withColumn("result", result).withColumn("revision", revision.cast("int")).drop("_rev", "_fp")


def activation_history(commands: DataFrame, keys: tuple[str, ...] = ("connection_id",), chunk: str = "day") -> DataFrame:
    """What each runtime command did, and the runtime revision after it.

    Needs connection_id, command_id, at, action, expected_revision, config_revision, ready. A stale revision is
    refused; a repeated command id answers as before; an activation without required values is rejected; a command
    that asks for the state in force changes nothing; every other one is APPLIED and raises the revision. The state
    in force is the last accepted request before (accepted commands always leave the state they ask for), so it is
    carried forward in time chunks rather than folded in one task.
    """
    from .ordered import last_before, running_sum

    k, order = list(keys), ["at", "command_id"]
    bucket = F.date_trunc(chunk, F.col("at"))
    first = commands.groupBy(*k, "command_id").agg(F.min("at").alias("_first_at"))
    rows = commands.join(first, [*k, "command_id"])
    stale = ~F.col("expected_revision").eqNullSafe(F.col("config_revision"))
    repeated = F.col("at") > F.col("_first_at")
    rejected = (F.col("action") != "DEACTIVATE") & ~F.col("ready")
    wanted = F.when(F.col("action") == "ACTIVATE", "ROUTINE").when(F.col("action") == "START_SETUP", "SETUP").otherwise("INACTIVE")
    accepted = ~stale & ~repeated & ~rejected
    rows = rows.withColumn("_wanted", wanted).withColumn("_ok", accepted)
    rows = last_before(rows, k, bucket, order, F.when(F.col("_ok"), F.col("_wanted")), "_state")
    changed = F.col("_ok") & (F.col("_wanted") != F.coalesce("_state", F.lit("INACTIVE")))
    rows = running_sum(rows.withColumn("_changed", changed), k, bucket, order, F.when(F.col("_changed"), 1).otherwise(0), "_n")
    outcome = (
        F.when(stale, "CONFLICT").when(repeated, "REPEATED").when(rejected, "REJECTED")
        .when(F.col("_changed"), "APPLIED").otherwise("ALREADY_APPLIED")
    )
    return rows.withColumn("outcome", outcome).withColumn("runtime_revision", (F.col("_n") + 1).cast("int")).withColumn(
        "purpose", F.when(F.col("_changed") & (F.col("_wanted") != "INACTIVE"), F.col("_wanted"))
    ).drop("_first_at", "_wanted", "_ok", "_state", "_changed", "_n")


def listener_port(protocol: Column, lower_layer: Column, ports: dict[tuple[str, str], int] | None = None) -> Column:
    """The shared listener port of a profile; NULL for a protocol or lower layer without one."""
    out = F.lit(None).cast("int")
    for (name, layer), port in (ports or LISTENER_PORTS).items():
        out = F.when((protocol == name) & (F.lit(layer == "") | (lower_layer == layer)), port).otherwise(out)
    return out


def refused_activations(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """Candidates that an already active connection could not be told apart from."""
    from .attribution import indistinguishable

    pairs = indistinguishable(candidates.unionByName(active.select(*candidates.columns)))
    ids = active.select(F.col("connection_id").alias("_active"))
    both = pairs.select("connection_id", F.col("other_id")).unionByName(pairs.select(F.col("other_id").alias("connection_id"), F.col("connection_id").alias("other_id")))
    hits = both.join(ids, both["other_id"] == ids["_active"], "left_semi").select("connection_id").distinct()
    return candidates.join(hits, "connection_id", "left_semi")


def readiness(connections: DataFrame) -> DataFrame:
    """Blockers of each connection. Needs profile_found, missing (array) and restore_failure."""
    blockers = F.filter(
        F.array(
            F.when(~F.col("profile_found"), F.lit("profile-unavailable")),
            F.when(F.col("restore_failure").isNotNull(), F.lit("runtime-restore-failed")),
            F.when(F.col("profile_found") & (F.size("missing") > 0), F.lit("missing-required-values")),
        ),
        lambda b: b.isNotNull(),
    )
    return connections.withColumn("blockers", blockers).withColumn("ready", F.size("blockers") == 0)


def pinned_fields(parsed: DataFrame) -> DataFrame:
    """Connection fields of each profile as one array of (key, required, parent, operator, expected, input_kind, choices).

    Instrument connections take an optional port, shown to the side that dials out.
    """
    instrument = F.col("doc.protocol.name").isin("ASTM", "HL7")

    def field(f: Column) -> Column:
        port = instrument & (f["key"] == "port")
        optional = instrument & f["key"].isin("port", "outboundPort")
        value = f["visibleWhen"]["value"]
        many = F.from_json(value, "array<string>")
        return F.struct(
            f["key"].alias("key"), (F.coalesce(f["required"], F.lit(False)) & ~optional).alias("required"),
            F.when(port, "connectionRole").otherwise(f["visibleWhen"]["fieldKey"]).alias("parent"),
            F.when(port, "EQUALS").otherwise(f["visibleWhen"]["operator"]).alias("operator"),
            F.when(port, F.array(F.lit("CLIENT"))).when(value.startswith("["), many).otherwise(F.array(clip(value))).alias("expected"),
            f["inputKind"].alias("input_kind"), F.transform(f["choices"], lambda c: c["value"]).alias("choices"),
        )

    return parsed.select(*PIN, F.transform("doc.connectionFields", field).alias("fields"))
