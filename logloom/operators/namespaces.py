"""Package namespaces: which a log shows, and whose code an issue is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import found
from .tree import boundary_crossings, clamped_depth

# fixed values: namespaces with their vendor, product and category; packages of the platform's own maker say so
VENDORS = {
    "SBQQ": ("platform", "CPQ", "PLATFORM_INTERNAL"),
    "blng": ("platform", "Billing", "PLATFORM_INTERNAL"),
    "fferpcore": ("Certinia", "FinancialForce Core", "ISV_PARTNER"),
    "c2g": ("Certinia", "Financial Management", "ISV_PARTNER"),
    "pse": ("Certinia", "Professional Services Automation", "ISV_PARTNER"),
    "nFORCE": ("nCino", "nCino Banking OS", "ISV_PARTNER"),
    "APXT": ("Conga", "Conga Composer", "ISV_PARTNER"),
    "dsfs": ("DocuSign", "DocuSign", "APPEXCHANGE"),
    "fflib_apex_mocks": ("Apex Mocks", "Apex Mocks Testing Framework", "APPEXCHANGE"),
    "sflabs": ("platform labs", "Labs Components", "PLATFORM_INTERNAL"),
    "vlocity_cmt": ("platform", "Industries", "PLATFORM_INTERNAL"),
}
# fixed values: visibility of the code of known namespaces
KNOWN_VISIBILITY = {
    "SBQQ": "PRIVATE", "blng": "PRIVATE", "fferpcore": "PRIVATE", "c2g": "PRIVATE", "pse": "PRIVATE", "nFORCE": "PRIVATE", "APXT": "PRIVATE", "dsfs": "PRIVATE",
    "fflib_apex_mocks": "PUBLIC", "sflabs": "PUBLIC", "vlocity_cmt": "PRIVATE",
}
# fixed values: names of the platform that are no namespaces
PLATFORM = ("System", "Schema", "Database", "ApexPages", "Test", "Auth", "Cache", "Canvas", "ConnectApi", "Dom", "Flow", "Http", "Messaging", "Reports", "Site", "UserInfo", "Limits", "Math", "JSON", "String", "List", "Map", "Set", "Trigger", "Batch")


# fixed values: namespaces whose vendor a piece of code is attributed to
CODE_VENDORS = {
    "SBQQ": ("platform", "CPQ (Steelbrick)"),
    "fflib_apex_mocks": ("Apex Mocks", "Testing Framework"),
    "fferpcore": ("Certinia", "Financial Force Core"),
    "c2g": ("Certinia", "Financial Management"),
    "pse": ("Certinia", "Professional Services Automation"),
}


def code_attribution(namespace: Column) -> Column:
    """struct(is_managed, can_modify, vendor, product): code without a namespace is the user's own."""
    managed = F.coalesce(namespace != "", F.lit(False))
    facts = F.create_map(*[x for k, v in CODE_VENDORS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("vendor"), F.lit(v[1]).alias("product")))])
    fact = F.element_at(facts, namespace)
    return F.struct(managed.alias("is_managed"), (~managed).alias("can_modify"), fact["vendor"].alias("vendor"), fact["product"].alias("product"))


def namespace_prefix(name: Column) -> Column:
    return found(name, r"^([a-zA-Z0-9]+)__")


def strip_namespace(name: Column) -> Column:
    return F.regexp_replace(name, r"^[a-zA-Z0-9]+__", "")


def _likely(name: Column) -> Column:
    return F.when(~name.isin(*PLATFORM) & name.rlike(r"^[a-zA-Z][a-zA-Z0-9_]{1,14}$"), name)


def shown_namespace() -> Column:
    """The namespace that an event's own fields show: entering a package, its field, its class, its unit."""
    by_class = F.when(F.col("type").isin("METHOD_ENTRY", "METHOD_EXIT"), _likely(found(F.col("class_name"), r"^([a-zA-Z_][a-zA-Z0-9_]*)\.")))
    by_unit = _likely(found(F.col("unit_name"), r"^([a-zA-Z_][a-zA-Z0-9_]*?)(?:__|\.)"))
    return F.coalesce(F.when(F.col("namespace") != "", F.col("namespace")), by_class, by_unit)


def vendors(spark) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in VENDORS.items()], "namespace string, vendor string, product string, category string")


def detect_namespaces(events: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, namespace, first_id, vendor, product, category, is_managed)."""
    seen = events.select(key, "id", shown_namespace().alias("namespace")).where("namespace is not null").groupBy(key, "namespace").agg(F.min("id").alias("first_id"))
    out = seen.join(F.broadcast(vendors(events.sparkSession)), "namespace", "left")
    low = F.lower("namespace")
    guess = F.when(low.startswith("sf"), "PLATFORM_INTERNAL").when(F.length("namespace") <= 6, "ISV_PARTNER").otherwise("UNKNOWN")
    return out.withColumns({"category": F.coalesce("category", guess), "is_managed": F.col("vendor").isNotNull() | F.length("namespace").between(2, 6)})


def execution_context(events: DataFrame) -> DataFrame:
    """events with context_ns: the namespace whose package the event runs in, entered and left as a stack."""
    leaves = F.col("type").isin("METHOD_EXIT", "CODE_UNIT_FINISHED") & shown_namespace().isNull()
    enters = F.col("type") == "ENTERING_MANAGED_PKG"
    deep = clamped_depth(events, F.when(enters, 1).when(leaves, -1).otherwise(0))
    asks = deep.select("*", F.col("depth_after").alias("_l"), F.lit(1).alias("_a"))
    gives = deep.where(enters).select("*", F.col("depth_after").alias("_l"), F.lit(0).alias("_a"))
    w = Window.partitionBy("log_id", "_l").orderBy("id", "_a").rowsBetween(Window.unboundedPreceding, 0)
    both = asks.unionByName(gives).withColumn("context_ns", F.when(F.col("_l") > 0, F.last(F.when(F.col("_a") == 0, F.col("namespace")), ignorenulls=True).over(w)))
    return both.where("_a = 1").drop("_l", "_a", "depth_after")


def crossings(events: DataFrame) -> DataFrame:
    return boundary_crossings(execution_context(events), F.col("context_ns"))


def obfuscated_name(name: Column) -> Column:
    return (F.length(name) <= 2) | name.rlike(r"^[a-zA-Z][0-9a-zA-Z]{0,4}$")


def namespace_stats(events: DataFrame, keys: tuple[str, ...] = ("log_id",), namespace: str = "namespace", duration: str = "duration") -> DataFrame:
    """Events and time of each namespace, with its share of the log's time."""
    own = events.where(F.col(namespace).isNotNull()).groupBy(*keys, namespace).agg(F.count("*").alias("n_events"), F.sum(F.coalesce(duration, F.lit(0))).alias("time"))
    total = F.sum("time").over(Window.partitionBy(*keys))
    return own.withColumn("pct", F.when(total > 0, 100 * F.col("time") / total).otherwise(0.0))


def attribution(managed: Column, user: Column, boundary: Column) -> Column:
    """Whose an issue is, from three sums of evidence."""
    return F.when((boundary > 0.5) & (user > 0) & (managed > 0), "BOUNDARY").when((managed > user) & (managed > 0.3), "MANAGED_PACKAGE").when(user > managed, "USER_CODE").otherwise("UNKNOWN")


def attribution_confidence(managed: Column, user: Column, boundary: Column) -> Column:
    source, most = attribution(managed, user, boundary), F.lit(0.9)
    return F.when(source == "BOUNDARY", F.least(most, boundary)).when(source == "MANAGED_PACKAGE", F.least(most, 0.5 + managed)).when(source == "USER_CODE", F.least(most, 0.5 + user)).otherwise(0.5)


# fixed values: errors that tell of a package
PACKAGE_ERRORS = (r"(?i)UNABLE_TO_LOCK_ROW.*managed", r"FIELD_CUSTOM_VALIDATION_EXCEPTION.*\w{2,15}__", r"Apex script unhandled.*\w{2,15}\.")


def attribute_issues(issues: DataFrame, events: DataFrame, near: int = 5) -> DataFrame:
    """(log_id, det_seq, managed, user, boundary, attribution, attribution_confidence) of issues with event ids; a column code_snippet is read if there.

    Evidence adds up: entering a package, other namespaces that events show, class prefixes, trigger and handler names, obfuscated methods,
    namespaces and errors in the snippet, and each crossing within `near` ids. Crossings are found by buckets of ids, not by comparing with a log's all."""
    key = ["log_id", "det_seq"]
    ids = issues.select(*key, F.explode("event_ids").alias("id")).distinct()
    e = ids.join(events.select("log_id", "id", "type", "class_name", "method_name", "namespace"), ["log_id", "id"])
    enters, named = F.col("type") == "ENTERING_MANAGED_PKG", F.coalesce(F.col("namespace"), F.lit("")) != ""
    spaces = e.where(named).groupBy(*key, "namespace").agg(F.count_if(enters).alias("n"), F.min(F.when(enters, F.col("id"))).alias("e"), F.min(F.when(~enters, F.col("id"))).alias("p"))
    # a namespace counts of its own only where no event before it has entered the package
    markers = spaces.groupBy(*key).agg(F.sum(0.9 * F.col("n") + F.when(F.col("p").isNotNull() & (F.col("e").isNull() | (F.col("p") < F.col("e"))), 0.8).otherwise(0.0)).alias("markers"))
    method = F.col("type").isin("METHOD_ENTRY", "METHOD_EXIT")
    prefix, trigger = method & F.col("class_name").rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*__"), method & F.col("class_name").rlike("Trigger|Handler")
    odd = method & (F.length("method_name") > 0) & obfuscated_name(F.col("method_name"))
    code = e.groupBy(*key).agg((0.75 * F.count_if(prefix) + 0.25 * F.count_if(trigger) + 0.7 * F.count_if(odd)).alias("code"), (0.25 * F.count_if(trigger)).alias("handlers"))
    width = 2 * near + 1
    cross = crossings(events).select("log_id", F.col("id").alias("cross_id"), F.explode(F.array_distinct(F.array(F.floor((F.col("id") - near) / width), F.floor((F.col("id") + near) / width)))).alias("_b"))
    close = ids.withColumn("_b", F.floor(F.col("id") / width)).join(cross, ["log_id", "_b"]).where(F.abs(F.col("id") - F.col("cross_id")) <= near)
    bounds = close.groupBy(*key).agg((0.85 * F.count_distinct("cross_id")).alias("boundary"))
    text = F.col("code_snippet") if "code_snippet" in issues.columns else F.lit(None).cast("string")
    told = 0.65 * F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Z][a-zA-Z0-9_]{1,14})__\w+"), 1)))
    error = F.coalesce(text.rlike("|".join(f"(?:{p})" for p in PACKAGE_ERRORS)), F.lit(False))
    out = issues.select(*key, (told + F.when(error, 0.6).otherwise(0.0)).alias("told")).distinct()
    for part in (markers, code, bounds):
        out = out.join(part, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.select(*key, (z("markers") + z("code") + z("told")).alias("managed"), (F.when(F.col("markers").isNull(), 0.7).otherwise(0.0) + z("handlers")).alias("user"), z("boundary").alias("boundary"))
    scores = (F.round("managed", 9), F.round("user", 9), F.round("boundary", 9))
    return out.withColumns({"attribution": attribution(*scores), "attribution_confidence": attribution_confidence(*scores)})


# fixed values: names of methods that are short but not obfuscated, shapes of obfuscated and of readable names
FRAMEWORK_METHODS = ("execute", "run", "invoke", "handle", "process")
OBFUSCATED_SHAPES = (r"(?i)^[a-z]\z", r"(?i)^[a-z][0-9a-z]+\z", r"^(.)\1{2,}\z", r"(?i)^__[a-z]+\z", r"(?i)^[a-z]+_\d+\z")
READABLE_SHAPES = (r"^[a-z][a-zA-Z0-9]*\z", r"^(get|set|handle|process|create|update|delete|validate|calculate)[A-Z]", r"^(on|handle|before|after)[A-Z]", r"^test[A-Z]")


def obfuscated_method(name: Column) -> Column:
    shaped = name.rlike("|".join(f"(?:{p})" for p in OBFUSCATED_SHAPES[:2])) | name.rlike(OBFUSCATED_SHAPES[2]) | name.rlike("|".join(f"(?:{p})" for p in OBFUSCATED_SHAPES[3:]))
    return ~F.lower(name).isin(*FRAMEWORK_METHODS) & (shaped | ((F.length(name) <= 2) & ~name.rlike(r"(?i)^(do|go|is|on)\z")))


def readable_method(name: Column) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in READABLE_SHAPES)) | (F.length(name).between(5, 50) & name.rlike(r"^[a-z][a-zA-Z0-9_]*\z"))


def visibility(events: DataFrame, key: str = "namespace", name: str = "method_name", stack: str | None = None, order: str = "id") -> DataFrame:
    """(key, n, obfuscated, readable, private, public, visibility, confidence) of each namespace.

    Known packages have what the table says. Else evidence adds up: the share of obfuscated or readable names among the distinct ones, the
    first exception whose frames (column `stack`, an array) tell, and the namespace's length."""
    names = events.where(F.col(key).isNotNull()).select(key, F.when(F.col(name) != "", F.col(name)).alias("_n")).distinct()
    odd = obfuscated_method(F.col("_n"))
    out = names.groupBy(key).agg(F.count("_n").alias("n"), F.count_if(odd).alias("obfuscated"), F.count_if(~odd & readable_method(F.col("_n"))).alias("readable"))
    if stack:
        hidden, clear = F.exists(stack, lambda f: f.rlike(r"\(\d+\)\z|Class\.[A-Z]+\.\d+")), F.exists(stack, lambda f: f.rlike(r"\w+\.\w+\.(\w{5,})"))
        kind = F.when(hidden, "hidden").when(clear, "clear")
        out = out.join(events.select(key, order, kind.alias("_kind")).where("_kind is not null").groupBy(key).agg(F.min_by("_kind", order).alias("_kind")), key, "left")
    else:
        out = out.withColumn("_kind", F.lit(None).cast("string"))
    many = lambda c: F.col("n") < 2 * F.col(c)
    long = F.length(key)
    step = lambda when, x: F.when(when, x).otherwise(0.0)
    private = step(many("obfuscated"), 0.8) + step(F.col("_kind") == "hidden", 0.6) + F.when(long.between(2, 4), 0.4).when(long < 2, 0.3).otherwise(0.0)
    public = step(many("readable") & ~many("obfuscated"), 0.7) + step(F.col("_kind") == "clear", 0.5) + F.when(long > 8, 0.15).when(long > 4, 0.1).otherwise(0.0)
    out = out.withColumns({"private": F.round(private, 4), "public": F.round(public, 4)}).drop("_kind")
    known = F.create_map(*[F.lit(x) for n, v in KNOWN_VISIBILITY.items() for x in (n, v)])
    own = F.when((F.col("private") > F.col("public")) & (F.col("private") > 0.5), "PRIVATE").when((F.col("public") > F.col("private")) & (F.col("public") > 0.5), "PUBLIC").otherwise("UNKNOWN")
    sure = F.when(own == "UNKNOWN", 0.5).otherwise(F.least(F.lit(0.9), 0.5 + F.greatest("private", "public")))
    told = F.element_at(known, F.col(key))
    return out.withColumns({"visibility": F.coalesce(told, own), "confidence": F.when(told.isNotNull(), 0.95).otherwise(F.round(sure, 4))})
