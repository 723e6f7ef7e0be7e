"""Network evidence: uses of known clients, services by annotated interfaces, stacks by their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Package prefixes of widespread network clients.
CLIENTS = {"okhttp3.": "okhttp", "retrofit2.": "retrofit", "java.net.HttpURLConnection": "url-connection", "java.net.URL.": "url", "org.apache.http.": "apache-http", "com.android.volley.": "volley", "io.ktor.client.": "ktor", "javax.net.ssl.": "tls", "java.net.Socket": "socket", "android.webkit.WebView": "webview"}
# Annotation names of HTTP verbs.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "HTTP")
PARAMETERS = ("Path", "Query", "QueryMap", "Header", "HeaderMap", "Body", "Field", "FieldMap", "Part", "PartMap", "Url", "Tag")


def api_usage(calls: DataFrame) -> DataFrame:
    """Calls into known clients: (class_id, method_id, pc, client, callee)."""
    client = None
    for prefix, name in CLIENTS.items():
        test = F.col("callee").startswith(prefix)
        client = F.when(test, F.lit(name)) if client is None else client.when(test, F.lit(name))
    return calls.withColumn("client", client).where("client is not null").select("class_id", "method_id", "pc", "client", "callee")


def services(classes: DataFrame, methods: DataFrame, annotations: DataFrame, values: DataFrame) -> DataFrame:
    """Methods of interfaces with a runtime HTTP annotation: verb, path, status (`proven`, or `ambiguous` for several verbs) and
    what their parameters are bound to; `parameters_known` is null where a runtime annotation of one is not known."""
    simple = F.regexp_extract("type", r"([^/$;]+);$", 1)
    live = annotations.where("visibility = 1").withColumn("simple", simple)
    verbs = live.where((F.col("owner_kind") == "method") & F.col("simple").isin(*VERBS))
    own = values.where("kind = 'string'").select("annotation_id", "path", "value")
    named = verbs.join(own, "annotation_id", "left")
    verb = F.max(F.when((F.col("simple") == "HTTP") & (F.col("path") == "method"), F.col("value")).when(F.col("simple") != "HTTP", F.col("simple")))
    route = F.max(F.when(F.col("path") == F.when(F.col("simple") == "HTTP", "path").otherwise("value"), F.col("value")))
    found = named.groupBy("owner").agg(verb.alias("verb"), route.alias("route"), F.countDistinct("annotation_id").alias("_n"))
    bound = live.where("owner_kind = 'parameter'").groupBy("owner").agg(
        F.sort_array(F.collect_list(F.struct("parameter", "simple"))).alias("bound"),
        F.min(F.col("simple").isin(*PARAMETERS)).alias("_known"),
    )
    interfaces = classes.where("is_interface").select("class_id")
    out = methods.join(interfaces, "class_id", "left_semi").join(found, methods["method_id"] == found["owner"]).drop("owner")
    out = out.join(bound, out["method_id"] == bound["owner"], "left").drop("owner")
    status = F.when(F.col("_n") == 1, "proven").otherwise("ambiguous")
    return out.select("class_id", "method_id", F.when(F.col("_n") == 1, F.col("verb")).alias("verb"), F.when(F.col("_n") == 1, F.col("route")).alias("route"), status.alias("status"), F.transform("bound", lambda p: p["simple"]).alias("parameters"), F.when(F.coalesce("_known", F.lit(True)), True).alias("parameters_known"))


def header_shapes(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Classes shaped like a header list: one String[] field, a (String)String and two (int)String methods."""
    f = fields.where("not is_static").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("type") == "[Ljava/lang/String;").cast("long")).alias("arrays"))
    by_name = F.sum(F.col("signature").rlike(r"\(Ljava/lang/String;\)Ljava/lang/String;$").cast("long"))
    by_index = F.sum(F.col("signature").rlike(r"\(I\)Ljava/lang/String;$").cast("long"))
    m = methods.where("not is_static").groupBy("class_id").agg(by_name.alias("by_name"), by_index.alias("by_index"))
    return f.join(m, "class_id").where("n = 1 and arrays = 1 and by_name >= 1 and by_index >= 2").select("class_id", F.lit("headers").alias("role"))


def url_shapes(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Classes shaped like a URL: three String fields, an int one, and an accessor of a URI or URL."""
    f = fields.where("not is_static").groupBy("class_id").agg(F.sum((F.col("type") == "Ljava/lang/String;").cast("long")).alias("strings"), F.sum((F.col("type") == "I").cast("long")).alias("ints"))
    m = methods.where("returns in ('Ljava/net/URI;', 'Ljava/net/URL;') and size(parameters) = 0").select("class_id").distinct()
    return f.join(m, "class_id", "left_semi").where("strings >= 3 and ints >= 1").select("class_id", F.lit("url").alias("role"))


def structural_stack(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Roles of a stack found by shape alone: headers, url, and requests that hold exactly one of each and a String."""
    heads, urls = header_shapes(fields, methods), url_shapes(fields, methods)
    roles = heads.unionByName(urls).select(F.concat(F.lit("L"), F.translate("class_id", ".", "/"), F.lit(";")).alias("type"), "role")
    held = fields.where("not is_static").join(roles, "type", "left").groupBy("class_id").agg(
        F.sum((F.col("role") == "headers").cast("long")).alias("h"), F.sum((F.col("role") == "url").cast("long")).alias("u"), F.sum((F.col("type") == "Ljava/lang/String;").cast("long")).alias("s")
    )
    request = held.where("h = 1 and u = 1 and s = 1").select("class_id", F.lit("request").alias("role"))
    return heads.unionByName(urls).unionByName(request)


def creations(arguments: DataFrame) -> DataFrame:
    """(method_id, pc, service, base_url): services that a method creates by class literal, with the one base address that
    the same method sets; null where it sets none or several."""
    made = arguments.where(F.col("callee").rlike(r"\.create\(Ljava/lang/Class;\)Ljava/lang/Object;$") & (F.col("kind") == "type"))
    address = arguments.where(F.col("callee").rlike(r"\.baseUrl\(Ljava/lang/String;\)") & (F.col("kind") == "string"))
    one = address.groupBy("method_id").agg(F.countDistinct("value").alias("_n"), F.min("value").alias("_url"))
    service = F.translate(F.regexp_extract("value", r"^L([^;]+);$", 1), "/", ".")
    return made.join(one, "method_id", "left").select("method_id", "pc", service.alias("service"), F.when(F.col("_n") == 1, F.col("_url")).alias("base_url"))
