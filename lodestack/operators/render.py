"""Class sources: a Java declaration of every member, with the bytecode listing as the body.

Bodies are not reconstructed as Java statements: every method with code is a `dex_fallback` in the coverage, and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.names import quoted, simple_type, type_name

# Access flags and their keywords, in the order in which Java writes them.
CLASS_FLAGS = ((0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x400, "abstract"), (0x10, "final"))
MEMBER_FLAGS = ((0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x400, "abstract"), (0x8, "static"), (0x10, "final"))
FIELD_FLAGS = (*MEMBER_FLAGS, (0x80, "transient"), (0x40, "volatile"))
METHOD_FLAGS = (*MEMBER_FLAGS, (0x20, "synchronized"), (0x100, "native"), (0x800, "strictfp"))


def modifiers(access: Column, flags: tuple) -> Column:
    """Keywords with a space after each."""
    words = [F.when(access.bitwiseAND(F.lit(bit)) != 0, F.lit(f"{word} ")) for bit, word in flags]
    return F.concat(*[F.coalesce(w, F.lit("")) for w in words])


def header(c: DataFrame) -> Column:
    """`public abstract class Name extends A implements B, C`."""
    shown = F.when(F.col("is_interface"), F.col("access").bitwiseAND(F.lit(~0x400))).otherwise(F.col("access"))
    kind = F.when(F.col("is_annotation"), "@interface").when(F.col("is_interface"), "interface").when(F.col("access").bitwiseAND(F.lit(0x4000)) != 0, "enum").otherwise("class")
    parent = F.when(F.col("superclass").isNotNull() & ~F.col("superclass").isin("java.lang.Object", "java.lang.Enum") & ~F.col("is_interface"), F.concat(F.lit(" extends "), "superclass"))
    word = F.when(F.col("is_interface"), " extends ").otherwise(" implements ")
    others = F.when((F.size("interfaces") > 0) & ~F.col("is_annotation"), F.concat(word, F.array_join("interfaces", ", ")))
    return F.concat(modifiers(shown, CLASS_FLAGS), kind, F.lit(" "), simple_type(F.col("class_id")), F.coalesce(parent, F.lit("")), F.coalesce(others, F.lit("")))


def field_lines(fields: DataFrame, values: DataFrame) -> DataFrame:
    """(class_id, kind, idx, text) of fields, with the constants that are known."""
    top = values.where("path = ''").select("field_id", F.col("kind").alias("_kind"), "value")
    shown = F.when(F.col("_kind") == "string", quoted(F.col("value"))).when(F.col("_kind").isin("int", "short", "byte", "boolean"), F.col("value")).when(F.col("_kind") == "long", F.concat("value", F.lit("L"))).when(F.col("_kind") == "null", F.lit("null"))
    joined = fields.join(top, "field_id", "left")
    tail = F.coalesce(F.concat(F.lit(" = "), shown), F.lit(""))
    line = F.concat(F.lit("    "), modifiers(F.col("access"), FIELD_FLAGS), type_name(F.col("type")), F.lit(" "), "name", tail, F.lit(";"))
    return joined.select("class_id", F.lit(0).alias("kind"), "idx", line.alias("text"))


def method_blocks(methods: DataFrame, listings: DataFrame) -> DataFrame:
    """(class_id, kind, idx, text) of methods: a Java signature, and the listing as a comment where there is code."""
    joined = methods.join(listings.select("method_id", F.col("text").alias("_listing")), "method_id", "left")
    owner = simple_type(F.col("class_id"))
    arguments = F.array_join(F.transform("parameters", lambda p, i: F.concat(type_name(p), F.lit(" p"), i.cast("string"))), ", ")
    named = F.when(F.col("name") == "<init>", F.concat(owner, F.lit("("), arguments, F.lit(")"))).when(F.col("name") == "<clinit>", F.lit("static")).otherwise(F.concat(type_name(F.col("returns")), F.lit(" "), "name", F.lit("("), arguments, F.lit(")")))
    flags = F.when(F.col("name") == "<clinit>", F.lit("")).otherwise(modifiers(F.col("access"), METHOD_FLAGS))
    body = F.concat(F.lit(" {\n        /* dex\n"), F.regexp_replace(F.replace("_listing", F.lit("*/"), F.lit("* /")), "(?m)^", "        "), F.lit("\n        */\n    }"))
    text = F.concat(F.lit("    "), flags, named, F.when(F.col("has_code") & F.col("_listing").isNotNull(), body).when(F.col("has_code"), F.lit(" { /* not read */ }")).otherwise(F.lit(";")))
    return joined.select("class_id", F.lit(1).alias("kind"), "idx", text.alias("text"))


def class_sources(classes: DataFrame, fields: DataFrame, methods: DataFrame, listings: DataFrame, values: DataFrame) -> DataFrame:
    """(class_id, text, sha256, methods, dex_fallback, omitted): one row a class; a class is bounded by its format."""
    members = field_lines(fields, values).unionByName(method_blocks(methods, listings))
    body = members.groupBy("class_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "idx", "text"))), lambda r: r["text"]), "\n\n").alias("_body"))
    read = listings.select("method_id", F.lit(True).alias("_read"))
    status = methods.join(read, "method_id", "left").groupBy("class_id").agg(
        F.count(F.lit(1)).alias("methods"),
        F.count(F.when(F.col("has_code") & F.col("_read"), 1)).alias("dex_fallback"),
        F.count(F.when(F.col("has_code") & F.col("_read").isNull(), 1)).alias("omitted"),
    )
    package = F.when(F.col("package") != "", F.concat(F.lit("package "), "package", F.lit(";\n\n"))).otherwise(F.lit(""))
    text = F.concat(package, header(classes), F.lit(" {\n"), F.coalesce(F.concat("_body", F.lit("\n")), F.lit("")), F.lit("}\n"))
    out = classes.join(body, "class_id", "left").join(status, "class_id", "left").select("class_id", text.alias("text"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("methods", "dex_fallback", "omitted")])
    return out.withColumn("sha256", F.sha2("text", 256))


def definitions(sources: DataFrame) -> DataFrame:
    """(class_id, line, name) of the member declarations in class sources."""
    lines = sources.select("class_id", F.posexplode(F.split("text", "\n")).alias("_i", "_t"))
    name = F.regexp_extract("_t", r"^    \S.*?([\w$]+)(?:\(.*| = .*|;)$", 1)
    return lines.select("class_id", (F.col("_i") + 1).cast("long").alias("line"), name.alias("name")).where("name <> ''")
