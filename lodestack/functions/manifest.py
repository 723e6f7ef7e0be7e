"""Decisions about manifest components, as nullable columns: null is unresolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base levels and flags of a permission's protection.
PROTECTION_BASES = ("normal", "dangerous", "signature", "signatureOrSystem", "internal")
PROTECTION_FLAGS = (
    (0x10, "privileged"), (0x20, "development"), (0x40, "appop"), (0x80, "pre23"), (0x100, "installer"), (0x200, "verifier"),
    (0x400, "preinstalled"), (0x800, "setup"), (0x1000, "instant"), (0x2000, "runtimeOnly"), (0x4000, "oem"), (0x8000, "vendorPrivileged"),
)


def exported(declared: Column, kind: Column, has_filters: Column, target_sdk: Column) -> Column:
    """The effective value: declared text, component kind, whether it has an intent filter, and the SDK as a number or null."""
    return (
        F.when(declared == "true", True)
        .when(declared == "false", False)
        .when(declared.isNotNull(), None)
        .when(kind == "provider", F.when(target_sdk.isNotNull(), target_sdk <= 16))
        .when(has_filters & (target_sdk.isNull() | (target_sdk >= 31)), None)
        .otherwise(has_filters)
    )


def exported_reason(declared: Column, kind: Column, has_filters: Column, target_sdk: Column) -> Column:
    return (
        F.when(declared.isin("true", "false"), "explicit")
        .when(declared.isNotNull(), "unresolved value")
        .when((kind == "provider") & target_sdk.isNull(), "unknown sdk")
        .when(kind == "provider", "provider default")
        .when(has_filters & target_sdk.isNull(), "unknown sdk")
        .when(has_filters & (target_sdk >= 31), "missing exported")
        .otherwise("filter default")
    )


def _flag(text: Column) -> Column:
    """An enabled flag: absent is true, anything but true and false unresolved."""
    return F.when(text.isNull() | (text == "true"), True).when(text == "false", False)


def enabled(component: Column, application: Column) -> Column:
    a, b = _flag(component), _flag(application)
    return F.when((a == F.lit(False)) | (b == F.lit(False)), False).when(a & b, True)


def full_class(name: Column, package: Column) -> Column:
    """`.X` and a bare name get the package; references stay."""
    bare = ~name.contains(".") & (package != "") & ~name.rlike("^[@?]")
    return F.when(name.startswith("."), F.concat(package, name)).when(bare, F.concat(package, F.lit("."), name)).otherwise(name)


def permission_state(declared: Column, inherited: Column) -> Column:
    """struct(permission, state): declared, else the application's; empty is explicitly none; a reference is unresolved."""
    value = F.coalesce(declared, inherited)
    state = F.when(value.isNull(), "none").when(value == "", "explicitly_none").when(value.rlike("^[@?]"), "unresolved").when(declared.isNotNull(), "declared").otherwise("inherited")
    return F.struct(F.when(state.isin("declared", "inherited"), value).alias("permission"), state.alias("state"))


def alias_permission(own: Column, targets: Column, target_permission: Column) -> Column:
    """An alias's permission: its own, else that of its only target activity."""
    return F.when(own.isNotNull(), own).when(targets == 1, target_permission)


def launch_field(own: Column, target: Column, default: str, is_alias: Column) -> Column:
    """struct(value, source, resolved): an alias launches as its target says; a reference is not resolved."""
    declared = F.when(is_alias, target).otherwise(own)
    source = F.when(declared.isNull(), "default").when(is_alias, "target").otherwise("declared")
    resolved = declared.isNull() | ~declared.rlike("^[@?]")
    return F.struct(F.coalesce(declared, F.lit(default)).alias("value"), source.alias("source"), resolved.alias("resolved"))


def protection(bits: Column) -> Column:
    """`signature|privileged`; bits without a name come last as hex."""
    base = F.get(F.array(*[F.lit(b) for b in PROTECTION_BASES]), bits.bitwiseAND(F.lit(0xF)).cast("int"))
    known = sum(bit for bit, _ in PROTECTION_FLAGS) | 0xF
    rest = bits.bitwiseAND(F.lit(~known & 0xFFFFFFFF))
    names = [F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in PROTECTION_FLAGS]
    return F.concat_ws("|", F.coalesce(base, F.lit("unknown")), *names, F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest)))))
