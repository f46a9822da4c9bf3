"""Column expressions over access flags and names of JVM classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access flags of the JVM class-file format.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, BRIDGE, INTERFACE, ABSTRACT, SYNTHETIC, ENUM = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40, 0x200, 0x400, 0x1000, 0x4000
OBJECT = "java/lang/Object"
# The methods that every object has.
OBJECT_METHODS = [
    ("getClass", "()Ljava/lang/Class;"), ("hashCode", "()I"), ("equals", "(Ljava/lang/Object;)Z"), ("clone", "()Ljava/lang/Object;"), ("toString", "()Ljava/lang/String;"), ("notify", "()V"),
    ("notifyAll", "()V"), ("wait", "()V"), ("wait", "(J)V"), ("wait", "(JI)V"), ("finalize", "()V"),
]
VISIBILITY = ["private", "package-private", "protected", "public"]


def has(access: Column | str, bit: int) -> Column:
    return F.col(access).bitwiseAND(bit) != 0 if isinstance(access, str) else access.bitwiseAND(bit) != 0


def visibility(access: str) -> Column:
    """private 0 < package-private 1 < protected 2 < public 3; malformed flags: public, then protected, then private."""
    return F.when(has(access, PUBLIC), 3).when(has(access, PROTECTED), 2).when(has(access, PRIVATE), 0).otherwise(1)


def visibility_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VISIBILITY)), level + 1)


def package(name: str) -> Column:
    return F.regexp_extract(name, "^(.*)/", 1)


def dotted(name: str) -> Column:
    return F.translate(name, "/", ".")


def array_element(name: str) -> Column:
    """The class of an array type, null for arrays of primitives; other names as they are."""
    return F.when(~F.col(name).startswith("["), F.col(name)).otherwise(F.nullif(F.regexp_extract(name, r"^\[+L(.*);$", 1), F.lit("")))


def is_object_method(name: str, descriptor: str) -> Column:
    return F.array_contains(F.array(*[F.lit(a + d) for a, d in OBJECT_METHODS]), F.concat(name, descriptor))


# The letters of primitive types in descriptors, and the most dimensions of an array.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
_TYPE = r"\[{0,255}(?:[BCDFIJSZV]|L[^;]*;)"


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def _shown_type(x: Column) -> Column:
    core = F.regexp_replace(x, r"^\[+", "")
    name = F.when(core.startswith("L"), simple_name(F.regexp_replace(core, "^L|;$", "")))
    for letter, word in PRIMITIVES.items():
        name = name.when(core == letter, word)
    return F.concat(name, F.repeat(F.lit("[]"), (F.length(x) - F.length(core)).cast("int")))


def pretty_member(owner: str = "owner", name: str = "name", descriptor: str = "descriptor") -> Column:
    """`a.B.m(int, String[])`, `a.B constructor (int)`, `a.B.f: long`, or `a.B` without a member; a malformed descriptor is shown as it is."""
    d, full = F.col(descriptor), F.concat_ws(".", dotted(owner), F.col(name))
    types = F.regexp_extract_all(F.regexp_extract(d, r"^\(([^)]*)\)", 1), F.lit(f"({_TYPE})"), F.lit(1))
    params = F.concat(F.lit("("), F.array_join(F.transform(types, _shown_type), ", "), F.lit(")"))
    method, type_ = d.rlike(rf"^\((?:{_TYPE})*\)"), d.rlike(f"^{_TYPE}")
    return (
        F.when(F.col(name).isNull(), dotted(owner))
        .when(method & (F.col(name) == "<init>"), F.concat(dotted(owner), F.lit(" constructor "), params))
        .when(method, F.concat(full, params))
        .when(type_, F.concat(full, F.lit(": "), _shown_type(F.regexp_extract(d, f"^({_TYPE})", 1))))
        .otherwise(F.concat_ws(" ", full, d))
    )
