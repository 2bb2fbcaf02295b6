"""Predicates and decodings of generated names, versions, identifiers and type descriptors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and later characters of generated names, in order of generation.
FIRST = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATER = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that are never generated.
NEVER_GENERATED = ["it", "by", "do"]
#: Parts of names that compilers invent.
SYNTHETIC_PARTS = ["$$ExternalSynthetic", "$$InternalSynthetic", "-$$Nest$", "$r8$", "$-CC", "-IA", "$EnumUnboxing", "$Wrapper", "$VivifiedWrapper"]
#: Letters of primitive types and their names in source.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def maybe_generated(name: Column, longest: Column | int, stop: list[str] = NEVER_GENERATED) -> Column:
    """Of the generator's characters, no longer than ``longest`` and not a stop word, compared as written."""
    return name.rlike("^[a-zA-Z][0-9a-zA-Z]*$") & (F.length(name) <= longest) & ~name.isin(stop)


def capacity_length(count: Column, most: int = 8) -> Column:
    """The least length whose names (26 first, 36 later characters) number ``count`` at least."""
    out, total = F.lit(most), [26 * sum(36**i for i in range(n)) for n in range(1, most + 1)]
    for n in range(most, 0, -1):
        out = F.when(count <= total[n - 1], n).otherwise(out)
    return out


def generator_index(name: Column) -> Column:
    """Place of a name in generation order, from 1: the first character counts singly, each later one 52 * 62^k; null for other names and beyond 64 bits."""
    digit = lambda alphabet, c: F.nullif(F.instr(F.lit(alphabet), c), F.lit(0)).cast("long")
    tail = F.reverse(F.split(F.substring(name, 2, 1 << 20), ""))
    high = F.aggregate(F.filter(tail, lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: F.try_add(F.try_multiply(n, F.lit(62).cast("long")), digit(LATER, c)))
    return F.when(name != "", F.try_add(F.try_multiply(high, F.lit(52).cast("long")), digit(FIRST, F.substring(name, 1, 1))))


def is_synthetic(name: Column) -> Column:
    out = F.lit(False)
    for part in SYNTHETIC_PARTS:
        out = out | name.contains(part)
    return out


def is_fresh(name: Column) -> Column:
    """``name$123``."""
    return name.rlike(r"^(?s:.+)\$[0-9]+$")


def split_base(descriptor: Column) -> Column:
    """The class that ``<base>$$Split<n>;`` or ``<base>$$Splitm<n>;`` was split off; null for others."""
    base = F.regexp_extract(descriptor, r"^(.*)\$\$Splitm?[0-9]+;$", 1)
    return F.when(base != "", F.concat(base, F.lit(";")))


def is_structural(name: Column) -> Column:
    """``hint_hex`` with 4 to 16 hex digits, and ``_n`` after a tie."""
    return name.rlike("^[a-zA-Z][0-9a-zA-Z]*_[0-9a-f]{4,16}(_[0-9]+)?$")


def is_version(text: Column) -> Column:
    """Two to four numbers of at most five digits, then perhaps a suffix."""
    return text.rlike(r"^[0-9]{1,5}(\.[0-9]{1,5}){1,3}(-[0-9a-zA-Z.-]*)?$")


def named_version(text: Column) -> Column:
    """(name, version) of ``name/1.2.3``, three numbers at least; null for others."""
    name, version = F.regexp_extract(text, r"^(.*)/[^/]*$", 1), F.regexp_replace(F.substring_index(text, "/", -1), "^v", "")
    fine = text.contains("/") & name.rlike("^[a-zA-Z][0-9a-zA-Z ._-]{0,39}$") & is_version(version) & (F.size(F.split(F.substring_index(version, "-", 1), r"\.")) >= 3)
    return F.when(fine, F.struct(name.alias("name"), version.alias("version")))


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z][a-z0-9.-]*$") & text.contains("-") & (F.length(text) <= 60)


def is_resource_id(number: Column) -> Column:
    """Package 0x7f and a type from 1 to 0x40 in the upper bytes of an int."""
    return (F.shiftrightunsigned(number, 24) == 0x7F) & F.shiftrightunsigned(number, 16).bitwiseAND(0xFF).between(1, 0x40)


def is_identifier(text: Column) -> Column:
    return text.rlike("^[a-zA-Z_$][0-9a-zA-Z_$]*$")


def is_constant_name(text: Column) -> Column:
    return text.rlike("^[A-Z][A-Z0-9_]*$")


def is_member_name(text: Column) -> Column:
    return text.isin("<init>", "<clinit>") | text.rlike(r"^[^\s\p{Cc}/;\[()<>.:]+$")


def is_descriptor(text: Column) -> Column:
    return text.rlike(r"^(V|\[*([ZBCSIJFD]|L[^\s\p{Cc}/;\[()<>.:]+(/[^\s\p{Cc}/;\[()<>.:]+)*;))$")


def looks_synthetic(descriptor: Column) -> Column:
    """``$$``, a dash, or an empty, numeric or lambda segment after the first ``$`` of the simple name."""
    simple = F.substring_index(F.regexp_replace(descriptor, ";+$", ""), "/", -1)
    later = F.slice(F.split(simple, r"\$"), 2, 1 << 20)
    return simple.contains("$$") | simple.contains("-") | F.exists(later, lambda s: s.rlike("^[0-9]*$") | s.startswith("lambda"))


def package_of(descriptor: Column) -> Column:
    return F.regexp_extract(descriptor, "^L(.*)/[^/]*;$", 1)


def simple_name(descriptor: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(descriptor, "^L", ""), "/", -1), ";$", "")


def sanitised(text: Column) -> Column:
    """Letters and digits only, no digit in front; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, "[^0-9a-zA-Z]", ""), "^[0-9]+", ""), F.lit(""))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def java_type(descriptor: Column) -> Column:
    """``[Ljava/lang/String;`` as ``java.lang.String[]``."""
    dims, base = F.length(F.regexp_extract(descriptor, r"^(\[*)", 1)), F.regexp_replace(descriptor, r"^\[+", "")
    known = F.create_map(*(F.lit(x) for pair in PRIMITIVES.items() for x in pair))
    named = F.replace(F.regexp_replace(base, "^L(.*);$", "$1"), F.lit("/"), F.lit("."))
    return F.concat(F.coalesce(F.try_element_at(known, base), named), F.repeat(F.lit("[]"), dims))


def proto_parts(proto: Column) -> Column:
    """(params, result) of ``(params)result``."""
    params = F.regexp_extract_all(F.regexp_extract(proto, r"^\((.*)\)", 1), F.lit(r"(\[*(?:[ZBCSIJFD]|L[^;]*;))"), F.lit(1))
    return F.struct(params.alias("params"), F.regexp_extract(proto, r"\)(.*)$", 1).alias("result"))


def erased_type(descriptor: Column, stable: Column) -> Column:
    """A class that is not ``stable`` becomes ``L?;``, its array depth kept."""
    return F.when(descriptor.rlike(r"^\[*L") & ~stable, F.concat(F.regexp_extract(descriptor, r"^(\[*)", 1), F.lit("L?;"))).otherwise(descriptor)


def is_platform(descriptor: Column, prefixes: list[str]) -> Column:
    """A primitive, or a class under one of the prefixes."""
    base, out = F.regexp_replace(descriptor, r"^\[+", ""), ~descriptor.rlike(r"^\[*L")
    for p in prefixes:
        out = out | base.startswith(p)
    return out


def erased_proto(proto: Column, prefixes: list[str]) -> Column:
    parts = proto_parts(proto)
    params = F.transform(parts["params"], lambda t: erased_type(t, is_platform(t, prefixes)))
    return F.concat(F.lit("("), F.array_join(params, ""), F.lit(")"), erased_type(parts["result"], is_platform(parts["result"], prefixes)))


def version_key(version: Column) -> Column:
    """Sort key: numbers without zeros at the end, then the rank of the qualifier (alpha, beta, rc, release, others), its first number, its text."""
    numbers = F.transform(F.split(F.substring_index(version, "-", 1), r"\."), lambda x: F.when(x.rlike("^[0-9]{1,18}$"), x.cast("long")).otherwise(F.lit(0).cast("long")))
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    text = F.when(version.contains("-"), F.lower(F.regexp_extract(version, "^[^-]*-(.*)$", 1)))
    rank = F.when(text.isNull(), 3).when(text.rlike("^(alpha|a[0-9])"), 0).when(text.rlike("^(beta|b[0-9])"), 1).when(text.rlike("^(rc|cr)"), 2).otherwise(4)
    first = F.regexp_extract(text, "([0-9]+)", 1)
    return F.struct(F.slice(numbers, 1, last).alias("parts"), rank.alias("rank"), F.when(first.rlike("^[0-9]{1,18}$"), first.cast("long")).otherwise(F.lit(0).cast("long")).alias("n"), F.coalesce(text, F.lit("")).alias("text"))


def hash_permille(key: Column, seed: str, of: int = 1_000_000) -> Column:
    """sha256(seed|key) modulo ``of``, for samples that do not depend on order."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), key), 256), 1, 12), 16, 10).cast("long"), F.lit(of))


def short_hash(text: Column) -> Column:
    """The first eight bytes of SHA-256, as hex."""
    return F.substring(F.sha2(text, 256), 1, 16)
