"""Rule passes over the tables of a program: classes, supertypes, methods, fields, references, instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroba.functions import names
from corroba.operators.graphs import closure
from corroba.rules.labels import applied

#: Access flags.
STATIC, PRIVATE, CONSTRUCTOR, ANNOTATION = 0x8, 0x2, 0x10000, 0x2000


def annotation_members(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Names of the members of annotations. classes: class, access; methods: item, class."""
    notes = classes.where(F.col("access").bitwiseAND(ANNOTATION) != 0).select("class")
    return applied(methods.join(notes, "class", "left_semi"), "item", "MemberName", "r8/annotation-member-name")


def library_supers(classes: DataFrame, supertypes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(class, library): all supertypes that the program does not define, through those that it does."""
    inside = closure(supertypes.join(classes.select(F.col("class").alias("super")), "super", "left_semi"), "class", "super", max_depth).select(F.col("src").alias("class"), F.col("dst").alias("via"))
    start = classes.select("class", F.col("class").alias("via")).union(inside)
    direct = supertypes.join(classes.select(F.col("class").alias("super")), "super", "left_anti").select(F.col("class").alias("via"), F.col("super").alias("library"))
    return start.join(direct, "via").select("class", "library").distinct()


def library_overrides(classes: DataFrame, supertypes: DataFrame, methods: DataFrame, references: DataFrame) -> DataFrame:
    """Names of instance methods that a referenced method of a library supertype has. methods: item, class, name, proto, access; references: owner, name, proto."""
    known = references.join(classes.select(F.col("class").alias("owner")), "owner", "left_anti").select(F.col("owner").alias("library"), "name", "proto").distinct()
    own = methods.where(F.col("access").bitwiseAND(STATIC | PRIVATE | CONSTRUCTOR) == 0)
    hit = own.join(library_supers(classes, supertypes), "class").join(known, ["library", "name", "proto"], "left_semi").select("item").distinct()
    return applied(hit, "item", "MemberName", "r8/library-override-name")


def declared_above(methods: DataFrame, supertypes: DataFrame) -> DataFrame:
    """(item, declared): whether any program supertype declares the method's name and prototype."""
    above = closure(supertypes, "class", "super").select(F.col("src").alias("class"), F.col("dst").alias("super"))
    theirs = methods.select(F.col("class").alias("super"), "name", "proto").distinct()
    hit = methods.join(above, "class").join(theirs, ["super", "name", "proto"], "left_semi").select("item").distinct()
    return methods.select("item").join(hit.withColumn("declared", F.lit(True)), "item", "left").select("item", F.coalesce("declared", F.lit(False)).alias("declared"))


def constant_stem(field: Column) -> Column:
    """The stem of a field-number constant: the field's name in upper case."""
    return F.upper(field)


def message_names(messages: DataFrame, constants: DataFrame, taken: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """Class names from message definitions with the same set of field numbers: (applications, hints).

    messages: full_name, name, fields; constants: class, package, simple, stem,
    number; taken: package, simple. A set that one message alone has, of three
    fields at least, proves the name if it is free in the package, claimed once and
    no generated name; other sets that name one message are hints (class, name).
    """
    stem = F.transform("fields", lambda f: F.struct(constant_stem(f["name"]).alias("stem"), f["number"].alias("number")))
    sets = messages.select("full_name", "name", F.array_sort(F.array_distinct(stem)).alias("set"), F.size("fields").alias("n")).where("n > 0 and size(set) = n")
    by_set = sets.groupBy("set").agg(F.count("*").alias("messages"), F.count_distinct("name").alias("named"), F.min("name").alias("found")).where("named = 1")
    own = constants.groupBy("class", "package", "simple").agg(F.array_sort(F.collect_set(F.struct("stem", F.col("number").cast("long").alias("number")))).alias("set"))
    found = own.join(by_set, "set").withColumn("claims", F.count("*").over(Window.partitionBy("package", "found")))
    used = taken.select("package", F.col("simple").alias("found")).distinct().withColumn("used", F.lit(True))
    found = found.join(used, ["package", "found"], "left")
    free = (F.col("simple") == F.col("found")) | (F.col("used").isNull() & (F.col("claims") == 1))
    kept = ~names.maybe_generated(F.col("found"), bound) & ~F.col("found").rlike("[0-9]$")
    found = found.withColumn("proven", (F.col("messages") == 1) & (F.size("set") >= 3) & free & kept)
    return applied(found.where("proven"), "class", "ClassName", "r8/protobuf-message-name", "found"), found.where("not proven").select("class", F.col("found").alias("name"))


def data_class_template(pieces: DataFrame) -> DataFrame:
    """(method, name, props): ``Name(a=`` field ``, b=`` field ... ``)``. pieces: method, pos, literal, field (one of both); every property has a field of its own."""
    rows = pieces.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("pos", "literal", "field"))).alias("p")).where("size(p) >= 3 and size(p) % 2 = 1")
    even = F.filter("p", lambda x, i: i % 2 == 0)
    odd = F.filter("p", lambda x, i: i % 2 == 1)
    rows = rows.select("method", F.transform(even, lambda x: x["literal"]).alias("lits"), F.transform(odd, lambda x: x["field"]).alias("fields"))
    head = r"^([a-zA-Z_$][0-9a-zA-Z_$]*)\(([a-zA-Z_$][0-9a-zA-Z_$]*)=$"
    middle = F.slice("lits", 2, F.size("lits") - 2)
    fine = F.get("lits", F.lit(0)).rlike(head) & (F.element_at("lits", -1) == ")") & F.forall(middle, lambda x: F.coalesce(x.rlike(r"^, [a-zA-Z_$][0-9a-zA-Z_$]*=$"), F.lit(False))) & ~F.exists("fields", lambda f: f.isNull()) & (F.size(F.array_distinct("fields")) == F.size("fields"))
    first = F.get("lits", F.lit(0))
    keys = F.concat(F.array(F.regexp_extract(first, head, 2)), F.transform(middle, lambda x: F.regexp_extract(x, r"^, (.*)=$", 1)))
    return rows.where(fine).select("method", F.regexp_extract(first, head, 1).alias("name"), F.transform(F.arrays_zip(keys.alias("key"), F.col("fields").alias("field")), lambda x: F.struct(x["key"].alias("property"), x["field"].alias("field"))).alias("props"))


#: Kinds of inlining hints.
HINTS = ["param-null-check", "discarded-getclass", "inlined-instance-call", "idiom:areEqual", "idiom:collectionSizeOrDefault"]


def inlining_hints(insns: DataFrame) -> DataFrame:
    """(method, idx, kind) of the five kinds of evidence that a call was inlined.

    insns: method, idx, op (invoke-virtual, invoke-static, move-result, instance-of, iget, iput, ...), name, proto, owner, obj (the receiver's register), args (how many), is_param (the receiver is a parameter).
    """
    w = Window.partitionBy("method").orderBy("idx")
    getter = (F.col("op") == "invoke-virtual") & (F.col("name") == "getClass") & (F.col("proto") == "()Ljava/lang/Class;") & (F.col("args") == 1)
    check = getter & F.col("is_param")
    follows = w.rowsBetween(1, 4)
    on_object = F.when(F.col("op").isin("iget", "iput") | (F.col("op").startswith("invoke") & (F.col("op") != "invoke-static")), F.col("obj"))
    sized = F.when(F.col("op").startswith("invoke") & (F.col("name") == "size") & (F.col("proto") == "()I"), 1)
    rows = insns.select(
        "method", "idx", getter.alias("getter"), "is_param", "obj", (F.lead("op").over(w) == "move-result").alias("used"),
        F.min(check.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prologue"), F.collect_list(on_object).over(follows).alias("later"),
        ((F.col("op") == "invoke-virtual") & (F.col("name") == "equals") & (F.col("proto") == "(Ljava/lang/Object;)Z") & (F.col("owner") == "Ljava/lang/Object;") & (F.col("args") == 2)).alias("equals"),
        ((F.col("op") == "instance-of") & (F.col("owner") == "Ljava/util/Collection;")).alias("collection"), F.count(sized).over(w.rowsBetween(1, 7)).alias("sized"),
    )
    unused = F.col("getter") & ~F.coalesce("used", F.lit(False))
    prologue = F.col("is_param") & (F.coalesce("prologue", F.lit(1)) == 1)
    kinds = F.array(
        F.when(unused & prologue, HINTS[0]), F.when(unused & ~prologue, HINTS[1]), F.when(unused & ~prologue & F.array_contains("later", F.col("obj")), HINTS[2]),
        F.when(F.col("equals"), HINTS[3]), F.when(F.col("collection") & (F.col("sized") > 0), HINTS[4]),
    )
    return rows.select("method", "idx", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def profile_key(settings: DataFrame, build: str, key: str, value: str) -> DataFrame:
    """(build, json, key): the canonical JSON of a build's settings, keys in order, and its content key."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    out = settings.groupBy(build).agg(F.to_json(pairs).alias("json"))
    return out.withColumn("key", F.substring(F.sha2("json", 256), 1, 16))
