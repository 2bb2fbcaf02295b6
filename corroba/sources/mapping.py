"""Name mappings as text: parser, normaliser, printer, header, inline frames.

A mapping is lines of text with a line number. ``read_mapping`` gives one row a
line, with its kind, the line of the class and member it belongs to, and its
parsed parts, or an error text for lines that break the grammar. All of it is
regular expressions and windows over the lines of one file, so many files are
parsed at once, one group each; ``print_mapping`` is the inverse, byte for byte.

Grammar: ``original -> obfuscated:`` in the first column; below it, indented,
``type [owner.]name -> obf`` or ``[a:b:]type [owner.]name(params)[:c[:d]] -> obf``;
``# `` comments belong to the last member of the class if they are indented and
there is one, else to the class; those before any class are the preamble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MEMBER = r"^(?:([0-9]+):([0-9]+):)?([^ ]+) (?:([^ (]+)\.)?([^ .(]+)(?:\(([^)]*)\)(?::([0-9]+)(?::([0-9]+))?)?)? -> (.+)$"
#: Types that no package qualifies.
PRIMITIVES = ["void", "boolean", "byte", "char", "short", "int", "long", "float", "double"]


def _part(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, _MEMBER, group), F.lit(""))


def read_mapping(lines: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> DataFrame:
    """One row a line that is not blank: file, line, kind (preamble, class, field, method, comment), class_line, member_line, error, and the parts of its kind."""
    rows = lines.select(F.col(file).alias("file"), F.col(line).alias("line"), F.rtrim(F.col(text)).alias("raw")).where(F.trim("raw") != "")
    t = F.trim("raw")
    indented, comment = F.col("raw").rlike(r"^\s"), t.startswith("#")
    first = F.when(comment, "comment").when(~indented, "class").when(t.contains("("), "method").otherwise("field")
    rows = rows.select("file", "line", "raw", t.alias("t"), indented.alias("indented"), first.alias("kind"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last_value(c, F.lit(True)).over(before)
    rows = rows.withColumn("class_line", last(F.when(F.col("kind") == "class", F.col("line"))))
    rows = rows.withColumn("last_member", last(F.when(F.col("kind").isin("field", "method"), F.col("line"))))
    of_member = F.col("kind").isin("field", "method") | ((F.col("kind") == "comment") & F.col("indented"))
    rows = rows.withColumn("member_line", F.when(of_member & (F.col("last_member") > F.col("class_line")), F.col("last_member")))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "comment") & F.col("class_line").isNull(), "preamble").otherwise(F.col("kind")))
    t, member = F.col("t"), F.col("kind").isin("field", "method")
    head = F.regexp_replace(t, ":$", "")
    low, high = _part(t, 1).try_cast("long"), _part(t, 2).try_cast("long")
    error = (
        F.when((F.col("kind") == "class") & ~t.endswith(":"), "class line must end with ':'")
        .when((F.col("kind") == "class") & ~t.contains(" -> "), "class line missing ' -> '")
        .when(member & F.col("class_line").isNull(), "member line before any class line")
        .when(member & ~t.contains(" -> "), "member line missing ' -> '")
        .when(member & ~t.rlike(_MEMBER), "bad member line")
        .when(member & (low > high), F.concat(F.lit("minified range "), low.cast("string"), F.lit(":"), high.cast("string"), F.lit(" is backwards")))
        .when((F.col("kind") == "field") & low.isNotNull(), "field mapping with a line range")
    )
    json = F.regexp_replace(t, r"^#\s*", "")
    known = F.when(F.col("kind").isin("comment", "preamble") & json.startswith("{"), json)
    return rows.select(
        "file", "line", "kind", "class_line", "member_line", "indented", error.alias("error"),
        F.when(F.col("kind") == "class", F.trim(F.substring_index(head, " -> ", 1))).when(member, _part(t, 5)).alias("original"),
        F.when(F.col("kind") == "class", F.trim(F.regexp_extract(head, "^.*? -> (.*)$", 1))).when(member, F.trim(_part(t, 9))).alias("obfuscated"),
        F.when(member, _part(t, 3)).alias("ty"), F.when(member, _part(t, 4)).alias("owner"),
        F.when(F.col("kind") == "method", F.when(F.regexp_extract(t, _MEMBER, 6) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_extract(t, _MEMBER, 6), ","))).alias("params"),
        F.when(member, low).alias("minified_from"), F.when(member, high).alias("minified_to"),
        F.when(member, _part(t, 7).try_cast("long")).alias("orig_from"), F.when(member, _part(t, 8).try_cast("long")).alias("orig_to"),
        F.when(F.col("kind").isin("comment", "preamble"), json).alias("comment"),
        F.get_json_object(lenient(known), "$.id").alias("metadata"), lenient(known).alias("payload"),
    )


def lenient(json: Column) -> Column:
    """JSON as written, or with bare keys and single quotes mended where that makes it parse."""
    mended = F.regexp_replace(F.regexp_replace(json, r"([{,]\s*)([a-zA-Z_][0-9a-zA-Z_]*)\s*:", '$1"$2":'), "'", '"')
    return F.coalesce(F.when(F.try_parse_json(json).isNotNull(), json), F.when(F.try_parse_json(mended).isNotNull(), mended))


def strict(mapping: DataFrame) -> DataFrame:
    """The mapping; an error with the number of the first bad line where one breaks the grammar."""
    fail = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("error"))).cast("string")
    return mapping.withColumn("kind", F.when(F.col("error").isNotNull(), fail).otherwise(F.col("kind")))


def header(mapping: DataFrame) -> DataFrame:
    """(file, key, value) of ``# key: value`` lines before the first class; the first of a key counts."""
    pair = mapping.where("kind = 'preamble' and comment not like '{%'").select("file", "line", F.trim(F.substring_index("comment", ":", 1)).alias("key"), F.trim(F.regexp_extract("comment", "^[^:]*:(.*)$", 1)).alias("value"))
    return pair.groupBy("file", "key").agg(F.min_by("value", "line").alias("value"))


def signature(prefix: str = "") -> Column:
    return F.concat(F.col(prefix + "ty"), F.lit(" "), F.col(prefix + "original"), F.lit("("), F.array_join(prefix + "params", ","), F.lit(")"))


def _qualified(name: Column, package: Column) -> Column:
    base = F.regexp_replace(name, r"(\[\])+$", "")
    return F.when((package != "") & ~base.contains(".") & ~base.isin(PRIMITIVES) & (base != ""), F.concat(package, F.lit("."), name)).otherwise(name)


def normalise(mapping: DataFrame) -> DataFrame:
    """Members with names qualified by the class's package, and ``residual``: the residual signature of the method's first range that has one, for all its ranges."""
    classes = mapping.where("kind = 'class'").select("file", F.col("line").alias("class_line"), F.when(F.col("original").contains("."), F.regexp_extract("original", r"^(.*)\.[^.]*$", 1)).otherwise("").alias("package"))
    own = mapping.where("kind = 'comment' and metadata = 'com.android.tools.r8.residualsignature'").groupBy("file", "member_line").agg(F.min_by(F.get_json_object("payload", "$.signature"), "line").alias("own"))
    members = mapping.where("kind in ('field', 'method')").join(own, ["file", "member_line"], "left").join(classes, ["file", "class_line"])
    package = F.col("package")
    members = members.withColumn("ty", _qualified(F.col("ty"), package)).withColumn("owner", _qualified(F.col("owner"), package)).withColumn("params", F.transform("params", lambda p: _qualified(p, package)))
    same = Window.partitionBy("file", "class_line", "obfuscated", signature()).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return members.withColumn("residual", F.coalesce("own", F.when(F.col("kind") == "method", F.first_value("own", F.lit(True)).over(same)))).drop("own", "package")


def frames(mapping: DataFrame) -> DataFrame:
    """Methods with ``stack`` (consecutive ones of equal range and obfuscated name), their depth in it, innermost 0, and whether they are the outermost."""
    order = Window.partitionBy("file", "class_line").orderBy("line")
    methods = mapping.where("kind = 'method'")
    goes_on = (F.lag("obfuscated").over(order) == F.col("obfuscated")) & (F.lag("minified_from").over(order) == F.col("minified_from")) & (F.lag("minified_to").over(order) == F.col("minified_to"))
    methods = methods.withColumn("stack", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    inside = Window.partitionBy("file", "class_line", "stack").orderBy("line")
    return methods.withColumn("depth", F.row_number().over(inside) - 1).withColumn("outermost", F.lead("line").over(inside).isNull())


def original_line(line: Column) -> Column:
    """The original line of a residual one inside the method's range."""
    linear = F.col("orig_to") - F.col("orig_from") == F.col("minified_to") - F.col("minified_from")
    return F.when(F.col("orig_from").isNull(), line).when(linear, F.col("orig_from") + line - F.col("minified_from")).otherwise(F.col("orig_from"))


def retrace(mapping: DataFrame, positions: DataFrame, band: int = 64) -> DataFrame:
    """(position columns, depth, class, method, signature, original): the frames of the first stack that covers each (file, class, obfuscated, residual)."""
    classes = mapping.where("kind = 'class'").select("file", F.col("line").alias("class_line"), F.col("obfuscated").alias("class"), F.col("original").alias("class_name"))
    stacks = frames(mapping).where("minified_from is not null").join(classes, ["file", "class_line"])
    cells = stacks.withColumn("__band", F.explode(F.sequence(F.floor(F.col("minified_from") / band), F.floor(F.col("minified_to") / band))))
    hit = positions.withColumn("__band", F.floor(F.col("residual") / band)).join(cells, ["file", "class", "obfuscated", "__band"]).where("residual between minified_from and minified_to")
    first = Window.partitionBy("file", "class", "obfuscated", "residual")
    hit = hit.withColumn("__first", F.min("stack").over(first)).where("stack = __first")
    return hit.select(*positions.columns, "depth", F.coalesce("owner", "class_name").alias("class_name"), F.col("original").alias("method"), signature().alias("signature"), original_line(F.col("residual")).alias("original"))


def print_mapping(mapping: DataFrame) -> DataFrame:
    """(file, line, text): the lines that ``read_mapping`` read, in canonical spacing."""
    owner = F.coalesce(F.concat("owner", F.lit(".")), F.lit(""))
    field = F.concat(F.lit("    "), "ty", F.lit(" "), owner, "original", F.lit(" -> "), "obfuscated")
    ranged = F.coalesce(F.concat(F.col("minified_from").cast("string"), F.lit(":"), F.col("minified_to").cast("string"), F.lit(":")), F.lit(""))
    origin = F.concat(F.coalesce(F.concat(F.lit(":"), F.col("orig_from").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("orig_to").cast("string")), F.lit("")))
    method = F.concat(F.lit("    "), ranged, "ty", F.lit(" "), owner, "original", F.lit("("), F.array_join("params", ","), F.lit(")"), origin, F.lit(" -> "), "obfuscated")
    text = F.when(F.col("kind") == "class", F.concat("original", F.lit(" -> "), "obfuscated", F.lit(":"))).when(F.col("kind") == "field", field).when(F.col("kind") == "method", method)
    comment = F.concat(F.when(F.col("member_line").isNotNull(), F.lit("      # ")).otherwise(F.lit("# ")), "comment")
    return mapping.select("file", "line", F.coalesce(text, comment).alias("text"))


def residual_names(mapping: DataFrame) -> DataFrame:
    """(file, class, obfuscated, original, candidates): what each residual method is called in source, from outermost frames; null where they disagree."""
    classes = mapping.where("kind = 'class'").select("file", F.col("line").alias("class_line"), F.col("obfuscated").alias("class"))
    named = frames(mapping).where("outermost").join(classes, ["file", "class_line"])
    out = named.groupBy("file", "class", "obfuscated").agg(F.array_sort(F.collect_set("original")).alias("candidates"))
    return out.withColumn("original", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))))


def renamed_lines(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class, text): the lines of a mapping, a class (original, obfuscated) and its renamed members (class, rank, text) in order; members that keep their name or were created are the caller's to leave out."""
    body = members.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda m: F.concat(F.lit("    "), m["text"])), "\n").alias("body"))
    head = classes.select(F.col("original").alias("class"), F.concat("original", F.lit(" -> "), "obfuscated", F.lit(":")).alias("head"))
    return head.join(body, "class", "left").select("class", F.concat_ws("\n", "head", "body").alias("text"))
