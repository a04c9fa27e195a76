"""Policy files as data: entity and rule lines of the text form, of any number, read with column expressions.

Lines come from spark.read.text. A line is split outside braces and parentheses by one fold over its pieces; attributes are rows
at first, whose types are inferred by one aggregation, and become one typed table after that. What a file says twice counts
as it was said last, so lines have positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.types import infer_datatypes, parse_set

#: The types of attributes and how tables hold them.
SPARK_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string"}


def split_outside_column(text: Column, separator: str) -> Column:
    """The parts of a text between separators that stand outside braces and parentheses, without space at their ends.

    Pieces between all separators are joined again while brackets are open; a closing bracket that none has opened counts
    for nothing.
    """
    pieces = F.split(text, rf"\Q{separator}\E", -1)
    brackets = lambda piece: F.filter(F.split(F.regexp_replace(piece, "[^{}()]", ""), ""), lambda b: b != "")
    after = lambda depth, piece: F.aggregate(brackets(piece), depth, lambda d, b: F.when(b.isin("{", "("), d + 1).otherwise(F.greatest(d - 1, F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(state: Column, piece: Column) -> Column:
        whole = F.when(state.open.isNull(), piece).otherwise(F.concat(state.open, F.lit(separator), piece))
        depth = after(state.depth, piece)
        return F.struct(F.when(depth == 0, F.concat(state.done, F.array(whole))).otherwise(state.done).alias("done"), F.when(depth > 0, whole).alias("open"), depth.alias("depth"))

    parts = F.aggregate(pieces, start, step, lambda s: F.when(s.open.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.open))))
    return F.transform(parts, lambda p: F.trim(p))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """pos and line of the lines (value) that say something: comments and space at the ends are gone. pos follows the order in
    which Spark reads the files."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    return lines.select(F.monotonically_increasing_id().alias("pos"), line.alias("line")).filter("line <> ''")


def entity_attributes(lines: DataFrame) -> DataFrame:
    """scope, id, attr and value (text) of userAttrib and resourceAttrib lines; ids are attributes, too (uid, rid). An entity that is
    declared again counts as it was last, an attribute of one line as well."""
    found = numbered_lines(lines).select("pos", F.regexp_extract("line", r"^(user|resource)Attrib\(\s*([^,()\s]+)\s*,(.*)\)$", 1).alias("kind"), F.regexp_extract("line", r"^(user|resource)Attrib\(\s*([^,()\s]+)\s*,(.*)\)$", 2).alias("id"), F.regexp_extract("line", r"^(user|resource)Attrib\(\s*([^,()\s]+)\s*,(.*)\)$", 3).alias("body")).filter("kind <> ''")
    last = found.groupBy("kind", "id").agg(F.max_by("body", "pos").alias("body"))
    scope = F.when(F.col("kind") == "user", "subject").otherwise("resource")
    pairs = F.filter(split_outside_column(F.col("body"), ","), lambda p: F.contains(p, F.lit("=")))
    named = F.transform(pairs, lambda p, at: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("attr"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value"), at.alias("at")))
    own = F.array(F.struct(F.when(F.col("kind") == "user", "uid").otherwise("rid").alias("attr"), F.col("id").alias("value"), F.lit(1 << 30).alias("at")))
    rows = last.select(scope.alias("scope"), "id", F.inline(F.concat(named, own)))
    return rows.groupBy("scope", "id", "attr").agg(F.max_by("value", "at").alias("value"))


def declared_attributes(attributes: DataFrame) -> DataFrame:
    """scope, name, datatype and multivalue of entity_attributes' rows: the type that holds all values of an attribute."""
    types = infer_datatypes(attributes.select("scope", "attr", "value"), "scope", "attr", "value")
    return types.select("scope", F.col("attr").alias("name"), "datatype", F.col("datatype").startswith("set[").alias("multivalue"))


def typed_entities(attributes: DataFrame, declared: DataFrame, scope: str) -> DataFrame:
    """id and a typed column for each declared attribute of one scope's entities; null where an entity has none. The declarations,
    a row for each attribute of a policy, go through the driver."""
    own = [(r.name, r.datatype) for r in declared.filter(F.col("scope") == scope).orderBy("name").collect()]
    columns = []
    for name, datatype in own:
        many, base = datatype.startswith("set["), datatype.removeprefix("set[").removesuffix("]")
        value = F.max(F.when(F.col("attr") == name, F.col("value")))
        kind = SPARK_TYPES[base]
        items = F.when(value.rlike(r"^\s*\{.*\}\s*$"), parse_set(value)).otherwise(F.array(value)) if many else value
        columns.append((F.when(value.isNotNull(), F.array_sort(items.cast(f"array<{kind}>"))) if many else value.cast(kind)).alias(name))
    rows = attributes.filter(F.col("scope") == scope).groupBy("id")
    return rows.agg(*columns) if columns else rows.agg(F.count("*").alias("__n")).drop("__n")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (pos, ...) with nth, from 1 in the order of pos: counts by part of the input are added up, no window holds all rows."""
    from pyspark.sql import Window

    part = F.shiftright("pos", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each part of the input
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = rows.withColumn("__part", part).withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy("pos")))
    return within.join(before, "__part").withColumn("nth", (F.col("__before") + F.col("__own")).cast("int")).drop("__part", "__own", "__before")


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def rule_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """rules and predicates, as a policy's tables have them, of rule(subject; resource; actions; comparison) lines, in their order: R1, R2, ...

    Conditions: a [ {x y}: in; a = b: equal, to the other side's attribute or else a literal; a ] b: contains; a > b: includes. What isn't understood has
    operator null, so it can be reported.
    """
    bodies = _numbered(numbered_lines(lines).select("pos", F.regexp_extract("line", r"^rule\((.*)\)$", 1).alias("body")).filter("body <> ''"))
    parts = bodies.select(F.concat(F.lit("R"), "nth").alias("rule_id"), (F.col("nth") - 1).alias("pos"), "body", split_outside_column(F.col("body"), ";").alias("parts"))
    said = F.get("parts", F.lit(2))
    actions = F.when(said.rlike(r"\{[^}]*\}"), F.filter(F.split(F.regexp_extract(said, r"\{([^}]*)\}", 1), r"[\s,]+"), lambda a: a != "")).when(said != "", F.array(said)).otherwise(F.array().cast("array<string>"))
    rules = parts.select("rule_id", "pos", F.lit("Permit").alias("effect"), actions.alias("actions"), F.lit("EROOT").alias("root"), F.lit(0).alias("priority"), F.concat(F.lit("rule("), "body", F.lit(")")).alias("source"))
    texts = lambda part, left, right: F.transform(F.filter(split_outside_column(part, ","), lambda c: c != ""), lambda c: F.struct(F.lit(left).alias("left_scope"), F.lit(right).alias("other"), c.alias("text")))
    compared = F.array_join(F.slice("parts", 4, F.greatest(F.size("parts") - 3, F.lit(0))), ";")
    conditions = F.concat(texts(F.coalesce(F.get("parts", F.lit(0)), F.lit("")), "subject", "resource"), texts(F.coalesce(F.get("parts", F.lit(1)), F.lit("")), "resource", "subject"), texts(F.coalesce(compared, F.lit("")), "subject", "resource"))
    each = parts.select("rule_id", F.posexplode(conditions).alias("pos", "c")).select("rule_id", "pos", "c.*")
    is_in, names = rf"^({_NAME})\s*\[\s*(\{{[^}}]*\}})$", rf"^({_NAME})\s*([=\]>])\s*({_NAME})$"
    literal = rf"^({_NAME})\s*=\s*(.+)$"
    t = F.col("text")
    by_name = t.rlike(names)
    value = F.when(t.rlike(is_in), F.regexp_extract(t, is_in, 2)).when(t.rlike(literal) & ~by_name, F.trim(F.regexp_extract(t, literal, 2)))
    sign = F.regexp_extract(t, names, 2)
    op = F.when(t.rlike(is_in), "IN").when(by_name, F.when(sign == "=", "EQ").when(sign == "]", "CONTAINS").otherwise("SUPERSET")).when(t.rlike(literal), "EQ")
    braced = value.rlike(r"^\{.*\}$")
    items = F.when(braced, parse_set(value)).when(value.isNotNull(), F.array(value))
    kinds = lambda v: F.when(v.rlike(r"^-?[0-9]+$"), "int").when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), "float").when(F.lower(v).isin("true", "false"), "bool").otherwise("string")
    found = F.array_distinct(F.transform(items, kinds))
    base = F.when(F.size(found) == 1, F.get(found, F.lit(0))).when((F.size(found) == 2) & F.forall(found, lambda k: k.isin("int", "float")), "float").when(items.isNotNull(), "string")
    left = F.regexp_extract(t, rf"^({_NAME})", 1)
    predicates = each.select(
        "rule_id", F.concat(F.lit("P"), F.col("pos") + 1).alias("predicate_id"), "pos", op.alias("op"), "left_scope", left.alias("left_attr"), F.when(by_name, F.col("other")).alias("right_scope"), F.when(by_name, F.regexp_extract(t, names, 3)).alias("right_attr"),
        F.when(by_name, "attribute").when(braced, "set").when(value.isNotNull(), "scalar").otherwise("none").alias("right_kind"), items.alias("right_values"), base.alias("right_type"), t.alias("said"),
    )
    return {"rules": rules, "predicates": predicates}


def read_policy_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """attributes, entities (scope, id, attr, value), rules and predicates of the policy files at a path, in any store that Spark reads."""
    lines = spark.read.text(path)
    entities = entity_attributes(lines)
    return {"entities": entities, "attributes": declared_attributes(entities), **rule_tables(lines)}
