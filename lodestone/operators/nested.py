"""Nested JSON turned into flat tables that keep parent, child and position.

First the merged schema is inferred: which members every object has anywhere, with what kinds of value. Spark's own
aggregate of VARIANT schemas gives it up to places where records disagree (an object where others have an array); those
are looked at by kind, in rounds, until nothing is open. From the schema one expression follows: each array level
is exploded into a child table whose rows carry the parent's key and the ordinal of the element. All child tables
come out of one stage without a shuffle, told apart by their path. What lies deeper than the schema is followed is
walked on from those nodes only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import store

#: Containers within one another that the schema follows; what is deeper is walked on from there, so many levels at a time.
DEPTH, STEPS = 12, 8
#: Members of one object from which it counts as a dictionary, as one whose names are all numbers does.
DICTIONARY = 200
#: Rounds of inference. Each settles one more level of disagreement.
ROUNDS = DEPTH


def _text(text: Column) -> Column:
    """JSON text, decoded if it was encoded once more as a JSON string."""
    inner = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return F.when(F.substring(F.ltrim(text), 1, 1) == '"', inner).otherwise(text)


def parse(text: Column) -> Column:
    """JSON text as VARIANT; text encoded once more as a JSON string counts as decoded; null where it isn't an object or array."""
    t = _text(text)
    # the parser reads one value and would pass over words behind it
    whole = F.right(F.rtrim(F.translate(t, "\t\r\n", "   ")), F.lit(1)).isin("}", "]")
    return F.when(whole, F.try_parse_json(t))


class Shape:
    """What values at one path are: objects with members, dictionaries of one kind of value, arrays; all of them in turn."""

    def __init__(self) -> None:
        self.members: dict[str, Shape] | None = None
        self.each: Shape | None = None
        self.items: Shape | None = None
        #: Records disagree here, or it is too deep: what is below isn't known yet.
        self.open = False
        self.scalars: set[str] = set()

    def holds(self) -> bool:
        return self.open or self.members is not None or self.each is not None or self.items is not None

    def merge(self, other: Shape) -> Shape:
        for name in ("each", "items"):
            mine, theirs = getattr(self, name), getattr(other, name)
            setattr(self, name, mine.merge(theirs) if mine and theirs else mine or theirs)
        if other.members is not None:
            self.members = self.members or {}
            for k, x in other.members.items():
                self.members[k] = self.members[k].merge(x) if k in self.members else x
        self.open, self.scalars = self.open or other.open, self.scalars | other.scalars
        return self.settle()

    def settle(self) -> Shape:
        """An object that is used as a dictionary has one shape for all its values."""
        if self.members and (self.each is not None or len(self.members) > DICTIONARY or all(k.isdigit() for k in self.members) or _ambiguous(self.members)):
            self.each = reduce(Shape.merge, self.members.values(), self.each or Shape())
            self.members = None
        return self

    def walk(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Shape]]:
        yield path, self
        for k, x in (self.members or {}).items():
            yield from x.walk((*path, "." + k))
        for step, x in (("*", self.each), ("[]", self.items)):
            if x is not None:
                yield from x.walk((*path, step))


def _ambiguous(names: dict[str, Shape]) -> bool:
    """Names that can't be the fields of one struct."""
    return len({k.lower() for k in names}) < len(names) or any("`" in k or not k for k in names)


_TOKEN = re.compile(r"(OBJECT|ARRAY)<|([>,:])|`((?:[^`]|``)*)`|([^\s<>,:`(]+(?:\([^)]*\))?)|\s+")


def read_schema(text: str, most: int = DEPTH) -> Shape:
    """The shape that Spark's schema of a VARIANT says, open where it is deeper than ``most``."""
    root = Shape()
    # a stack of shapes being read, with the name of the member that comes next
    stack: list[tuple[Shape, list[str]]] = [(root, [])]
    at: Shape | None = root
    for m in _TOKEN.finditer(text):
        kind, mark, quoted, word = m.groups()
        if kind:
            if len(stack) > most:
                at.open = True
            if kind == "ARRAY":
                at.items = Shape()
                stack.append((at, []))
                at = at.items
            else:
                at.members = {}
                stack.append((at, []))
                at = None
        elif mark == ":":
            name = stack[-1][1].pop()
            at = stack[-1][0].members.setdefault(name, Shape())
        elif mark == ">":
            done, _ = stack.pop()
            if done.open:
                done.members = done.items = None
            done.settle()
            at = None
        elif mark == ",":
            at = None
        elif at is None and (quoted is not None or word):
            stack[-1][1].append(quoted.replace("``", "`") if quoted is not None else word)
        elif word:
            at.open = word == "VARIANT"
            at.scalars |= {word} - {"VARIANT", "VOID"}
    return root.settle()


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _fields(names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _values(value: Column, path: tuple[str, ...]) -> Column:
    """All values at a path below a value, as an array."""
    if not path:
        return F.array(value)
    step, rest = path[0], path[1:]
    none = F.array().cast("array<variant>")
    if step[0] == ".":
        return _let(_get(value, _fields([step[1:]])), lambda o: F.when(o.isNotNull(), _values(o[step[1:]], rest)).otherwise(none))
    many = _get(value, "array<variant>") if step == "[]" else F.map_values(_get(value, "map<string,variant>"))
    return F.coalesce(F.flatten(F.transform(many, lambda x: _values(x, rest))), none)


def _tagged(values: Column, i: int) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(i).alias("i"), x.alias("x")))


def infer(df: DataFrame, value: str) -> Shape:
    """The merged schema of a VARIANT column, over all rows."""
    v = F.col(value)
    shape = read_schema(df.agg(F.schema_of_variant_agg(v)).first()[0] or "VOID")
    for _ in range(ROUNDS):
        asked = [(p, x) for p, x in shape.walk() if x.open and len(p) < DEPTH]
        if not asked:
            break
        found = F.concat(*[_tagged(_values(v, p), i) for i, (p, _) in enumerate(asked)])
        x = F.col("one.x")
        kinds = df.select(F.explode(found).alias("one")).groupBy("one.i").agg(
            F.schema_of_variant_agg(F.when(_get(x, "map<string,variant>").isNotNull(), x)).alias("objects"),
            F.schema_of_variant_agg(F.when(_get(x, "array<variant>").isNotNull(), x)).alias("arrays"),
        ).collect()
        said = {r.i: r for r in kinds}
        for i, (p, x) in enumerate(asked):
            x.open = False
            for text in (said[i].objects, said[i].arrays) if i in said else ():
                if text and text not in ("VOID", "VARIANT"):
                    x.merge(read_schema(text, DEPTH - len(p)))
        shape = _settled(shape)
    return shape


def _settled(shape: Shape) -> Shape:
    for _, x in list(shape.walk()):
        x.settle()
    return shape


def _row(node: Column, parent: Column, path: Column, ordinal: Column, kind: str, in_array: bool, value: Column | None, rest: Column | None) -> Column:
    none = F.lit(None).cast("variant")
    fields = {"node": node, "parent": parent, "path": path, "ordinal": ordinal, "kind": F.lit(kind), "in_array": F.lit(in_array), "value": none if value is None else value, "rest": none if rest is None else rest}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


NODE = "struct<node:string,parent:string,path:string,ordinal:int,kind:string,in_array:boolean,value:variant,rest:variant>"


def _below(x: Column, shape: Shape, node: Column, above: Column, path: str, ordinal: Column | None, keep: bool, root: bool = False) -> Column:
    """The rows of a value and of everything below it, as one array of nodes; ``above`` is the nearest object around it."""
    in_array, none = ordinal is not None, F.array().cast(f"array<{NODE}>")
    at = ordinal if in_array else F.lit(None).cast("int")

    def me(kind: str, rest: Column | None = None) -> list[Column]:
        """The value's own row: the root has none, nor has an array that is a member."""
        has = not root and (kind == "object" or in_array or rest is not None)
        return [F.array(_row(node, above, F.lit(path), at, kind, in_array, x if keep else None, rest))] if has else []

    def together(parts: list[Column]) -> Column:
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none

    if shape.open:
        # what is below is walked later, from here
        return F.when(_get(x, "map<string,variant>").isNotNull(), together(me("object", x))).when(_get(x, "array<variant>").isNotNull(), together(me("array", x))).otherwise(together(me("scalar")))
    ways: list[Column] = []
    under = (lambda name: name) if root else (lambda name: F.concat(node, F.lit("."), name))
    table = (lambda name: f"{path}.{name}") if path else (lambda name: name)
    if shape.each is not None:
        each = shape.each
        entry = lambda e: _below(e["value"], each, under(e["key"]), node, table("*"), None, keep)
        inside = lambda o: [F.flatten(F.transform(F.map_entries(o), entry))] if each.holds() else []
        ways.append(_let(_get(x, "map<string,variant>"), lambda o: F.when(o.isNotNull(), together(me("object") + inside(o)))))
    elif shape.members is not None:
        held = {k: m for k, m in shape.members.items() if m.holds()}
        # only an object can be read as a struct; of one without containers any name will do
        fields = _get(x, _fields(list(held) or ["_"]))
        inside = lambda o: [_below(o[k], m, under(F.lit(k)), node, table(k), None, keep) for k, m in held.items()]
        ways.append(_let(fields, lambda o: F.when(o.isNotNull(), together(me("object") + inside(o)))))
    if shape.items is not None:
        items = shape.items
        element = lambda e, i: _below(e, items, F.concat(node, F.lit("["), i.cast("string"), F.lit("]")), above, f"{path}[]", i, keep)
        ways.append(_let(_get(x, "array<variant>"), lambda o: F.when(o.isNotNull(), together([*me("array"), F.flatten(F.transform(o, element))]))))
    return F.coalesce(*ways, together(me("scalar"))) if ways else together(me("scalar"))


def flatten(df: DataFrame, key: str, value: str, shape: Shape | None = None, keep: bool = True) -> DataFrame:
    """One row for each object and array element below the roots of a VARIANT column: all child tables in one.

    Columns: ``root_id``, ``node`` (its path, positions from 0), ``parent`` (path of
    the nearest enclosing object, empty for the root), ``path`` (the child table's name, with ``[]`` for array levels
    and ``*`` for the names of a dictionary),
    ``ordinal`` (position in its array, else null), ``is_object``, ``in_array``, ``value`` (VARIANT),
    ``row_key`` and ``parent_key`` (surrogate keys of the row and its parent).
    Without ``keep`` the values are null. ``shape`` is the merged schema, inferred if it isn't given.

    Null values (also what could not be parsed) have no rows; null elements of an array
    count for positions and are rows with a null value, members that are null or scalar
    are columns of their object; a root that isn't an object or array has no rows. An
    object with two members of one name can't be parsed and has no rows. Repeated
    rows give repeated nodes: drop them from the input. Other columns are ignored. Nodes deeper than ``DEPTH``
    are found from their ancestors there, level by level; their path is written with the names that occur.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("root_id"), F.col(value).alias("v"))
    shape = shape or infer(rows, "v")
    out = rows.select("root_id", F.inline(_below(F.col("v"), shape, F.lit(""), F.lit(""), "", None, keep, root=True)))
    deep = out.where(F.col("rest").isNotNull()) if any(x.open for _, x in shape.walk()) else None
    found = [out]
    while deep is not None:
        deep = store(deep)
        if deep.isEmpty():
            break
        grown = store(_grown(deep, keep))
        found.append(grown)
        deep = grown.where(F.col("rest").isNotNull())
    every = reduce(DataFrame.unionByName, found)
    row_key = lambda node: F.concat("root_id", F.lit("#"), node)
    is_object = (F.col("kind") == "object").alias("is_object")
    return every.select("root_id", "node", "parent", "path", "ordinal", is_object, "in_array", "value", row_key("node").alias("row_key"), row_key("parent").alias("parent_key"))


def _grown(deep: DataFrame, keep: bool) -> DataFrame:
    """What is up to ``STEPS`` levels below nodes that the schema doesn't reach; ``rest`` is left where there is more."""
    names = [c for c in deep.columns if c != "root_id"]
    out = deep.select("root_id", F.struct(*names, F.lit(0).alias("level")).alias("n"))
    for _ in range(STEPS):
        n = F.col("n")
        done = F.struct(*[F.lit(None).cast("variant").alias(c) if c == "rest" else n[c].alias(c) for c in [*names, "level"]])
        out = out.select("root_id", F.explode(F.when(n["rest"].isNotNull(), F.concat(F.array(done), _children(n, keep))).otherwise(F.array(n))).alias("n"))
    return out.where("n.level > 0").select("root_id", *[F.col("n")[c].alias(c) for c in names])


def _children(n: Column, keep: bool) -> Column:
    """The containers and array elements right below a node."""
    x = n["rest"]

    def child(value: Column, name: Column, above: Column, table: Column, ordinal: Column, in_array: bool) -> Column:
        what = F.when(_get(value, "map<string,variant>").isNotNull(), "object").when(_get(value, "array<variant>").isNotNull(), "array").otherwise("scalar")
        none = F.lit(None).cast("variant")
        fields = {"node": name, "parent": above, "path": table, "ordinal": ordinal, "kind": what, "in_array": F.lit(in_array), "value": value if keep else none, "rest": F.when(what != "scalar", value), "level": n["level"] + 1}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    here = F.when(n["kind"] == "object", n["node"]).otherwise(n["parent"])
    items = F.transform(_get(x, "array<variant>"), lambda e, i: child(e, F.concat(n["node"], F.lit("["), i.cast("string"), F.lit("]")), here, F.concat(n["path"], F.lit("[]")), i, True))
    entry = lambda e: child(e["value"], F.concat(n["node"], F.lit("."), e["key"]), here, F.concat(n["path"], F.lit("."), e["key"]), F.lit(None).cast("int"), False)
    members = F.filter(F.transform(F.map_entries(_get(x, "map<string,variant>")), entry), lambda m: m["kind"] != "scalar")
    return F.coalesce(F.when(n["kind"] == "array", items).otherwise(members), F.array().cast("array<struct<node:string,parent:string,path:string,ordinal:int,kind:string,in_array:boolean,value:variant,rest:variant,level:int>>"))


def merged_schema(df: DataFrame, value: str, shape: Shape | None = None) -> DataFrame:
    """Every path of the merged schema with the kinds of value seen there: ``path, kind``.

    Paths name members joined by ``.``, array levels by ``[]`` and the names of a dictionary by ``*``.
    Kinds are ``object``, ``array`` and the types of scalars. An empty table has no path.
    """
    out = []
    for steps, x in (shape or infer(df, value)).walk():
        path = "".join(p if p != "*" else ".*" for p in steps).lstrip(".")
        kinds = (["object"] if x.members is not None or x.each is not None else []) + (["array"] if x.items is not None else []) + sorted(x.scalars)
        out += [(path, k) for k in kinds]
    return df.sparkSession.createDataFrame(out, "path string, kind string")


def child_table(nodes: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one array or object path: keys, ordinal and the named scalar members.

    ``fields``: member name to SQL type; a member that is absent or of another type is null.
    """
    cols = [F.try_variant_get("value", f"$['{name}']", kind).alias(name) for name, kind in fields.items()]
    return nodes.where(F.col("path") == path).select("root_id", "row_key", "parent_key", "ordinal", *cols)


def flatten_map(df: DataFrame, key: str, column: str) -> DataFrame:
    """Entries of a MAP column as child rows: ``root_id, node, parent, value``; null maps and null values have none."""
    return (
        df.select(F.col(key).cast("string").alias("root_id"), F.explode(column).alias("member", "value"))
        .where("value is not null")
        .select("root_id", F.concat(F.lit(f"{column}."), "member").alias("node"), F.lit("").alias("parent"), "value")
    )
