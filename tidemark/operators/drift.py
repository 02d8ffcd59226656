"""Schemas that drift between files: minimum-cost edit scripts, a report of changes and one consistent table.

Each file's schema is a tree of fields, at any depth, with types and evidence (the amounts a field has by year).
Consecutive files of an entity are compared by a tree edit distance in which the children of two matched nodes are matched at least cost;
the script (add, delete, rename, retype, move) that the distance yields is the report, and its renames are compiled
into the projection that brings every file to the same columns.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

ADD, DELETE, RETYPE, RENAME, MOVE = 1.0, 1.0, 0.25, 0.5, 0.75


@dataclass
class Node:
    """A field: its name, its type ('' if all its values are null), what amounts it has by year (a digest of each year's
    set) and the fields below it."""

    name: str
    type: str = "object"
    evidence: dict[str, object] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass(frozen=True)
class Edit:
    """path is the field's place in the new schema, for removed fields in the old one; old_path that from which a field
    was renamed or moved. The depths count the levels of both."""

    change: str
    path: str
    old_path: str = ""
    depth: int = 1
    old_depth: int = 0


def assign(cost: list[list[float]]) -> list[int]:
    """For each row the column matched to it, at least total cost; there are at least as many columns as rows.

    Shortest augmenting paths with potentials, cubic in the rows.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], back[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def agreement(new: Node, old: Node, years: frozenset[str]) -> int:
    """In how many of the years both have the same amount; 0 if in any of them they have others."""
    same = 0
    for y in years:
        a, b = new.evidence.get(y), old.evidence.get(y)
        if a and b:
            if a != b:
                return 0
            same += 1
    return same


def _candidates(new: list[Node], old: list[Node], years: frozenset[str]) -> Iterator[tuple[int, int, int]]:
    """(place in new, place in old, years that agree) of the pairs whose evidence agrees, found by equal amounts of a year."""
    by: dict[tuple, list[int]] = {}
    for j, o in enumerate(old):
        for y in years & o.evidence.keys():
            by.setdefault((y, o.evidence[y]), []).append(j)
    for i, n in enumerate(new):
        for j in sorted({j for y in years & n.evidence.keys() for j in by.get((y, n.evidence[y]), [])}):
            if k := agreement(n, old[j], years):
                yield i, j, k


def _components(pairs: Iterable[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Rows and columns of the connected parts of a bipartite graph."""
    parts: dict[tuple[str, int], set] = {}
    for i, j in pairs:
        whole = parts.get(("r", i), {("r", i)}) | parts.get(("c", j), {("c", j)})
        for x in whole:
            parts[x] = whole
    unique = {id(p): p for p in parts.values()}.values()
    return [(sorted(i for k, i in p if k == "r"), sorted(i for k, i in p if k == "c")) for p in unique]


def _match(old: Node, new: Node, years: frozenset[str]) -> tuple[float, list[tuple[Node, Node]], list[Node], list[Node]]:
    """Cost, matched pairs, deleted and added children of two matched nodes.

    Children of one name match; of the others a pair may match if its evidence agrees, at the cost of a rename that
    falls with the years that agree and, least, with the likeness of the names. Each child is matched once. Only the
    parts of the graph of candidates that hang together are assigned together.
    """
    names = {c.name: c for c in new.children}
    pairs = [(o, names[o.name]) for o in old.children if o.name in names]
    kept = {o.name for o, _ in pairs}
    gone = sorted((o for o in old.children if o.name not in kept), key=lambda c: c.name)
    come = sorted((n for n in new.children if n.name not in kept), key=lambda c: c.name)
    cost = {}
    for i, j, k in _candidates(come, gone, years):
        alike = difflib.SequenceMatcher(None, come[i].name.lower(), gone[j].name.lower()).ratio()
        cost[i, j] = RENAME / (1 + 0.01 * k) - 0.001 * alike
    for rows, cols in _components(cost):
        # A column for each row stands for adding it; the vanished fields left over are deleted.
        table = [[cost.get((i, j), 1e6) - DELETE for j in cols] + [ADD if r == k else 1e6 for k in range(len(rows))] for r, i in enumerate(rows)]
        for r, c in enumerate(assign(table)):
            if c < len(cols) and (rows[r], cols[c]) in cost:
                pairs.append((gone[cols[c]], come[rows[r]]))
    matched = {id(x) for p in pairs for x in p}
    gone, come = [o for o in gone if id(o) not in matched], [n for n in come if id(n) not in matched]
    total = sum((RENAME if o.name != n.name else 0) + (RETYPE if o.type and n.type and o.type != n.type else 0) for o, n in pairs)
    return total + sum(DELETE * o.size() for o in gone) + sum(ADD * n.size() for n in come), pairs, gone, come


def edit_script(old: Node, new: Node, years: frozenset[str] = frozenset(), at: str = "", old_at: str = "") -> tuple[float, list[Edit]]:
    """The least cost to turn the old tree into the new one, and the edits in order of path.

    The distance is the constrained one on unordered trees: parents match before their children, so each level is an
    assignment problem. A subtree deleted under one parent and added with the same name and type, or agreeing amounts,
    under another counts as moved. A field whose type changes between object and another loses or gains the fields
    below it. years are those both files cover.
    """
    cost, edits, gone, come = _walk(old, new, years, at, old_at)
    parent = lambda path, node: path[: -len(node.name)] if node.name else path
    alike: dict[tuple, list[int]] = {}
    for j, (_, o, _) in enumerate(gone):
        alike.setdefault((o.name, o.type), []).append(j)
    agreed: dict[int, list[int]] = {}
    for i, j, _ in _candidates([n for _, n, _ in come], [o for _, o, _ in gone], years):
        agreed.setdefault(i, []).append(j)
    went, arrived = set(), set()
    for i, (path, n, depth) in enumerate(come):
        for j in sorted({*alike.get((n.name, n.type), []), *agreed.get(i, [])} - went):
            old_path, o, old_depth = gone[j]
            if parent(path, n) != parent(old_path, o):
                edits.append(Edit("moved", path, old_path, depth, old_depth))
                cost += MOVE - DELETE * o.size() - ADD * n.size()
                went.add(j)
                arrived.add(i)
                break
    edits += [Edit("added", p, "", d) for i, (p, _, d) in enumerate(come) if i not in arrived]
    edits += [Edit("removed", p, "", d, d) for j, (p, _, d) in enumerate(gone) if j not in went]
    return cost, sorted(edits, key=lambda e: (e.path, e.change, e.old_path))


def _walk(old: Node, new: Node, years: frozenset[str], at: str, old_at: str, depth: int = 1):
    """Cost and edits below two matched nodes, with the deleted and the added nodes as (path, node, depth)."""
    cost, pairs, gone, come = _match(old, new, years)
    edits: list[Edit] = []
    lost, found = [(f"{old_at}/{o.name}", o, depth) for o in gone], [(f"{at}/{n.name}", n, depth) for n in come]
    for o, n in pairs:
        path, old_path = f"{at}/{n.name}", f"{old_at}/{o.name}"
        if o.name != n.name:
            edits.append(Edit("renamed", path, old_path, depth, depth))
        if o.type and n.type and o.type != n.type:
            edits.append(Edit("retyped", path, old_path if o.name != n.name else "", depth, depth))
        if o.children or n.children:
            c, e, g, a = _walk(o, n, years, path, old_path, depth + 1)
            cost, edits, lost, found = cost + c, edits + e, lost + g, found + a
    return cost, edits, lost, found


#: Types of a field, each with its bit.
TYPES = {"number": 1, "text": 2, "object": 4, "array": 8, "boolean": 16}


def tree_of(fields: Iterable[dict], name: str = "") -> Node:
    """A tree from a file's descriptor: rows of pointer (names from the top, as in a JSON pointer), kinds (bits of TYPES)
    and evidence (year, digest of its amounts). A field stands under an object even if that is null in every row."""
    root = Node(name)
    known = {(): root}

    def at(steps: tuple[str, ...]) -> Node:
        if steps not in known:
            known[steps] = Node(steps[-1], "")
            at(steps[:-1]).children.append(known[steps])
        return known[steps]

    for f in fields:
        node = at(tuple(x.replace("~1", "/").replace("~0", "~") for x in f["pointer"].split("/")[1:]))
        node.type = "+".join(sorted(t for t, bit in TYPES.items() if (f["kinds"] or 0) & bit))
        node.evidence = dict(f["evidence"])
    return root


def _fields(v: Column, text: Column) -> Column:
    """array<struct<pointer, value>> of all fields below a variant at any depth, '[]' standing for the elements of an array.

    The walk goes level by level; the braces of its text bound the depth, so flat objects are walked once.
    """
    entries = "array<struct<pointer:string,value:variant>>"

    def below(pointer: Column, value: Column) -> Column:
        step = lambda k: F.concat(pointer, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(step(e["key"]).alias("pointer"), e["value"].alias("value")))
        elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: F.struct(F.concat(pointer, F.lit("/[]")).alias("pointer"), e.alias("value")))
        return F.coalesce(fields, elements, F.array().cast(entries)).cast(entries)

    open_ = F.length(text) - F.length(F.translate(text, "{[", ""))
    top = below(F.lit(""), v)
    deeper = F.aggregate(F.sequence(F.lit(2), open_), F.array(top), lambda acc, _: F.concat(acc, F.array(F.flatten(F.transform(F.element_at(acc, -1), lambda x: below(x["pointer"], x["value"]))).cast(entries))), lambda acc: F.flatten(acc))
    return F.when(open_ < 2, top).otherwise(deeper)


def descriptors(df: DataFrame, *, entity: str, file: str, order: str, year: str, data: str, amount_paths: tuple[str, ...] = ("$", "$.amount", "$.value")) -> DataFrame:
    """One row per file: entity, file, ord, years and fields (pointer, kinds, evidence).

    data is JSON text with an object; other or unreadable text adds a row without fields. Fields at all depths are
    described. A field's amounts are its numbers, also as text with thousands separators or, of an object, under one of
    the amount_paths, in at most six decimals. A year's amounts are kept as one short text: the amount, or of several
    their number, hash and greatest. Null values give a field without type. So a row holds a file's names and years,
    whatever the number of its rows, and is formed by aggregations with partial results.
    """
    text = F.coalesce(F.col(data), F.lit("{}"))
    parsed = df.select(F.col(entity).alias("entity"), F.col(file).alias("file"), F.col(order).alias("ord"), F.col(year).cast("string").alias("year"), text.alias("__t"), F.try_parse_json(text).alias("__v"))
    per_file = parsed.groupBy("entity", "file").agg(F.min("ord").alias("ord"), F.collect_set("year").alias("years"))
    objects = parsed.where(F.schema_of_variant("__v").startswith("OBJECT"))
    rows = objects.select("entity", "file", "year", F.explode(_fields(F.col("__v"), F.col("__t"))).alias("f")).select("entity", "file", "year", "f.pointer", F.col("f.value").alias("v"))
    kind = F.schema_of_variant("v")
    number = F.when(kind.startswith("OBJECT"), TYPES["object"]).when(kind.startswith("ARRAY"), TYPES["array"]).when(kind == "STRING", TYPES["text"]).when(kind == "BOOLEAN", TYPES["boolean"]).when(kind.isNull() | (kind == "VOID"), 0).otherwise(TYPES["number"])
    amount = F.coalesce(*[F.try_variant_get("v", p, "decimal(30,6)") for p in amount_paths], F.regexp_replace(F.try_variant_get("v", "$", "string"), r"[,\s]", "").try_cast("decimal(30,6)"))
    keys = ["entity", "file", "pointer"]
    one = rows.select(*keys, "year", number.alias("kinds"), F.when(number.isin(TYPES["number"], TYPES["text"], TYPES["object"]), amount).alias("amount")).groupBy(*keys, "year", "amount").agg(F.bit_or("kinds").alias("kinds"))
    yearly = one.groupBy(*keys, "year").agg(F.bit_or("kinds").alias("kinds"), F.count("amount").alias("n"), F.bit_xor(F.when(F.col("amount").isNotNull(), F.xxhash64("amount"))).alias("h"), F.max("amount").alias("top"))
    digest = F.when(F.col("n") == 1, F.col("top").cast("string")).when(F.col("n") > 1, F.concat_ws(":", "n", "h", "top"))
    fields = yearly.groupBy(*keys).agg(F.bit_or("kinds").alias("kinds"), F.collect_list(F.when(digest.isNotNull() & F.col("year").isNotNull(), F.struct("year", digest.alias("digest")))).alias("evidence"))
    packed = fields.groupBy("entity", "file").agg(F.collect_list(F.struct("pointer", "kinds", "evidence")).alias("fields"))
    return per_file.join(packed, ["entity", "file"], "left")


def with_previous(files: DataFrame) -> DataFrame:
    """(entity, file, previous) by (ord, file) within an entity; a first file isn't returned.

    The order is kept in two levels, files within months (ord's first seven characters) and months within an entity,
    so that no task holds all the files of one entity.
    """
    from pyspark.sql import Window

    key = F.struct("ord", "file")
    f = files.select("entity", "file", "ord", F.substring(F.col("ord").cast("string"), 1, 7).alias("month"))
    inner = f.withColumn("__in", F.lag("file").over(Window.partitionBy("entity", "month").orderBy("ord", "file")))
    months = f.groupBy("entity", "month").agg(F.max(key).alias("last"))
    months = months.withColumn("__before", F.lag("last.file").over(Window.partitionBy("entity").orderBy("last"))).select("entity", "month", "__before")
    return inner.join(months, ["entity", "month"]).select("entity", "file", F.coalesce("__in", "__before").alias("previous")).where("previous is not null")


def file_changes(described: DataFrame) -> DataFrame:
    """(entity, file, previous, change, path, old_path, depth, old_depth, cost): the edits of each file against the file before it.

    described comes from descriptors(). Paths start with '/', one step per level; old_path is '' but for 'renamed' and
    'moved' fields and those 'retyped' that were renamed too. Files without a change return no row; ties in order fall to the file name.
    """
    # A row per file with its names and years: written once, as it is read for the files, their order and their predecessors.
    described = cut(described)
    new = described.join(with_previous(described), ["entity", "file"])
    old = described.select(F.col("entity"), F.col("file").alias("previous"), F.col("years").alias("old_years"), F.col("fields").alias("old_fields"))
    pairs = new.join(old, ["entity", "previous"]).select("entity", "file", "previous", "years", "fields", "old_years", "old_fields")

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                trees = [tree_of(dict(f, evidence=[(m["year"], m["digest"]) for m in f["evidence"]]) for f in ([] if x is None else x)) for x in (r["old_fields"], r["fields"])]
                cost, edits = edit_script(*trees, frozenset(r["years"]) & frozenset(r["old_years"]))
                out += [(r["entity"], r["file"], r["previous"], e.change, e.path, e.old_path, e.depth, e.old_depth, cost) for e in edits]
            yield pd.DataFrame(out, columns=["entity", "file", "previous", "change", "path", "old_path", "depth", "old_depth", "cost"])

    types = dict(pairs.dtypes)
    return pairs.mapInPandas(scripts, f"entity {types['entity']}, file {types['file']}, previous {types['previous']}, change string, path string, old_path string, depth int, old_depth int, cost double")


def projections(described: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity, file, field, canonical): the column that each top-level field of each file goes to.

    A field keeps the name under which it first appeared, through any number of renames. Only renames travel: they are
    chained by doubling (each step joins a chain with the chain behind it), so the steps grow with the logarithm of
    the longest chain.
    """
    pointer = F.col("f.pointer")
    top = described.select("entity", "file", F.explode("fields").alias("f")).where(F.instr(F.substring(pointer, 2, 2**31 - 1), "/") == 0)
    fields = top.select("entity", "file", F.replace(F.replace(F.expr("substr(f.pointer, 2)"), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("field"))
    renames = changes.where("change = 'renamed' and depth = 1").select("entity", "file", F.expr("substr(path, 2)").alias("new"), F.expr("substr(old_path, 2)").alias("old"))
    order = described.select("entity", "file", "ord")
    # A rename holds from its file on until the name is given anew; its older name is looked up just before it.
    r = renames.join(order, ["entity", "file"]).select("entity", "new", "old", F.struct("ord", "file").alias("at"))
    links = cut(r.select("entity", F.col("new").alias("name"), "at", F.col("old").alias("target"), F.col("at").alias("target_at")))
    while True:
        nxt = links.select("entity", F.col("name").alias("target"), F.col("at").alias("n_at"), F.col("target").alias("n_target"), F.col("target_at").alias("n_target_at"))
        step = links.alias("l").join(nxt.alias("n"), (F.col("l.entity") == F.col("n.entity")) & (F.col("l.target") == F.col("n.target")) & (F.col("n.n_at") < F.col("l.target_at")), "left")
        best = step.groupBy("l.entity", "l.name", "l.at").agg(F.max_by(F.struct(F.col("n.n_target").alias("t"), F.col("n.n_target_at").alias("a")), F.col("n.n_at")).alias("next"), F.first("l.target").alias("target"), F.first("l.target_at").alias("target_at"))
        new = cut(best.select("entity", "name", "at", F.coalesce("next.t", "target").alias("target"), F.coalesce("next.a", "target_at").alias("target_at"), F.col("next").isNotNull().alias("moved")))
        links = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    f = fields.join(order, ["entity", "file"]).withColumn("here", F.struct("ord", "file"))
    hit = f.alias("f").join(links.alias("l"), (F.col("f.entity") == F.col("l.entity")) & (F.col("f.field") == F.col("l.name")) & (F.col("l.at") <= F.col("f.here")), "left")
    return hit.groupBy("f.entity", "f.file", "f.field").agg(F.coalesce(F.max_by("l.target", "l.at"), F.col("f.field")).alias("canonical")).select("entity", "file", "field", "canonical")


def unify(df: DataFrame, projection: DataFrame, *, entity: str, file: str, data: str, keep: list[str]) -> DataFrame:
    """One long table: the columns in keep, canonical field, field and amount text of every value of every file."""
    rows = df.select(*[F.col(c) for c in dict.fromkeys([entity, file, *keep])], F.explode(F.from_json(data, "map<string,string>")).alias("field", "value"))
    p = projection.select(F.col("entity").alias(entity), F.col("file").alias(file), "field", "canonical")
    return rows.join(p, [entity, file, "field"]).select(*keep, "canonical", "field", "value")


def amount_text(c: Column) -> Column:
    """The number in a segment value, however written (number, text with separators, object with an amount), as decimal(30,6)."""
    return F.coalesce(F.regexp_replace(c, r"[,\s]", "").try_cast("decimal(30,6)"), F.regexp_replace(F.coalesce(F.get_json_object(c, "$.amount"), F.get_json_object(c, "$.value")), r"[,\s]", "").try_cast("decimal(30,6)"))
