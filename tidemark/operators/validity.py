"""Attributes as they were known at the time of an event, by dyadic time nodes.

A validity interval [from, to) is covered by nodes of dyadic trees over time: units of 32 days in the first, what is
left at its ends by days in the second, then by minutes, at last by milliseconds. An event lies in exactly one node of
each level, so it meets all intervals around it by equality of nodes; since a node of a cover lies wholly inside its
interval, such a match is exact, and of all intervals over one node only the first by precedence need stay. Neither a
window over an entity nor pairs of events and intervals arise, however many rows an entity has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

DAY = 86_400_000
#: Units of the trees, in milliseconds. A unit's tree numbers it within the unit before.
UNITS = (32 * DAY, DAY, 60_000, 1)
#: Bytes that a node (with the packed row it carries) and a question for one take in a shuffle, as measured.
NODE_BYTES, ASKED_BYTES = 20, 10


def _levels(bits: int, stride: int) -> list[int]:
    return list(range(0, bits + 1, stride))


def best_stride(bits: int, pieces: int, units: int, sides: int) -> int:
    """The stride that moves the fewest bytes: with a greater one, units ask fewer nodes and intervals have more.

    An interval whose cover is open on one side has (2**stride - 1) / 2 nodes a level used, on both sides twice that.
    Only the work depends on it, not the result.
    """
    return min((1, 2, 3, 4), key=lambda s: len(_levels(bits, s)) * (pieces * sides * (2**s - 1) / 2 * NODE_BYTES + units * ASKED_BYTES))


def _cover(a: Column, b: Column, levels: Sequence[int]) -> Column:
    """The nodes of the levels that lie in [a, b) while their parents don't: array<struct<level, prefix>>."""
    parts = []
    for i, level in enumerate(levels):
        lo, hi = F.shiftright(a + ((1 << level) - 1), level), F.shiftright(b, level)
        span = lambda x, y, at=level: F.when(y > x, F.transform(F.sequence(x, y - 1), lambda p: F.struct(F.lit(at).alias("level"), p.alias("prefix")))).otherwise(F.array().cast("array<struct<level:int,prefix:bigint>>"))
        if i + 1 == len(levels):
            parts.append(span(lo, hi))
            continue
        up = levels[i + 1]
        plo, phi = F.shiftright(a + ((1 << up) - 1), up), F.shiftright(b, up)
        inner = phi > plo
        parts += [span(lo, F.when(inner, F.shiftleft(plo, up - level)).otherwise(hi)), F.when(inner, span(F.shiftleft(phi, up - level), hi)).otherwise(F.array().cast("array<struct<level:int,prefix:bigint>>"))]
    return F.concat(*parts)


def _best(pieces: DataFrame, columns: Sequence[str]) -> tuple[Column, Callable[[Column], Column]]:
    """A value that compares as the columns in their order, the last of which is the id, and the id of such a value.

    Whole numbers and dates whose ranges together fit into 37 digits are packed into one decimal, of which Spark forms
    the maximum by hashing. The ranges are those of the data, nulls come first in each. All else becomes a struct, for
    which it must sort.
    """
    kinds = dict(pieces.dtypes)
    if all(kinds[c] in ("tinyint", "smallint", "int", "bigint", "date") for c in columns):
        whole = {c: (F.unix_date(c) if kinds[c] == "date" else F.col(c)).cast("decimal(20,0)") for c in columns}
        r = pieces.agg(*[f(whole[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        low = [int(r[f"lo{i}"] or 0) for i in range(len(columns))]
        width = [int(r[f"hi{i}"] or 0) - low[i] + 2 for i in range(len(columns))]
        total, packed = 1, None
        for i, c in enumerate(columns):
            total *= width[i]
            if total >= 10**37:
                break
            own = F.coalesce(whole[c] - F.lit(Decimal(low[i] - 1)), F.lit(Decimal(0)))
            packed = (own if packed is None else packed * F.lit(Decimal(width[i])) + own).cast(f"decimal({len(str(total))},0)")
        else:
            return packed.cast("decimal(38,0)"), lambda x: ((x % F.lit(Decimal(width[-1]))) + F.lit(Decimal(low[-1] - 1))).cast(kinds[columns[-1]])
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]), lambda x: x.getField(f"k{len(columns) - 1}")


def _resolve(points: DataFrame, pieces: DataFrame, unit: int, levels: Sequence[int], last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(e, u, best, split) of the units in which points lie, and the parts of pieces left at their ends (e, u, a, b, best).

    Pieces are [a, b) in milliseconds; best is the first of those that hold for the whole unit, split tells whether
    others hold for parts of it. Points of an entity in one unit share its nodes: the tree is asked once for them, so
    a node meets at most as many rows as it has units.
    """
    end = F.expr(f"b div {unit}")
    node = F.col("n.level").cast("long") * 2**52 + F.col("n.prefix")
    nodes = pieces.select("e", "best", F.explode(_cover(F.expr(f"(a + {unit - 1}) div {unit}"), end, levels)).alias("n")).groupBy("e", node.alias("node")).agg(F.max("best").alias("best"))
    units = points.select("e", F.expr(f"t div {unit}").alias("u")).distinct()
    # Unit and level travel as one number; the node is formed where the sides meet.
    asked = units.select(F.col("e").alias("ae"), F.explode(F.array(*[F.col("u") * 64 + level for level in levels])).alias("ul"))
    at = F.expr(f"(ul % 64) * {2**52} + shiftright(ul div 64, cast(ul % 64 as int))")
    best = asked.join(nodes, (F.col("ae") == F.col("e")) & (at == F.col("node"))).groupBy("e", F.expr("ul div 64").alias("u")).agg(F.max("best").alias("best"))
    if last:
        return best.withColumn("split", F.lit(False)), None
    none = F.array().cast("array<struct<u:bigint,a:bigint,b:bigint>>")
    begin = F.expr(f"a div {unit}")
    part = lambda u, a, b: F.array(F.struct(u.alias("u"), a.cast("long").alias("a"), b.cast("long").alias("b")))
    head = F.when(F.expr(f"a % {unit} <> 0"), part(begin, F.col("a"), F.least((begin + 1) * unit, F.col("b")))).otherwise(none)
    tail = F.when(F.expr(f"b % {unit} <> 0") & ((end > begin) | F.expr(f"a % {unit} = 0")), part(end, end * unit, F.col("b"))).otherwise(none)
    ends = pieces.select("e", "best", F.explode(F.concat(head, tail)).alias("p")).select("e", "p.u", "p.a", "p.b", "best")
    split = ends.select("e", "u").distinct().withColumn("split", F.lit(True))
    return best.join(split, ["e", "u"], "full").select("e", "u", "best", F.coalesce("split", F.lit(False)).alias("split")), ends


def as_known_at(events: DataFrame, attributes: DataFrame, *, entity: str, event_id: str, event_time: str, attribute_id: str, valid_from: str, valid_to: str | None = None, precedence: Sequence[str] = (), stride: int | None = None) -> DataFrame:
    """(event_id, attribute_id): for each event the attribute row valid at its time that comes first by precedence.

    entity names the key column of both inputs; times are bigint milliseconds since 1970. A row of attributes is valid
    in [valid_from, valid_to), without an end where valid_to is not given or null. Of several valid rows the one with
    the greatest precedence columns, in their order, wins, at last the greatest attribute_id; nulls in them come last.

    Events with a null entity, time or id, rows with a null entity, id or valid_from, and empty intervals match
    nothing; events without a match aren't returned. Repeated rows count once; an event_id with several entities or
    times is answered for each, equal answers once. Other columns of either input are neither read nor returned, so
    clashing names do no harm.

    The first tree spans the days between the first and the last event; open intervals end with the tree, so that
    their covers are open on one side only. Of each tree only every stride-th level is used, by default the stride
    that moves the fewest bytes for these inputs in the first tree and two in the others. Events in units in which no interval of their entity begins or ends
    are settled there; only the others go on to finer units. Both inputs and what goes on are written once, as several
    passes read them. Events meet their unit's answer in a plain join, whose inputs come straight from a shuffle, so
    that adaptive execution splits the units of a hot entity.
    """
    ev = cut(events.where(F.col(entity).isNotNull() & F.col(event_time).isNotNull() & F.col(event_id).isNotNull()).select(F.col(entity).alias("e"), F.col(event_id).alias("id"), F.col(event_time).cast("long").alias("t")))
    lo, hi = ev.agg(F.min("t"), F.max("t")).first()
    first_day, last_day = (lo or 0) // DAY, (hi or 0) // DAY
    bits = max(((last_day - first_day) // (UNITS[0] // DAY)).bit_length(), 1)
    top = UNITS[0] << bits
    usable = attributes.where(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(attribute_id).isNotNull())
    begin = F.greatest(F.col(valid_from).cast("long"), F.lit(first_day * DAY)) - first_day * DAY
    end = F.greatest(F.least(F.coalesce(F.col(valid_to).cast("long"), F.lit(first_day * DAY + top)), F.lit(first_day * DAY + top)), F.lit(first_day * DAY)) - first_day * DAY if valid_to else F.lit(top)
    order = [f"__k{i}" for i in range(len(precedence) + 1)]
    ranks = [F.col(c).alias(k) for k, c in zip(order, [*precedence, attribute_id])]
    rows = cut(usable.select(F.col(entity).alias("e"), begin.cast("long").alias("a"), end.cast("long").alias("b"), *ranks).where("a < b"))
    packed, unpacked = _best(rows, order)
    pieces = rows.select("e", "a", "b", packed.alias("best"))
    points = ev.select("e", "id", (F.col("t") - first_day * DAY).alias("t"), F.lit(None).cast(dict(pieces.dtypes)["best"]).alias("base"))
    sides, found = 2 if valid_to else 1, None
    for i, unit in enumerate(UNITS):
        last = i + 1 == len(UNITS)
        if i:
            bits = (UNITS[i - 1] // unit - 1).bit_length()
        # Behind the first tree about as many ends as events are left, for which two is best: nothing need be counted.
        step = stride or (2 if i else best_stride(bits, pieces.count(), points.count(), sides))
        answers, ends = _resolve(points, pieces, unit, _levels(bits, step), last)
        met = points.withColumn("u", F.expr(f"t div {unit}")).join(answers, ["e", "u"], "left" if i else "inner")
        met = met.select("e", "id", "t", F.greatest("base", "best").alias("base"), F.coalesce("split", F.lit(False)).alias("split"))
        if not last:
            # What is settled keeps only its answer.
            met = cut(met.where("split or base is not null").select("id", "base", "split", *[F.when(F.col("split"), F.col(c)).alias(c) for c in ("e", "t")]))
            points = met.where("split").select("e", "id", "t", "base")
            units = points.select("e", F.expr(f"t div {unit}").alias("u")).distinct()
            pieces = cut(ends.join(units, ["e", "u"], "left_semi").select("e", "a", "b", "best"))
        done = met.where("not split and base is not null").select("id", "base")
        found = done if found is None else found.unionByName(done)
    return found.select(F.col("id").alias(event_id), unpacked(F.col("base")).alias(attribute_id)).distinct()
