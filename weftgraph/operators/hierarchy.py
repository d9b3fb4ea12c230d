"""Parent-child links to full hierarchies: leaf peeling, cycles, paths, depths, roots, descendants.

Nodes are numbered once; the rounds move pairs of numbers only. ``peel`` takes the leaves (nodes without children left) off
round by round. A round costs one shuffle of the links still alive, and a round that takes off less than one part in
``SLOW`` of them shows that only single chains and cycles are left: those levels, some hundred in deep hierarchies, are
joined by doubling, in as many rounds as the logarithm of the depth. The rounds thus follow the shape of the data; there is
no fixed number of them.

Upwards, each peeled leaf sends its descendants (rows, not arrays, so no task holds a whole subtree) to its parents, which
counts subtree sizes. Downwards, in reverse peel order, parents hand path, depth and root to their children. What peeling
from both ends leaves over contains the cycles.

Nulls: links with a null end are ignored. Repeated links count once. Empty tables give empty results. A node that is its
own parent is on a cycle. Nodes that only lead to a cycle are on none; path, depth and root follow a node's first parent
(in the order of its entries), and are null where that way enters a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut

#: Peeling goes on as long as a round takes off at least one part in SLOW of the links.
SLOW = 16


def bare_name(entry: Column) -> Column:
    """Class name of a base entry, without module, namespace, type arguments, pointer signs and access words."""
    x = entry
    for _ in range(4):
        x = F.regexp_replace(x, r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)", "")
    x = F.trim(F.regexp_replace(x, r"[<\[(].*$|[*&]", " "))
    return F.regexp_extract(x, r"([^\s.:]+)$", 1)


def parent_links(classes: DataFrame) -> DataFrame:
    """(repo_id, child, parent, ord) of live classes: each base or interface entry that names a class of its repository.

    The entries are exploded and joined by bare name; ``ord`` is the entry's place (bases before interfaces).
    """
    entries = F.concat(F.coalesce("base_classes", F.array().cast("array<string>")), F.coalesce("interfaces", F.array().cast("array<string>")))
    e = classes.select("repo_id", F.col("id").alias("child"), F.posexplode(entries).alias("ord", "entry"))
    e = e.select("repo_id", "child", "ord", bare_name(F.col("entry")).alias("name")).filter("name <> ''")
    named = classes.select("repo_id", "name", F.col("id").alias("parent"))
    return e.join(named, ["repo_id", "name"]).groupBy("repo_id", "child", "parent").agg(F.min("ord").alias("ord"))


def numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbers, pairs): a number v for every (repo_id, id) of a link end, and the links as (child, parent, ord) of numbers."""
    known = cut(links.filter("child is not null and parent is not null").groupBy("repo_id", "child", "parent").agg(F.min("ord").alias("ord")))
    ends = known.select("repo_id", F.explode(F.array("child", "parent")).alias("id")).distinct()
    numbers = cut(ends.withColumn("v", F.monotonically_increasing_id()))
    at = lambda end: numbers.select("repo_id", F.col("id").alias(end), F.col("v").alias(f"{end}_v"))
    pairs = known.join(at("child"), ["repo_id", "child"]).join(at("parent"), ["repo_id", "parent"])
    return numbers, cut(pairs.select(F.col("child_v").alias("child"), F.col("parent_v").alias("parent"), "ord"))


def peel(pairs: DataFrame, both_ends: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, rest): the links (child, parent) of the leaves taken off in each round, and the links left over.

    ``both_ends`` also takes off links whose parent has no parent left; their rounds are not kept, as only cycles are asked for.
    """
    alive, rounds = pairs, []
    size = alive.count()
    while size:
        inner = alive.select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
        split = alive.join(inner, "child", "left")
        if both_ends:
            top = alive.select(F.col("child").alias("parent")).distinct().withColumn("below", F.lit(True))
            split = split.join(top, "parent", "left").withColumn("inner", F.col("inner") & F.col("below"))
        split = cut(split.select(*pairs.columns, F.coalesce("inner", F.lit(False)).alias("inner")))
        alive = split.filter("inner").drop("inner")
        left = alive.count()
        if not both_ends and left < size:
            rounds.append(split.filter("not inner").drop("inner"))
        taken, size = size - left, left
        if taken * SLOW < taken + left:
            break
    return rounds, alive


def doubled(pairs: DataFrame) -> DataFrame:
    """All (node, ancestor) over links (child, parent), by doubling.

    ``known`` holds pairs of distance 1 .. 2^k - 1, ``step`` pairs of distance 2^k. In a tree every pair is made once;
    the result is as large as the descendant lists asked for. Stops when no pair is new.
    """
    step = cut(pairs.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    known, size = step.limit(0), 0
    while True:
        on = step.withColumnRenamed("ancestor", "mid")
        up = on.join(known.withColumnRenamed("node", "mid"), "mid").select("node", "ancestor") if size else known
        grown = cut(known.unionByName(step).unionByName(up).distinct())
        now = grown.count()
        if now == size:
            return grown
        known, size = grown, now
        step = cut(on.join(step.withColumnRenamed("node", "mid"), "mid").select("node", "ancestor").distinct())


def lineage(rounds: list[DataFrame], rest: DataFrame) -> DataFrame:
    """All (node, ancestor) pairs of numbers: each round's leaves send themselves and their descendants to their parents.

    The descendants of a leaf are complete when it is peeled, so every pair is sent once over every link above it. Leaves
    that hang on the rest send theirs to the parents and those parents' ancestors within the rest.
    """
    out, below = [], None
    for front in rounds:
        own = front.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
        if below is not None:
            sent = below.join(front.select(F.col("child").alias("mid"), F.col("parent").alias("up")), F.col("ancestor") == F.col("mid"))
            own = own.unionByName(sent.select("node", F.col("up").alias("ancestor")))
        own = cut(own.distinct())
        out.append(own)
        below = own if below is None else cut(below.unionByName(own).distinct())
    inner = doubled(rest)
    if below is None:
        return inner
    over = below.join(inner.select(F.col("node").alias("mid"), F.col("ancestor").alias("up")), F.col("ancestor") == F.col("mid"))
    return cut(below.unionByName(inner).unionByName(over.select("node", F.col("up").alias("ancestor"))).distinct())


def closure(links: DataFrame) -> DataFrame:
    """All (repo_id, node, ancestor) pairs over child -> parent links."""
    numbers, pairs = numbered(links if "ord" in links.columns else links.withColumn("ord", F.lit(0)))
    return _named(numbers, lineage(*peel(pairs)))


def _named(numbers: DataFrame, pairs: DataFrame) -> DataFrame:
    at = lambda end: numbers.select(F.col("v").alias(end), F.col("id").alias(f"{end}_id"), F.col("repo_id").alias(f"{end}_repo"))
    out = pairs.join(at("node"), "node").join(at("ancestor").drop("ancestor_repo"), "ancestor")
    return out.select(F.col("node_repo").alias("repo_id"), F.col("node_id").alias("node"), F.col("ancestor_id").alias("ancestor"))


def on_cycle(links: DataFrame) -> DataFrame:
    """(repo_id, id) of the nodes on a cycle: what peeling from both ends leaves over and is its own ancestor."""
    numbers, pairs = numbered(links if "ord" in links.columns else links.withColumn("ord", F.lit(0)))
    _, rest = peel(pairs, both_ends=True)
    loops = doubled(rest).filter("node = ancestor").select(F.col("node").alias("v"))
    return numbers.join(loops, "v", "left_semi").select("repo_id", "id")


def jumped(state: DataFrame) -> DataFrame:
    """Pointer jumping over (v, up, names, depth, top): every node takes over what its target holds and doubles the jump, until
    no node has a target left or only cycles do."""
    before = -1
    while True:
        left = state.filter("up is not null")
        n = left.count()
        if n in (0, before):
            return state
        before = n
        target = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("names").alias("names2"), F.col("depth").alias("depth2"), F.col("top").alias("top2"))
        moved = left.join(target, "up").select("v", F.col("up2").alias("up"), F.concat("names2", "names").alias("names"), (F.col("depth") + F.col("depth2") + 1).alias("depth"), F.col("top2").alias("top"))
        state = cut(state.filter("up is null").unionByName(moved))


def ways(names: DataFrame, pairs: DataFrame, rounds: list[DataFrame], rest: DataFrame) -> DataFrame:
    """(v, names, depth, top) of every numbered node with a way to a root: names from the root down, depth, number of the root.

    Nodes of the rest and the nodes above come first, by pointer jumping; then the rounds in reverse peel order, each node
    one step below its first parent, which was peeled later or not at all.
    """
    first = pairs.groupBy(F.col("child").alias("v")).agg(F.min_by("parent", F.struct("ord", "parent")).alias("up"))
    peeled = None
    for front in rounds:
        part = front.select(F.col("child").alias("v")).distinct()
        peeled = part if peeled is None else peeled.unionByName(part)
    upper = names.join(peeled, "v", "left_anti") if peeled is not None else names
    state = upper.join(first, "v", "left").select("v", "up", F.array("name").alias("names"), F.lit(0).alias("depth"), F.col("v").alias("top"))
    done = jumped(cut(state)).filter("up is null").drop("up")
    for front in reversed(rounds):
        mine = front.select(F.col("child").alias("v")).distinct().join(first, "v").join(names, "v")
        over = done.select(F.col("v").alias("up"), F.col("names").alias("above"), F.col("depth").alias("over"), "top")
        below = mine.join(over, "up").select("v", F.concat("above", F.array("name")).alias("names"), (F.col("over") + 1).alias("depth"), "top")
        done = cut(done.unionByName(below))
    return done


def hierarchy(classes: DataFrame) -> DataFrame:
    """Each class with path, depth and root along its first parent, subtree size over all links, and whether it is on a cycle."""
    nodes = classes.select("repo_id", "id", "name")
    numbers, pairs = numbered(parent_links(classes))
    rounds, rest = peel(pairs)
    all_pairs = lineage(rounds, rest)
    names = numbers.join(nodes, ["repo_id", "id"]).select("v", "name")
    way = ways(names, pairs, rounds, rest).select("v", F.array_join("names", "/").alias("path"), "depth", "top")
    root = numbers.select(F.col("v").alias("top"), F.col("id").alias("root"))
    size = all_pairs.groupBy(F.col("ancestor").alias("v")).agg(F.count_if(F.col("node") != F.col("ancestor")).alias("descendants"), F.bool_or(F.col("node") == F.col("ancestor")).alias("on_cycle"))
    facts = numbers.join(way, "v", "left").join(root, "top", "left").join(size, "v", "left").select("repo_id", "id", F.lit(True).alias("linked"), "path", "depth", "root", "descendants", "on_cycle")
    alone = F.col("linked").isNull()
    out = nodes.join(facts, ["repo_id", "id"], "left")
    return out.select(
        "repo_id", F.col("id").alias("class_id"), F.when(alone, F.col("name")).otherwise(F.col("path")).alias("path"), F.when(alone, 0).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        F.when(alone, F.col("id")).otherwise(F.col("root")).alias("root"), F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
    )


def descendants(classes: DataFrame) -> DataFrame:
    """(repo_id, class_id, descendant_id) of every class over all parent links, one row per pair."""
    return closure(parent_links(classes)).select("repo_id", F.col("ancestor").alias("class_id"), F.col("node").alias("descendant_id"))
