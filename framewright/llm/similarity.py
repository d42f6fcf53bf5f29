"""Grouping boxes into clusters of mutually similar ones.

A record is five numbers: the corners (in order) and the confidence. Records are first pre-aggregated: all
records in one cell of the size of the tolerance are mutually similar, so a cell with the extents of its
members stands for them however many they are, and neighbouring cells whose joint extents stay within the
tolerance are merged into one node. Nodes, not records, are compared.

A node's lower ends are written as tokens, two for each number: its cell in a grid of four tolerances and its
cell in the same grid shifted by half of that. MinHash uses permutations that rank one (number, grid) block
first, so a signature value is the token of that block; a band takes one of the two grids for each of BANDED.
Lower ends at most two tolerances apart share a cell in at least one of the two grids, hence nodes that hold
similar records agree in at least one band, and their token sets have a Jaccard similarity of 1/3 or more:
banding by these permutations loses no similar pair, which random permutations would. Every pair is verified
by the Jaccard similarity and then by the extents, or, where those leave it open, on ever smaller cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.graph import components
from framewright.session import cut

PIXELS = 20.0  #: tolerance of a corner coordinate
CONFIDENCE = 0.2  #: tolerance of the confidence
UNITS = 1000  #: confidences and pixels are compared as whole thousandths
MIN_JACCARD = 1 / 3  #: what two similar records reach at least: 5 tokens of 15
BANDED = ("x1", "y1", "x2")  #: numbers whose grids make up a band
HOT_SHARE = 1000  #: a cell with more than 1/HOT_SHARE of all rows is hot, so there are fewer hot cells than that
HOT_SALTS = 64  #: parts a hot cell is split into
NUMBERS = ["x1", "y1", "x2", "y2", "cf"]
TOLERANCE = {"x1": int(PIXELS * UNITS), "y1": int(PIXELS * UNITS), "x2": int(PIXELS * UNITS), "y2": int(PIXELS * UNITS), "cf": int(CONFIDENCE * UNITS)}


def box_records(detections: DataFrame) -> DataFrame:
    """(video_id, det_id, x1, y1, x2, y2, cf) in thousandths; corners in order, null confidence as 0.

    Boxes without id, video or a corner (null or NaN) are left out; repeated rows of a ``det_id`` are harmless.
    """
    t = lambda c: F.round(c * UNITS).cast("long")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("x1", "y1", "x2", "y2")])
    return detections.where(whole & F.col("det_id").isNotNull() & F.col("video_id").isNotNull()).select(
        "video_id", "det_id",
        t(F.least("x1", "x2")).alias("x1"), t(F.least("y1", "y2")).alias("y1"), t(F.greatest("x1", "x2")).alias("x2"), t(F.greatest("y1", "y2")).alias("y2"),
        t(F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))).alias("cf"),
    )


CELL = [f"c_{n}" for n in NUMBERS]
EXTENT = [f"{p}_{n}" for n in NUMBERS for p in ("lo", "hi")]


def _cells(halvings: int = 0) -> list[Column]:
    return [F.floor(F.col(n) * (1 << halvings) / TOLERANCE[n]).alias(f"c_{n}") for n in NUMBERS]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, parts)


def cells_of(records: DataFrame, halvings: int = 0) -> DataFrame:
    """One row per occupied cell of a video: extents, smallest id, number of rows and the cell's 64-bit hash."""
    extents = [f(n).alias(f"{p}_{n}") for n in NUMBERS for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return records.select("*", *_cells(halvings)).groupBy("video_id", *CELL).agg(F.min("det_id").alias("node"), F.count("*").alias("n"), *extents).withColumn("cell", F.xxhash64(*CELL))


def merge_cells(cells: DataFrame) -> DataFrame:
    """(video_id, node, extents, members): cells that together stay within the tolerance as one node.

    ``members`` are the hashes of a node's cells. Those in one bucket of two tolerances are merged if they fit;
    buckets hold few cells. The second round shifts the buckets by one tolerance, the third the confidence only.
    """
    item = lambda node, extents, members: F.struct(node.alias("node"), *[e.alias(x) for e, x in zip(extents, EXTENT)], members.alias("members"))
    nodes = cells.select("video_id", "node", *EXTENT, F.array("cell").alias("members"))
    for shift in ([0] * 5, [1] * 5, [0, 0, 0, 0, 1]):
        bucket = [F.floor((F.col(f"lo_{n}") / TOLERANCE[n] + s) / 2).alias(f"b_{n}") for n, s in zip(NUMBERS, shift)]
        own = item(F.col("node"), [F.col(x) for x in EXTENT], F.col("members"))
        whole = [(F.min if x.startswith("lo") else F.max)(x).alias(x) for x in EXTENT]
        full = nodes.select("video_id", *bucket, *EXTENT, own.alias("x")).groupBy("video_id", *[f"b_{n}" for n in NUMBERS]).agg(F.collect_list("x").alias("xs"), *whole)
        fits = _all([F.col(f"hi_{n}") - F.col(f"lo_{n}") <= TOLERANCE[n] for n in NUMBERS])
        one = item(F.array_min("xs.node"), [F.col(x) for x in EXTENT], F.flatten("xs.members"))
        nodes = full.select("video_id", F.explode(F.when(fits, F.array(one)).otherwise(F.col("xs"))).alias("x")).select("video_id", "x.*")
    return nodes


def _grid(number: str, value: Column, shifted: int) -> Column:
    return F.floor((value / TOLERANCE[number] + 2 * shifted) / 4)


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """(video_id, a, b, jaccard): pairs of nodes of one video that share a band, each once.

    Only ids pass through the buckets; the extents are joined to the distinct pairs for the verification.
    """
    bands = list(product((0, 1), repeat=len(BANDED)))
    keys = [F.xxhash64("video_id", F.lit(i), *[_grid(n, F.col(f"lo_{n}"), g) for n, g in zip(BANDED, grids)]) for i, grids in enumerate(bands)]
    banded = nodes.select("video_id", "node", F.explode(F.array(*keys)).alias("bucket"))
    buckets = banded.groupBy("video_id", "bucket").agg(F.collect_list("node").alias("xs")).where(F.size("xs") > 1)
    pairs = buckets.select("video_id", "xs", F.explode("xs").alias("p")).select("video_id", "p", F.explode(F.filter("xs", lambda x: x > F.col("p"))).alias("q")).distinct()
    side = lambda s, k: nodes.select("video_id", F.col("node").alias(k), F.struct("node", *EXTENT).alias(s))
    both = pairs.join(side("a", "p"), ["video_id", "p"]).join(side("b", "q"), ["video_id", "q"])
    same = [_grid(n, F.col(f"a.lo_{n}"), g) == _grid(n, F.col(f"b.lo_{n}"), g) for n in NUMBERS for g in (0, 1)]
    shared = reduce(lambda p, q: p + q, [x.cast("int") for x in same])
    return both.withColumn("jaccard", shared / (F.lit(4 * len(NUMBERS)) - shared)).where(F.col("jaccard") >= MIN_JACCARD).select("video_id", "a", "b", "jaccard")


def _verdict() -> Column:
    """'linked' if all members of both sides are similar, 'apart' if none can be, else 'open'."""
    span = lambda n: F.greatest(f"a.hi_{n}", f"b.hi_{n}") - F.least(f"a.lo_{n}", f"b.lo_{n}")
    gap = lambda n: F.greatest(f"a.lo_{n}", f"b.lo_{n}") - F.least(f"a.hi_{n}", f"b.hi_{n}")
    apart = reduce(lambda p, q: p | q, [gap(n) > TOLERANCE[n] for n in NUMBERS])
    return F.when(_all([span(n) <= TOLERANCE[n] for n in NUMBERS]), "linked").when(apart, "apart").otherwise("open")


def members_of(nodes: DataFrame) -> DataFrame:
    """(video_id, node, cell): the cells of each node."""
    return nodes.select("video_id", "node", F.explode("members").alias("cell"))


def _open_links(pairs: DataFrame, cells: DataFrame, records: DataFrame) -> DataFrame:
    """(video_id, a, b): those of the open pairs of nodes that hold at least one similar pair of records.

    The nodes' cells are held against each other by their extents, what stays open on cells of half the size,
    and so on. Cells of a single distinct record settle what is left exactly; only records of open cells take
    part.
    """
    side = lambda s, df, keys: df.select("video_id", *[F.col(k).alias(f"{s}_{k}") for k in keys], F.struct(*CELL, *EXTENT).alias(s))
    own = cells.select("video_id", "node", *CELL, *EXTENT)
    found, level = None, 0
    tried = pairs.withColumnsRenamed({"a": "a_node", "b": "b_node"}).join(side("a", own, ["node"]), ["video_id", "a_node"]).join(side("b", own, ["node"]), ["video_id", "b_node"])
    while True:
        tried = cut(tried.withColumn("verdict", _verdict()).where("verdict <> 'apart'").select("video_id", "a_node", "b_node", "a", "b", "verdict"))
        linked = tried.where("verdict = 'linked'").select("video_id", "a_node", "b_node").distinct()
        found = linked if found is None else found.unionByName(linked)
        still = tried.where("verdict = 'open'").join(linked, ["video_id", "a_node", "b_node"], "left_anti")
        if (TOLERANCE["x1"] >> level) == 0 or still.isEmpty():
            return found.select("video_id", F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        level += 1
        parent = [f"p_{n}" for n in NUMBERS]
        open_cells = still.select("video_id", F.explode(F.array("a", "b")).alias("x")).select("video_id", *[F.col(f"x.{c}").alias(p) for c, p in zip(CELL, parent)]).distinct()
        above = [F.floor(F.col(n) * (1 << (level - 1)) / TOLERANCE[n]).alias(p) for n, p in zip(NUMBERS, parent)]
        inside = records.select("*", *above).join(open_cells, ["video_id", *parent], "left_semi")
        children = cells_of(inside.drop(*parent), level)
        children = children.select("*", *[F.floor(F.col(c) / 2).alias(p) for c, p in zip(CELL, parent)])
        again = still.select("video_id", "a_node", "b_node", *[F.col(f"{s}.{c}").alias(f"{s}_{p}") for s in "ab" for c, p in zip(CELL, parent)])
        tried = again.join(side("a", children, parent), ["video_id", *[f"a_{p}" for p in parent]]).join(side("b", children, parent), ["video_id", *[f"b_{p}" for p in parent]])


def cluster_cells(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, nodes, links, roots): the occupied cells, the nodes they are merged into, the verified links between
    nodes and each node's component, of ``box_records``."""
    cells = cut(cells_of(records))
    nodes = cut(merge_cells(cells))
    judged = cut(candidate_pairs(nodes).withColumn("verdict", _verdict()).where("verdict <> 'apart'"))
    vertices = nodes.select("video_id", "node")
    links = judged.where("verdict = 'linked'").select("video_id", F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    roots = components(links, vertices)
    is_open = judged.where("verdict = 'open'")
    if not is_open.isEmpty():
        root = lambda s: roots.select("video_id", F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
        between = is_open.select("video_id", F.col("a.node").alias("a"), F.col("b.node").alias("b")).join(root("a"), ["video_id", "a"]).join(root("b"), ["video_id", "b"])
        between = cut(between.where("root_a <> root_b").select("video_id", "a", "b"))
        if not between.isEmpty():
            placed = cells.drop("node").join(members_of(nodes), ["video_id", "cell"])
            links = cut(links.unionByName(_open_links(between, placed, records)))
            roots = components(links, vertices)
    return cells, nodes, links, roots


def similarity_groups(detections: DataFrame) -> DataFrame:
    """(group_det_id, det_id): each detection of a group with the group's smallest id, that one itself left out.

    Two detections are similar if they are of one video, no corner coordinate differs by more than PIXELS and
    the confidence by no more than CONFIDENCE; groups are the connected components. Boxes without all corners
    belong to no group; an id that is repeated is listed once; an empty table gives an empty result. Rows find
    their cell by its 64-bit hash within the video; hot cells are split over HOT_SALTS tasks.
    """
    cells, nodes, _, roots = cluster_cells(box_records(detections))
    total = cells.agg(F.sum("n")).first()[0] or 0
    hot = cells.where(F.col("n") * HOT_SHARE > total).select("video_id", "cell", F.lit(HOT_SALTS).alias("salts"))
    with_salts = lambda df: df.join(F.broadcast(hot), ["video_id", "cell"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    members = box_records(detections).select("video_id", "det_id", F.xxhash64(*_cells()).alias("cell"))
    salted = with_salts(members).select("video_id", "cell", "det_id", F.pmod("det_id", "salts").cast("int").alias("salt"))
    targets = with_salts(members_of(nodes).join(roots, ["video_id", "node"])).select("video_id", "cell", "root", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.join(targets, ["video_id", "cell", "salt"]).where("det_id <> root").select(F.col("root").alias("group_det_id"), "det_id").distinct()


def _around(side: DataFrame, other: DataFrame, loose: float) -> DataFrame:
    """(video_id, root, a, b, pb, away): cells ``b`` of the same component at most ``loose`` tolerances from ``a``, itself
    left out, with ``b``'s priority and the greatest distance in any number. They meet by their places in a grid of
    ``loose`` along the first two numbers, so no component is gone through as a whole."""
    grid = [F.floor(F.col(f"m_{n}") / loose).alias(f"g{i}") for i, n in enumerate(NUMBERS[:2])]
    near = F.explode(F.array(*[F.struct(*[(F.floor(F.col(f"m_{n}") / loose) + d).alias(f"g{i}") for i, (n, d) in enumerate(zip(NUMBERS[:2], shift))]) for shift in product((-1, 0, 1), repeat=2)])).alias("g")
    mids = lambda s: F.array(*[f"m_{n}" for n in NUMBERS]).alias(s)
    asking = side.select("video_id", "root", F.col("det_id").alias("a"), mids("ma"), near).select("video_id", "root", "a", "ma", "g.*")
    held = other.select("video_id", "root", F.col("det_id").alias("b"), mids("mb"), F.col("priority").alias("pb"), *grid)
    away = F.array_max(F.zip_with("ma", "mb", lambda x, y: F.abs(x - y)))
    return asking.join(held, ["video_id", "root", "g0", "g1"]).where("a <> b").withColumn("away", away).where(F.col("away") <= loose).select("video_id", "root", "a", "b", "pb", "away")


def _medoids(cells: DataFrame, loose: float) -> DataFrame:
    """(video_id, root, det_id): the cells that become medoids if, by falling priority, each cell of a component that no
    medoid is within ``loose`` of becomes one.

    In a round every cell whose priority is above those of all others left around it becomes a medoid, and those
    around it leave; that picks the same cells as going through them one by one.
    """
    key = ["video_id", "root", "det_id"]
    links = cut(_around(cells, cells, loose).select("video_id", "root", "a", "b", "pb"))
    left = cut(cells.select(*key, "priority"))
    found = None
    while not left.isEmpty():
        others = links.join(left.select("video_id", "root", F.col("det_id").alias("b")), ["video_id", "root", "b"], "left_semi").groupBy("video_id", "root", F.col("a").alias("det_id")).agg(F.max("pb").alias("best"))
        new = cut(left.join(others, key, "left").where(F.col("best").isNull() | (F.col("priority") > F.col("best"))).select(*key))
        found = new if found is None else found.unionByName(new)
        covered = links.join(new.select("video_id", "root", F.col("det_id").alias("b")), ["video_id", "root", "b"], "left_semi").select("video_id", "root", F.col("a").alias("det_id"))
        left = cut(left.join(covered.unionByName(new), key, "left_anti"))
    return found if found is not None else cells.select(*key).limit(0)


def group_summary(detections: DataFrame, typical: int = 3, loose: float = 1.0) -> DataFrame:
    """(video_id, group_det_id, medoid_det_id, size, typical): size and most typical members of each group.

    The degree of a cell is the number of detections similar to its own: those of its node and of the nodes linked
    to that. A group's medoid is its cell of the highest degree (then of the most detections, then of the smallest
    id). A group with cells more than ``loose`` tolerances away from the medoid is loose and is split: those cells
    form groups of their own around the next medoid; a cell goes to the first medoid within ``loose``. Cells are
    joined to those around them, no task holds a component. A repeated detection counts once; ``typical`` lists the
    smallest ids of up to so many cells nearest the medoid. An empty table gives an empty result.
    """
    records = cut(box_records(detections).distinct())
    cells, nodes, links, roots = cluster_cells(records)
    placed = cut(cells.withColumnRenamed("node", "det_id").join(members_of(nodes), ["video_id", "cell"]))
    weight = placed.groupBy("video_id", "node").agg(F.sum("n").alias("rows"))
    both = links.unionAll(links.select("video_id", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(weight.withColumnRenamed("node", "b"), ["video_id", "b"]).groupBy("video_id", F.col("a").alias("node")).agg(F.sum("rows").alias("linked"))
    degree = weight.join(near, ["video_id", "node"], "left").select("video_id", "node", (F.col("rows") + F.coalesce("linked", F.lit(0))).alias("degree"))
    mid = [((F.col(f"lo_{n}") + F.col(f"hi_{n}")) / (2.0 * TOLERANCE[n])).alias(f"m_{n}") for n in NUMBERS]
    priority = F.struct("degree", "n", (-F.col("det_id")).alias("id")).alias("priority")
    seen = cut(placed.join(roots, ["video_id", "node"]).join(degree, ["video_id", "node"]).select("video_id", "root", "det_id", "n", priority, *mid))
    mids = F.array(*[f"m_{n}" for n in NUMBERS])
    first = seen.groupBy("video_id", "root").agg(F.max(F.struct("priority", mids.alias("at"))).alias("m")).select("video_id", "root", (-F.col("m.priority.id")).alias("medoid"), F.col("m.at").alias("at"))
    held = cut(seen.join(first, ["video_id", "root"]).withColumn("away", F.array_max(F.zip_with(mids, "at", lambda x, y: F.abs(x - y)))).drop("at"))
    split = cut(held.where(F.col("away") > loose).select("video_id", "root").distinct())
    whole = held.join(split, ["video_id", "root"], "left_anti").select("video_id", "root", "medoid", "det_id", "n", "away")
    apart = seen.join(split, ["video_id", "root"], "left_semi")
    medoids = cut(apart.join(_medoids(apart, loose), ["video_id", "root", "det_id"], "left_semi"))
    own = medoids.select("video_id", "root", F.col("det_id").alias("medoid"), "det_id", "n", F.lit(0.0).alias("away"))
    others = apart.join(medoids.select("video_id", "root", "det_id"), ["video_id", "root", "det_id"], "left_anti")
    nearest = _around(others, medoids, loose).groupBy("video_id", "root", F.col("a").alias("det_id")).agg(F.max_by(F.struct("b", "away"), "pb").alias("m"))
    joined = others.join(nearest, ["video_id", "root", "det_id"]).select("video_id", "root", F.col("m.b").alias("medoid"), "det_id", "n", F.col("m.away").alias("away"))
    members = cut(whole.unionByName(own).unionByName(joined))
    group = ["video_id", "root", "medoid"]
    facts = members.groupBy(*group).agg(F.min("det_id").alias("group_det_id"), F.sum("n").alias("size"))
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("away", "det_id"))).where(F.col("rank") <= typical)
    best = ranked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "det_id"))), lambda x: x["det_id"]).alias("typical"))
    return facts.join(best, group).select("video_id", "group_det_id", F.col("medoid").alias("medoid_det_id"), "size", "typical")
