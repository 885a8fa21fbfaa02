"""Peer graphs and exposure.

Edges are produced by equi-joins on small keys only:

* same manager: members of a (department, role, level) group ranked by md5,
  cut into chunks of 8; a self-join on (group, chunk) gives the clique of
  each chunk — at most 56 ordered pairs per chunk, whatever the group size;
* same role: 5 hash draws per member whatever the size of the group,
  resolved by an index join (member #k of the group), so cost is
  O(members · draws), never quadratic;
* same tenure: 3 hash draws per member, same index join.

Exposure walks the undirected edges (stored edges ∪ reversed) to exited
peers and sums weight · exp(-0.1 · days) per node.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_mod
from ..functions.labels import (EDGE_WEIGHTS, EXPOSURE_DECAY, EXPOSURE_WINDOW_DAYS, MANAGER_CHUNK,
                                ROLE_DRAWS, TENURE_COHORTS, TENURE_DRAWS)
from ..session import cut_lineage
from .features import small_join
from .ranking import group_rank, hex_sub_bucket

BROADCAST_IDS = 500_000


def tenure_cohort(years: Column) -> Column:
    expr = None
    for name, upper in TENURE_COHORTS:
        expr = F.when(years < upper, name) if expr is None else expr.when(years < upper, name)
    return expr.otherwise("10+")


def node_table(cohort: DataFrame) -> DataFrame:
    """id, department, role, level, tenure cohort, active flag, exit date
    ('' when none).  Tenure is in years (months / 12)."""
    return cohort.select(
        F.col("employee_id").alias("id"), "department", F.col("job_role").alias("job_role"),
        F.col("job_level").alias("job_level"),
        tenure_cohort(F.col("years_at_company") / 12.0).alias("tenure_cohort"),
        (F.col("attrition") == 0).alias("is_active"),
        F.coalesce(F.col("date_of_leaving"), F.lit("")).alias("exit_date"))


def _ranked(nodes: DataFrame, group: list[str]) -> DataFrame:
    h = F.md5(F.col("id"))
    return group_rank(nodes.withColumn("_h", h), group, "_h", "id", hex_sub_bucket(F.col("_h")))


def _edges(pairs: DataFrame, etype: str) -> DataFrame:
    return pairs.select(F.col("src"), F.col("dst"), F.lit(EDGE_WEIGHTS[etype]).alias("weight"),
                        F.lit("inferred").alias("source"), F.lit(etype).alias("type"))


def same_manager_edges(nodes: DataFrame) -> DataFrame:
    g = ["department", "job_role", "job_level"]
    r = _ranked(nodes.select("id", *g), g).withColumn("chunk", F.floor((F.col("rank") - 1) / MANAGER_CHUNK))
    a = r.select(*g, "chunk", F.col("id").alias("src"))
    b = r.select(*g, "chunk", F.col("id").alias("dst"))
    return _edges(a.join(b, [*g, "chunk"]).where(F.col("src") != F.col("dst")), "SAME_MANAGER")


def _draws(ranked: DataFrame, group: list[str], draws: int, tag: str) -> DataFrame:
    """(group, id, _idx): the places that each member draws."""
    d = ranked.select(*group, "id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k"))
    return d.select(*group, "id", (md5_mod(F.concat_ws("|", F.col("id"), F.lit(tag), F.col("k").cast("string")), 1 << 30)
                                   % F.col("group_size") + 1).alias("_idx"))


def _members(ranked: DataFrame, group: list[str]) -> DataFrame:
    return ranked.select(*group, F.col("rank").alias("_idx"), F.col("id").alias("dst"))


def _pairs(drawn: DataFrame) -> DataFrame:
    return drawn.select(F.col("id").alias("src"), "dst").where(F.col("src") != F.col("dst"))


def _draw_edges(ranked: DataFrame, group: list[str], draws: int, tag: str) -> DataFrame:
    """``draws`` md5 draws per member: member #(md5(id|tag|k) mod n) of the
    group; self-draws dropped; duplicates removed."""
    return _pairs(_draws(ranked, group, draws, tag).join(_members(ranked, group), [*group, "_idx"])).distinct()


def same_role_edges(nodes: DataFrame) -> DataFrame:
    g = ["department", "job_role"]
    r = _ranked(nodes.select("id", *g), g)
    return _edges(_draw_edges(r, g, ROLE_DRAWS, "role"), "SAME_ROLE_DEPT")


def same_tenure_edges(nodes: DataFrame) -> DataFrame:
    g = ["tenure_cohort"]
    r = _ranked(nodes.select("id", *g), g)
    return _edges(_draw_edges(r, g, TENURE_DRAWS, "tenure"), "SAME_TENURE_COHORT")


def all_edges(nodes: DataFrame) -> DataFrame:
    return (same_manager_edges(nodes).unionByName(same_role_edges(nodes))
            .unionByName(same_tenure_edges(nodes)))


def edges_touching(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with an end in ``ids`` (id), and those of their chunks,
    without building the others: draws are matched against the places of those members, or made by
    those members, and only their chunks are paired.  ``ids`` up to a checked
    number are broadcast, so that draws that miss them are never shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    small = F.broadcast if few else (lambda df: df)
    g = ["department", "job_role", "job_level"]
    r = _ranked(nodes.select("id", *g), g).withColumn("chunk", F.floor((F.col("rank") - 1) / MANAGER_CHUNK))
    chunks = r.join(small(ids), "id").select(*g, "chunk").distinct()
    r = r.join(small(chunks), [*g, "chunk"]).select(*g, "chunk", "id")
    pairs = (r.withColumnRenamed("id", "src").join(r.withColumnRenamed("id", "dst"), [*g, "chunk"]).where(F.col("src") != F.col("dst")))
    out = _edges(pairs, "SAME_MANAGER")
    for group, draws, tag, kind in ((["department", "job_role"], ROLE_DRAWS, "role", "SAME_ROLE_DEPT"),
                                    (["tenure_cohort"], TENURE_DRAWS, "tenure", "SAME_TENURE_COHORT")):
        ranked = _ranked(nodes.select("id", *group), group)
        drawn, members = _draws(ranked, group, draws, tag), _members(ranked, group)
        to = drawn.join(small(members.join(small(ids.withColumnRenamed("id", "dst")), "dst")), [*group, "_idx"])
        by = drawn.join(small(ids), "id").join(members, [*group, "_idx"])
        out = out.unionByName(_edges(_pairs(to).union(_pairs(by)).distinct(), kind))
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """Stored edges in both directions, as a pattern match without direction
    sees them (an edge stored both ways is seen twice)."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer")),
                   F.struct(F.col("dst").alias("node"), F.col("src").alias("peer")))
    return edges.select("weight", "type", F.explode(ends).alias("e")).select("e.node", "e.peer", "weight", "type")


def exposure_contributions(edges: DataFrame | None, nodes: DataFrame, as_of: str) -> DataFrame:
    """(node, peer, weight, days, contribution) for exited peers with
    0 <= days since exit <= 60, over ``edges`` or, without them, over the peer
    graph of ``nodes``, of which only edges that touch such a peer are made."""
    exited = cut_lineage(nodes.where(~F.col("is_active") & (F.col("exit_date") != ""))
                         .select(F.col("id").alias("peer"), F.col("job_role").alias("peer_role"),
                                 F.datediff(F.lit(as_of).cast("date"), F.to_date("exit_date")).alias("days"))
                         .where((F.col("days") >= 0) & (F.col("days") <= EXPOSURE_WINDOW_DAYS)))
    if edges is None:
        edges = edges_touching(nodes, exited.select(F.col("peer").alias("id")))
    u = undirected(edges).join(exited, "peer")
    return u.withColumn("contribution", F.col("weight") * F.exp(F.lit(-EXPOSURE_DECAY) * F.col("days")))


def exposure_scores(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("node").agg(F.sum("contribution").alias("exposure_score"),
                                       F.count(F.lit(1)).alias("connected_exits"))


def exposure_curve(contrib: DataFrame) -> DataFrame:
    """61 daily points (day 0 = as-of, back to -60) per node with peers:
    sum of weight · exp(-0.1 · (days - d)) over exits already past at -d."""
    by_day = contrib.groupBy("node", "days").agg(F.sum("weight").alias("weight"))  # at most 61 rows a node
    pts = by_day.select("node", "weight", "days", F.explode(F.sequence(F.lit(0), F.lit(EXPOSURE_WINDOW_DAYS)))
                         .alias("d"))
    val = F.when(F.col("days") - F.col("d") >= 0,
                 F.col("weight") * F.exp(F.lit(-EXPOSURE_DECAY) * (F.col("days") - F.col("d")))).otherwise(0.0)
    return pts.groupBy("node", (-F.col("d")).alias("day")).agg(F.sum(val).alias("score"))


def boosted_risk(general_risk: Column, exposure: Column) -> Column:
    """P = 1 - (1 - p)^(1 + e) on the 0..100 scale."""
    p = general_risk / 100.0
    return (1.0 - F.pow(1.0 - p, 1.0 + exposure)) * 100.0


# ---------------------------------------------------------------------------
# reporting tree
# ---------------------------------------------------------------------------
def org_hierarchy(cohort: DataFrame) -> DataFrame:
    """Manager per employee: a hash-drawn member of the nearest non-empty
    higher level in the department, else the department head; heads report
    to the root.  Returns (id, manager_id, department, role, level, is_active)
    including the root and head rows."""
    emp = cohort.select(F.col("employee_id").alias("id"), "department", F.col("job_role").alias("role"),
                        F.col("job_level_rank").alias("level"), (F.col("attrition") == 0).cast("int")
                        .alias("is_active"))
    pools = emp.groupBy("department", "level").agg(F.count(F.lit(1)).alias("pool_size"))
    # nearest non-empty higher level, from the small (department, level) table
    cand = pools.select("department", F.col("level").alias("target_level"), "pool_size")
    targets = (emp.select("department", "level").distinct()
               .join(cand, "department").where(F.col("target_level") > F.col("level"))
               .groupBy("department", "level").agg(F.min("target_level").alias("target_level")))
    targets = targets.join(cand, ["department", "target_level"])
    e = small_join(emp, targets, ["department", "level"])
    e = e.withColumn("_idx", md5_mod(F.concat(F.col("id"), F.lit("|manager")), 1 << 30) % F.col("pool_size") + 1)
    pool = _ranked(emp.select("id", "department", F.col("level").alias("target_level")),
                   ["department", "target_level"]).select("department", "target_level",
                                                          F.col("rank").alias("_idx"),
                                                          F.col("id").alias("manager_id"))
    e = e.join(pool, ["department", "target_level", "_idx"], "left")
    head = F.concat(F.lit("HEAD_"), F.replace(F.col("department"), F.lit(" "), F.lit("_")))
    e = e.select("id", F.coalesce("manager_id", head).alias("manager_id"), "department", "role", "level",
                 "is_active")
    heads = (emp.select("department").distinct()
             .select(head.alias("id"), F.lit("CEO").alias("manager_id"), "department",
                     F.concat(F.lit("VP of "), F.col("department")).alias("role"), F.lit(None).cast("int")
                     .alias("level"), F.lit(1).alias("is_active")))
    root = cohort.sparkSession.range(1).select(
        F.lit("CEO").alias("id"), F.lit("").alias("manager_id"), F.lit("Executive").alias("department"),
        F.lit("Chief Executive Officer").alias("role"), F.lit(None).cast("int").alias("level"),
        F.lit(1).alias("is_active"))
    return root.unionByName(heads).unionByName(e)


def tree_depths(tree: DataFrame) -> DataFrame:
    """Depth of every node, see ``tree_paths``."""
    return tree_paths(tree).select("id", "depth")


PATH_STEP, PATH_END = "\x01", "\x02"  # ids hold neither


def tree_paths(tree: DataFrame) -> DataFrame:
    """(id, depth, path) of every node by frontier expansion from the root, one
    equi-join per level until no node is left.  The path holds the ids from the
    root down, so that those below a node are the range of paths from its own
    and ``PATH_STEP`` up to its own and ``PATH_END``.  Each level is materialised and taken from
    the rest, so no level repeats the joins of earlier ones.  Nodes that no
    path from the root reaches (a cycle, an unknown manager) are an error."""
    tree = cut_lineage(tree.select("id", "manager_id"))
    level = tree.where(F.col("manager_id") == "").select("id", F.lit(0).alias("depth"), F.col("id").alias("path"))
    out, rest, depth = level, tree.where(F.col("manager_id") != ""), 0
    while not rest.isEmpty():
        depth += 1
        bosses = level.select(F.col("id").alias("manager_id"), F.col("path").alias("above"))
        level = cut_lineage(rest.join(bosses, "manager_id").select(
            "id", F.lit(depth).alias("depth"), F.concat("above", F.lit(PATH_STEP), "id").alias("path")))
        if level.isEmpty():
            raise ValueError("the reporting lines hold a cycle or an unknown manager")
        out = out.unionByName(level)
        rest = cut_lineage(rest.join(bosses.select("manager_id"), "manager_id", "left_anti"))
    return out


def subtrees(labelled: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, id, depth below the head) of every node under each of ``heads``
    (id), itself included.  ``labelled``: id, depth, path.  The heads, few and
    checked so, filter the labels by one range each."""
    found = heads.join(labelled, "id").select(F.col("id").alias("head"), F.col("depth").alias("top"), F.col("path").alias("low"))
    few = found.limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("ask for at most 1000 subtrees at once")
    ranges = F.array(*[F.struct(F.lit(h["head"]).alias("head"), F.lit(h["top"]).alias("top"),
                                F.lit(h["low"]).alias("low"), F.lit(h["low"] + PATH_STEP).alias("first"), F.lit(h["low"] + PATH_END).alias("last"))
                       for h in few]) if few else F.array().cast("array<struct<head:string,top:int,low:string,first:string,last:string>>")
    under = F.filter(ranges, lambda x: (F.col("path") == x["low"]) | ((F.col("path") >= x["first"]) & (F.col("path") < x["last"])))
    return (labelled.select("id", "depth", F.explode(under).alias("r"))
            .select("r.head", "id", (F.col("depth") - F.col("r.top")).alias("depth")))


def department_view(tree: DataFrame, department: str) -> DataFrame:
    """The nodes of one department's page: its members, its head and the root."""
    head = "HEAD_" + department.replace(" ", "_")
    return tree.where((F.col("id") == "CEO") | (F.col("id") == head) | (F.col("department") == department))
