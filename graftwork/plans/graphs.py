"""Closures over the graph of the star tables: region, nation, customer, order, part, supplier."""

from pyspark.sql import functions as F

from graftwork.operators import closure
from graftwork.plans.registry import Tables, query

node = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(t: Tables, back: bool = True):
    """(src, dst) with the back edge from supplier to nation, which closes cycles."""
    placed = [
        t.nation.select(node("r:", "n_regionkey").alias("src"), node("n:", "n_nationkey").alias("dst")),
        t.customer.select(node("n:", "c_nationkey").alias("src"), node("c:", "c_custkey").alias("dst")),
        t.orders.select(node("c:", "o_custkey").alias("src"), node("o:", "o_orderkey").alias("dst")),
        t.lineitem.select(node("o:", "l_orderkey").alias("src"), node("p:", "l_partkey").alias("dst")),
        t.lineitem.select(node("p:", "l_partkey").alias("src"), node("s:", "l_suppkey").alias("dst")),
    ]
    if back:
        placed.append(t.supplier.select(node("s:", "s_suppkey").alias("src"), node("n:", "s_nationkey").alias("dst")))
    return closure.union_edges(*placed)


EDGES = """
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
  UNION SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
  UNION SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
  UNION SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem"""
BACK = "\n  UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier"


@query(f"""
WITH RECURSIVE edges AS ({EDGES}{BACK}),
walk(node, depth) AS (
  SELECT 'r:' || r_regionkey, 0 FROM region WHERE r_name = 'ASIA'
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 10
)
SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node
""")
def closure_from_region(t: Tables):
    roots = t.region.filter("r_name = 'ASIA'").select(node("r:", "r_regionkey").alias("node"))
    return closure.reach(edges(t), roots)


@query(f"""
WITH RECURSIVE edges AS ({EDGES}),
walk(root, node, depth) AS (
  SELECT r_name, 'r:' || r_regionkey, 0 FROM region
  UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3
)
SELECT root, node, min(depth)::INTEGER AS depth FROM walk GROUP BY root, node
""")
def closure_bounded_per_root(t: Tables):
    roots = t.region.select(F.col("r_name").alias("root"), node("r:", "r_regionkey").alias("node"))
    return closure.reach(edges(t, back=False), roots, max_depth=3, by=("root",))


@query(f"""
WITH RECURSIVE edges AS ({EDGES}),
walk(node) AS (
  SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node
)
SELECT 'p:' || p_partkey AS node FROM part WHERE 'p:' || p_partkey NOT IN (SELECT node FROM walk)
""")
def unreachable_parts(t: Tables):
    roots = t.customer.filter("c_mktsegment = 'BUILDING'").select(node("c:", "c_custkey").alias("node"))
    return closure.unreachable(t.part.select(node("p:", "p_partkey").alias("node")), closure.reach(edges(t, back=False), roots))


@query("""
WITH RECURSIVE deps AS (
  SELECT DISTINCT c_nationkey AS package, s_nationkey AS dep_package
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE o_orderpriority = '1-URGENT' AND l_quantity >= 49
), inside AS (SELECT d.* FROM deps d JOIN nation ON n_nationkey = d.dep_package WHERE n_regionkey <> 2),
walk(package) AS (
  SELECT n_nationkey FROM nation WHERE n_regionkey = 2
  UNION SELECT i.dep_package FROM walk w JOIN inside i ON i.package = w.package
)
SELECT package FROM walk
""")
def package_closure(t: Tables):
    sold = t.orders.filter("o_orderpriority = '1-URGENT'").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem.filter("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    deps = sold.select(F.col("c_nationkey").alias("package"), F.col("s_nationkey").alias("dep_package")).distinct()
    named = t.nation.select(F.col("n_nationkey").alias("package"), "n_regionkey")
    return closure.package_closure(deps, named.filter("n_regionkey <> 2"), named.filter("n_regionkey = 2"))


@query("""
WITH calls AS (SELECT 'c' || o_custkey AS owner, 'c' || (l_partkey % ((SELECT count(*) FROM customer) + 50)) AS target, l_linenumber % 2 = 0 AS inside FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
known AS (SELECT 'c' || c_custkey AS id FROM customer)
SELECT count(*) AS calls, count(*) FILTER (owner <> target AND target IN (SELECT id FROM known)) AS edges, count(*) FILTER (inside AND target NOT IN (SELECT id FROM known)) AS unmapped FROM calls
""")
def call_edge_counters(t: Tables):
    n = t.customer.agg(F.count("*").alias("n"))
    calls = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(n)).select(node("c", "o_custkey").alias("owner"), F.concat(F.lit("c"), (F.col("l_partkey") % (F.col("n") + 50)).cast("string")).alias("target"), (F.col("l_linenumber") % 2 == 0).alias("in_workspace"))
    every = t.customer.select(node("c", "c_custkey").alias("id"))
    return closure.call_edges(calls, every, every)[1]


@query("""
WITH RECURSIVE aliases AS (SELECT o_custkey AS path, min(o_custkey + 1 + o_orderkey % 3) AS target FROM orders GROUP BY o_custkey),
types AS (SELECT c_custkey AS path FROM customer WHERE c_mktsegment = 'MACHINERY'),
walk(start, at_) AS (
  SELECT c_custkey, c_custkey FROM customer
  UNION SELECT w.start, a.target FROM walk w JOIN aliases a ON a.path = w.at_ WHERE w.at_ NOT IN (SELECT path FROM types)
)
SELECT c_custkey AS start, max(w.at_) FILTER (w.at_ IN (SELECT path FROM types)) AS target FROM customer JOIN walk w ON w.start = c_custkey GROUP BY c_custkey
""")
def reexport_chains(t: Tables):
    aliases = t.orders.groupBy(F.col("o_custkey").alias("path")).agg(F.min(F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("target"))
    types = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("path"))
    return closure.resolve_chain(t.customer.select(F.col("c_custkey").alias("start")), aliases, types)


@query("""
WITH RECURSIVE reached AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
cand AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM reached)),
links AS (SELECT DISTINCT o_custkey AS owner, l_partkey AS dep FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50),
inside AS (SELECT l.* FROM links l JOIN cand c ON c.id = l.dep),
seeds AS (SELECT c.id FROM cand c JOIN customer ON c_custkey = c.id WHERE c_acctbal < 0),
walk(id) AS (SELECT id FROM seeds UNION SELECT i.dep FROM walk w JOIN inside i ON i.owner = w.id)
SELECT id, id IN (SELECT id FROM seeds) AS direct FROM walk
""")
def retained_by_unknown(t: Tables):
    reached = t.orders.filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    cand = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal").join(reached, "id", "left_anti")
    links = t.orders.join(t.lineitem.filter("l_quantity >= 50"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("dep")).distinct()
    evidence = cand.select("id", F.lit(True).alias("mapped"), F.lit(False).alias("referenced"), (F.col("c_acctbal") < 0).alias("failed"), F.lit(False).alias("mentioned"))
    return closure.blocked_by_unknown(cand.select("id"), links, evidence)


@query("""
SELECT c_custkey AS custkey, arg_min(o_orderkey, o_orderpriority || lpad(o_orderkey::VARCHAR, 12, '0')) FILTER (o_orderstatus = 'F') AS orderkey
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def first_success(t: Tables):
    tries = t.orders.select(F.col("o_custkey").alias("custkey"), F.concat("o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("priority"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("orderkey"))
    return closure.first_success(tries, "custkey", "priority", "orderkey")
