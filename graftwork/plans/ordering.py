"""Positions, budgets, dedup, samples and edits."""

from pyspark.sql import functions as F

from graftwork.functions import hashing
from graftwork.operators import edits, order, spans
from graftwork.plans.registry import Tables, query

FNV = "list_reduce(list_prepend({start}::HUGEINT, list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::INTEGER::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)"
START = 14695981039346656037


def fnv(text: str, seed: int = 0) -> str:
    return FNV.format(start=START ^ seed, text=text)


@query("""
WITH pts AS (SELECT o_orderkey AS point, o_custkey AS file, (o_orderdate::DATE - DATE '1970-01-01') AS line, o_orderkey % 9 AS col FROM orders),
spans AS (
  SELECT 'item' || file AS id, 'item' AS kind, file, min(line) AS a, max(line) AS b, 3 AS ca, 4 AS cb FROM pts GROUP BY file
  UNION ALL SELECT 'call' || point, 'callable', file, line, line + point % 90, 4, 6 FROM pts WHERE point IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
), ranked AS (
  SELECT p.point, p.file, p.line, s.id, s.kind, row_number() OVER (PARTITION BY p.point ORDER BY (s.kind <> 'callable'), (s.b - s.a) * 10000 + greatest(s.cb - s.ca, 0), s.id) AS n
  FROM pts p LEFT JOIN spans s ON s.file = p.file AND (p.line, p.col) >= (s.a, s.ca) AND (p.line, p.col) <= (s.b, s.cb)
)
SELECT point, file, line, id AS owner, kind AS owner_kind FROM ranked WHERE n = 1
""")
def innermost_span(t: Tables):
    pts = t.orders.select(F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("file"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("line"), (F.col("o_orderkey") % 9).alias("col"), "o_orderpriority")
    cols = lambda a, b: (F.lit(a).alias("start_col"), F.lit(b).alias("end_col"))
    item = pts.groupBy("file").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).select(F.concat(F.lit("item"), "file").alias("id"), F.lit("item").alias("kind"), "file", "start_line", "end_line", *cols(3, 4))
    call = pts.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("call"), "point").alias("id"), F.lit("callable").alias("kind"), "file", F.col("line").alias("start_line"), (F.col("line") + F.col("point") % 90).alias("end_line"), *cols(4, 6))
    return spans.innermost(pts.drop("o_orderpriority"), item.unionByName(call)).select("point", "file", "line", "owner", "owner_kind")


@query("""
SELECT doc_id, length(substr(text, 1, n_chars // 2)) - length(replace(substr(text, 1, n_chars // 2), chr(10), '')) + 1 AS line,
  length(list_extract(string_split(substr(text, 1, n_chars // 2), chr(10)), -1)) AS col
FROM documents WHERE n_chars // 2 <= length(text)
""")
def text_positions(t: Tables):
    at = spans.position_of(F.col("text"), F.floor(F.col("n_chars") / 2))
    return t.documents.select("doc_id", at.alias("p")).filter("p is not null").select("doc_id", F.col("p.line").cast("bigint").alias("line"), F.col("p.col").cast("bigint").alias("col"))


@query("""
SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) <= 1000 AS queried FROM events
""")
def ordered_budget(t: Tables):
    rank = order.file_priority(F.col("event_type") == "error", F.col("event_type") == "purchase")
    return order.ordered_budget(t.events.select("event_id", "event_type", "ts"), 1000, [rank, F.col("ts"), F.col("event_id")]).select("event_id", "queried")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3 AS queried FROM events")
def ordered_budget_per_key(t: Tables):
    return order.ordered_budget(t.events.select("event_id", "user_id", "value"), 3, [F.desc("value"), F.col("event_id")], ["user_id"]).select("event_id", "queried")


@query("""
WITH lagged AS (SELECT *, lag(event_type) OVER w AS before, lag(k) OVER w AS before_k, row_number() OVER w AS n
  FROM (SELECT event_id, user_id, event_type, (props::JSON->>'$.k')::BIGINT % 3 AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_type, event_id))
SELECT event_id, user_id, event_type, k FROM lagged WHERE n = 1 OR event_type <> before OR k IS DISTINCT FROM before_k
""")
def adjacent_dedup(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("k"))
    return order.sorted_adjacent_dedup(rows, ["event_type"], ["event_type", "k"], ["user_id"], "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def full_dedup(t: Tables):
    return order.full_dedup(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def first_seen_order(t: Tables):
    return order.first_seen(t.part, "p_brand", "p_partkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 200")
def priority_top_k(t: Tables):
    return order.prioritised(t.orders.select("o_orderkey", "o_orderpriority"), order.rank_of("o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1}), ["o_orderkey"], 200)


@query("""
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'used' WHEN 'O' THEN 'prunable' ELSE 'kept' END AS decision
FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 3 ELSE 5 END, o_orderkey LIMIT 500
""")
def decision_samples(t: Tables):
    named = F.when(F.col("o_orderstatus") == "F", "used").when(F.col("o_orderstatus") == "O", "prunable").otherwise("kept")
    return order.decision_samples(t.orders.select(F.col("o_orderkey").alias("id"), named.alias("decision")), 500)


@query("""
WITH r AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, any_value(n) AS n, string_agg(c_name, ', ' ORDER BY k) FILTER (k <= 5) || CASE WHEN any_value(n) > 5 THEN ', … ' || (any_value(n) - 5) || ' more' ELSE '' END AS preview FROM r GROUP BY c_nationkey
""")
def capped_preview(t: Tables):
    return order.capped_preview(t.customer.select("c_nationkey", "c_name"), "c_nationkey", "c_name", "c_name")


@query(f"SELECT p_partkey, {fnv('p_name')}::UBIGINT::VARCHAR AS score FROM part")
def fnv_hash(t: Tables):
    return t.part.select("p_partkey", hashing.fnv1a64(F.col("p_name")).cast("string").alias("score"))


@query(f"SELECT c_custkey, lower(lpad(to_hex({fnv('c_name')}::UBIGINT), 16, '0')) AS print FROM customer")
def fnv_fingerprint(t: Tables):
    return t.customer.select("c_custkey", hashing.fingerprint(F.col("c_name")).alias("print"))


@query(f"SELECT p_partkey, score::VARCHAR AS score FROM (SELECT p_partkey, {fnv('p_type', 42)} AS score FROM part) ORDER BY score::HUGEINT, p_partkey LIMIT 100")
def seeded_sample(t: Tables):
    return order.seeded_sample(t.part.select("p_partkey", "p_type"), F.col("p_type"), 42, 100, "p_partkey").select("p_partkey", F.col("score").cast("string").alias("score"))


@query(f"""
WITH s AS (SELECT p_partkey, p_brand, {fnv("p_name || p_partkey", 7)} AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score, p_partkey) AS n FROM s)
SELECT p_partkey, p_brand FROM r ORDER BY CASE WHEN n = 1 AND p_brand = 'Brand#3' THEN 0 WHEN n = 1 AND p_brand = 'Brand#1' THEN 1 ELSE 2 END, score, p_partkey LIMIT 40
""")
def stratified_sample(t: Tables):
    picked = order.stratified_sample(t.part.select("p_partkey", "p_brand", "p_name"), "p_brand", ["Brand#3", "Brand#1"], F.concat("p_name", F.col("p_partkey").cast("string")), 7, 40, "p_partkey")
    return picked.select("p_partkey", "p_brand")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def short_digest(t: Tables):
    return t.documents.select("doc_id", hashing.short_digest(F.col("text")).alias("digest"))


@query("""
WITH RECURSIVE iv AS (SELECT DISTINCT user_id, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('second', ts))::BIGINT + (event_id % 7200) AS b, event_type FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b, event_type) AS n FROM iv),
walk(user_id, n, a, b, event_type, la, lb, took) AS (
  SELECT user_id, n, a, b, event_type, a, b, true FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.a, o.b, o.event_type,
    CASE WHEN o.a < w.lb OR (o.a = w.la AND o.b = w.lb) THEN w.la ELSE o.a END, CASE WHEN o.a < w.lb OR (o.a = w.la AND o.b = w.lb) THEN w.lb ELSE o.b END,
    NOT (o.a < w.lb OR (o.a = w.la AND o.b = w.lb))
  FROM walk w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1
)
SELECT user_id, a AS start, b AS stop, event_type FROM walk WHERE took
""")
def greedy_intervals(t: Tables):
    start = F.unix_timestamp("ts")
    rows = t.events.select("user_id", start.alias("start"), (start + F.col("event_id") % 7200).alias("stop"), "event_type")
    return edits.greedy_intervals(rows, "user_id", "start", "stop", "event_type")


@query("""
SELECT p_partkey AS file, 'big ' || substr(p_name, strpos(p_name, ' ') + 1) || '!' AS text, 2 AS applied FROM part WHERE strpos(p_name, ' ') > 0 AND substr(p_name, 1, strpos(p_name, ' ') - 1) <> 'big'
UNION ALL SELECT p_partkey, p_name || '!', 1 FROM part WHERE strpos(p_name, ' ') > 0 AND substr(p_name, 1, strpos(p_name, ' ') - 1) = 'big'
""")
def applied_edits(t: Tables):
    files = t.part.select(F.col("p_partkey").alias("file"), F.col("p_name").alias("text")).filter("instr(text, ' ') > 0")
    first = files.select("file", F.lit(0).alias("start"), (F.instr("text", " ") - 1).alias("stop"), F.lit("big").alias("replacement"))
    inner = files.select("file", F.lit(0).alias("start"), F.instr("text", " ").alias("stop"), F.lit("never").alias("replacement"))
    last = files.select("file", F.length("text").alias("start"), F.length("text").alias("stop"), F.lit("!").alias("replacement"))
    both = first.unionByName(last)
    # the longer edit at the same start comes after the shorter and is refused, unless the shorter was a no-op
    longer = inner.join(files.filter("substring_index(text, ' ', 1) <> 'big'").select("file"), "file", "left_semi")
    return edits.apply_edits(files, both.unionByName(longer))
