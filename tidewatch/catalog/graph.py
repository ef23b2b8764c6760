"""Alignment joins, attention and graph incidence."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.catalog.activity import _flows
from tidewatch.catalog.context import MEMBERS
from tidewatch.catalog.registry import ctes, grid, grid_sql, grids, query, recursive_ctes
from tidewatch.operators import attention, context, graph, joins
from tidewatch.operators.activity import event_clocks
from tidewatch.plans.views import SHORT_WINDOW, embedding_flows, packets, table
from tidewatch.session import shared_stage


@query("j1_attached_labels", ctes("packets") + """
SELECT capture_id, frame_number, CASE WHEN protocol = 'tcp' THEN CAST(binary_label AS BIGINT) END AS binary_label, protocol <> 'tcp' AS violation FROM packets""")
def j1_attached_labels(spark, sf):
    rows = packets(spark, sf)
    labels = rows.where("protocol = 'tcp'").select("capture_id", "frame_number", F.col("binary_label").cast("long").alias("binary_label"))
    bare = rows.drop("binary_label")
    missing = joins.label_violations(bare, labels).withColumn("violation", F.lit(True))
    out = joins.attach_labels(bare, labels).join(missing, joins.FRAME, "left")
    return out.select("capture_id", "frame_number", "binary_label", F.coalesce("violation", F.lit(False)).alias("violation"))


@query("j2_aligned_populations", """
SELECT coalesce(d.doc_id, l.k) AS row_id, n_chars, CAST(toxic AS BIGINT) AS toxic,
  CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.k IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM documents d FULL JOIN (SELECT doc_id + 100 AS k, toxic FROM labels) l ON d.doc_id = l.k""")
def j2_aligned_populations(spark, sf):
    scores = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    labels = table(spark, sf, "labels").select((F.col("doc_id") + 100).alias("row_id"), F.col("toxic").cast("long").alias("toxic"))
    return joins.align(scores, labels, ["row_id"])


@query("j3_population_difference", ctes("packets", ("n", "SELECT capture_id, src_ip, dst_ip, protocol, count(*) AS n FROM packets GROUP BY ALL"),
    ("following", "SELECT capture_id AS earlier, lead(capture_id) OVER (ORDER BY capture_id) AS later FROM (SELECT DISTINCT capture_id FROM n) QUALIFY later IS NOT NULL"),
    ("a", "SELECT earlier, later, src_ip, dst_ip, protocol, n FROM following JOIN n ON capture_id = earlier"),
    ("b", "SELECT earlier, later, src_ip, dst_ip, protocol, n FROM following JOIN n ON capture_id = later")) + """
SELECT earlier, later, src_ip, dst_ip, protocol, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus
FROM a FULL JOIN b USING (earlier, later, src_ip, dst_ip, protocol) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def j3_population_difference(spark, sf):
    """Every capture against the one that follows it by name."""
    rows = packets(spark, sf)
    following = rows.select(F.col("capture_id").alias("earlier")).distinct()
    following = following.withColumn("later", F.lead("earlier").over(Window.orderBy("earlier"))).where("later IS NOT NULL")
    side = lambda s: rows.join(following, F.col("capture_id") == F.col(s))
    return joins.population_difference(side("earlier"), side("later"), ["earlier", "later", "src_ip", "dst_ip", "protocol"])


# Ports folded to one number, so that reverse keys occur.
def _folded(rows):
    return rows.withColumns({"src_port": F.col("src_port") % 3, "dst_port": F.col("dst_port") % 3})


def _events(spark, sf):
    flows = _folded(_flows(spark, sf))
    keys = ["capture_id", "timestamp_second", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "behaviour"]
    return flows.groupBy(*keys).agg(F.min("event_id").alias("event_id"), F.min("first_packet_time").alias("first_packet_time"), F.sum("byte_count").alias("byte_count"))


_EVENTS = ("ev", """SELECT capture_id, timestamp_second, src_ip, dst_ip, src_port % 3 AS src_port, dst_port % 3 AS dst_port, protocol, min(event_id) AS event_id,
  min(first_ts) AS first_packet_time, sum(byte_count) AS byte_count FROM sflows GROUP BY ALL""")


@query("j6_reverse_flows", ctes("sflows", _EVENTS) + """
SELECT a.capture_id, a.event_id, b.event_id AS reverse_event_id FROM ev a LEFT JOIN ev b ON b.capture_id = a.capture_id AND b.timestamp_second = a.timestamp_second
  AND b.src_ip = a.dst_ip AND b.dst_ip = a.src_ip AND b.src_port = a.dst_port AND b.dst_port = a.src_port AND b.protocol = a.protocol""")
def j6_reverse_flows(spark, sf):
    return joins.reverse_flows(_events(spark, sf), ["event_id"]).select("capture_id", "event_id", "reverse_event_id")


H = 8
_REL = {0: "p.src = t.src", 1: "p.dst = t.dst", 2: "p.dst = t.src", 3: "p.src = t.dst"}
_ENDS = ("en", """SELECT *, src_ip || ':' || src_port AS src, dst_ip || ':' || dst_port AS dst, src_ip || ':' || src_port || '>' || dst_ip || ':' || dst_port || '>' || protocol AS con,
  dst_ip || ':' || dst_port || '>' || src_ip || ':' || src_port || '>' || protocol AS rev FROM ev""")


@query("j7_incident_counts", ctes("sflows", _EVENTS, _ENDS) + " UNION ALL ".join(f"""
SELECT t.capture_id, t.event_id, CAST({r} AS BIGINT) AS relation, count(*) FILTER (WHERE p.timestamp_second < t.timestamp_second AND p.con <> t.con AND p.con <> t.rev) AS historical_count,
  count(*) FILTER (WHERE p.timestamp_second = t.timestamp_second AND p.event_id <> t.event_id) AS current_count
FROM en t LEFT JOIN en p ON p.capture_id = t.capture_id AND {on} AND p.timestamp_second >= t.timestamp_second - {H * SHORT_WINDOW} AND p.timestamp_second <= t.timestamp_second
GROUP BY t.capture_id, t.event_id""" for r, on in _REL.items()))
def j7_incident_counts(spark, sf):
    out = graph.incident_counts(_events(spark, sf), H, SHORT_WINDOW)
    return out.withColumn("relation", F.col("relation").cast("long"))


_PRIVATE = (("own", f"""SELECT t.capture_id, t.event_id, p.event_id AS neighbor, p.first_packet_time AS nt, row_number() OVER (PARTITION BY t.capture_id, t.event_id ORDER BY p.timestamp_second DESC, p.event_id DESC) AS i
FROM en t JOIN en p ON p.capture_id = t.capture_id AND p.con = t.con AND p.timestamp_second >= t.timestamp_second - {H * SHORT_WINDOW} AND p.timestamp_second < t.timestamp_second"""),
    ("own8", "SELECT * FROM own WHERE i <= 8"), ("revs", f"""
SELECT t.capture_id, t.event_id, p.event_id AS neighbor, p.first_packet_time AS nt, row_number() OVER (PARTITION BY t.capture_id, t.event_id ORDER BY p.timestamp_second DESC, p.event_id DESC) AS i
FROM en t JOIN en p ON p.capture_id = t.capture_id AND p.con = t.rev AND p.timestamp_second >= t.timestamp_second - {H * SHORT_WINDOW} AND p.timestamp_second < t.timestamp_second
LEFT JOIN own8 o ON o.capture_id = t.capture_id AND o.event_id = t.event_id AND o.neighbor = p.event_id WHERE o.neighbor IS NULL"""),
    ("pc", "SELECT capture_id, event_id, 'own' AS side, neighbor, nt FROM own8 UNION ALL SELECT capture_id, event_id, 'reverse', neighbor, nt FROM revs WHERE i <= 4"))


def _private(spark, sf):
    return graph.private_chain(_events(spark, sf), H, 8, 4, SHORT_WINDOW)


@query("j8_private_chain", ctes("sflows", _EVENTS, _ENDS, *_PRIVATE) + "SELECT capture_id, event_id, side, neighbor FROM pc")
def j8_private_chain(spark, sf):
    return _private(spark, sf).select("capture_id", "event_id", "side", "neighbor")


@query("c32_edge_times", ctes("sflows", _EVENTS, _ENDS, *_PRIVATE) + f"""
SELECT capture_id, event_id, neighbor, {grid_sql("ln(1 + max(nt) OVER (PARTITION BY capture_id, event_id) - nt) / ln(65)")} AS dt FROM pc""")
def c32_edge_times(spark, sf):
    edges = graph.edge_dt(_private(spark, sf), None, private=True)
    return edges.select("capture_id", "event_id", "neighbor", grid("dt").alias("dt"))


def _draw_sql(seed, *parts):
    return f"CAST('0x' || substr(md5({" || '|' || ".join([f"'{seed}'", *parts])}), 1, 15) AS BIGINT)"


def _ranks_sql(name, asked, keys, seed, *parts):
    """Tables that draw `most` distinct ranks below `size` for each row of `asked`: `name` has keys, rank and turn."""
    parts = [f"CAST({p} AS VARCHAR)" for p in parts]
    kept = ", ".join(keys)
    candidate = f"{_draw_sql(seed, *parts, 'CAST(j AS VARCHAR)')} % (j + 1)"
    return ((f"{name}_steps", f"""SELECT {kept}, size, size - most AS j, CAST([] AS BIGINT[]) AS chosen FROM {asked} WHERE size > most
UNION ALL SELECT {kept}, size, j + 1, list_append(chosen, CASE WHEN list_contains(chosen, {candidate}) THEN j ELSE {candidate} END) FROM {name}_steps WHERE j < size"""),
            (f"{name}_set", f"""SELECT {kept}, unnest(chosen) AS rank FROM {name}_steps WHERE j = size
UNION ALL SELECT {kept}, unnest(range(size)) FROM {asked} WHERE size > 0 AND size <= most"""),
            (name, f"""SELECT {kept}, rank, row_number() OVER (PARTITION BY {kept} ORDER BY {_draw_sql(seed + 1, *parts, 'CAST(rank AS VARCHAR)')}, rank) - 1 AS turn FROM {name}_set"""))


_K = 4
# Every candidate of a target, relation and time with its place among them; then the draws; then one relation after the other.
_SAMPLES = (("cand", " UNION ALL ".join(f"""
SELECT t.capture_id, t.event_id, {r}::BIGINT AS relation, p.timestamp_second = t.timestamp_second AS now, p.event_id AS neighbor,
  row_number() OVER (PARTITION BY t.capture_id, t.event_id, p.timestamp_second = t.timestamp_second ORDER BY p.timestamp_second, p.event_id) - 1 AS rank
FROM en t JOIN en p ON p.capture_id = t.capture_id AND {on} AND p.timestamp_second >= t.timestamp_second - {H * SHORT_WINDOW} AND p.timestamp_second <= t.timestamp_second
WHERE CASE WHEN p.timestamp_second = t.timestamp_second THEN p.event_id <> t.event_id ELSE p.con <> t.con AND p.con <> t.rev END""" for r, on in _REL.items())),
    ("asked", f"""SELECT capture_id, event_id, relation, now, CASE WHEN now THEN 'c' ELSE 'h' END AS mark, count(*) AS size, (relation + 1) * {_K} AS most FROM cand GROUP BY ALL"""),
    *_ranks_sql("ranks", "asked", ["capture_id", "event_id", "relation", "now", "mark"], 11, "event_id", "relation", "mark"),
    ("e", "SELECT c.*, turn FROM ranks JOIN cand c USING (capture_id, event_id, relation, now, rank)"),
    ("k0", f"SELECT capture_id, event_id, now, relation, neighbor FROM e WHERE relation = 0 AND turn < {_K}"),
    *[(f"k{r}", f"""SELECT * FROM k{r - 1} UNION ALL SELECT capture_id, event_id, now, relation, neighbor FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.capture_id, e.event_id, e.now ORDER BY turn) AS i FROM e LEFT JOIN k{r - 1} k
    ON k.capture_id = e.capture_id AND k.event_id = e.event_id AND k.now = e.now AND k.neighbor = e.neighbor
  WHERE e.relation = {r} AND k.neighbor IS NULL) WHERE i <= {_K}""") for r in (1, 2, 3)])


def _samples(spark, sf):
    events = shared_stage(_events(spark, sf))
    both = [graph.sample_relations(events, _K, H, 11, current=c, slice_seconds=SHORT_WINDOW).withColumn("current", F.lit(c)) for c in (False, True)]
    return both[0].unionByName(both[1]).withColumn("relation", F.col("relation").cast("long"))


@query("c31_relation_sample_sizes", recursive_ctes("sflows", _EVENTS, _ENDS, *_SAMPLES) + """
SELECT capture_id, event_id, relation, now AS current, count(*) AS sampled FROM k3 GROUP BY ALL""")
def c31_relation_sample_sizes(spark, sf):
    return _samples(spark, sf).groupBy("capture_id", "event_id", "relation", "current").agg(F.count("*").alias("sampled"))


@query("c31_relation_sample", recursive_ctes("sflows", _EVENTS, _ENDS, *_SAMPLES) + f"""
SELECT k.capture_id, k.event_id, relation, neighbor, {grid_sql("first_packet_time", 3)} AS neighbor_time, timestamp_second AS neighbor_second, now AS current
FROM k3 k JOIN en p ON p.capture_id = k.capture_id AND p.event_id = k.neighbor""")
def c31_relation_sample(spark, sf):
    return _samples(spark, sf).withColumn("neighbor_time", grid("neighbor_time", 3))


_DONOR_BLOCK = 10 * SHORT_WINDOW
_DONORS = (("clk", """SELECT capture_id, event_id, row_number() OVER (PARTITION BY capture_id, src_ip, dst_ip, src_port, dst_port, protocol ORDER BY first_packet_time, event_id) = 1 AS fresh FROM ev"""),
    ("pool", f"""SELECT ev.capture_id, ev.event_id, fresh, (timestamp_second - (SELECT min(timestamp_second) FROM ev)) // {_DONOR_BLOCK} AS block, ln(1 + byte_count) AS x
FROM ev JOIN clk USING (capture_id, event_id) WHERE (capture_id, event_id) IN (SELECT (capture_id, event_id) FROM pc)"""),
    ("placed", "SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY block, capture_id, event_id) - 1 AS place FROM pool"),
    ("spaced", "SELECT *, min(place) OVER (PARTITION BY fresh, block) AS low, count(*) OVER (PARTITION BY fresh, block) AS width, count(*) OVER (PARTITION BY fresh) AS pool FROM placed"),
    ("want", "SELECT capture_id, event_id, pool - width AS size, 33 AS most FROM spaced WHERE pool > width"),
    *_ranks_sql("ranks", "want", ["capture_id", "event_id"], 3, "capture_id", "event_id"),
    ("drawn", """SELECT capture_id, event_id, turn, fresh, x AS own, CASE WHEN rank < low THEN rank ELSE rank + width END AS place
FROM ranks JOIN spaced USING (capture_id, event_id)"""),
    ("met", """SELECT d.capture_id, d.event_id, turn, p.capture_id AS dc, p.event_id AS de, (own - x) * (own - x) AS distance
FROM drawn d JOIN placed p ON p.fresh = d.fresh AND p.place = d.place"""),
    ("near", "SELECT *, row_number() OVER (PARTITION BY capture_id, event_id ORDER BY turn = 0, distance, turn) AS i FROM met"))


@query("j14_donors", recursive_ctes("sflows", _EVENTS, _ENDS, *_PRIVATE, *_DONORS) + """
SELECT capture_id, event_id, max(dc) FILTER (WHERE turn = 0) AS random_capture, max(de) FILTER (WHERE turn = 0) AS random_event,
  max(dc) FILTER (WHERE turn > 0 AND i = 1) AS nearest_capture, max(de) FILTER (WHERE turn > 0 AND i = 1) AS nearest_event, count(*) AS drawn FROM near GROUP BY ALL""")
def j14_donors(spark, sf):
    events = shared_stage(_events(spark, sf).withColumn("x", F.array(F.log1p("byte_count"))))
    private = graph.private_chain(events, H, 8, 4, SHORT_WINDOW)
    out = graph.donors(events, private, event_clocks(events), "x", 3, 32, _DONOR_BLOCK)
    return out.select("capture_id", "event_id", F.col("random_donor.capture_id").alias("random_capture"), F.col("random_donor.event_id").alias("random_event"),
                      F.col("nearest_donor.capture_id").alias("nearest_capture"), F.col("nearest_donor.event_id").alias("nearest_event"), "drawn")


@query("j11_causal_response", ctes("packets", ("k", """SELECT *, src_port % 3 AS sp, dst_port % 3 AS dp FROM packets"""), ("x", """
SELECT a.frame_number, a.capture_id, CAST(a.binary_label AS BIGINT) AS binary_label, a.binary_label = 0 AND EXISTS (SELECT 1 FROM k p WHERE p.capture_id = a.capture_id AND p.binary_label = 1 AND p.src_ip = a.dst_ip
  AND p.dst_ip = a.src_ip AND p.sp = a.dp AND p.dp = a.sp AND p.protocol = a.protocol AND (p.ts < a.ts OR (p.ts = a.ts AND p.frame_number < a.frame_number)) AND a.ts - p.ts <= 20000) AS response FROM k a""")) + """
SELECT frame_number, capture_id, binary_label, response, CASE WHEN response THEN 1 ELSE binary_label END AS causal_label FROM x""")
def j11_causal_response(spark, sf):
    # Twenty thousand seconds stand in for ten milliseconds on the month-long view.
    out = joins.causal_response(_folded(packets(spark, sf)), 20000.0)
    return out.select("frame_number", "capture_id", F.col("binary_label").cast("long").alias("binary_label"), "response", F.col("causal_label").cast("long").alias("causal_label"))


D = 8


def _attending(spark, sf):
    rows = context.memberships(embedding_flows(spark, sf))
    scaled = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x * 12.0)
    return rows.select("capture_id", "window_index", "entity", "row_id", scaled(1, D).alias("query"), scaled(1 + D, D).alias("key"),
                       (F.col("local_score") / 10).alias("null_score"))


_ATT = (("atx", f"SELECT capture_id, window_index, entity, row_id, list_transform(embedding[1:{D}], lambda x: x * 12.0) AS q, list_transform(embedding[{D + 1}:{2 * D}], lambda x: x * 12.0) AS k, local_score / 10 AS nul FROM m"),
    ("lg", f"""SELECT a.capture_id, a.window_index, a.entity, a.row_id, a.nul, list_dot_product(a.q, b.k) / sqrt({D}.0::DOUBLE) AS z, false AS is_null
FROM atx a JOIN atx b ON b.capture_id = a.capture_id AND b.window_index = a.window_index AND b.entity = a.entity AND b.row_id <> a.row_id"""))


@query("j9_scope_pairs", ctes("eflows", MEMBERS, *_ATT, ("b", """
SELECT *, greatest(nul, max(z) OVER (PARTITION BY capture_id, window_index, entity, row_id)) AS top FROM lg""")) + f"""
SELECT capture_id, window_index, entity, row_id, {grid_sql("z")} AS logit, 1::BIGINT AS copies FROM b WHERE z > top - 1""")
def j9_scope_pairs(spark, sf):
    scope = ["capture_id", "window_index", "entity"]
    pairs = attention.scope_pairs(_attending(spark, sf), scope, D)
    best = pairs.groupBy(*scope, "row_id").agg(F.max("logit").alias("best"))
    kept = pairs.join(best, [*scope, "row_id"]).where(F.col("logit") > F.greatest("null_score", "best") - 1)
    return kept.select(*scope, "row_id", grid("logit").alias("logit"), "copies")


_C10 = ["null_weight", "relevance", "effective_neighbors", "observed_intensity"]


@query("c10_sparse_attention", ctes("eflows", MEMBERS, *_ATT, ("al", """
SELECT capture_id, window_index, entity, row_id, z, is_null FROM lg UNION ALL SELECT capture_id, window_index, entity, row_id, nul, true FROM atx"""), ("sh", """
SELECT *, z - max(z) OVER (PARTITION BY capture_id, window_index, entity, row_id) AS s FROM al"""), ("cu", """
SELECT *, row_number() OVER w AS r, sum(s) OVER w AS c FROM sh WINDOW w AS (PARTITION BY capture_id, window_index, entity, row_id ORDER BY s DESC, is_null ROWS UNBOUNDED PRECEDING)"""), ("ta", """
SELECT capture_id, window_index, entity, row_id, max(r) AS size, arg_max(c, r) AS mass FROM cu WHERE 1 + r * s > c GROUP BY ALL"""), ("we", """
SELECT cu.*, greatest(0, s - (mass - 1) / size) AS w FROM cu JOIN ta USING (capture_id, window_index, entity, row_id)"""), ("ag", """
SELECT capture_id, window_index, entity, row_id, sum(w) FILTER (WHERE is_null) AS null_weight, count(*) FILTER (WHERE w > 0 AND NOT is_null) AS support_size,
  coalesce(sum(w * w) FILTER (WHERE NOT is_null), 0) AS sq FROM we GROUP BY ALL"""), ("fi", """
SELECT *, 1 - null_weight AS relevance, (1 - null_weight) ** 2 / (sq + 1e-8) AS effective_neighbors, ln(1 + (1 - null_weight) * ((1 - null_weight) ** 2 / (sq + 1e-8))) AS observed_intensity FROM ag""")) + f"""
SELECT capture_id, window_index, entity, row_id, support_size, {", ".join(f"{grid_sql(c, 5)} AS {c}" for c in _C10)} FROM fi""")
def c10_sparse_attention(spark, sf):
    scope = ["capture_id", "window_index", "entity"]
    out = attention.sparse_attention(_attending(spark, sf), scope, D)
    return out.select(*scope, "row_id", "support_size", *grids(*_C10, digits=5))
