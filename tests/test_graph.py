import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attention, graph
from tidewatch.operators.activity import event_clocks
from tidewatch.operators.joins import causal_response, causal_summary

EVENT = (
    "capture_id string, event_id long, timestamp_second long, src_ip string, src_port int, dst_ip string, dst_port int, "
    "protocol string, first_packet_time double, behaviour int"
)
H, K = 5, 2


def make_events(n=160, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        second = int(rng.integers(0, 25))
        rows.append(("c", i, second, f"n{rng.integers(0, 2)}", int(rng.integers(0, 2)), f"n{rng.integers(0, 2)}", int(rng.integers(0, 2)),
                     ["tcp", "udp"][int(rng.integers(0, 2))], second + float(rng.uniform()), int(rng.integers(0, 2))))
    return rows


ROWS = make_events()
SRC, DST = (lambda r: (r[3], r[4])), (lambda r: (r[5], r[6]))
CONNECTION, REVERSE = (lambda r: (SRC(r), DST(r), r[7])), (lambda r: (DST(r), SRC(r), r[7]))


def pools(t, current):
    """All candidates of a target per relation, by looking at every event."""
    def near(e):
        if current:
            return e[2] == t[2] and e[1] != t[1]
        return t[2] - H <= e[2] < t[2] and CONNECTION(e) not in (CONNECTION(t), REVERSE(t))
    rules = [lambda e: SRC(e) == SRC(t), lambda e: DST(e) == DST(t), lambda e: DST(e) == SRC(t), lambda e: SRC(e) == DST(t)]
    return [{e[1] for e in ROWS if near(e) and rule(e)} for rule in rules]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, EVENT)


def test_counts_match_brute_force(events):
    got = {(r["event_id"], r["relation"]): r for r in graph.incident_counts(events, H).collect()}
    for t in ROWS:
        for rel in range(4):
            assert got[(t[1], rel)]["historical_count"] == len(pools(t, False)[rel])
            assert got[(t[1], rel)]["current_count"] == len(pools(t, True)[rel])


@pytest.mark.parametrize("sliced", [False, True])
@pytest.mark.parametrize("current", [False, True])
def test_samples_are_full_valid_and_free_of_repeats(events, request, sliced, current):
    if sliced:
        request.getfixturevalue("many_slices")
    got = {}
    for r in graph.sample_relations(events, K, H, 7, current).collect():
        got.setdefault(r["event_id"], {}).setdefault(r["relation"], []).append(r["neighbor"])
    for t in ROWS:
        taken = set()
        for rel, pool in enumerate(pools(t, current)):
            chosen = got.get(t[1], {}).get(rel, [])
            assert len(chosen) == len(set(chosen)) == min(K, len(pool - taken))
            assert set(chosen) <= pool - taken
            taken |= set(chosen)


def test_samples_are_spread_evenly(spark):
    # One target with 40 candidates, drawn under many seeds.
    rows = [("c", i, 1, "s", 1, f"d{i}", 1, "tcp", 1.0, 0) for i in range(40)] + [("c", 99, 2, "s", 1, "z", 1, "tcp", 2.0, 0)]
    df = spark.createDataFrame(rows, EVENT)
    hits = np.zeros(40)
    for seed in range(30):
        picked = graph.sample_relations(df, 8, H, seed).where("event_id = 99 AND relation = 0").collect()
        assert len(picked) == 8
        hits[[r["neighbor"] for r in picked]] += 1
    assert hits.max() <= 15 and (hits > 0).sum() >= 38  # mean is 6


@pytest.mark.parametrize("sliced", [False, True])
def test_private_chain_and_edge_times(events, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    chain = graph.private_chain(events, H, 3, 2)
    got = {}
    for r in chain.collect():
        got.setdefault(r["event_id"], {}).setdefault(r["side"], set()).add(r["neighbor"])
    for t in ROWS:
        past = lambda key: sorted((e[2], e[1]) for e in ROWS if CONNECTION(e) == key and t[2] - H <= e[2] < t[2])
        own = [i for _, i in past(CONNECTION(t))][-3:]
        reverse = [i for _, i in past(REVERSE(t)) if i not in own][-2:]
        assert got.get(t[1], {}).get("own", set()) == set(own)
        assert got.get(t[1], {}).get("reverse", set()) == set(reverse)
    times = {e[1]: e[8] for e in ROWS}
    for r in graph.edge_dt(chain, events, private=False).collect():
        assert r["dt"] == pytest.approx(np.log1p(abs(times[r["event_id"]] - times[r["neighbor"]])) / np.log(65))
    newest = graph.edge_dt(chain, events, private=True).groupBy("event_id").agg(F.min("dt").alias("m")).collect()
    assert all(r["m"] == 0 for r in newest)


def test_clocks_and_banned_events(events):
    def fold(banned):
        previous, fresh, out = {}, {}, {}
        for e in sorted(ROWS, key=lambda r: (r[8], r[1])):
            key = (e[3], e[5], e[9])
            new = CONNECTION(e) not in previous
            prior = fresh.get(key) if new else previous[CONNECTION(e)]
            out[e[1]] = (new, -1 if prior is None else prior[1], 0.0 if prior is None else e[8] - prior[8])
            if e[1] not in banned:
                previous[CONNECTION(e)] = e
                if new:
                    fresh[key] = e
        return out
    for banned in (set(), set(range(0, 160, 3))):
        condition = F.col("event_id").isin(list(banned)) if banned else None
        expected = fold(banned)
        for r in event_clocks(events, condition).collect():
            new, prior, gap = expected[r["event_id"]]
            assert (r["new_connection"], r["gap_predecessor"]) == (new, prior) and r["gap"] == pytest.approx(gap)


def test_donors_come_from_other_blocks_with_the_same_newness(events):
    data = events.withColumn("x", F.array(F.col("first_packet_time"), F.col("src_port").cast("double")))
    chain, clocks = graph.private_chain(events, H, 3, 2), event_clocks(events)
    armed = {r["event_id"] for r in chain.select("event_id").distinct().collect()}
    new = {r["event_id"]: r["new_connection"] for r in clocks.collect()}
    second = {e[1]: e[2] for e in ROWS}
    low = min(second.values())
    out = graph.donors(data, chain, clocks, "x", 3, choices=4).collect()
    pool = lambda t: {e for e in armed if new[e] == new[t] and (second[e] - low) // 10 != (second[t] - low) // 10}
    assert {r["event_id"] for r in out} == {t for t in armed if pool(t)}
    for r in out:
        assert r["random_donor"]["event_id"] in pool(r["event_id"]) and r["drawn"] == min(5, len(pool(r["event_id"])))
        if r["drawn"] > 1:
            assert r["nearest_donor"]["event_id"] in pool(r["event_id"]) - {r["random_donor"]["event_id"]}


def sparsemax(z):
    s = np.sort(z)[::-1]
    c = np.cumsum(s)
    k = np.arange(1, len(z) + 1)
    n = k[1 + k * s > c].max()
    return np.maximum(0, z - (c[n - 1] - 1) / n)


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_attention_is_exact(spark, spread):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        key = rng.normal(0, spread, 4).round(1) if i % 3 else np.ones(4) * spread  # a third of all keys are equal
        rows.append(("s" if i % 4 else "t", i, [float(x) for x in rng.normal(0, spread, 4)], [float(x) for x in key], float(rng.normal())))
    df = spark.createDataFrame(rows, "scope string, row_id long, query array<double>, key array<double>, null_score double")
    got = {r["row_id"]: r for r in attention.sparse_attention(df, ["scope"], 4, bits=2).collect()}
    assert len(got) == len(rows)
    for scope, i, query, _, null in rows:
        others = np.array([r[3] for r in rows if r[0] == scope and r[1] != i])
        w = sparsemax(np.concatenate([[null], others @ np.array(query) / 2.0]))
        r = got[i]
        assert r["null_weight"] == pytest.approx(w[0], abs=1e-9) and r["support_size"] == int((w[1:] > 1e-12).sum())
        effective = (1 - w[0]) ** 2 / (np.square(w[1:]).sum() + 1e-8)
        assert r["effective_neighbors"] == pytest.approx(effective, rel=1e-6, abs=1e-9)


def test_attention_prunes_pairs(spark):
    # Far apart clusters: a query can only be supported from its own cluster's block.
    rows = [("s", i, [10.0 if i % 2 else -10.0, 1.0], [10.0 if i % 2 else -10.0, (i % 5) / 10.0], 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "scope string, row_id long, query array<double>, key array<double>, null_score double")
    assert attention.scope_pairs(df, ["scope"], 2, bits=1).count() <= 60 * 30


@pytest.mark.parametrize("sliced", [False, True])
def test_causal_response(packet_table, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [
        (1.000, a, b, 1, 2, "tcp", 60, 1), (1.004, b, a, 2, 1, "tcp", 60, 0), (1.020, b, a, 2, 1, "tcp", 60, 0),
        (1.005, b, a, 2, 9, "tcp", 60, 0), (1.006, a, b, 1, 2, "tcp", 60, 0), (0.999, b, a, 2, 1, "tcp", 60, 0)]
    out = causal_response(packet_table(rows), 0.010)
    assert [r["response"] for r in out.orderBy("frame_number").collect()] == [False, True, False, False, False, False]
    assert tuple(causal_summary(out).first()) == (6, 1, 1, 2)


def test_drawn_ranks_are_distinct_and_even(spark):
    n, size, most = 4000, 40, 8
    rows = spark.range(n).select(graph._distinct_ranks(F.lit(size).cast("long"), F.lit(most).cast("long"), 11, F.col("id")).alias("r"))
    drawn = [r["r"] for r in rows.collect()]
    assert all(len(set(d)) == most and set(d) <= set(range(size)) for d in drawn)
    for part in (drawn, [d[:1] for d in drawn]):  # the subset, and the first of its order
        hits = np.bincount([x for d in part for x in d], minlength=size)
        mean = hits.sum() / size
        assert ((hits - mean) ** 2 / mean).sum() < 80  # 39 degrees of freedom: beyond one in ten thousand
