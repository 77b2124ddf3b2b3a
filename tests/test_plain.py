"""Registered queries that SQL can't express, against plain Python over the smallest tables."""

import hashlib
import hmac
import json
import math
import os
import re
from collections import Counter, defaultdict

import pytest

from wirespark import plans
from wirespark.functions import encoding
from wirespark.operators import anomaly, classify, streams
from wirespark.plans.packets import packets as packet_table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def run(spark, name):
    return plans.queries()[name](spark, DIR).collect()


def rows(spark, table, *columns):
    return spark.read.parquet(f"{DIR}/{table}.parquet").select(*columns).collect()


@pytest.fixture(scope="module")
def packets(spark):
    return sorted((r.asDict() for r in packet_table(spark, DIR).collect()), key=lambda r: r["packet_id"])


def test_moving_average(spark, packets):
    got = {r.packet_id: r for r in run(spark, "win_ewma")}
    state = {}
    for p in packets:
        n, mean, var = state.get(p["src_ip"], (0, 0.0, 0.0))
        x = float(p["length"])
        odd = n >= 10 and var > 0 and abs(x - mean) / math.sqrt(var) > 3
        mean, var = (x, 0.0) if n == 0 else (mean + 0.1 * (x - mean), 0.9 * (var + 0.1 * (x - mean) ** 2))
        state[p["src_ip"]] = n + 1, mean, var
        r = got[p["packet_id"]]
        assert (r.ema, r.em_var, r.is_anomaly) == (pytest.approx(mean, abs=1e-5), pytest.approx(var, rel=1e-6, abs=1e-4), odd)


def test_vector(spark):
    features = {r.packet_id: r for r in classify.flow_features(classify.scored_samples(packet_table(spark, DIR))).collect()}
    got = run(spark, "cls_vector")
    assert len(got) == len(features) > 0 and len(classify.FLOW_VECTOR) == 38
    for r in got:
        assert r.vector == [features[r.packet_id][n] if n in classify.FLOW_FEATURES else 0.0 for n in classify.FLOW_VECTOR]


def test_packet_features(spark, packets):
    got = {r.packet_id: r for r in run(spark, "cls_packet_features")}
    assert len(got) == len(packets)
    for p in packets:
        r, extra = got[p["packet_id"]], {6: 20, 17: 8}.get(p["ip_proto"], 0)
        payload = b"x" * p["k"] if extra else bytes([8, 0, 0, 0, 0, 1, 0, 1]) + b"x" * p["k"]
        share = [n / len(payload) for n in Counter(payload).values()]
        assert (r.length, r.payload_length, r.ttl) == (34 + extra + len(payload), len(payload), pytest.approx(64 / 255))
        assert r.entropy == pytest.approx(-sum(x * math.log2(x) for x in share), abs=1e-9) and (r.syn, r.ack) == ((0, 1) if p["ip_proto"] == 6 else (None, None))


def test_hash_chain(spark):
    by = defaultdict(list)
    for r in rows(spark, "events", "user_id", "event_id", "event_type"):
        by[r.user_id].append((r.event_id, r.event_type.encode()))
    got = {(r.user_id, r["index"]): r for r in run(spark, "win_hashchain")}
    assert len(got) == sum(map(len, by.values()))
    for user, links in list(by.items())[:20]:
        before = bytes(32)
        for n, (at, data) in enumerate(sorted(links)):
            own = encoding.blake3_many([data])[0]
            before = encoding.chain_hash(n, own, before, at)
            assert (got[user, n].data_hash, got[user, n].chain_hash) == (own.hex(), before.hex())


def test_quic_keys(spark):
    def expand(secret, label, n):
        info = n.to_bytes(2, "big") + bytes([6 + len(label)]) + b"tls13 " + label + b"\0"
        return hmac.new(secret, info + b"\1", hashlib.sha256).digest()[:n]

    salt = bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a")
    for r in run(spark, "fn_hkdf"):
        first = hmac.new(salt, f"{r.event_id:08d}".encode(), hashlib.sha256).digest()
        client = expand(first, b"client in", 32)
        assert r.client_key in (client.hex(), expand(client, b"quic key", 16).hex())


def test_fingerprints(spark):
    got = run(spark, "tls_fingerprints")
    want = "771,4865-4866-4867-49196-49195,0-10-11-13-16-43,29-23,0"  # no GREASE, whether sent or not
    assert {r.ja3 for r in got} == {want} and len({r.ja4 for r in got}) == 1
    assert all(re.fullmatch("t13d0506h2_[0-9a-f]{12}_[0-9a-f]{12}", r.ja4) for r in got)


def test_case(spark, packets):
    by = defaultdict(list)
    for r in run(spark, "snk_case"):
        by[r.kind].append(json.loads(r.json))
    flows = Counter(p["flow_id"] for p in packets)
    assert len(by["flow"]) == len(flows) and sum(x["packets"] for x in by["flow"]) == len(packets) and sum(x["bytes"] for x in by["flow"]) == sum(p["length"] for p in packets)
    assert {x["addressValue"] for x in by["host"]} == {p[k] for p in packets for k in ("src_ip", "dst_ip")}


def test_redaction(spark):
    address = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    text = {r.doc_id: r.text for r in rows(spark, "documents", "doc_id", "text")}
    got = {r.doc_id: r.text for r in run(spark, "pii_redact_text")}
    assert got.keys() == text.keys()
    for i, t in text.items():
        if not re.search(r"[0-9@]", t or ""):
            assert got[i] == t
        for found in address.findall(t or ""):
            assert found not in got[i]


def test_carving(spark):
    pages = rows(spark, "pages", "page_id", "html")
    per, total = defaultdict(list), Counter()
    for r in run(spark, "crv_embedded"):
        per[r.page_id].append(r)
    for p in pages:
        own = {(r.extension, r.start): r for r in per[p.page_id]}
        assert (own[".png", 50].size, own[".png", 50].category) == (len(p.html.encode()) + 16, "image")
        assert len(own) == len({start for _, start in own})  # one for each place
        total.update((f["category"], n) for f in streams.carve(p.html.encode(), True) for n in ["files"] + ["threats"] * f["threat"])
    for r in run(spark, "agg_carver_stats"):
        assert (r.files, r.threats) == (total[r.category, "files"], total[r.category, "threats"])
    data = b"".join(b"ZZ" + bytes([i % 64]) * 200 + b"YY" for i in range(120))
    own = [(".z", "x/z", "5a5a", "5959", 1, "other", False), (".y", "x/y", "5959", "", 1, "other", False)]
    assert [f["start"] for f in streams.carve(data, signatures=own[:1])] == [204 * i for i in range(100)] and len(streams.carve(data, signatures=own, most=10**6)) > 200


def test_reassembly_totals(spark):
    pages = rows(spark, "pages", "html")
    r = run(spark, "agg_reasm_stats")[0]
    assert r.streams == len(pages) and r.packets == sum(2 * max(1, -(-len(p.html.encode()) // 500)) for p in pages)
    assert r.server_bytes + r.client_bytes <= sum(len(p.html.encode()) for p in pages)


def test_alerts(spark):
    got = run(spark, "cls_alerts_lib")
    threats = {r.alert_id: r for r in run(spark, "cls_alerts_gui")}
    assert {r.alert_id for r in got if r.source == "threat"} == threats.keys()
    for r in got:
        assert (r.severity, r.rule_severity) == (("critical", threats[r.alert_id].rule_severity) if r.source == "threat" else ("high", "critical" if r.score > 5 else "high" if r.score > 4 else "medium" if r.score > 3 else "low"))


def test_pipeline(spark, packets):
    got, count, seen = run(spark, "cls_pipeline"), Counter(), set()
    bad = {r.flow_id for r in run(spark, "cls_threat") if r.is_threat}
    for p in packets:
        count[p["flow_id"]] += 1
        if count[p["flow_id"]] > 10:
            seen.add(p["packet_id"])
    assert {r.packet_id for r in got} == seen and all(r.z >= 0 for r in got)
    assert all(r.flow_id in bad for r in got if r.is_threat and r.threat_type != "exfiltration")  # that one goes by bytes so far


#: Fixed values of the public BLAKE3 specification: the start, and the order of words in the next round.
BLAKE3_IV = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
BLAKE3_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]


def plain_blake3(data):
    mask = 0xFFFFFFFF

    def compress(cv, block, counter, size, flags):
        m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
        v = [*cv, *BLAKE3_IV[:4], counter & mask, counter >> 32, size, flags]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
                for x, first, second in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + x) & mask
                    v[d] ^= v[a]
                    v[d] = (v[d] >> first | v[d] << 32 - first) & mask
                    v[c] = (v[c] + v[d]) & mask
                    v[b] ^= v[c]
                    v[b] = (v[b] >> second | v[b] << 32 - second) & mask
            m = [m[i] for i in BLAKE3_ORDER]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def node(part, number, root):
        if len(part) <= 1024:
            cv, blocks = BLAKE3_IV, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for k, block in enumerate(blocks):
                last = k == len(blocks) - 1
                cv = compress(cv, block.ljust(64, b"\0"), number, len(block), (k == 0) + 2 * last + 8 * (last and root))
            return cv
        left = 1024 << ((len(part) - 1) // 1024).bit_length() - 1  # the largest power of two of chunks that leaves some
        children = node(part[:left], number, False) + node(part[left:], number + left // 1024, False)
        return compress(BLAKE3_IV, b"".join(x.to_bytes(4, "little") for x in children), 0, 64, 4 + 8 * root)

    return b"".join(x.to_bytes(4, "little") for x in node(data, 0, True))


def test_blake3(spark):
    want = {r.doc_id: plain_blake3(r.text.encode()).hex() for r in rows(spark, "documents", "doc_id", "text")}
    assert {r.doc_id: r.blake3 for r in run(spark, "fn_blake3")} == want


def test_merkle(spark):
    want = {}
    for r in rows(spark, "documents", "doc_id", "text"):
        data = r.text.encode()
        level = [plain_blake3(data[i : i + 1024]) for i in range(0, max(1, len(data)), 1024)]
        while len(level) > 1:
            level = [plain_blake3(a + b) for a, b in zip(level[::2], [*level[1::2], level[-1]])]
        want[r.doc_id] = level[0].hex()
    assert {r.doc_id: bytes(r.root).hex() if not isinstance(r.root, str) else r.root for r in run(spark, "fn_merkle")} == want


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.vec_id: [float(x) for x in r.embedding] for r in rows(spark, "embeddings", "vec_id", "embedding")}


def forest_scores(spark, vectors, most):
    """Every vector walked down every tree; the trees are those of the query, grown from its sample."""
    dims = [f"x{k}" for k in range(len(next(iter(vectors.values()))))]
    table = spark.createDataFrame([(i, *x) for i, x in vectors.items()], "vec_id long, " + ", ".join(f"{n} double" for n in dims))
    model = anomaly.IsolationForest(anomaly.sampled(table, dims, most, "vec_id"))

    def depth(tree, x, at=0):
        feature, limit, left, right, end = tree[at]
        return end if feature < 0 else depth(tree, x, int(left if x[int(feature)] < limit else right))

    n = model.size
    usual = 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return {i: 2 ** -(sum(depth(t, x) for t in model.trees) / len(model.trees) / usual) for i, x in vectors.items()}


def test_forest(spark, vectors):
    scores = forest_scores(spark, vectors, 4096)
    limit = sorted(scores.values())[min(len(scores) - 1, int(len(scores) * 0.9))]
    got = run(spark, "cls_iforest")
    assert len(got) == len(scores)
    for r in got:
        assert abs(r.score - scores[r.vec_id]) < 1e-6 and (r.is_anomaly == (scores[r.vec_id] > limit) or abs(scores[r.vec_id] - limit) < 1e-9)
    scores = forest_scores(spark, vectors, 2000)
    got = run(spark, "cls_ml")
    assert len(got) == len(scores)
    assert all((r.label, r.confidence) == ("odd" if scores[r.vec_id] >= 0.5 else "ordinary", pytest.approx(max(scores[r.vec_id], 1 - scores[r.vec_id]), abs=1e-6)) for r in got)


def test_ensemble(spark, vectors):
    forest, k = forest_scores(spark, vectors, 2000), 20
    near = {i: sorted((math.dist(x, y), j) for j, y in vectors.items() if j != i)[:k] for i, x in vectors.items()}
    reach = {i: n[-1][0] for i, n in near.items()}
    density = {i: 1 / max(sum(max(d, reach[j]) for d, j in n) / k, 1e-12) for i, n in near.items()}
    width, got = len(next(iter(vectors.values()))), run(spark, "cls_ensemble")
    columns = list(zip(*vectors.values()))
    mean = [sum(c) / len(c) for c in columns]
    std = [math.sqrt(sum((x - m) ** 2 for x in c) / len(c)) for c, m in zip(columns, mean)]
    assert len(got) == len(vectors)
    for r in got:
        i, inner = r.vec_id, near[r.vec_id][: k - 1]  # a row that is scored is its own first neighbour
        own = 1 / max((reach[i] + sum(max(d, reach[j]) for d, j in inner)) / k, 1e-12)
        lof = min(1, max(0, ((density[i] + sum(density[j] for _, j in inner)) / k / own - 1) / 2))
        z = math.sqrt(sum(((x - m) / s) ** 2 for x, m, s in zip(vectors[i], mean, std)) / width)
        score = 0.4 * min(1, z / 3) + 0.35 * forest[i] + 0.25 * lof
        assert r.score == pytest.approx(score, abs=2e-6) and (r.is_anomaly == (score > 0.5) or abs(score - 0.5) < 1e-9)
