import random
import re

import numpy as np

from wirespark.llm.graph import components
from wirespark.llm.minhash import SetStore, band_keys, least_agreeing, links_among, op10_minhash_dedup, shingle_set, signature


def brute(rows, size, percent):
    def shingles(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted((rows[i][0], len(sets[i]), low[find(i)], low[find(i)] == rows[i][0]) for i in range(len(rows)))


def corpus():
    random.seed(3)
    words = [f"w{i}" for i in range(400)] + ["É", "ß", "Word"]
    out = []
    for g in range(25):
        base = random.choices(words, k=random.choice([4, 30, 120, 200]))
        for _ in range(random.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 22))):
                copy[random.randrange(len(copy))] = random.choice(words)
            out.append(random.choice([" ", "\n"]).join(copy).replace("w1", random.choice(["w1", "W1"])))
    out += [None, "", " \t\n", "one", "ONE", "one two", "One  two", "ß", "x y z", "a b c a b c a b c", "a b c"]
    random.shuffle(out)
    return list(enumerate(out)) + [(5, out[5])]


def test_against_brute_force(spark, tables):
    rows = corpus()
    tables.make("documents", [(i, t, "row", 1) for i, t in rows], "doc_id long, text string, digest string, n int")
    assert sorted(tuple(r) for r in op10_minhash_dedup(spark, tables).collect()) == brute(rows, 3, 85)
    tables.make("documents", [], "doc_id long, text string")
    assert op10_minhash_dedup(spark, tables).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2654435761)
        a, b = np.unique(x[:340]), np.unique(x[60:])
        errors.append((signature(a) == signature(b)).mean() - 280 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert band_keys(np.stack([signature(a), signature(a)])).shape == (2, 32)


def test_members_of_a_band_are_linked_through_others(tmp_path):
    # 1 and 2 are in no component with their head; they are linked with each other
    x = shingle_set(" ".join(f"w{i}" for i in range(100)), 3)
    y = np.unique(np.concatenate([x[:-3], x[:2] + np.uint64(1 << 20)]))
    data = [signature(s).tobytes() + s.tobytes() for s in (x, y)]
    (tmp_path / "s.sets").write_bytes(b"".join(data))
    pointers = [("s", 0, len(x)), ("s", len(data[0]), len(y))]
    sigs = np.stack([signature(x), signature(y)])
    both = [0, 1]
    assert links_among([1, 2], [1, 2], {0}, pointers, sigs, 85, SetStore(str(tmp_path)), both, both) == [(1, 2)]
    assert links_among([1, 2], [1, 1], {0}, pointers, sigs, 85, SetStore(str(tmp_path)), both, both) == []


def test_agreement_that_is_asked_for_is_all_but_certain():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        least = least_agreeing(percent)
        assert 0.4 * 128 < least < 0.7 * 128
        sets = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2654435761)) for _ in range(40)]
        share = [x[: int(len(x) * percent / 100) + 1] for x in sets]  # similarity just over the threshold
        assert min((signature(a) == signature(b)).sum() for a, b in zip(sets, share)) > least


def test_large_groups_and_long_texts(spark, tables):
    random.seed(8)
    words = [f"w{i}" for i in range(5000)]
    base = random.choices(words, k=120)
    rows = [(i, " ".join(base + [f"t{i}"])) for i in range(1500)]  # near copies, more than a task compares at a time
    rows += [(2000 + i, " ".join(base)) for i in range(1500)]  # exact ones
    long = random.choices(words, k=60_000)
    rows += [(9000, " ".join(long)), (9001, " ".join(long[:-9])), (9002, " ".join(reversed(long)))]
    tables.make("documents", rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op10_minhash_dedup(spark, tables).collect()}
    assert got == {i: 0 for i, _ in rows if i < 9000} | {9000: 9000, 9001: 9000, 9002: 9002}


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (205, 201)]
    random.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {x: 100 for x in range(100, 140)} | {200: 200, 201: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_an_id(spark, tables):
    tables.make("documents", [(None, "some words here", "en"), (None, None, None), (1, "some words here", "en")], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in op10_minhash_dedup(spark, tables).collect()) == ["1", "None", "None"]
