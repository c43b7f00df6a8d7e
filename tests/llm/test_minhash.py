"""Near-duplicates against all pairs."""

import random
import re

import pytest

from tidemill.llm.components import components, joined_components
from tidemill.llm.minhash import FINE, deduplicate, near_duplicates, packed_bits, report, signature
from tidemill.llm.shingles import shingle_sets


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            c = len(sets[a] & sets[b])
            if sets[a] and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def family(n, seed=2):
    """Variants of one text with few or many changed words, exact copies, and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, out = [word() for _ in range(120)], {}
    for i in range(n):
        w = list(base) if i % 5 else [word() for _ in range(100)]
        for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 16])):
            w[rng.randrange(len(w))] = word()
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, docs, k):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in report(docs, k=k).collect()}
    assert got == brute(texts, k)


def test_family_of_near_copies(spark):
    texts = family(400)
    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    got = {r["key"]: (r["n"], r["component"]) for r in near_duplicates(df, 2).collect()}
    assert got == brute(texts, 2)


def test_deduplicate_keeps_one_of_each(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {c for _, c in brute(texts, 5).values()}
    assert {r["doc_id"] for r in deduplicate(docs).collect()} == want


def test_short_and_empty_texts():
    sizes = [len(s) for s in shingle_sets(["", None, "a", "A b", "a B", "a b c", " \n"], 2)]
    assert sizes == [0, 0, 1, 1, 1, 2, 0]
    a, b = list(shingle_sets(["Ä a", "ä a"], 2))
    assert a[0] != b[0]
    x, y = list(shingle_sets(["q" * 600 + "a", "q" * 600 + "b"], 1))
    assert x[0] != y[0]


def test_estimate_is_close(spark):
    rng = random.Random(1)
    common = [str(rng.random()) for _ in range(800)]
    for shared in (0, 400, 720, 800):
        texts = [" ".join(common[:shared] + [str(rng.random()) for _ in range(800 - shared)]) for _ in range(2)]
        a, b = (s for s in shingle_sets(texts, 1))
        pa, pb = (packed_bits(signature(s, FINE)).view("u8") for s in (a, b))
        wrong = sum(bin(((int(x) | int(x) >> 1) & 0x5555555555555555)).count("1") for x in pa ^ pb)
        got = (1 - wrong / FINE - 0.25) / 0.75
        assert abs(got - shared / (1600 - shared)) < 0.08


@pytest.mark.parametrize("name", ["chain", "random", "star", "loop"])
def test_components(spark, name):
    rng = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(40)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)], "star": [(i, 0) for i in range(1, 40)], "loop": [(5, 5)]}[name]

    def brute_components(pairs):
        up = {x: x for e in pairs for x in e}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in pairs)}

    whole = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in whole.collect()} == brute_components(edges)
    h = max(1, len(edges) // 2)
    later = joined_components(components(spark.createDataFrame(edges[:h], "a long, b long")), spark.createDataFrame(edges[h:], "a long, b long"))
    assert {r["id"]: r["component"] for r in later.collect()} == brute_components(edges)
